"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded from
how its characters follow each other and how its words repeat; gated
attention, learned from document labels alone, weighs the passages, and the
weighted mean representation is scored (Ilse, Tomczak and Welling, 2018).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod
from tessera.llm.textbytes import hand_back, released

PASSAGE = 64
#: A bound on the labelled documents that the model is fitted on.
SAMPLE = 4000
THRESHOLD = 0.3
FOLDS = 5
#: Bytes of text that are turned into features at once.
BLOCK = 1 << 20

_CLASS = np.full(256, 10, dtype=np.int64)  # 10: beyond ASCII
_CLASS[:128] = 8  # 8: symbols
for _chars, _k in ((b" \t\x0b\x0c\r", 0), (b"\n", 1), (bytes(range(97, 123)), 2), (bytes(range(65, 91)), 3), (b"0123456789", 4), (b".", 5), (b",", 6), (b"-'\"():;", 7), (b"!?", 9)):
    _CLASS[list(_chars)] = _k
K = 11
FEATURES = K * K + 5
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), base, dtype=np.uint64))])


def _block_features(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(b) + 1 for b in blobs])
    buf = np.frombuffer(b"\n".join(blobs) + b"\n", dtype=np.uint8)
    doc = np.repeat(np.arange(len(blobs)), sizes)
    kind = _CLASS[buf]
    filled = kind > 1
    before = np.concatenate([[False], filled[:-1]])
    starts = np.flatnonzero(filled & ~before)
    ends = np.flatnonzero(~filled & before)
    word_doc = doc[starts]
    first_word = np.searchsorted(word_doc, np.arange(len(blobs)))
    n_words = np.bincount(word_doc, minlength=len(blobs))
    n_pass = np.maximum(1, -(-n_words // PASSAGE))
    first_pass = np.cumsum(n_pass) - n_pass
    total = int(n_pass.sum())
    word_pass = first_pass[word_doc] + (np.arange(len(starts)) - first_word[word_doc]) // PASSAGE
    marks = np.zeros(len(buf), dtype=np.int64)
    byte_pass = first_pass[doc]
    if len(starts):
        step = np.diff(np.concatenate([[0], word_pass - first_pass[word_doc]]))
        new_doc = np.concatenate([[True], word_doc[1:] != word_doc[:-1]])
        marks[starts] = np.where(new_doc, 0, step)
        run = np.cumsum(marks)
        byte_pass = byte_pass + run - run[np.searchsorted(doc, doc)]
    last_kind = np.concatenate([[1], kind[:-1]])  # every text follows a line break
    pairs = np.bincount(byte_pass * (K * K) + last_kind * K + kind, minlength=total * K * K).reshape(total, K * K).astype(np.float32)
    n_bytes = np.maximum(1, pairs.sum(1, keepdims=True))
    x = np.zeros((total, FEATURES), dtype=np.float32)
    x[:, : K * K] = np.sqrt(pairs / n_bytes)
    if len(starts):
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(_R, len(buf)))])
            hashes = (sums[ends] - sums[starts]) * _powers(_R_INV, len(buf))[starts]
            own = (hashes ^ (word_pass.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * _R
        count = np.maximum(1, np.bincount(word_pass, minlength=total))
        same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (word_doc[1:] == word_doc[:-1])])
        order = np.argsort(own)
        fresh = np.concatenate([[True], own[order][1:] != own[order][:-1]])
        x[:, -5] = np.bincount(word_pass, ends - starts, total) / count / 10
        x[:, -4] = np.bincount(word_pass, same, total) / count
        x[:, -3] = np.bincount(word_pass[order[fresh]], minlength=total) / count
        x[:, -2] = np.bincount(word_pass, minlength=total) / PASSAGE
    x[:, -1] = np.log1p(np.bincount(byte_pass, kind == 1, total)) / 4
    return x, n_pass


def bag_features(texts: list[str | None]):
    """Yields (passage features, passages of each text) for consecutive groups of texts; every text has a passage at least."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        blob = (text or "").encode("utf-8", "surrogatepass")
        if group and size + len(blob) > BLOCK:
            yield _block_features(group)
            group, size = [], 0
        group.append(blob)
        size += len(blob) + 1
    if group:
        yield _block_features(group)


def _forward(m: dict[str, np.ndarray], x: np.ndarray, n: np.ndarray):
    at = np.cumsum(n) - n
    z = (x - m["mean"]) / m["scale"]
    h = np.tanh(z @ m["e"] + m["eb"])
    v, u = np.tanh(h @ m["v"]), 1 / (1 + np.exp(-np.clip(h @ m["u"], -30, 30)))
    a = (v * u) @ m["w"]
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, at), n))
    a /= np.repeat(np.add.reduceat(a, at), n)
    bag = np.add.reduceat(a[:, None] * h, at)
    p = 1 / (1 + np.exp(-np.clip(bag @ m["c"] + m["cb"], -30, 30)))
    return z, h, v, u, a, bag, p


def fit(x: np.ndarray, n: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 260, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> dict[str, np.ndarray]:
    """The model for bags ``n`` of passages ``x`` with labels ``y`` in {0, 1}: full-batch Adam on the log loss, in single precision."""
    rng = np.random.default_rng(seed)
    x, y = x.astype(np.float32), y.astype(np.float32)
    m = {
        "mean": x.mean(0), "scale": x.std(0) + 1e-2,
        "e": rng.normal(0, 0.1, (x.shape[1], hidden)), "eb": np.zeros(hidden),
        "v": rng.normal(0, 0.2, (hidden, gate)), "u": rng.normal(0, 0.2, (hidden, gate)), "w": rng.normal(0, 0.2, gate),
        "c": rng.normal(0, 0.2, hidden), "cb": np.zeros(1),
    }
    m = {k: w.astype(np.float32) for k, w in m.items()}
    at = np.cumsum(n) - n
    slots = {k: (np.zeros_like(m[k]), np.zeros_like(m[k])) for k in ("e", "eb", "v", "u", "w", "c", "cb")}
    for epoch in range(1, epochs + 1):
        z, h, v, u, a, bag, p = _forward(m, x, n)
        d = (p - y) / len(y)
        g = {"c": bag.T @ d, "cb": np.array([d.sum()])}
        d_bag = np.repeat(d[:, None] * m["c"], n, axis=0)
        d_a = (d_bag * h).sum(1)
        d_score = a * (d_a - np.repeat(np.add.reduceat(a * d_a, at), n))
        g["w"] = (v * u).T @ d_score
        d_gate = d_score[:, None] * m["w"]
        d_v, d_u = d_gate * u * (1 - v * v), d_gate * v * u * (1 - u)
        g["v"], g["u"] = h.T @ d_v, h.T @ d_u
        d_h = (a[:, None] * d_bag + d_v @ m["v"].T + d_u @ m["u"].T) * (1 - h * h)
        g["e"], g["eb"] = z.T @ d_h, d_h.sum(0)
        for k, (first, second) in slots.items():
            grad = g[k] + decay * m[k]
            first += 0.1 * (grad - first)
            second += 0.001 * (grad * grad - second)
            m[k] = m[k] - rate * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)
    return {k: w.astype(np.float64) for k, w in m.items()}


def predict(m: dict[str, np.ndarray], texts: list[str | None]) -> np.ndarray:
    """Scores 0 to 1; the higher, the likelier label 1."""
    found = [_forward(m, x, n)[-1] for x, n in bag_features(texts)]
    return np.concatenate(found) if found else np.zeros(0)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """The model from at most ``sample`` labelled documents outside the held-out fold, those of the smallest id hash.

    Rows without a label or an id are passed over; of several labels of one id
    the largest counts. With no labelled document at all the model scores every text 0.5; with one class only, near it.
    """
    marks = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null").where(crc_mod("k", FOLDS) != 0)
    chosen = marks.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(sample)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(F.broadcast(chosen), "k").select("k", "y", "t")

    def encode(batches):
        for batch in batches:
            at = 0
            keys, marks = batch.column(0), batch.column(1)
            for x, n in bag_features(batch.column(2).to_pylist()):
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, len(n)), marks.slice(at, len(n)), pa.array([x[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)], pa.binary())], names=["k", "y", "x"]
                )
                at += len(n)

    got = rows.mapInArrow(encode, "k long, y int, x binary").toArrow().sort_by([("k", "ascending")])
    if not got.num_rows:
        zero = fit(np.zeros((1, FEATURES)), np.array([1]), np.array([0.5]), epochs=1)
        return zero | {"c": zero["c"] * 0, "cb": np.zeros(1)}
    bags = [np.frombuffer(b, dtype=np.float32).reshape(-1, FEATURES) for b in got["x"].to_pylist()]
    model = fit(np.concatenate(bags), np.array([len(b) for b in bags]), got["y"].to_numpy().astype(np.float64))
    del bags, got
    hand_back()
    return model


def score_quality(df: DataFrame, model: dict[str, np.ndarray], text: str = "text", column: str = "score") -> DataFrame:
    """``df`` with ``column``: the score of every whole text, a null or empty one too; a column of that name is replaced."""
    df = df.drop(column)
    names = df.columns
    at = names.index(text)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(predict(model, part.column(at).to_pylist()))], names=[*names, column])

    return df.mapInArrow(lambda batches: released(run(batches)), ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"`{column}` double"]))
