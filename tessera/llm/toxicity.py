"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w.x), with one weight vector w for all
thresholds (proportional odds). x marks the words of a text and the word
stems (first letters) among a selected, bounded vocabulary. The score is the
expected grade, the sum of P(grade > k).
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod
from tessera.llm.textbytes import hand_back

#: Bounds on the labelled documents of the fit, and on the features kept.
SAMPLE = 6000
VOCABULARY = 4000
GRADES = 4
FOLDS = 5
STEMS = (4, 5, 6)
MEMO = 300_000
#: Least log-likelihood ratio of a feature; chance alone reaches it about once in 20,000 terms.
EVIDENCE = 8.0
LETTERS = re.compile(r"[^\W\d_]+")


def terms(word: str) -> list[str]:
    """A word's features: itself and its stems."""
    return [word, *(f"{word[:n]}+" for n in STEMS if len(word) >= n)]


def text_words(text: str | None) -> Counter:
    return Counter(LETTERS.findall((text or "").lower()))


class Vocabulary:
    """Texts as sorted feature numbers; words are looked up once and remembered within a bound."""

    def __init__(self, names: list[str]):
        self.index = {name: i for i, name in enumerate(names)}
        self.memo: dict[str, tuple[int, ...]] = {}

    def rows(self, text: str | None) -> np.ndarray:
        return self.of_words(set(LETTERS.findall((text or "").lower())))

    def of_words(self, words) -> np.ndarray:
        memo, index, out = self.memo, self.index, set()
        if len(memo) > MEMO:
            memo.clear()
        for word in words:
            found = memo.get(word)
            if found is None:
                found = memo[word] = tuple(index[t] for t in terms(word) if t in index)
            out.update(found)
        return np.array(sorted(out), dtype=np.int64)


def select(bags: list[set[str]], toxic: np.ndarray, size: int = VOCABULARY, least: int = 4) -> tuple[list[str], dict[str, float]]:
    """The ``size`` terms whose presence tells most of the label, by the log-likelihood ratio; and each one's log-odds."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for bag, y in zip(bags, toxic, strict=True):
        seen[int(y)].update({t for word in bag for t in terms(word)})
    n0, n1 = max(1, int((toxic == 0).sum())), max(1, int((toxic == 1).sum()))
    gains, odds = {}, {}
    for t in {*seen[0], *seen[1]}:
        a, b = seen[1][t], seen[0][t]
        if a + b < least:
            continue
        p, p1, p0 = (a + b + 1) / (n0 + n1 + 2), (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
        gains[t] = a * np.log(p1 / p) + b * np.log(p0 / p) + (n1 - a) * np.log((1 - p1) / (1 - p)) + (n0 - b) * np.log((1 - p0) / (1 - p))
        odds[t] = float(np.log(p1 / (1 - p1)) - np.log(p0 / (1 - p0)))
    names = sorted((t for t in gains if gains[t] >= EVIDENCE), key=lambda t: (-gains[t], t))[:size]
    return names, {t: odds[t] for t in names}


def graded(bags: list[set[str]], toxic: np.ndarray, odds: dict[str, float], grades: int = GRADES) -> np.ndarray:
    """Severity grades where labels only say toxic or not.

    A clean document has grade 0. Toxic ones get grades 1 to ``grades - 1`` by
    equal shares of how many different marked words they hold (words with a
    term whose log-odds exceed 3), the most the highest; ties go to one grade.
    """
    out = np.zeros(len(bags), dtype=np.int64)
    at = np.flatnonzero(toxic == 1)
    if not len(at):
        return out
    marked = np.array([sum(any(odds.get(t, 0) > 3 for t in terms(w)) for w in bags[i]) for i in at])
    edges = np.quantile(marked, np.arange(1, grades - 1) / (grades - 1)) if grades > 2 else np.array([])
    out[at] = 1 + np.searchsorted(edges, marked, side="left")
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[np.ndarray], y: np.ndarray, size: int, grades: int, epochs: int = 400, rate: float = 0.05, ridge: float = 2e-4, sparse: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by full-batch Adam on the ordinal likelihood, with a shrinkage step towards zero."""
    n = np.array([len(r) for r in rows])
    columns, owner = np.concatenate([*rows, np.zeros(0, dtype=np.int64)]), np.repeat(np.arange(len(rows)), n)
    w, first = np.zeros(size), np.array([1.0])
    gaps = np.zeros(grades - 2)
    state = [(np.zeros_like(v), np.zeros_like(v)) for v in (w, first, gaps)]
    for epoch in range(1, epochs + 1):
        cuts = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        s = np.bincount(owner, w[columns], minlength=len(rows))
        upper, lower = np.concatenate([cuts, [np.inf]])[y], np.concatenate([[-np.inf], cuts])[y]
        a, b = np.where(np.isinf(upper), 1.0, _sigmoid(upper - s)), np.where(np.isinf(lower), 0.0, _sigmoid(lower - s))
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        d_s = (da - db) / len(y)
        d_cuts = np.zeros(grades + 1)
        np.add.at(d_cuts, y + 1, -da / len(y))
        np.add.at(d_cuts, y, db / len(y))
        d_cuts = d_cuts[1:grades]
        tail = np.cumsum(d_cuts[::-1])[::-1]
        grads = (np.bincount(columns, d_s[owner], minlength=size) + ridge * w, tail[:1], tail[1:] * np.exp(gaps))
        for value, grad, (m1, m2) in zip((w, first, gaps), grads, state, strict=True):
            m1 += 0.1 * (grad - m1)
            m2 += 0.001 * (grad * grad - m2)
            value -= rate * (m1 / (1 - 0.9**epoch)) / (np.sqrt(m2 / (1 - 0.999**epoch)) + 1e-8)
        w[:] = np.sign(w) * np.maximum(0, np.abs(w) - rate * sparse * 10)
    return w, np.concatenate([first, first + np.cumsum(np.exp(gaps))])


def train(texts: list[str | None], labels: np.ndarray, grades: int | None = None, size: int = VOCABULARY) -> dict:
    """A model from texts and labels: 0/1 labels are graded first, labels with more values are the grades."""
    return train_words([set(text_words(t)) for t in texts], labels, grades, size)


def train_words(bags: list[set[str]], labels: np.ndarray, grades: int | None = None, size: int = VOCABULARY) -> dict:
    """train() from each text's distinct words."""
    labels = np.asarray(labels, dtype=np.int64)
    names, odds = select(bags, (labels > 0).astype(np.int64), size)
    binary = labels.max(initial=0) <= 1
    y = graded(bags, labels, odds, grades or GRADES) if binary else labels
    k = (grades or GRADES) if binary else int(labels.max()) + 1
    vocabulary = Vocabulary(names)
    w, cuts = fit([vocabulary.of_words(bag) for bag in bags], y, len(names), k)
    keep = np.abs(w) > 1e-4
    return {"names": [x for x, s in zip(names, keep, strict=True) if s], "w": w[keep], "cuts": cuts}


def predict(model: dict, texts: list[str | None], vocabulary: Vocabulary | None = None) -> np.ndarray:
    """P(grade > k) for each text and threshold k."""
    vocabulary = vocabulary or Vocabulary(model["names"])
    s = np.array([model["w"][vocabulary.rows(t)].sum() for t in texts])
    return _sigmoid(s[:, None] - model["cuts"][None, :])


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> dict:
    """The model from at most ``sample`` labelled documents outside the held-out fold, those of the smallest id hash.

    Each of its documents comes to the driver as its distinct words, never as
    its text. Of several labels of one id the largest counts. Without labelled documents
    every text gets one small severity.
    """
    marks = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null").where(crc_mod("k", FOLDS) != 0)
    chosen = marks.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(sample)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(F.broadcast(chosen), "k").select("k", "y", "t")

    def words(batches):
        for batch in batches:
            bags = [" ".join(sorted(set(LETTERS.findall((t or "").lower())))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.string())], names=["k", "y", "words"])

    got = rows.mapInArrow(words, "k long, y int, words string").toArrow().sort_by([("k", "ascending"), ("words", "ascending")])
    if not got.num_rows:
        return {"names": [], "w": np.zeros(0), "cuts": np.arange(3.0, 3.0 + GRADES - 1)}
    model = train_words([set(w.split()) for w in got["words"].to_pylist()], got["y"].to_numpy())
    del got
    hand_back()
    return model


def grade(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``df`` with severity (expected grade), grade (the likeliest by medians) and is_toxic (P(grade > 0) at least a half).

    The whole text counts. A null or empty text has the severity of no word at
    all. Repeated rows stay; columns named like an added one are replaced.
    """
    df = df.drop("severity", "grade", "is_toxic")
    names = df.columns
    at = names.index(text)

    def run(batches):
        vocabulary = Vocabulary(model["names"])
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                p = predict(model, part.column(at).to_pylist(), vocabulary)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1).astype(np.int32)), pa.array(p[:, 0] >= 0.5)], names=[*names, "severity", "grade", "is_toxic"])

    return df.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), "severity double", "grade int", "is_toxic boolean"]))
