"""Line dedup over a range-partitioned, sorted table of line hashes.

Long lines become rows (128-bit hash, document, position), range-partitioned
by all of these, so that a line held by a third of all documents spans many
partitions, and sorted inside a partition: hash, then document from the
largest down, then position. One pass streams each partition and keeps the
first document of a hash; a run that crosses partition borders is completed
from a summary of two rows a partition. What comes back is a compressed bitmap
a document that loses lines, never a text; the bitmaps go to the documents,
whose texts stay where they are as long as the bitmaps of all are small.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BLANKS, cut, free, let_go, partitions

MIN_CHARS = 40
MIN_DOCUMENTS = 5
#: Bytes of bitmaps, with their keys, that are sent to every executor; more of them meet the documents in a shuffle.
SENT = 32_000_000


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def long_lines(df: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows (h1, h2, doc, rid, pos) of the lines with a key of at least ``min_chars`` code points. df: doc, rid, text."""

    def hashed(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            docs, rids, texts = (batch.column(i) for i in range(3))
            for at in range(0, len(docs), 512):
                found, n, pos = [], [], []
                for text in texts.slice(at, 512).to_pylist():
                    before = len(found)
                    if text and len(text) >= min_chars:
                        for k, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
                            if len(line) >= min_chars:
                                key = line_key(line)
                                if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
                                    found.append(digest(key))
                                    pos.append(k)
                    n.append(len(found) - before)
                h = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
                index = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), docs.slice(at, 512).take(index), rids.slice(at, 512).take(index), pa.array(np.array(pos, dtype=np.int32))],
                    names=["h1", "h2", "doc", "rid", "pos"],
                )

    return df.select("doc", "rid", "text").mapInArrow(hashed, "h1 long, h2 long, doc long, rid long, pos int")


def _groups(batches):
    """Sorted columns (h1, h2, doc, rid, pos), split so that a hash's rows are together or follow each other."""
    for batch in batches:
        if batch.num_rows:
            yield [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]


def _edges(columns) -> tuple[np.ndarray, np.ndarray]:
    """Where a new hash begins, and where a new document of a hash begins."""
    h1, h2, doc = columns[:3]
    same = np.zeros(len(h1), dtype=bool)
    same[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
    again = same.copy()
    again[1:] &= doc[1:] == doc[:-1]
    return ~same, ~again


def _summary(batches):
    """Of a partition: first and last hash, the documents in each, and the border documents."""
    part = TaskContext.get().partitionId()
    first = last = None
    for columns in _groups(batches):
        h1, h2, doc = columns[:3]
        new, fresh = _edges(columns)
        at = np.flatnonzero(new)
        n = np.add.reduceat(fresh.astype(np.int64), at)
        for i in sorted({0, len(at) - 1}):  # only border runs of a batch can be border runs of the partition
            a, b = at[i], (at[i + 1] if i + 1 < len(at) else len(h1)) - 1
            run = [int(h1[a]), int(h2[a]), int(n[i]), int(doc[a]), int(doc[b])]
            if last is not None and last[:2] == run[:2]:
                last[2] += run[2] - (last[4] == run[3])
                last[4] = run[4]
            else:
                last = run
                if first is None:
                    first = last
    if first is not None:
        yield pa.RecordBatch.from_pylist([{"part": part, "k": k, "h1": r[0], "h2": r[1], "n": r[2], "d0": r[3], "d1": r[4]} for k, r in enumerate([first, last])], schema=pa.schema([("part", pa.int32()), ("k", pa.int32()), *((c, pa.int64()) for c in ("h1", "h2", "n", "d0", "d1"))]))


def _border(rows: list) -> dict[int, tuple]:
    """For each partition: (documents of its first hash before it, its owner and last document), (documents of its last hash after it)."""
    ends = {}
    for r in rows:
        ends.setdefault(r["part"], {})[r["k"]] = r
    order = sorted(ends)
    before: dict[int, tuple] = {}
    carried = None  # hash, documents so far, owner, last document
    for p in order:
        a, b = ends[p][0], ends[p][1]
        if carried and carried[0] == (a["h1"], a["h2"]):
            before[p] = carried[1:]
            n, owner = carried[1] + a["n"] - (carried[3] == a["d0"]), carried[2]
        else:
            n, owner = a["n"], a["d0"]
        if (a["h1"], a["h2"]) != (b["h1"], b["h2"]):
            n, owner = b["n"], b["d0"]
        carried = ((b["h1"], b["h2"]), n, owner, b["d1"])
    after: dict[int, int] = {}
    follow = None  # hash, documents from here on, first document
    for p in reversed(order):
        a, b = ends[p][0], ends[p][1]
        if follow and follow[0] == (b["h1"], b["h2"]):
            after[p] = follow[1] - (follow[2] == b["d1"])
            n = b["n"] + after[p]
        else:
            n = b["n"]
        if (a["h1"], a["h2"]) != (b["h1"], b["h2"]):
            n = a["n"]
        follow = ((a["h1"], a["h2"]), n, a["d0"])
    return {p: (before.get(p), after.get(p, 0)) for p in order}


def _decide(border: dict[int, tuple], min_documents: int):
    """Streams a sorted partition and yields (doc, rid, pos) of the lines that go."""

    def run(batches):
        before, after = border.get(TaskContext.get().partitionId(), (None, 0))
        key = owner = last_doc = None
        count, held = 0, []  # of the hash that may go on; held: rows that wait for its count

        def out(parts):
            doc, rid, pos = (np.concatenate([p[i] for p in parts]) for i in range(3))
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(rid), pa.array(pos.astype(np.int32))], names=["doc", "rid", "pos"])

        for columns in _groups(batches):
            h1, h2, doc, rid, pos = columns
            new, fresh = _edges(columns)
            at = np.flatnonzero(new)
            n = np.add.reduceat(fresh.astype(np.int64), at)
            owners, gone = doc[at].copy(), []
            first_key = (int(h1[0]), int(h2[0]))
            if key is None and before is not None:
                key, count, owner, last_doc = first_key, *before
            if key == first_key:
                owners[0] = owner
                n[0] += count - (last_doc == doc[0])
                if held and n[0] >= min_documents:
                    gone, held = held, []
            if key != first_key or len(at) > 1:  # the hash they waited for is over
                held = []
            run_of = np.cumsum(new) - 1
            key, count, owner, last_doc = (int(h1[-1]), int(h2[-1])), int(n[-1]), owners[-1], doc[-1]
            open_rows = run_of == len(at) - 1
            loses = doc != owners[run_of]
            sure = loses & (n[run_of] >= min_documents)
            if sure.any():
                gone.append((doc[sure], rid[sure], pos[sure]))
            waits = loses & open_rows & ~sure
            if waits.any():
                held = [*held, (doc[waits], rid[waits], pos[waits])]
            if gone:
                yield out(gone)
        if held and count + after >= min_documents:
            yield out(held)

    return run


def dropped_lines(df: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc, rid, pos) of every line that goes. df: doc, rid, text, with no null in doc."""
    parts = max(partitions(df.sparkSession), 8)
    found = cut(long_lines(df, min_chars))  # the ranges are found from a sample of these rows, not of texts hashed again
    order = (F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("pos"))
    rows = cut(found.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    let_go(found)
    border = _border(rows.mapInArrow(_summary, "part int, k int, h1 long, h2 long, n long, d0 long, d1 long").collect())  # two rows a partition
    return rows.mapInArrow(_decide(border, min_documents), "doc long, rid long, pos int")


def packed(positions) -> bytes:
    """The compressed bitmap that drops ``positions``: bit i, from the lowest of byte 0 on, tells whether line i stays; lines beyond it stay."""
    stays = np.ones(max(positions) // 8 * 8 + 8, dtype=bool)  # whole bytes
    stays[list(positions)] = False
    return zlib.compress(np.packbits(stays, bitorder="little").tobytes(), 1)


def unpacked(bitmap: bytes | None, n: int) -> np.ndarray:
    """Which of ``n`` lines a bitmap keeps."""
    stays = np.ones(n, dtype=bool)
    if bitmap:
        raw = np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8)
        bits = np.unpackbits(raw, bitorder="little", count=min(n, 8 * len(raw)))
        stays[: len(bits)] = bits
    return stays


def keep_bitmaps(df: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc, rid, n_dropped, keep_bitmap) of the documents that lose lines. df: doc, rid, text, with no null in doc."""

    def pack(batches):
        for batch in batches:
            maps = [packed(p) for p in batch.column(2).to_pylist()]
            sizes = [len(p) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary())], names=["doc", "rid", "n_dropped", "keep_bitmap"])

    gone = dropped_lines(df, min_chars, min_documents).groupBy("doc", "rid").agg(F.collect_set("pos").alias("gone"))
    return gone.mapInArrow(pack, "doc long, rid long, n_dropped long, keep_bitmap binary")


def _numbered(df: DataFrame, key: str, text: str, doc: str, rid: str) -> DataFrame:
    return df.withColumn(doc, F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(2**63)))).withColumn(rid, F.xxhash64(F.col(f"`{text}`").cast("string")))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, sent: int = SENT) -> DataFrame:
    r"""``df`` with lines removed from ``text``, and n_lines, n_dropped, keep_bitmap.

    A line's key is the line without ASCII white space at its ends, A-Z
    lower-cased. Keys of at least ``min_chars`` code points that at least
    ``min_documents`` documents hold lose all their lines but those in the
    largest document id. keep_bitmap is zlib-compressed: bit i, from the lowest
    of byte 0 on, tells whether line i stays, lines beyond it stay; it is null
    where no line goes. A null or empty text is one empty line and comes back
    as the empty text; a document whose lines all go keeps its row. A null id
    counts as one document, the smallest of all; rows that repeat an id are
    one document for the count, each row keeping its own lines. Other columns
    pass through, whatever they are named; a column named like an added one is
    replaced. An empty table gives an empty one.
    """
    docs = df.drop("n_lines", "n_dropped", "keep_bitmap")
    names = docs.columns
    doc, rid, bitmap = free(names, "doc__", "rid__", "bitmap__")
    docs = _numbered(docs, key, text, doc, rid)
    bitmaps = cut(keep_bitmaps(docs.select(F.col(doc).alias("doc"), F.col(rid).alias("rid"), F.col(f"`{text}`").cast("string").alias("text")), min_chars, min_documents))
    size = bitmaps.agg(F.coalesce(F.sum(F.octet_length("keep_bitmap") + 24), F.lit(0))).first()[0]
    bitmaps = bitmaps.select(F.col("doc").alias(doc), F.col("rid").alias(rid), F.col("keep_bitmap").alias(bitmap))
    joined = docs.join(F.broadcast(bitmaps) if size <= sent else bitmaps.hint("shuffle_hash"), [doc, rid], "left").select(*(F.col(f"`{c}`") for c in names), bitmap)
    at = names.index(text)

    def keep(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):  # bounds what very long texts hold at once
                part = batch.slice(start, 1024)
                kept, n_lines, n_gone = [], [], []
                for value, marks in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist(), strict=True):
                    value = value or ""
                    n = value.count("\n") + 1
                    if marks:
                        stays = unpacked(marks, n)
                        value = "\n".join(x for x, s in zip(value.split("\n"), stays, strict=True) if s)
                        n_gone.append(int(n - stays.sum()))
                    else:
                        n_gone.append(0)
                    kept.append(value)
                    n_lines.append(n)
                columns = list(part.columns)
                columns[at] = pa.array(kept, pa.string())
                yield pa.RecordBatch.from_arrays([*columns[:-1], pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64()), columns[-1]], names=[*names, "n_lines", "n_dropped", "keep_bitmap"])

    schema = ", ".join(f"`{c}` {'string' if c == text else t}" for c, t in docs.select(*(F.col(f"`{c}`") for c in names)).dtypes)
    return joined.mapInArrow(keep, f"{schema}, n_lines long, n_dropped long, keep_bitmap binary")


def apply_bitmap(text: str | None, bitmap: bytes | None) -> str:
    """The lines of ``text`` that ``bitmap`` keeps."""
    lines = (text or "").split("\n")
    return "\n".join(x for x, s in zip(lines, unpacked(bitmap, len(lines)), strict=True) if s)
