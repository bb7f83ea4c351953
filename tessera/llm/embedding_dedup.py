"""Near-duplicates of embeddings by p-stable hashing and exact cosine checks.

Unit vectors are projected on Gaussian directions and the projections are cut
into cells of one width (Datar et al., 2004); several projections make a
bucket, several independent buckets (tables) make a missed pair unlikely. The
vectors of each bucket with company are compared exactly, as blocks of a
matrix product. All projections are integers, so that a vector's buckets are
the same wherever they are computed.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, let_go, mix64, partitions
from tessera.llm.graph import components, spread_join
from tessera.llm.streams import grouped

THRESHOLD = 0.95
#: Cell width in units of the distance between unit vectors.
WIDTH = 2.0
#: Chance that all tables miss a pair just at the threshold.
MISS = 0.001
#: Numbers of crowded buckets that are sent to every executor (16 bytes each); more of them meet the vectors in a shuffle.
SENT = 1_000_000
#: Buckets of so many vectors are remembered by a task.
MEMO = 40_000
#: Rows of a bucket that one task compares with as many others.
TILE = 1024


def collide(distance: float, width: float = WIDTH) -> float:
    """Chance that one projection puts two points at ``distance`` into one cell."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(n: int, threshold: float = THRESHOLD, width: float = WIDTH, miss: float = MISS) -> tuple[int, int]:
    """Projections a table, and tables, for ``n`` vectors.

    Unrelated (orthogonal) vectors should rarely meet: a sixteenth of a stranger
    in a bucket on average, so projections grow with log n. Tables follow from
    ``miss``.
    """
    near, far = collide(math.sqrt(2 - 2 * threshold), width), collide(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(16 * max(n, 2)) / -math.log(far)))
    return k, math.ceil(math.log(miss) / math.log(1 - near**k))


class Tables:
    def __init__(self, k: int, tables: int, width: float = WIDTH, seed: int = 11):
        self.k, self.tables, self.width, self.seed = k, tables, width, seed
        self.by_size: dict[int, tuple] = {}

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """One 64-bit bucket number for each row and table."""
        dim = unit.shape[1]
        if dim not in self.by_size:
            rng = np.random.default_rng([self.seed, dim])
            a = np.rint(rng.normal(size=(dim, self.tables * self.k)) * 1024)
            shift = rng.random(self.tables * self.k)
            odd = rng.integers(0, 1 << 62, self.tables * self.k, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            salt = mix64(np.arange(self.tables, dtype=np.uint64) + np.uint64(dim << 32))
            self.by_size[dim] = a, shift, odd, salt
        a, shift, odd, salt = self.by_size[dim]
        whole = np.rint(unit * 32768) @ a  # exact: integers below 2**53
        whole *= 1 / (self.width * 32768 * 1024)
        whole += shift
        cells = np.floor(whole, out=whole).astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            cells *= odd
            return mix64(cells.reshape(len(unit), self.tables, self.k).sum(axis=2, dtype=np.uint64) ^ salt)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = np.ascontiguousarray(x, dtype=np.float64)
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(big > 0, big, 1)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_size(column: pa.Array, dtype) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector in a column of bytes."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    width = np.dtype(dtype).itemsize
    ends = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1] // width
    flat = np.frombuffer(array.buffers()[2], dtype=dtype) if len(array) else np.zeros(0, dtype=dtype)
    size = np.diff(ends)
    out = []
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        out.append((rows, flat[ends[rows][:, None] + np.arange(dim)]))
    return out


def vector_classes(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, str]:
    """Rows (vec_id, cls, vec): the vector's bytes, and a digest of them, null where the vector links with nothing."""
    wide = "double" in dict(df.dtypes)[vector]
    dtype = np.float64 if wide else np.float32

    def encode(batches):
        for batch in batches:
            lists = batch.column(1)
            begin, end = lists.offsets.to_numpy()[:-1], lists.offsets.to_numpy()[1:]
            flat = lists.values.to_numpy(zero_copy_only=False).astype(dtype) + dtype(0)  # a null is NaN, -0 becomes 0
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            filled = np.concatenate([[0], np.cumsum(flat != 0)])
            ok = (bad[end] == bad[begin]) & (filled[end] > filled[begin]) & lists.is_valid().to_numpy(zero_copy_only=False)
            raw = flat.tobytes()
            blobs = [raw[a:b] if k else None for a, b, k in zip((begin * flat.itemsize).tolist(), (end * flat.itemsize).tolist(), ok.tolist(), strict=True)]
            digests = [x and hashlib.blake2b(x, digest_size=12).digest() for x in blobs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(blobs, pa.binary())], names=["vec_id", "cls", "vec"])

    rows = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>" if wide else "array<float>").alias("v"))
    return rows.mapInArrow(encode, "vec_id long, cls binary, vec binary"), np.dtype(dtype).str


def _memberships(classes: DataFrame, tables: Tables, dtype: str) -> DataFrame:
    """(bucket, place, id): each class in its bucket of each table; place numbers the tables."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                for rows, vectors in _by_size(part.column(1), dtype):
                    b = tables.buckets(unit_rows(vectors))
                    ids = part.column(0).take(pa.array(np.repeat(rows, tables.tables)))
                    place = np.tile(np.arange(tables.tables, dtype=np.int32), len(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(b.view(np.int64).ravel()), pa.array(place), ids], names=["bucket", "place", "id"])

    return classes.select("id", "vec").mapInArrow(run, "bucket long, place int, id long")


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _compare(tables: Tables, threshold: float, dtype: str):
    """Sorted rows (bucket, ta, tb, side, id, vec, n) to (id, links, root): links a row found, and a linked row of its own."""

    def run(batches):
        known: dict[int, np.ndarray] = {}  # a vector with links meets them in many tables
        for table in grouped(batches, 3, 4096):
            bucket, ta, tb, side, ids, n = (table.column(i).to_numpy().astype(np.int64) for i in (0, 1, 2, 3, 4, 6))
            sized = _by_size(table.column(5), dtype)
            size = np.zeros(len(bucket), dtype=np.int64)
            for rows, vectors in sized:
                size[rows] = vectors.shape[1]
            new = np.ones(len(bucket), dtype=bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(bucket))
            units = {vectors.shape[1]: (rows, unit_rows(vectors)) for rows, vectors in sized}
            left, right = [], []
            for dim, (own, vectors) in units.items():
                unit = vectors
                if len(units) > 1:  # a bucket of several sizes is a hash collision
                    unit = np.zeros((len(bucket), dim))
                    unit[own] = vectors
                spans = ends - starts
                for m in np.unique(spans):
                    if m < 2:
                        continue
                    groups = starts[spans == m]
                    step = max(1, (1 << 22) // int(m * m))
                    for g in range(0, len(groups), step):
                        index = groups[g : g + step, None] + np.arange(m)
                        x = unit[index]
                        hit = np.einsum("gik,gjk->gij", x, x, optimize=True) >= threshold if m <= 8 else np.matmul(x, x.transpose(0, 2, 1)) >= threshold
                        hit &= np.triu(np.ones((m, m), dtype=bool), 1)
                        where, i, j = np.nonzero(hit)
                        left.append(index[where, i])
                        right.append(index[where, j])
            if not left:
                continue
            i, j = np.concatenate(left), np.concatenate(right)
            ok = ((ta[i] == tb[i]) | (side[i] != side[j])) & (size[i] == size[j])
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            rows, back = np.unique(np.concatenate([i, j]), return_inverse=True)
            if len(known) > MEMO:
                known.clear()
            names = ids[rows].tolist()
            fresh = np.array([x not in known for x in names])
            for dim, (own, vectors) in units.items():
                lost = np.flatnonzero(fresh & (size[rows] == dim))
                at = np.searchsorted(own, rows[lost])
                for s in range(0, len(lost), 2048):
                    known.update(zip((names[r] for r in lost[s : s + 2048]), tables.buckets(vectors[at[s : s + 2048]]), strict=True))
            signs = np.stack([known[x] for x in names])
            a, b = back[: len(i)], back[len(i) :]
            mine = np.zeros(len(i), dtype=bool)  # a pair counts in the first table where it meets
            for s in range(0, len(i), 1 << 16):
                same = signs[a[s : s + (1 << 16)]] == signs[b[s : s + (1 << 16)]]
                first = same.argmax(axis=1)
                mine[s : s + (1 << 16)] = signs[a[s : s + (1 << 16)], first] == bucket[i[s : s + (1 << 16)]].view(np.uint64)
            a, b, i, j = a[mine], b[mine], i[mine], j[mine]
            if not len(i):
                continue
            links = np.bincount(a, n[j], len(rows)) + np.bincount(b, n[i], len(rows))
            parent = np.arange(len(rows))
            for p, q in zip(a.tolist(), b.tolist(), strict=True):
                p, q = _find(parent, p), _find(parent, q)
                if p != q:
                    parent[max(p, q)] = min(p, q)
            seen = np.flatnonzero(links > 0)
            roots = np.array([_find(parent, r) for r in seen.tolist()])
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows[seen]]), pa.array(links[seen].astype(np.int64)), pa.array(ids[rows[roots]])], names=["id", "links", "root"])

    return run


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, miss: float = MISS, tile: int = TILE) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Links are pairs with a cosine of at least ``threshold`` in double
    precision; a pair just at the threshold is missed with probability
    ``miss``, closer ones far less often. n_links counts the other rows linked
    directly, copies too. Vectors that are null, empty, all zero, or hold a
    null or non-finite component link with nothing; so do vectors of different
    lengths. Rows that repeat an id are vectors of their own; a null id is
    never a component_id unless all ids of the component are null.

    Equal vectors are one class from the start. Buckets of different tables
    that hold the same vectors are compared once, as the one of the first such
    table. A bucket larger than ``tile`` is compared tile by tile in many
    tasks, whole, and only counts and one edge a vector leave a task. The
    other columns of ``df`` are left out; an empty table gives an empty one.
    """
    spark = df.sparkSession
    rows, dtype = vector_classes(df, key, vector)
    rows = cut(rows)
    classes = rows.where("cls is not null").groupBy("cls").agg(F.max("vec").alias("vec"), F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    tables = Tables(*shape(classes.count(), threshold, miss=miss))
    member = _memberships(classes, tables, dtype)
    crowded = cut(member.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"))
    few = F.broadcast(crowded) if crowded.count() <= SENT else crowded
    shared = cut(member.join(few, "bucket"))
    groups = shared.groupBy("bucket").agg(F.max("m").alias("m"), F.min("place").alias("place"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    groups = groups.groupBy("m", "x", "y").agg(F.min(F.struct("place", "bucket"))["bucket"].alias("bucket")).select("bucket")
    met = shared.join(groups, "bucket").withColumn("c", F.ceil(F.col("m") / F.lit(tile)).cast("int"))
    met = met.withColumn("side", F.pmod(F.xxhash64("id"), F.col("c")).cast("int"))
    met = met.select("bucket", "id", "side", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other"))
    met = met.select("bucket", F.least("side", "other").alias("ta"), F.greatest("side", "other").alias("tb"), "side", "id")
    met = met.join(classes.select("id", "vec", "n"), "id").select("bucket", "ta", "tb", "side", "id", "vec", "n")
    tiles = met.repartition(max(partitions(spark), 8), "bucket", "ta", "tb").sortWithinPartitions("bucket", "ta", "tb")
    found = cut(tiles.mapInArrow(_compare(tables, threshold, dtype), "id long, links long, root long"))
    roots = components(found, "id", "root")
    linked = classes.select(F.col("id").alias("node"), "rep").join(roots, "node")
    lows = linked.groupBy("root").agg(F.min("rep").alias("low"))
    linked = spread_join(linked.select("node", "root"), lows, "root", "node").select(F.col("node").alias("id"), "low")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    answer = classes.select("id", "cls", "n", "rep").join(linked, "id", "left").join(links, "id", "left")
    answer = cut(answer.select("cls", F.coalesce("low", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    let_go(classes, crowded, shared, found)
    out = spread_join(rows.select("vec_id", "cls"), answer, "cls", "vec_id", "left")  # copies of one vector may be a third of all rows
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
