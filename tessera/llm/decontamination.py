"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a seed (a run of MIN_MATCH tokens)
are compared by greedy string tiling with running Karp-Rabin matching (Wise,
1993): the longest common runs of unmarked tokens are marked as tiles, again
and again, down to MIN_MATCH tokens, wherever they stand; so a reordered
passage is covered too. The share of an item's tokens in tiles decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free, mix64
from tessera.llm.graph import spread_join
from tessera.llm.textbytes import BLANK, Rolling, blocks, word_hashes, worker_state

MIN_MATCH = 5
COVERAGE = 0.5
#: Seeds of a benchmark that are sent to every executor (16 bytes each); a larger benchmark is joined by shuffles.
MAX_SEEDS = 1_000_000
#: Items of a large benchmark that a task remembers.
ITEMS = 64
#: Characters of text that are turned into tokens at once.
BLOCK = 1_000_000
#: White space and ASCII punctuation stand between tokens.
_BETWEEN = BLANK.copy()
_BETWEEN[[0, *(c for c in range(33, 127) if not chr(c).isalnum())]] = True
_R = np.uint64(0x9E3779B97F4A7C15)


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all tokens, text after text; and how many each text has."""
    return word_hashes(texts, worker_state("decontamination words", lambda: Rolling(6)), _BETWEEN)


def windows(tokens: np.ndarray, length: int) -> np.ndarray:
    """Running Karp-Rabin hashes of all runs of ``length`` tokens."""
    n = len(tokens) - length + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total, power = np.zeros(n, dtype=np.uint64), np.uint64(1)
        if length <= 8:
            for i in range(length):
                total += tokens[i : i + n] * power
                power *= _R
            return mix64(total)
        powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(tokens), _R))])
        prefix = np.zeros(len(tokens) + 1, dtype=np.uint64)
        for i, t in enumerate(tokens):  # Horner: prefix[i + 1] = prefix[i] * R + token
            prefix[i + 1] = prefix[i] * _R + t
        return prefix[length:] - prefix[:-length] * powers[length]


def tile(item: np.ndarray, doc: np.ndarray, least: int, closed: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiles (start in item, start in doc, length) of at least ``least`` tokens; ``closed`` marks tokens of doc that match nothing."""
    used_i, used_d = np.zeros(len(item), dtype=bool), np.zeros(len(doc), dtype=bool) if closed is None else closed.copy()
    tiles: list[tuple[int, int, int]] = []
    search = max(least, min(20, len(item)))
    while True:
        matches, longer = _scan(item, doc, used_i, used_d, search)
        if longer > 2 * search:
            search = longer
            continue
        for i, d, n in sorted(matches, key=lambda m: (-m[2], m[0], m[1])):
            if not used_i[i : i + n].any() and not used_d[d : d + n].any():
                used_i[i : i + n] = used_d[d : d + n] = True
                tiles.append((i, d, n))
        again, _ = _scan(item, doc, used_i, used_d, search) if matches else ([], 0)
        if again:  # what overlapped a marked tile and still is long enough
            continue
        if search <= least:
            return tiles
        search = search // 2 if search > 2 * least else least


def _scan(item, doc, used_i, used_d, length) -> tuple[list[tuple[int, int, int]], int]:
    """Maximal matches of unmarked tokens of at least ``length``, and the longest one's length."""
    a, b = windows(item, length), windows(doc, length)
    if not len(a) or not len(b):
        return [], 0
    free_a = np.flatnonzero(np.convolve(used_i, np.ones(length), "valid") == 0)
    free_b = np.flatnonzero((np.convolve(used_d, np.ones(length), "valid") == 0) & np.isin(b, a[free_a]))
    if not len(free_b):
        return [], 0
    places: dict[int, list[int]] = {}
    for i in free_a.tolist():
        places.setdefault(int(a[i]), []).append(i)
    found, longest, reached = [], 0, {}
    for d in free_b.tolist():
        for i in places[int(b[d])]:
            if reached.get(d - i, -1) >= d:  # inside a match of this diagonal
                continue
            n = 0
            while i + n < len(item) and d + n < len(doc) and not used_i[i + n] and not used_d[d + n] and item[i + n] == doc[d + n]:
                n += 1
            if n >= length:
                reached[d - i] = d + n - length
                found.append((i, d, n))
                longest = max(longest, n)
    return found, longest


class Benchmark:
    """Items with their seeds, for comparing whole documents with all of them."""

    def __init__(self, items: list[tuple[int, np.ndarray]], least: int = MIN_MATCH):
        self.items = [(k, t, min(least, len(t))) for k, t in items if len(t)]
        self.lengths = sorted({n for _, _, n in self.items})
        seeds, owner, place = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for i, (_, tokens, n) in enumerate(self.items):
            w = windows(tokens, n)
            with np.errstate(over="ignore"):
                seeds.append(w + np.uint64(n))
            owner.append(np.full(len(w), i))
            place.append(np.arange(len(w)))
        seeds, owner, place = np.concatenate(seeds), np.concatenate(owner), np.concatenate(place)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner, self.place = seeds[order], owner[order], place[order]
        self.flags = np.zeros(1 << 20, dtype=bool)
        self.flags[(self.seeds & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.memo: dict = {}

    def search(self, texts: list[str | None], coverage: float):
        """Yields (number of the text, what compare() finds) for the texts that hold seeds."""
        for piece in blocks(texts, BLOCK):
            flat, n = token_hashes(texts[piece])
            ends = np.cumsum(n)
            found = [np.zeros(0, dtype=np.int64)]
            for length in self.lengths:
                p, _ = self._seeds(flat, length)
                doc = np.searchsorted(ends, p, side="right")
                found.append(doc[p + length <= ends[doc]])
            for i in np.unique(np.concatenate(found)).tolist():
                if got := self.compare(flat[ends[i] - n[i] : ends[i]], coverage):
                    yield piece.start + i, got

    def _seeds(self, tokens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where a seed of ``length`` tokens stands, and which."""
        with np.errstate(over="ignore"):
            w = windows(tokens, length) + np.uint64(length)
        p = np.flatnonzero(self.flags[(w & np.uint64((1 << 20) - 1)).astype(np.int64)])
        p = p[np.isin(w[p], self.seeds)] if len(p) else p
        return p, w[p]

    def compare(self, tokens: np.ndarray, coverage: float) -> list[tuple[int, int, int, list]]:
        """(item, its tokens, tokens covered, tiles) of all items covered to at least ``coverage``."""
        at, seed = [], []
        for n in self.lengths:
            p, w = self._seeds(tokens, n)
            at.append(p)
            seed.append(w)
        at, seed = np.concatenate([np.zeros(0, dtype=np.int64), *at]), np.concatenate([np.zeros(0, dtype=np.uint64), *seed])
        if not len(at):
            return []
        low, high = np.searchsorted(self.seeds, seed, "left"), np.searchsorted(self.seeds, seed, "right")
        n = high - low
        post = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        starts, owners = np.repeat(at, n), self.owner[post]
        out = []
        for i in np.unique(owners).tolist():
            key, item, least = self.items[i]
            own = owners == i
            reach = np.zeros(len(item), dtype=bool)
            for s in np.unique(self.place[post[own]]).tolist():
                reach[s : s + least] = True
            if reach.sum() < coverage * len(item):
                continue  # tiles consist of seeds, so they can't cover more
            span = np.zeros(len(tokens) + 1, dtype=np.int64)
            np.add.at(span, starts[own], 1)
            np.add.at(span, starts[own] + least, -1)
            used = np.cumsum(span)[:-1] > 0
            index = np.flatnonzero(used)
            breaks = np.flatnonzero(np.diff(index) > 1) + 1
            region, closed = np.insert(tokens[index], breaks, 0), np.insert(np.zeros(len(index), dtype=bool), breaks, True)
            where = np.insert(index, breaks, -1)
            memo_key = (i, region.tobytes())
            tiles = self.memo.get(memo_key)
            if tiles is None:
                if len(self.memo) > 2000:
                    self.memo.clear()
                tiles = tile(item, region, least, closed)
                if len(region) < 4096:
                    self.memo[memo_key] = tiles
            covered = sum(n for _, _, n in tiles)
            if covered >= coverage * len(item):
                out.append((key, len(item), covered, [(a, int(where[b]), n) for a, b, n in tiles]))
        return out


PAIRS = "item_id long, n_tokens int, covered int, coverage double, tiles array<struct<item_start:int,doc_start:int,length:int>>"


def _small_benchmark(bench: DataFrame, item: str, text: str, max_seeds: int) -> list | None:
    """The items' tokens if they have at most ``max_seeds`` in all; the size is checked before anything is collected."""
    rows = bench.select(F.col(item).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.count("*")).first()
    if size[0] / 2 > max_seeds * 4 or size[1] > max_seeds:
        return None
    items = [(r["k"], token_hashes([r["t"]])[0]) for r in sorted(rows.collect(), key=lambda r: (r["k"] is None, r["k"] or 0, r["t"]))]
    return items if sum(map(len, (t for _, t in items))) <= max_seeds else None


def contaminated_pairs(df: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, least: int = MIN_MATCH, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """doc_id, item_id, n_tokens, covered, coverage, tiles of every pair whose coverage reaches the threshold.

    Tokens are runs of anything but ASCII white space and punctuation, A-Z
    lower-cased. An item shorter than ``least`` tokens is one seed itself; an
    item without tokens, and a null or empty text, match nothing. Repeated
    rows and null ids give their own pairs.
    """
    items = _small_benchmark(bench, item, item_text, max_seeds)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t__"))
    if items is None:
        return _joined_pairs(docs, bench.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("i__")), coverage, least)

    def run(batches):
        whole = Benchmark(items, least)
        for batch in batches:
            docs_of = batch.column(0)
            rows = [_row(docs_of[i].as_py(), found) for i, got in whole.search(batch.column(1).to_pylist(), coverage) for found in got]
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW_PAIRS)

    return docs.mapInArrow(run, f"doc_id long, {PAIRS}")


ARROW_PAIRS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_tokens", pa.int32()), ("covered", pa.int32()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())])))])


def _row(doc, found) -> dict:
    item, n, covered, tiles = found
    return {"doc_id": doc, "item_id": item, "n_tokens": n, "covered": covered, "coverage": covered / n, "tiles": [{"item_start": a, "doc_start": b, "length": c} for a, b, c in tiles]}


def _seed_rows(df: DataFrame, least: int, of_items: bool) -> DataFrame:
    """(row, seed, n): distinct seeds of each text; items give the seeds of their own length, documents those of every length up to ``least``."""

    def run(batches):
        for batch in batches:
            for row, value in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                tokens = token_hashes([value])[0]
                lengths = ([min(least, len(tokens))] if len(tokens) else []) if of_items else range(1, least + 1)
                with np.errstate(over="ignore"):
                    seeds = [np.unique(windows(tokens, n) + np.uint64(n)) for n in lengths]
                flat = np.concatenate([np.zeros(0, dtype=np.uint64), *seeds]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(flat), pa.int64()), pa.array(flat)], names=["row", "seed"])

    return df.mapInArrow(run, "row long, seed long")


def _joined_pairs(docs: DataFrame, items: DataFrame, coverage: float, least: int) -> DataFrame:
    """The way for a benchmark too large to send: seeds meet in a shuffled join, then each pair's texts."""
    docs = docs.withColumn("row", F.xxhash64("doc_id", "t__"))
    items = items.withColumn("irow", F.xxhash64("item_id", "i__"))
    item_seeds = _seed_rows(items.select("irow", "i__"), least, True).select(F.col("row").alias("irow"), "seed")
    met = spread_join(_seed_rows(docs.select("row", "t__"), least, False), item_seeds, "seed", "row").select("row", "irow").distinct()
    pairs = met.join(docs, "row").join(items, "irow").select("doc_id", "t__", "item_id", "i__")

    def run(batches):
        known: dict[tuple, Benchmark] = {}
        for batch in batches:
            rows = []
            for doc, value, item, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (item, text) not in known:
                    if len(known) >= ITEMS:
                        known.clear()
                    known[item, text] = Benchmark([(item, token_hashes([text])[0])], least)
                rows += [_row(doc, found) for found in known[item, text].compare(token_hashes([value])[0], coverage)]
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW_PAIRS)

    return pairs.mapInArrow(run, f"doc_id long, {PAIRS}")


def decontaminate(df: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, least: int = MIN_MATCH, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """``df`` without the rows whose text covers an item to at least ``coverage``; all its columns stay, whatever they are named.

    The size of the benchmark decides how seeds meet, not which rows go: items
    of at most ``max_seeds`` tokens are sent to the executors, others joined.
    Null and empty texts stay; an empty benchmark takes nothing away.
    """
    items = _small_benchmark(bench, item, item_text, max_seeds)
    if items is None:
        (rid,) = free(df.columns, "rid__")
        mark = F.xxhash64(F.col(f"`{text}`").cast("string"))
        pairs = contaminated_pairs(df.select(mark.alias("doc_id"), F.col(f"`{text}`").alias("text")), bench, "doc_id", "text", item, item_text, coverage, least, max_seeds)
        gone = pairs.select(F.col("doc_id").alias(rid)).distinct()
        return df.join(gone, mark == F.col(rid), "left_anti")
    at = df.columns.index(text)

    def run(batches):
        whole = Benchmark(items, least)
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            clean[[i for i, _ in whole.search(batch.column(at).to_pylist(), coverage)]] = False
            yield batch.filter(pa.array(clean))

    return df.mapInArrow(run, df.schema)
