"""Best-fit packing of token sequences by a configuration linear program.

Pieces of equal length are interchangeable, so the whole problem is the
histogram of lengths: at most ``capacity`` numbers, whatever the input. The
driver solves the configuration LP over that histogram (a configuration is a
multiset of lengths that fits into one sequence) by multiplicative weights,
prices configurations with a bounded knapsack's dynamic program over lengths
drawn by their weights, rounds each step down to whole sequences and places
the last tenth of the tokens by best fit, in bulk. The executors then only
look up the place of the k-th piece of each length.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, free
from tessera.llm.textbytes import Rolling, blocks, joined, released, worker_state

CAPACITY = 4096
END_ID = 1
#: Entries of the memo of a worker; beyond it the memo starts anew.
MEMO = 600_000
#: Characters that are cut into parts at once.
BLOCK = 1_000_000


# ---------------------------------------------------------------- tokens


#: Byte kinds: white space, ASCII letters, ASCII punctuation, digits, and what may belong to either side.
_KIND = np.full(256, 4, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = 2
_KIND[48:58] = 3


#: Texts that tell whether a vocabulary encodes parts like wholes.
PROBES = ("a b  c\td\ne\r\nf", "one,two;three. (four) [five] - six_seven/eight!?", "x1 12 a12b 3.14 1,000", "don't 's 've it's '' 'a' \"b\"", "é1 naïve,ça 日本,語。 x…y ½7", "aaa...bbb --- ### $5 50% a@b.c", " lead and trail ")


class WordIds:
    """Token ids of whole texts.

    For vocabularies that drop white space, fold case and never join letters
    with ASCII punctuation, digits or each other's neighbours across these
    borders: a text's ids are those of its parts, one after another. A part
    next to an apostrophe or a character beyond ASCII is not cut there. Each
    distinct part is encoded once and found again by two 64-bit hashes; where
    only one of them agrees, or a special token may be meant, the tokenizer
    gets the whole text. A vocabulary that gives other ids for the parts of
    PROBES than for the whole ones gets every text whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.one, self.two = Rolling(3), Rolling(4)
        self.clear()
        self.by_parts = all(self._block([p, p.upper()]) == [self._whole(p), self._whole(p.upper())] for p in PROBES)

    def clear(self) -> None:
        self.h1 = self.h2 = np.zeros(0, dtype=np.uint64)
        self.at = self.size = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        parts = [i for i, t in enumerate(texts) if self.by_parts and "<|" not in t]
        for i in sorted({*range(len(texts))} - {*parts}):
            out[i] = self._whole(texts[i])
        plain = [texts[i] for i in parts]
        for piece in blocks(plain, BLOCK):
            for i, ids in zip(parts[piece], self._block(plain[piece]), strict=True):
                out[i] = ids
        return out

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _block(self, texts: list[str]) -> list[bytes]:
        buf, begin = joined(texts)
        kind = _KIND[buf]
        before = np.concatenate([[np.uint8(0)], kind[:-1]])
        other = (kind != before) & (((kind < 4) & (before < 4)) | (kind == 0) | (before == 0)) | ((kind == 3) & (before == 3))
        edge = np.append(np.flatnonzero(other), len(buf))
        starts, ends = edge[:-1], edge[1:]
        real = kind[starts] != 0
        starts, ends = starts[real], ends[real]
        h1, h2 = self.one.runs(buf, starts, ends), self.two.runs(buf, starts, ends)
        order = np.argsort(h1)
        s1, s2 = h1[order], h2[order]
        new = np.ones(len(s1), dtype=bool)
        new[1:] = s1[1:] != s1[:-1]
        u1, u2, first = s1[new], s2[new], order[new]
        rank = np.cumsum(new) - 1
        if len(self.h1) > MEMO:
            self.clear()
        at = np.searchsorted(self.h1, u1)
        known = np.zeros(len(u1), dtype=bool)
        inside = at < len(self.h1)
        known[inside] = self.h1[at[inside]] == u1[inside]
        if (s2 != u2[rank]).any() or (self.h2[at[known]] != u2[known]).any():
            return [self._whole(t) for t in texts]
        lost = np.flatnonzero(~known)
        if len(lost):
            raw = buf.tobytes()
            words = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[first[lost]].tolist(), ends[first[lost]].tolist(), strict=True)]
            found = [e.ids for k in range(0, len(words), 20_000) for e in self.tokenizer.encode_batch_fast(words[k : k + 20_000], add_special_tokens=False)]
            size = np.array([len(x) for x in found], dtype=np.int64)
            flat = np.fromiter((t for ids in found for t in ids), dtype=np.uint32, count=int(size.sum()))
            self.size = np.insert(self.size, at[lost], size)
            self.at = np.insert(self.at, at[lost], len(self.flat) + np.cumsum(size) - size)
            self.h1, self.h2 = np.insert(self.h1, at[lost], u1[lost]), np.insert(self.h2, at[lost], u2[lost])
            self.flat = np.concatenate([self.flat, flat])
            at = np.searchsorted(self.h1, u1)
        entry = np.empty(len(order), dtype=np.int64)
        entry[order] = at[rank]
        size = self.size[entry]
        ends_at = np.cumsum(size)
        ids = self.flat[np.repeat(self.at[entry] - (ends_at - size), size) + np.arange(int(size.sum()))].astype("<u4").tobytes()
        owner = np.searchsorted(begin, starts, side="right") - 1
        edges = 4 * np.concatenate([[0], np.cumsum(np.bincount(owner, size, len(texts)).astype(np.int64))])
        return [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def piece_rows(df: DataFrame, vocabulary: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut only beyond ``capacity``."""
    end = np.array([END_ID], dtype="<u4").tobytes()

    def tokenise(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = worker_state(f"ids {vocabulary}", lambda: WordIds(vocabulary))
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, len(keys), 1024):  # bounds what a batch of very long texts holds at once
                rows: list[tuple] = []
                part = [x or "" for x in texts.slice(at, 1024).to_pylist()]
                for doc, ids in zip(keys.slice(at, 1024).to_pylist(), coder.encode(part), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for piece, start in enumerate(range(0, n, capacity)):
                        cut_ids = ids[4 * start : 4 * (start + capacity)]
                        rows.append((doc, piece, start, len(cut_ids) // 4, zlib.crc32(cut_ids)))
                columns = list(zip(*rows, strict=True))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(lambda batches: released(tokenise(batches)), "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- the plan


#: Lengths that one pricing looks at, drawn by their weights; four times as many where these fill no sequence.
PRICED = 32
#: How much a weight may move a length's price: one part in so many.
FIRM = 256
#: The program is solved until so much of all tokens is left, which best fit places.
LEFT = 0.1
#: Steps that are tried, until the plan is this close to the least number of sequences that the tokens need.
STEPS, GAP = (0.5, 0.25), 2e-4


def price(lengths: np.ndarray, copies: np.ndarray, values: np.ndarray, capacity: int) -> tuple[dict[int, int], int]:
    """The most valuable configuration with at most ``copies`` of each length, by the bounded knapsack's dynamic program: {index: copies}, and the tokens it fills."""
    items = []
    for i, n in enumerate(copies.tolist()):
        k = 1
        while n:
            items.append((i, min(k, n)))
            n -= min(k, n)
            k *= 2
    sizes = lengths.tolist()
    best, took = np.zeros(capacity + 1, dtype=np.float32), np.zeros((len(items), capacity + 1), dtype=bool)
    for j, (i, n) in enumerate(items):
        size = sizes[i] * n
        with_it = best[: capacity + 1 - size] + np.float32(values[i] * n)
        np.greater(with_it, best[size:], out=took[j, size:])
        np.maximum(with_it, best[size:], out=best[size:])
    mix: dict[int, int] = {}
    room = capacity
    for j in range(len(items) - 1, -1, -1):
        if took[j, room]:
            i, n = items[j]
            mix[i] = mix.get(i, 0) + n
            room -= sizes[i] * n
    return mix, capacity - room


def solve(lengths: np.ndarray, total: np.ndarray, capacity: int, step: float, seed: int = 1) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Configurations with whole multiples, and what they leave of each length.

    Multiplicative weights over the covering constraints of the configuration
    LP, one a length: a constraint's weight starts at one and is multiplied by
    one minus the share of its open demand that a step covers, so it is the
    share of the demand that is still open. A round draws candidate lengths by
    weight times demand, prices the best configuration of them within the
    open counts, and uses it as often as it takes ``step`` of its scarcest
    length's open demand, rounded down (once where that is none). Prices are
    the lengths themselves, the dual solution of a perfect packing, raised or
    lowered by up to one part in FIRM by the weights.
    """
    rng, left, used = np.random.default_rng(seed), total.copy(), []
    mass = todo = int((lengths * total).sum())
    while todo > LEFT * mass:
        alive = np.flatnonzero(left)
        weight = left[alive] / total[alive]
        order = rng.exponential(size=len(alive)) / (lengths[alive] * total[alive] * weight)
        found, fill, chosen = {}, 0, alive
        for k in (PRICED, 4 * PRICED):
            near = np.argpartition(order, k)[:k] if len(alive) > k else np.arange(len(alive))
            at = alive[near]
            mix, filled = price(lengths[at], np.minimum(left[at], capacity // lengths[at]), lengths[at] * (1 + (weight[near] - 1) / FIRM), capacity)
            if filled > fill:
                found, fill, chosen = mix, filled, at
            if fill == capacity or len(alive) <= k:
                break
        at, n = chosen[list(found)], np.array(list(found.values()))
        times = max(1, int(np.floor(step * (left[at] / n).min())))
        left[at] -= n * times
        todo -= fill * times
        used.append(({int(lengths[i]): int(c) for i, c in zip(at, n, strict=True)}, times))
    return used, left


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int, open_bins: list[tuple[dict[int, int], int]]) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, of equal pieces in bulk; takes room in ``open_bins`` first.

    A bin is ({length: copies}, how many such bins). The number of distinct
    bins depends on the number of distinct lengths, not on the counts.
    """
    by_room: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(capacity + 1)]
    for bins, n in open_bins:
        by_room[capacity - sum(size * k for size, k in bins.items())].append((bins, n))
    rooms = np.array([bool(x) for x in by_room])
    for i in np.argsort(-lengths, kind="stable"):
        size, left = int(lengths[i]), int(counts[i])
        while left:
            fitting = np.flatnonzero(rooms[size:])
            if not len(fitting):
                each = min(capacity // size, left)
                bins, n = {}, left // each
                room = capacity
            else:
                room = int(fitting[0]) + size
                bins, n = by_room[room].pop()
                rooms[room] = bool(by_room[room])
                each = min(room // size, left)
                if n * each > left:
                    full = left // each
                    by_room[room].append((bins, n - full))
                    rooms[room] = True
                    n = full
            left -= n * each
            grown = dict(bins)
            grown[size] = grown.get(size, 0) + each
            by_room[room - size * each].append((grown, n))
            rooms[room - size * each] = True
    return [x for same in by_room for x in same]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Configurations and how often each is used; every piece is placed exactly once.

    The configuration LP is solved down to a tenth of all tokens (LEFT); best
    fit places those, in the room of the configurations first. Smaller steps
    follow where the plan isn't within GAP of the least number of sequences,
    and the plan of the fewest sequences is taken; plain best fit is one of
    the plans compared.
    """
    lengths = np.array(sorted(counts), dtype=np.int64)
    if not len(lengths):
        return []
    total = np.array([counts[int(x)] for x in lengths], dtype=np.int64)
    bound = -(-int((lengths * total).sum()) // capacity)
    size = lambda bins: sum(n for _, n in bins)
    plans: list[list[tuple[dict[int, int], int]]] = []
    for step in STEPS:
        used, left = solve(lengths, total, capacity, step)
        rest = left > 0
        plans.append(best_fit(lengths[rest], left[rest], capacity, used))
        if size(plans[-1]) <= bound * (1 + GAP):
            break
    plans.append(best_fit(lengths, total, capacity, []))
    return min(plans, key=size)


def intervals(bins: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length and rank, the first sequence, copies a sequence and offset; sorted by (length, rank)."""
    rows, ranks, sequence = [], {}, 0
    for mix, n in bins:
        offset = 0
        for size, each in sorted(mix.items(), reverse=True):
            first = ranks.get(size, 0)
            rows.append((size, first, sequence, each, offset))
            ranks[size] = first + n * each
            offset += size * each
        sequence += n
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), np.ascontiguousarray(table.T), strict=True))


# ---------------------------------------------------------------- the operator


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, lanes: int = 64, length: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset.

    Only the histogram of lengths (at most ``capacity`` rows) comes to the
    driver. Ranks inside a length are counted over ``lanes`` lanes, so a
    length that a third of all pieces have is spread over so many groups.
    Columns named sequence_id or offset are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    row, lane, n, first, rank = free(names, "row__", "lane__", "n__", "first__", "rank__")
    rows = cut(pieces.withColumn(row, F.monotonically_increasing_id()))
    rows = rows.withColumn(lane, F.pmod(F.xxhash64(row), F.lit(lanes)).cast("int"))
    by_lane = rows.groupBy(length, lane).agg(F.count("*").alias(n))
    counts = {int(r[0]): int(r[1]) for r in by_lane.groupBy(length).agg(F.sum(n)).collect()}
    table = intervals(plan(counts, capacity))
    before = Window.partitionBy(length).orderBy(lane).rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_lane.select(length, lane, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(length, lane).orderBy(row)) - 1)
    ranked = ranked.join(firsts, [length, lane]).select(*(F.col(f"`{c}`") for c in names), (F.col(first) + F.col(rank)).alias(rank))
    at_length = names.index(length)

    def place(batches):
        order = table["length"] * (1 << 48) + table["rank"]
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(at_length).to_numpy(zero_copy_only=False).astype(np.int64)
            ranks = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(order, sizes * (1 << 48) + ranks, side="right") - 1
            inside = ranks - table["rank"][at]
            each = table["each"][at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(table["sequence"][at] + inside // each), pa.array(table["offset"][at] + inside % each * sizes)],
                names=[*names, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(df: DataFrame, vocabulary: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece holding the end id. Rows that repeat a
    doc_id are packed as documents of their own; null ids stay null. An empty
    table gives an empty result. Texts are tokenised whole; documents are cut
    only where they exceed ``capacity`` ids.
    """
    return pack_pieces(piece_rows(df, vocabulary, capacity, key, text), capacity)
