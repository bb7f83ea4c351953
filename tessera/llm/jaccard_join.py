"""Jaccard self-join of word shingle sets by PartEnum signatures.

Sets of one size band with a Jaccard similarity of at least GAMMA differ in at
most k elements (Arasu, Ganti and Kaushik, 2006). The shingle domain is cut
into groups of three partitions. With more groups than half of k, some group
holds at most one difference, so two of its partitions agree; a signature is
the content of two partitions of a group, and all three choices are emitted.
Two linked sets always share a signature, with no chance involved.

Signatures of empty partitions would bring all documents together. They are
left out, which loses nothing as long as a set has enough groups without
empty choices; a set that has too few also emits single partitions of ever
finer cuts until it has enough of them.

Signatures travel as packed, sorted arrays, a row for each range of signature
values and block of documents. Every candidate pair is then checked: by a
bitmap that bounds the difference from below, and by its texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, free, let_go, mix64, partitions
from tessera.llm.graph import components, spread_join
from tessera.llm.streams import grouped
from tessera.llm.textbytes import Rolling, blocks, released, word_hashes, worker_state

SHINGLE = 5
#: Characters of text that are turned into signatures at once.
BLOCK = 1_000_000
#: Signature bits that are compared; what falls together by chance is sorted out by the check.
BITS = 48
#: Sets that a task remembers, so that their copies do not speak again.
MEMO = 200_000
#: Share of the most runs that makes a document fit to be the centre of its runs.
NEARLY, OFTEN = 0.3, 0.3
#: Bits of a bitmap that are never folded together.
THIN = 1024
#: Pairs of a component in a run that are looked at first.
EACH = 1024
#: Documents of one signature run that a task compares with as many others.
TILE = 2048
LOW = -(2**63)
_R = np.uint64(0x9E3779B97F4A7C15)


# ------------------------------------------------------------------ shingles


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingle hashes, one text after another; and how many each has."""
    flat, n = word_hashes(texts, worker_state("shingle words", lambda: Rolling(5)))
    k = np.where(n == 0, 0, np.maximum(1, n - width + 1))
    doc = np.repeat(np.arange(len(texts)), k)
    first = np.arange(int(k.sum())) + np.repeat(np.cumsum(n) - n - np.cumsum(k) + k, k)
    sums, power = np.zeros(len(doc), dtype=np.uint64), np.uint64(1)
    flat = np.concatenate([flat, np.zeros(width, dtype=np.uint64)])
    short = np.flatnonzero(n[doc] < width)
    with np.errstate(over="ignore"):
        for i in range(width):
            sums += flat[first + i] * power
            power *= _R
        for at in short.tolist():  # one shingle of fewer words
            words = flat[first[at] : first[at] + n[doc[at]]]
            sums[at] = np.uint64(sum(int(w) * pow(int(_R), i, 1 << 64) for i, w in enumerate(words)) + 1 + len(words) & 0xFFFFFFFFFFFFFFFF)
        sums = mix64(sums)
        own = mix64(sums + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(own)
    fresh = np.ones(len(own), dtype=bool)
    fresh[order[1:]] = own[order[1:]] != own[order[:-1]]
    return sums[fresh], np.bincount(doc[fresh], minlength=len(texts))


def set_keys(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums of each set."""
    doc = np.repeat(np.arange(len(n)), n)
    return _sum64(doc, mix64(h ^ np.uint64(0x51ED2701)), len(n)), _sum64(doc, mix64(h ^ np.uint64(0xA24BAED4963EE407)), len(n))


def _sum64(cell: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
    """Sums modulo 2**64 of ``h`` in each cell."""
    if len(h) >= 1 << 21:  # beyond the whole numbers of a double
        out, order = np.zeros(size, dtype=np.uint64), np.argsort(cell, kind="stable")
        at = np.flatnonzero(np.diff(cell[order], prepend=-1))
        out[cell[order][at]] = np.add.reduceat(h[order], at)
        return out
    low = np.bincount(cell, (h & np.uint64(0xFFFFFFFF)).astype(np.float64), size).astype(np.uint64)
    high = np.bincount(cell, (h >> np.uint64(32)).astype(np.float64), size).astype(np.uint64)
    with np.errstate(over="ignore"):
        return low + (high << np.uint64(32))


def sketch_bits(n: int) -> int:
    """Eight to sixteen bits for each of ``n`` elements."""
    return max(64, 8 << int(n - 1).bit_length()) if n else 64


def sketch(h: np.ndarray) -> bytes:
    """A bitmap of the elements, its width a power of two."""
    bits = sketch_bits(len(h))
    flags = np.zeros(bits, dtype=bool)
    flags[(h & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _folded(bitmap: bytes, bits: int) -> np.ndarray:
    x = np.frombuffer(bitmap, dtype=np.uint64)
    return np.bitwise_or.reduce(x.reshape(-1, bits // 64)) if len(x) * 64 > bits else x


def least_difference(a: bytes, b: bytes) -> int:
    """At least so many elements are in one of the two sets alone."""
    bits = 8 * min(len(a), len(b))
    return int(np.bitwise_count(_folded(a, bits) ^ _folded(b, bits)).sum())


# ---------------------------------------------------------------- signatures


class Bands:
    """Size bands [low, high] with high = low / 0.8, for a similarity of 80 per cent."""

    def __init__(self, largest: int):
        low, self.low, self.high = 1, [], []
        while low <= max(largest, 1):
            self.low.append(low)
            self.high.append(5 * low // 4)
            low = self.high[-1] + 1
        self.low.append(low)
        self.high.append(5 * low // 4)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.k = 2 * self.high // 9
        self.good = self.k // 2 + 1  # groups of which one must have at most one difference
        self.spare = np.where(self.k > 0, np.ceil(0.12 * self.good).astype(np.int64) + 1, 0)
        self.groups = self.good + self.spare

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, side="right") - 1


def signatures(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of the set) of all sets; a set takes part in its own band and the next."""
    bands = Bands(int(n.max(initial=1)))
    out_s, out_d = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    owner = np.repeat(np.arange(len(n)), n)
    band = bands.of(n)
    for step in (0, 1):
        which = band + step
        member = (n > 0) & (5 * n >= 4 * bands.low[which])
        mask = member[owner]
        hs, own = (h, owner) if mask.all() else (h[mask], owner[mask])
        groups = np.where(member, bands.groups[which], 0)
        offset = 3 * (np.cumsum(groups) - groups)
        cells = _cells(hs, which[own], (3 * groups)[own])
        total = 3 * int(groups.sum())
        sums = _sum64(offset[own] + cells, hs, total).reshape(-1, 3)
        filled = np.bincount(offset[own] + cells, minlength=total).reshape(-1, 3) > 0
        doc = np.repeat(np.arange(len(n)), groups)
        group = np.arange(len(doc)) - np.repeat(offset // 3, groups)
        exact = bands.k[which][doc] == 0  # only equal sets link: the whole set is the signature
        for s, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
            with np.errstate(over="ignore"):
                content = sums[:, i] + sums[:, j]
                content = np.where(exact, sums.sum(axis=1, dtype=np.uint64), content)
                place = ((which[doc] << 44) + (group << 3) + s).astype(np.uint64)
                sig = mix64(mix64(content) + place * _R)
            keep = np.where(exact, s == 0, filled[:, i] | filled[:, j])
            out_s.append(sig[keep])
            out_d.append(doc[keep])
        weak = np.bincount(doc, (filled.sum(axis=1) < 2) & ~exact, minlength=len(n))
        short = np.flatnonzero(member & (weak > bands.spare[which]))
        level = 0
        while len(short):
            take = np.zeros(len(n), dtype=bool)
            take[short] = True
            mask = take[owner]
            hs, own = h[mask], owner[mask]
            cuts = ((bands.k[which] + 1) * 4) << level
            cells = _cells(hs, which[own] + 4096, cuts[own])
            number, inverse = np.unique((own.astype(np.uint64) << np.uint64(40)) + cells.astype(np.uint64), return_inverse=True)
            doc = (number >> np.uint64(40)).astype(np.int64)
            with np.errstate(over="ignore"):
                place = (which[doc].astype(np.uint64) << np.uint64(50)) + ((number & np.uint64((1 << 40) - 1)) << np.uint64(8)) + np.uint64(4 + 8 * level)
                out_s.append(mix64(mix64(_sum64(inverse, hs, len(number))) + place * _R))
            out_d.append(doc)
            enough = np.bincount(doc, minlength=len(n)) > bands.k[which]
            short = short[~enough[short] & (level < 24)]
            level += 1
    return np.concatenate(out_s), np.concatenate(out_d)


def _cells(h: np.ndarray, band: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """A cell below ``cells`` for each hash, by the band's own hash function."""
    with np.errstate(over="ignore"):
        part = (h * (np.uint64(2) * mix64(band.astype(np.uint64) + np.uint64(77)) + np.uint64(1))) >> np.uint64(32)
    return ((part * cells.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers with their bytes by rank, so that high bytes that are alike stand together."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel()


def signature_rows(docs: DataFrame, ranges: int) -> DataFrame:
    """(part, sigs, docs): packed signatures of one range of values. docs: doc, text; ranges: a power of two."""
    shift = BITS - ranges.bit_length() + 1

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for piece in blocks(texts, BLOCK):
                h, n = shingle_sets(texts[piece])
                keys = np.stack(set_keys(h, n), axis=1)
                chosen = np.zeros(len(n), dtype=bool)
                if len(seen) > MEMO:
                    seen.clear()
                for i in np.flatnonzero(n).tolist():  # a set's copies in this task speak once
                    if (own := keys[i].tobytes()) not in seen:
                        seen.add(own)
                        chosen[i] = True
                mask = np.repeat(chosen, n)
                sig, doc = signatures(h[mask], np.where(chosen, n, 0))
                sig >>= np.uint64(64 - BITS)
                order = np.argsort(sig)
                sig, doc = sig[order], ids[piece][doc[order]].astype(np.int64).view(np.uint64)
                edges = np.searchsorted(sig, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(shift))
                parts = np.flatnonzero(np.diff(edges))
                rows = [(int(p), _planes(np.diff(sig[edges[p] : edges[p + 1]], prepend=np.uint64(0))), _planes(doc[edges[p] : edges[p + 1]])) for p in parts]
                for at in range(0, len(rows), 64):
                    columns = list(zip(*rows[at : at + 64], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["part", "sigs", "docs"])

    return docs.select("doc", "text").mapInArrow(lambda batches: released(run(batches)), "part int, sigs binary, docs binary")


def _runs(batches):
    """Of each range: (0, a, b) for a run's centre, the first of the documents that nearly the most runs of the range hold, with each other; (1, run, doc) for different runs of three or more."""

    def rows(kind, x, y):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, dtype=np.int8)), pa.array(np.ascontiguousarray(x)), pa.array(np.ascontiguousarray(y))], names=["kind", "x", "y"])

    def one_range(sigs, docs):
        if not sigs:
            return
        sig, doc = np.concatenate(sigs), np.concatenate(docs)
        order = np.lexsort((doc, sig))
        sig, doc = sig[order], doc[order]
        fresh = np.ones(len(sig), dtype=bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])
        sig, doc = sig[fresh], doc[fresh]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(start, len(sig)))
        start, size = start[size > 1], size[size > 1]
        if not len(start):
            return
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(doc.view(np.uint64)))])
            name = mix64(total[start + size] - total[start]) ^ size.astype(np.uint64)
        _, one = np.unique(name, return_index=True)  # runs of the same documents speak once
        start, size, name = start[one], size[one], name[one]
        index = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        member = doc[index]
        _, number, held = np.unique(member, return_inverse=True, return_counts=True)
        run = np.repeat(np.arange(len(size)), size)
        most = np.maximum.reduceat(held[number], np.cumsum(size) - size)
        near = held[number] >= NEARLY * most[run]  # members of nearly the most runs count alike, so that ranges agree on one
        hub = np.minimum.reduceat(np.where(near, member, np.iinfo(np.int64).max), np.cumsum(size) - size)
        other = np.maximum.reduceat(np.where(held[number] >= OFTEN * most[run], member, np.iinfo(np.int64).min), np.cumsum(size) - size)
        ends = np.concatenate([np.stack([np.repeat(c, size), member], axis=1) for c in (hub, other)])
        ends = ends[ends[:, 0] != ends[:, 1]]
        ends.sort(axis=1)
        ends = ends[np.lexsort((ends[:, 1], ends[:, 0]))]
        fresh = np.ones(len(ends), dtype=bool)
        fresh[1:] = (ends[1:] != ends[:-1]).any(axis=1)
        pairs = ends[fresh]
        yield rows(0, pairs[:, 0], pairs[:, 1])
        big = np.repeat(size > 2, size)
        if big.any():
            yield rows(1, np.repeat(name, size)[big].view(np.int64), member[big])

    current, sigs, docs = None, [], []
    for batch in batches:
        for part, a, b in zip(*(batch.column(i) for i in range(3)), strict=True):
            if part.as_py() != current:
                yield from one_range(sigs, docs)
                current, sigs, docs = part.as_py(), [], []
            sigs.append(np.cumsum(_unplaned(a.as_py())))
            docs.append(_unplaned(b.as_py()).view(np.int64))
    yield from one_range(sigs, docs)


# -------------------------------------------------------------------- checks


def _may_link(na, sa, nb, sb) -> bool:
    return 5 * min(na, nb) >= 4 * max(na, nb) and 9 * least_difference(sa, sb) <= na + nb


def _thinned(batches):
    """(key, n, sketch) with bitmaps of a quarter of their width, THIN bits at least, which bound a difference too, if not as well."""
    for batch in batches:
        maps = [None if x is None else _folded(x, max(THIN, 2 * len(x))).tobytes() for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], names=["key", "n", "sketch"])


def _screen(batches):
    """(ka, na, sa, kb, nb, sb) to the (ka, kb) that may link."""
    for batch in batches:
        keep = [_may_link(*row) for row in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4, 5)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], names=["ka", "kb"]).filter(pa.array(keep, pa.bool_()))


def _verify(batches):
    """(ka, ta, kb, tb) to the (ka, kb) that link."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = part.column(1).to_pylist() + part.column(3).to_pylist()
            distinct = list(dict.fromkeys(texts))
            sets: dict = {}
            for piece in blocks(distinct, BLOCK):
                h, n = shingle_sets(distinct[piece])
                ends = np.cumsum(n)
                sets |= {t: h[e - k : e] for t, e, k in zip(distinct[piece], ends, n, strict=True)}
            keep = []
            for x, y in zip(texts[: part.num_rows], texts[part.num_rows :], strict=True):
                a, b = sets[x], sets[y]
                shared = np.intersect1d(a, b, assume_unique=True).size
                keep.append(100 * shared >= 80 * (len(a) + len(b) - shared) > 0)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2)], names=["ka", "kb"]).filter(pa.array(keep, pa.bool_()))


def _cross(each: int):
    """Sorted rows (run, ta, tb, side, key, comp, n, sketch) to the (ka, kb) of different components that may link.

    Of each component but a run's largest one the ``each`` pairs of the least
    difference by their bitmaps, so there are no more than ``each`` for a
    member; where that leaves pairs out, a row of nulls says so. A task gives
    a pair once as long as it remembers it.
    """

    def run(batches):
        told: set[bytes | None] = set()
        for table in grouped(batches, 3, 4096):
            run, ta, tb, side, n = (table.column(i).to_numpy().astype(np.int64) for i in (0, 1, 2, 3, 6))
            _, key = np.unique(np.array([k.hex() for k in table.column(4).to_pylist()]), return_inverse=True)
            _, comp = np.unique(np.array([c.hex() for c in table.column(5).to_pylist()]), return_inverse=True)
            bitmaps = table.column(7).to_pylist()
            new = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1])]))
            left, right, seen, more = [], [], set(), False
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(run)], strict=True):
                members = key[a:b].tobytes() + side[a:b].tobytes() if ta[a] != tb[a] else key[a:b].tobytes()
                if members in seen:
                    continue
                seen.add(members)
                bits = 8 * min(len(x) for x in bitmaps[a:b])
                x = np.stack([_folded(x, bits) for x in bitmaps[a:b]])
                rest = np.flatnonzero(comp[a:b] != np.bincount(comp[a:b]).argmax())  # one end is outside the largest component
                found = [np.zeros((3, 0))]
                for s in range(0, len(rest), max(1, (1 << 21) // x.size)):
                    i = rest[s : s + max(1, (1 << 21) // x.size)]
                    least = np.bitwise_count(x[i, None, :] ^ x[None, :, :]).sum(axis=2)
                    sizes, total = n[a:b], n[a + i, None] + n[None, a:b]
                    near = (9 * least <= total) & (5 * np.minimum(sizes[i, None], sizes) >= 4 * np.maximum(sizes[i, None], sizes)) & (comp[a + i, None] != comp[None, a:b])
                    if ta[a] != tb[a]:
                        near &= side[a + i, None] != side[None, a:b]
                    p, q = np.nonzero(near)
                    kept, cut_off = _closest(np.stack([i[p], q, least[p, q] / total[p, q]]), comp[a:b], each)
                    found.append(kept)
                    more |= cut_off
                kept, cut_off = _closest(np.concatenate(found, axis=1), comp[a:b], each)
                more |= cut_off
                left.append(a + kept[0].astype(np.int64))
                right.append(a + kept[1].astype(np.int64))
            i, j = np.concatenate([np.zeros(0, dtype=np.int64), *left]), np.concatenate([np.zeros(0, dtype=np.int64), *right])
            swap = key[i] > key[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            _, one = np.unique(key[i] * (key.max() + 1) + key[j], return_index=True)
            keys = table.column(4).combine_chunks()
            if len(told) > MEMO:
                told.clear()
            both = [(x, y) for x, y in zip(*(keys.take(pa.array(e[one], pa.int64())).to_pylist() for e in (i, j)), strict=True) if x + y not in told]
            told.update(x + y for x, y in both)
            if more and None not in told:
                told.add(None)
                both.append((None, None))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in both], pa.binary()) for k in (0, 1)], names=["ka", "kb"])

    return run


def _closest(pairs: np.ndarray, comp: np.ndarray, each: int) -> tuple[np.ndarray, bool]:
    """Of the pairs (i, j, distance) the ``each`` closest of every component but the largest, each pair once; and whether that left pairs out."""
    i, j = pairs[0].astype(np.int64), pairs[1].astype(np.int64)
    low, high = np.minimum(i, j), np.maximum(i, j)
    _, one = np.unique(low * len(comp) + high, return_index=True)
    low, high, distance = low[one], high[one], pairs[2, one]
    kept = np.zeros(len(one), dtype=bool)
    large = np.bincount(comp).argmax() if len(comp) else -1
    at = np.tile(np.arange(len(one)), 2)
    own = np.concatenate([comp[low], comp[high]])
    at, own = at[own != large], own[own != large]
    order = np.lexsort((high[at], low[at], distance[at], own))
    start = np.flatnonzero(np.diff(own[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    kept[at[order[rank < each]]] = True
    return np.stack([low, high, distance])[:, kept], not kept.all()


def shingle_classes(docs: DataFrame) -> DataFrame:
    """(doc, n, key, sketch) of each document: set size, set key (null for the empty set), bitmap; other columns follow."""
    others = [c for c in docs.columns if c not in ("doc", "text")]
    types = dict(docs.dtypes)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for piece in blocks(texts, BLOCK):
                h, n = shingle_sets(texts[piece])
                a, b = set_keys(h, n)
                ends = np.cumsum(n)
                both = np.stack([a, b], axis=1)
                keys = [both[i].tobytes() if n[i] else None for i in range(len(n))]
                bitmaps = [sketch(h[e - k : e]) if k else None for e, k in zip(ends, n, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.start, len(n)), pa.array(n.astype(np.int64)), pa.array(keys, pa.binary()), pa.array(bitmaps, pa.binary()), *(c.slice(piece.start, len(n)) for c in batch.columns[2:])], names=["doc", "n", "key", "sketch", *others])

    return docs.select("doc", "text", *others).mapInArrow(lambda batches: released(run(batches)), ", ".join(["doc long, n long, key binary, sketch binary", *(f"{c} {types[c]}" for c in others)]))


def _checked(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The links among (ka, kb): each class's text is that of its document ``rep``."""
    ends = pairs.select("ka").union(pairs.select("kb")).distinct().withColumnRenamed("ka", "key")
    reps = ends.join(classes.select("key", "rep"), "key")
    texts = docs.join(reps.withColumnRenamed("rep", "doc"), "doc").select("key", "doc", "text")
    # several rows may share the id of a class's document; all of its texts are checked
    both = pairs.join(texts.select(F.col("key").alias("ka"), F.col("text").alias("ta")), "ka").join(texts.select(F.col("key").alias("kb"), F.col("text").alias("tb")), "kb")
    return both.select("ka", "ta", "kb", "tb").mapInArrow(lambda batches: released(_verify(batches)), "ka binary, kb binary").distinct()


def link_classes(docs: DataFrame, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(table of documents, (node, root) of linked set keys). docs: doc, text, with no null in doc, and columns that the table keeps."""
    spark = docs.sparkSession
    table = cut(shingle_classes(docs))
    classes = table.where("key is not null").groupBy("key").agg(F.min("doc").alias("rep"))
    total = table.agg(F.sum("n")).first()[0] or 0
    ranges = 1 << max(4, int(max(4 * partitions(spark), total // 1_000_000) - 1).bit_length())
    packed = signature_rows(docs, ranges).repartition(max(partitions(spark), 8), "part").sortWithinPartitions("part")
    met = cut(packed.mapInArrow(lambda batches: released(_runs(batches)), "kind byte, x long, y long"))
    involved = met.select(F.explode(F.when(F.col("kind") == 0, F.array("x", "y")).otherwise(F.array("y"))).alias("doc")).distinct()
    key_of = cut(table.where("key is not null").select("doc", "key", "n", "sketch").join(involved, "doc", "left_semi"))
    pairs = met.where("kind = 0").select("x", "y").distinct()
    left = key_of.select(F.col("doc").alias("x"), F.col("key").alias("k1"), F.col("n").alias("n1"), F.col("sketch").alias("s1"))
    right = key_of.select(F.col("doc").alias("y"), F.col("key").alias("k2"), F.col("n").alias("n2"), F.col("sketch").alias("s2"))
    screened = pairs.join(left, "x").join(right, "y").where("k1 != k2").select("k1", "n1", "s1", "k2", "n2", "s2").mapInArrow(lambda batches: released(_screen(batches)), "ka binary, kb binary")
    screened = cut(screened.select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb")).distinct())
    links = cut(_checked(screened, classes, docs))
    roots = components(links, "ka", "kb")
    thin = key_of.select("key", "n", "sketch").mapInArrow(_thinned, "key binary, n long, sketch binary").groupBy("key").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    whole = key_of.groupBy("key").agg(F.min("n").alias("n"), F.min("sketch").alias("s"))
    # pairs of a run that none of its first links has brought together: the closest ones of each component at first,
    # then what is left between those that these didn't join, until no pair is left out
    tried, each, crossing = screened, EACH, None
    while True:
        named = key_of.select("doc", "key") if crossing is None else crossing.select("run", "key")
        comps = spread_join(named, roots.withColumnRenamed("node", "key"), "key", "doc" if crossing is None else "run", "left").withColumn("comp", F.coalesce("root", "key")).drop("root")
        inside = met.where("kind = 1").select(F.col("x").alias("run"), F.col("y").alias("doc")).distinct().join(comps, "doc").select("run", "key", "comp") if crossing is None else comps
        mixed = inside.groupBy("run").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("m")).where("c0 != c1").select("run", F.ceil(F.col("m") / F.lit(tile)).cast("int").alias("c"))
        before, crossing = crossing, cut(inside.join(mixed, "run").distinct())
        if before is None:
            let_go(met)
        else:
            let_go(before)
        found = cut(_tiles(crossing, thin).mapInArrow(lambda batches, run=_cross(each): released(run(batches)), "ka binary, kb binary").distinct())
        more = found.where("ka is not null").join(tried, ["ka", "kb"], "left_anti")
        both = more.join(whole.select(F.col("key").alias("ka"), F.col("n").alias("na"), F.col("s").alias("sa")), "ka").join(whole.select(F.col("key").alias("kb"), F.col("n").alias("nb"), F.col("s").alias("sb")), "kb")
        linked = cut(_checked(both.select("ka", "na", "sa", "kb", "nb", "sb").mapInArrow(_screen, "ka binary, kb binary"), classes, docs))
        left_out = found.where("ka is null").limit(1).count()
        if linked.limit(1).count():
            roots = components(roots.select(F.col("node").alias("ka"), F.col("root").alias("kb")).union(linked), "ka", "kb")
        if not left_out:
            let_go(key_of, screened, crossing)
            return table, roots
        tried, each = tried.union(found.where("ka is not null")), each * 512  # most components are one by now


def _tiles(inside: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Rows (run, ta, tb, side, key, comp, n, sketch), sorted: each run cut into ``c`` sides, each two of which meet in a task."""
    rows = inside.join(bitmaps, "key").withColumn("side", F.pmod(F.xxhash64("key"), F.col("c")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    rows = rows.select("run", F.least("side", "other").alias("ta"), F.greatest("side", "other").alias("tb"), "side", "key", "comp", "n", "sketch")
    return rows.repartition(max(partitions(inside.sparkSession), 8), "run", "ta", "tb").sortWithinPartitions("run", "ta", "tb")


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are maximal runs of anything but ASCII white space, A-Z lower-cased;
    a document's set holds its distinct runs of five words, or with fewer
    words the whole sequence as one. Sets link at a Jaccard similarity of at
    least 0.8; component_id is the smallest id reachable. A null or empty
    text, or one of white space, has the empty set, which links with nothing:
    its component is its own id. Rows that repeat an id keep a row each; rows
    of one id with different texts aren't compared with each other. A null id
    counts as the smallest and stays null.
    """
    docs = df.select(F.coalesce(F.col(key).cast("long"), F.lit(LOW)).alias("doc"), F.col(text).cast("string").alias("text"))
    table, roots = link_classes(docs)
    lows = roots.join(table.groupBy("key").agg(F.min("doc").alias("rep")), F.col("node") == F.col("key")).groupBy("root").agg(F.min("rep").alias("low"))
    linked = spread_join(roots, lows, "root", "node").select(F.col("node").alias("key"), F.col("low").alias("linked"))
    # copies of one text may be a third of all rows; a set without links has its own smallest id
    own = table.where("key is not null").groupBy("key").agg(F.min("doc").alias("own")).join(linked, "key", "left").select("key", F.coalesce("linked", "own").alias("low"))
    out = spread_join(table.select("doc", "n", "key"), own, "key", "doc", "left").select("doc", "n", F.coalesce("low", "doc").alias("low"))
    real = lambda c: F.when(F.col(c) != LOW, F.col(c))
    return out.select(real("doc").alias("doc_id"), F.col("n").alias("n_shingles"), real("low").alias("component_id"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each group: the one of the smallest id, null ids last, and of rows with equal ids that of the smallest text hash; all columns stay.

    Rows are compared whatever their ids: those with null ids or of one id
    with different texts link like any others. Of rows with equal ids and
    texts any one stays. Documents with the empty set all stay.
    """
    names = df.columns
    gone_id, gone_mark = free(names, "id__", "mark__")
    number, mark = F.col(f"`{key}`").cast("long"), F.xxhash64(F.col(f"`{text}`").cast("string"))
    docs = df.select(number.alias("id"), mark.alias("mark"), F.col(f"`{text}`").cast("string").alias("text"))
    repeated = docs.where("id is not null").groupBy("id").count().where("count > 1").limit(1).count()
    own = F.xxhash64("id", "mark")  # rows that share an id need names of their own to be compared; ids pack better
    table, roots = link_classes(docs.withColumn("doc", own if repeated else F.coalesce("id", own)))
    filled = table.where("key is not null")
    named = spread_join(filled.select("id", "mark", "key"), roots.withColumnRenamed("node", "key"), "key", "mark", "left").select("id", "mark", F.coalesce("root", "key").alias("comp"))
    first = named.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull(), "id", "mark")).alias("first"))
    goes = spread_join(named, first, "comp", "mark").where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark"))))
    goes = goes.select(F.col("id").alias(gone_id), F.col("mark").alias(gone_mark)).distinct()
    same = number.eqNullSafe(F.col(gone_id)) & (mark == F.col(gone_mark))
    left = df.join(goes, same, "left_anti").select(*(F.col(f"`{c}`") for c in names))
    twice = filled.groupBy("id", "mark").count().where("count > 1").select(F.col("id").alias(gone_id), F.col("mark").alias(gone_mark))
    if not twice.limit(1).count():
        return left
    return left.join(twice, same, "left_anti").union(left.join(twice, same, "left_semi").dropDuplicates([key, text]))
