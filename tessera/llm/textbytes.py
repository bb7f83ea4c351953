"""Hashes of all words of a block of texts at once, from their bytes."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from tessera.llm.common import mix64

#: ASCII white space, and letters folded to lower case.
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def worker_state(name: str, make: Callable):
    """One object a Python worker keeps between its tasks; it must be a pure function of ``name``, a cache or a loaded file."""
    store = sys.modules.setdefault("_tessera_worker", types.ModuleType("_tessera_worker")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def released(batches):
    """``batches``, and then the worker's unused memory goes back to the system."""
    try:
        yield from batches
    finally:
        hand_back()


def hand_back() -> None:
    """Gives memory that this process no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


class _Powers:
    """Powers of one odd ratio and of its inverse, as far as they were needed."""

    RATIO = 0x5851F42D4C957F2D

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            ratios = self.RATIO, pow(self.RATIO, -1, 1 << 64)
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, np.uint64(r), dtype=np.uint64))]) for r in ratios)


class Rolling:
    """64-bit polynomial hashes of byte runs; each byte value counts as a random number, A-Z as a-z."""

    def __init__(self, seed: int):
        self.values = np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64)[FOLD]

    def runs(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(buf)
        powers = worker_state("powers", _Powers)
        powers.grow(n)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(self.values[buf] * powers.up[:n], out=sums[1:])
            h = (sums[ends] - sums[starts]) * powers.down[starts]
            return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes, a line break after each; and where each begins."""
    blobs = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    sizes = np.array([len(b) + 1 for b in blobs], dtype=np.int64)
    return np.frombuffer(b"\n".join(blobs) + b"\n", dtype=np.uint8), np.cumsum(sizes) - sizes


def word_spans(buf: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't ``blank``; ``buf`` ends with a blank."""
    filled = ~blank[buf]
    edge = np.flatnonzero(np.diff(filled, prepend=False))
    return edge[::2], edge[1::2]


def word_hashes(texts: list[str | None], rolling: Rolling, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text; and how many words each text has."""
    buf, begin = joined(texts)
    starts, ends = word_spans(buf, blank)
    owner = np.searchsorted(begin, starts, side="right") - 1
    return rolling.runs(buf, starts, ends), np.bincount(owner, minlength=len(texts))


def blocks(texts: list[str | None], limit: int):
    """Slices of ``texts`` of about ``limit`` characters; a longer text is a slice of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        own = len(text or "") + 1
        if i > start and size + own > limit:
            yield slice(start, i)
            start, size = i, 0
        size += own
    if start < len(texts):
        yield slice(start, len(texts))
