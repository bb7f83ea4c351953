"""Groups of rows that follow each other in sorted Arrow batches."""

from __future__ import annotations

import pyarrow as pa


def grouped(batches, n_keys: int, least_rows: int = 1):
    """Yields tables that hold whole groups of the first ``n_keys`` columns, of ``least_rows`` rows or more where there are so many.

    Rows must come sorted by these columns. What is held back is one group and
    one batch.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and rows >= least_rows:
            last = held[-1]
            key = [last.column(i)[last.num_rows - 1].as_py() for i in range(n_keys)]
            at = _first_other(batch, key)
            if at < batch.num_rows:
                if at:
                    held.append(batch.slice(0, at))
                yield pa.Table.from_batches(held)
                held, rows, batch = [], 0, batch.slice(at)
        held.append(batch)
        rows += batch.num_rows
        if rows >= least_rows:
            at = _last_start(batch, n_keys)
            if at:
                held[-1] = batch.slice(0, at)
                yield pa.Table.from_batches(held)
                held, rows = [batch.slice(at)], batch.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def _first_other(batch: pa.RecordBatch, key: list) -> int:
    low, high = 0, batch.num_rows
    while low < high:
        mid = (low + high) // 2
        if [batch.column(i)[mid].as_py() for i in range(len(key))] == key:
            low = mid + 1
        else:
            high = mid
    return low


def _last_start(batch: pa.RecordBatch, n_keys: int) -> int:
    """Where the last group of the batch begins."""
    key = [batch.column(i)[batch.num_rows - 1].as_py() for i in range(n_keys)]
    low, high = 0, batch.num_rows - 1
    while low < high:
        mid = (low + high) // 2
        if [batch.column(i)[mid].as_py() for i in range(n_keys)] == key:
            high = mid
        else:
            low = mid + 1
    return low
