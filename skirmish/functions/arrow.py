"""Helpers for Arrow batch iterators inside ``mapInArrow`` functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def change_flags(table: pa.Table, keys: list[str]) -> np.ndarray:
    """True at each row whose key differs from the row before; null equals null."""
    n = table.num_rows
    flags = np.zeros(n, dtype=bool)
    if n:
        flags[0] = True
    for k in keys:
        col = table.column(k).combine_chunks()
        if n < 2:
            break
        a, b = col.slice(0, n - 1), col.slice(1)
        diff = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        if col.null_count:
            diff = diff | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
        flags[1:] |= diff
    return flags


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Yield ``(table, starts, ends)`` of whole groups from key-sorted batches.

    Only the last, possibly unfinished group is carried to the next batch.
    """
    rest: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        # the last row before tells whether the batch goes on with the group that is kept back
        seam = pa.concat_tables([rest[-1].slice(rest[-1].num_rows - 1), t]) if rest else t
        starts = np.flatnonzero(change_flags(seam, keys)) - (1 if rest else 0)
        cut = int(starts[-1])
        if cut < 0:
            rest.append(t)
            continue
        kept = sum(x.num_rows for x in rest)
        whole = pa.concat_tables([*rest, t.slice(0, cut)]).combine_chunks()
        rest = [t.slice(cut)]
        if whole.num_rows:
            first = [0] if kept else []
            inner = starts[starts >= 0] + kept
            borders = np.array([*first, *inner.tolist()], dtype=np.int64)
            yield whole, borders[:-1], borders[1:]
    if rest:
        last = pa.concat_tables(rest).combine_chunks()
        yield last, np.array([0]), np.array([last.num_rows])


def rows_of(table: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of ``table`` in the given schema."""
    yield from table.cast(schema).to_batches(max_chunksize=20_000)
