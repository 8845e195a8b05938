"""Arrow batches of sorted rows, cut into tables of many whole groups.

A call for each small group costs more than its arithmetic. Rows arrive sorted by
the keys of their group alone, and a table of many groups is worked on at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

# Fixed value: rows of whole groups worked on together; one longer group is a table of its own.
TOGETHER = 1 << 15
TOO_LONG = "A series is longer than the bound that was promised."


def starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """First row of each run of equal keys; a NULL key is a group too."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        code = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def in_order(table: pa.Table, keys: Sequence[str], within: Sequence[str]) -> pa.Table:
    """The rows of each group sorted by ``within``, whole numbers without NULL; ties keep their order."""
    group = np.zeros(table.num_rows, np.int64)
    group[starts(table, keys)[1:]] = 1
    columns = [group.cumsum(), *(table.column(c).to_numpy() for c in within)]
    order = np.lexsort(columns[::-1])
    return table if (order[1:] > order[:-1]).all() else table.take(pa.array(order)).combine_chunks()


def whole_groups(batches, keys: Sequence[str], within: Sequence[str], limit: int) -> Iterator[pa.Table]:
    """Tables of whole groups of at most ``limit`` rows, sorted in themselves; a longer group fails before it is gathered whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < TOGETHER:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = int(starts(table, keys)[-1])
        if table.num_rows - last > limit:
            raise ValueError(TOO_LONG)
        if last:
            yield in_order(table.slice(0, last), keys, within)
        held = table.slice(last).to_batches()
    table = pa.Table.from_batches(held).combine_chunks() if held else None
    if table is not None and table.num_rows:
        yield in_order(table, keys, within)


class Lists:
    """A column of number lists; ``rows(a, b)`` are the values of a run of rows, one after another."""

    def __init__(self, column: pa.ChunkedArray):
        whole = column.combine_chunks()
        self._starts, self._values = whole.offsets.to_numpy(), whole.values.to_numpy(zero_copy_only=False)

    def rows(self, a: int, b: int) -> np.ndarray:
        return self._values[self._starts[a] : self._starts[b]]


def lists(values: np.ndarray) -> pa.ListArray:
    """One list for each row of a matrix."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.ravel()))
