"""Arrow batches of rows sorted by a group key, cut into whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches, key: str) -> Iterator[pa.Table]:
    """One table for each run of equal keys; a run may go on over several batches."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if waiting and waiting[-1].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(waiting)
            waiting = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if waiting and a:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(a, b - a))
    if waiting:
        yield pa.Table.from_batches(waiting)
