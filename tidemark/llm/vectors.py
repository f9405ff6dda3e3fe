"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, not zero, and every component is a finite number."""
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists as one matrix of doubles."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1)


def runs(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal rows of ``keys`` start, and the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    change = np.any(keys[1:] != keys[:-1], axis=1)
    return np.concatenate([[0], np.flatnonzero(change) + 1, [len(keys)]])


def groups(batches, n_keys: int):
    """Record batches in which rows with equal values of the first ``n_keys`` columns
    stand together -> one record batch per group. Holds one group and one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)], axis=1)
        cut = runs(keys)
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            key = tuple(keys[s])
            if last is not None and key != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            last = key
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
