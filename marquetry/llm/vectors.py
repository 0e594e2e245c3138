"""What operators on embeddings share: which vectors count, whole numbers of their entries, and Arrow lists as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole numbers of entries are held within these bounds, so that a double of any size has one.
MOST = float(1 << 61)


def whole(vector: Column) -> Column:
    """True where a vector has no null and no entry that is null, infinite or not a number."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & F.coalesce(~odd, F.lit(False))


def floored(vector: Column, times: float, plus: int = 0) -> Column:
    """``floor(times * entry) + plus`` of each entry, as array of long."""

    def one(c: Column) -> Column:
        x = F.greatest(F.least(c.cast("double") * times, F.lit(MOST)), F.lit(-MOST))
        return F.floor(x).cast("long") + F.lit(plus).cast("long")

    return F.transform(vector, one)


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``length, rows, matrix`` for each length of the vectors in a column of lists of long without nulls."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        if len(rows) == len(lengths):
            yield int(d), rows, values.reshape(-1, d)
        else:
            yield int(d), rows, values[(ends[rows] - d)[:, None] + np.arange(d)]
