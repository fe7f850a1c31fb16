"""What the vector operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there, is not empty, and holds finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def matrix(column, width: int, kind: str):
    """Rows of a binary column, each ``width`` numbers of a dtype, as a matrix."""
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)
