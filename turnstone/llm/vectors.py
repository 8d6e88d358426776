"""What the operators on vectors share: clean rows of a vector column, and its integer form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integer components lie within this, so that sums of squares over some hundreds of dimensions are exact as longs.
MOST = 1 << 26


def width_of(rows: DataFrame, vector: str = "embedding") -> int:
    """The length that most vectors have, the smaller of equals; 0 where there is none. One small aggregate."""
    lengths = rows.where(F.size(F.col(f"`{vector}`")) > 0).groupBy(F.size(F.col(f"`{vector}`")).alias("w")).count()
    most = lengths.orderBy(F.desc("count"), "w").first()
    return most.w if most else 0


def clean(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column with the given length and finite components alone, as doubles, and which rows these are."""
    own = np.asarray(column.value_lengths().fill_null(-1)) == width
    rows = np.flatnonzero(own)
    kept = column if own.all() else column.filter(pa.array(own))
    values = kept.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    finite = np.isfinite(values).all(axis=1)
    return (values, rows) if finite.all() else (values[finite], rows[finite])


def floors(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) as longs, components beyond MOST at MOST."""
    return np.clip(np.floor(256 * values), -MOST, MOST).astype(np.int64)
