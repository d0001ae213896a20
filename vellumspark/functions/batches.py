"""Arrow UDFs whose workers hold a bounded stretch of texts as Python objects, however many rows Spark hands over at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Tuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: What is taken out of an Arrow batch at a time: rows at most, and bytes of their texts, besides those of the row that exceeds them.
ROWS, BYTES = 512, 1 << 20


def cuts(columns: list[pa.Array], rows: int = ROWS, size: int = BYTES) -> list[tuple[int, int]]:
    """(start, length) of the stretches of columns, by the bytes of those that hold text."""
    n = len(columns[0])
    weights = np.full(n, size / rows)
    for c in columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            weights += np.asarray(pc.fill_null(pc.binary_length(c), 0), dtype=float)
    stretch = np.ceil(np.cumsum(weights) / size)
    starts = [0, *(np.flatnonzero(np.diff(stretch)) + 1).tolist(), n]
    return [(a, b - a) for a, b in zip(starts, starts[1:]) if b > a]


def arrow_rows_udf(kind: T.DataType, f: Callable, columns: int = 1):
    """A UDF that gives ``f`` of each row of its ``columns`` columns; structs are dicts, maps lists of pairs."""
    arrow = to_arrow_type(kind)

    def stretches(columns):
        for a, n in cuts(columns):
            yield pa.array([f(*row) for row in zip(*(c.slice(a, n).to_pylist() for c in columns))], type=arrow)

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield from stretches([column])

    def several(batches: Iterator[Tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield from stretches(columns)

    return F.arrow_udf(one if columns == 1 else several, kind)
