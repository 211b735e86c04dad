"""Python work on one column, in Arrow batches; every other column passes through untouched."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

_ARROW = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


def pieces_of(sizes: np.ndarray, rows: int, n_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows and ``n_bytes`` bytes; a longer text stands alone."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = min(a + rows, max(a + 1, int(np.searchsorted(ends, n_bytes + (ends[a - 1] if a else 0), "right"))))
        yield a, b
        a = b


def map_column(df: DataFrame, column: str, make: Callable[[], Callable], new: str, rows: int = 1000, n_bytes: int = 8 << 20) -> DataFrame:
    """``df`` without ``column`` (string or binary), with the columns ``new`` (as DDL).

    ``make()`` gives, once a task, a function of a list of values. It returns
    the new columns as lists, after the number of rows that each value gives, or
    None where that is one. Ids and other columns never become pandas, so null
    ones leave the others as they are. Lists are cut by rows and by bytes.
    """
    added = StructType.fromDDL(new)
    kept = [f for f in df.schema.fields if f.name != column]
    clash = {f.name for f in kept} & set(added.names)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    kinds = [_ARROW[f.dataType.simpleString()] for f in added.fields]
    names, at = [*(f.name for f in kept), *added.names], df.columns.index(column)
    others = [i for i, c in enumerate(df.columns) if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            values = batch.column(at)
            sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
            for a, b in pieces_of(sizes, rows, n_bytes):
                times, *found = work(values.slice(a, b - a).to_pylist())
                rest = [batch.column(i).slice(a, b - a) for i in others]
                if times is not None:
                    take = pa.array(np.repeat(np.arange(b - a), times))
                    rest = [x.take(take) for x in rest]
                yield pa.RecordBatch.from_arrays([*rest, *(pa.array(x, kind) for x, kind in zip(found, kinds, strict=True))], names=names)

    return df.mapInArrow(run, StructType([*kept, *added.fields]))
