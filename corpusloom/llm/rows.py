"""Rows told apart by where they are stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stored_row() -> Column:
    """File (as a 64-bit hash of its path) and place in the file of a row of a Parquet table.

    Numbers by partition change when a table is read again with more or fewer
    executors, since its splits depend on them; these stay. They are there for
    a table that was read from Parquet and then only filtered or projected.
    """
    return F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
