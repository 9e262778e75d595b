"""Row helpers that keep Catalyst from repeating expensive per-row work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_where(df: DataFrame, columns: list[Column], keep: Callable[[Column], Column]) -> DataFrame:
    """``df.select(*columns).where(keep(row))``, evaluating the columns once.

    A plain ``where`` on a computed column is pushed below the projection
    with the column's expression inlined, so an expensive expression (a text
    normaliser) runs twice per row. Here the row is built as one struct and
    kept or dropped inside a generator, which nothing is pushed through."""
    row = F.struct(*columns)
    return df.select(F.inline(F.filter(F.array(row), keep)))


#: bytes of input (as Spark estimates them) up to which rows are dealt anew
SMALL_INPUT = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input evenly. Parquet is read a row group at a
    time, so a table of some megabytes may be one row group, and all text work
    over it one task. Inputs beyond ``SMALL_INPUT`` have row groups enough and are
    left as they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_INPUT else df
