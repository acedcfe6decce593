"""Running totals and row numbers over a whole table, without a window that sends all rows to one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import checkpoint


def running(df: DataFrame, order: Sequence[Column | str], sums: Mapping[str, Column | str]) -> DataFrame:
    """``df`` with a column for each of ``sums``: its running total in ``order``, which should tell rows apart.

    Rows are dealt by range of the order and written, so that ranges stay what they are; each range is summed and
    takes on the sum of the ranges before it. Only those sums, one row a shuffle partition, meet in one task.
    """
    parts = df.withColumns({f"_x_{n}": c if isinstance(c, Column) else F.col(c) for n, c in sums.items()})
    rows = checkpoint(parts.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    each = rows.groupBy("_range").agg(*[F.sum(f"_x_{n}").alias(f"_s_{n}") for n in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.broadcast(each.select("_range", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums]))
    upto = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(before, "_range").select(*df.columns, *[(F.sum(f"_x_{n}").over(upto) + F.col(f"_b_{n}")).alias(n) for n in sums])


def numbered(df: DataFrame, order: Sequence[Column | str], name: str, first: int = 0) -> DataFrame:
    """``df`` with the row's number in ``order``, counted from ``first``."""
    return running(df, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) + (first - 1))
