"""Numbers and running sums over a whole table in an order, without a window over all rows in one task.

Rows are range-partitioned and sorted, and the totals of the partitions (one row each) are added up. The ranged table is
stored in between, so both steps see the same partitions whatever executors are lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Store = Callable[[DataFrame], DataFrame]


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], store: Store) -> DataFrame:
    """``df`` with, for each name in ``sums``, the sum of its column over all rows before this one in ``order``
    (ascending, nulls last).

    ``store`` writes a table and reads it back. Rows that agree in the whole order lie in one partition, in any order
    between them, so the order should be nearly unique. An empty table stays empty."""
    given = df.select("*", *[c.alias(f"_sum_{name}") for name, c in sums.items()], *[c.alias(f"_by_{i}") for i, c in enumerate(order)])
    by = [F.col(f"_by_{i}").asc_nulls_last() for i in range(len(order))]
    placed = store(given.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(*[F.sum(f"_sum_{name}").alias(f"_all_{name}") for name in sums])
    # One row for each partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", *[F.coalesce(F.sum(f"_all_{name}").over(before), F.lit(0)).alias(f"_base_{name}") for name in sums])
    inside = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.select("*", *[F.coalesce(F.sum(f"_sum_{name}").over(inside), F.lit(0)).alias(f"_own_{name}") for name in sums])
    return own.join(bases, "_part").select(*df.columns, *[(F.col(f"_base_{name}") + F.col(f"_own_{name}")).alias(name) for name in sums])


def numbered(df: DataFrame, order: list[Column], store: Store, name: str = "place") -> DataFrame:
    """``df`` with dense numbers from 0 on, nulls of the order last.

    Sorted once, over ranges; what is stored has each row's partition and its place in it, so all that is left is to add
    what the partitions before hold: one row each."""
    given = df.select("*", *[c.alias(f"_by_{i}") for i, c in enumerate(order)])
    placed = store(given.orderBy(*[F.col(f"_by_{i}").asc_nulls_last() for i in range(len(order))]).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    bases = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    # One row for each partition of the sort.
    return placed.withColumn("_part", part).join(F.broadcast(bases), "_part").select(*df.columns, (F.col("_base") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias(name))
