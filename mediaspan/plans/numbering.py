"""Consecutive numbers for the rows of a table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaspan.plans.workspace import Workspace


def numbered(rows: DataFrame, by: list[str], first: int, name: str, work: Workspace) -> DataFrame:
    """rows with a column of numbers from first on, in the order of `by`, which should tell rows apart.

    Rows are range-partitioned and written; a row's number is the count of all
    earlier partitions, one small row each, and its place in its own.
    """
    dealt = work.table(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), f"numbered-{name}")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1
    return dealt.join(F.broadcast(before), "_part").withColumn(name, (F.lit(first) + F.col("_before") + place).cast("long")).drop("_part", "_before")
