"""Row numbers within groups of any size: no task takes a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.streams import shared_folder


def numbered(rows: DataFrame, by: str, *order: str, name: str = "row_no") -> DataFrame:
    """rows with their place (from 0) among those with the same value of by, in the order of the columns; rows equal in all are ordered anyhow.

    Rows are dealt out by ranges of group and order and written, so that a large group lies in several ranges; each range is
    numbered for itself, and what the earlier ranges of its group hold is added. Only one group can begin before a range
    does, so that as many sums are broadcast as there are ranges at most. A null group is a group."""
    part, before = "_part", "_before"
    path = shared_folder(rows.sparkSession)
    rows.repartitionByRange(F.col(by), *[F.col(c) for c in order]).withColumn(part, F.spark_partition_id()).write.parquet(path)
    dealt = rows.sparkSession.read.parquet(path)
    earlier = Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(by, part).agg(F.count("*").alias("n")).withColumn(before, F.sum("n").over(earlier)).where(F.col(before) > 0).select(F.col(by).alias("_by"), F.col(part).alias("_at"), before)
    own = F.row_number().over(Window.partitionBy(by, part).orderBy(*order)) - 1
    joined = dealt.withColumn(name, own).join(F.broadcast(sums), F.col(by).eqNullSafe(F.col("_by")) & (F.col(part) == F.col("_at")), "left")
    return joined.withColumn(name, (F.col(name) + F.coalesce(before, F.lit(0))).cast("long")).drop(part, before, "_by", "_at")


def batched(rows: DataFrame, n: int, by: str, *order: str) -> DataFrame:
    """rows with batch_no: of n rows each, in order, within the group."""
    return numbered(rows, by, *order, name="_no").withColumn("batch_no", F.expr(f"_no div {int(n)}")).drop("_no")

