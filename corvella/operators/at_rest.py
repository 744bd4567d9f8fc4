"""Tables at rest, in hash buckets: a change rewrites the buckets that it touches and no other.

Each row carries the version of the change that wrote it, and a change leaves rows of its own or a later version alone. So
a change that was cut off can be made again, and one that comes twice changes nothing. One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from ..sources.streams import shared_folder

VERSION, GONE = "row_version", "row_gone"


@dataclass(frozen=True)
class Table:
    """A table of parquet files below path with rows of schema and a key that is unique and not null.

    Buckets are folders; so many that a bucket's rows fit a few tasks, for the whole life of the table."""

    path: str
    key: str
    schema: StructType
    buckets: int = 64

    @property
    def _bucket(self) -> str:
        return f"bucket_of_{self.buckets}"

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self._bucket, F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int"))

    def _whole(self, spark: SparkSession) -> DataFrame:
        more = [StructField(VERSION, LongType()), StructField(GONE, BooleanType()), StructField(self._bucket, IntegerType())]
        return spark.read.schema(StructType([*self.schema.fields, *more])).parquet(self.path)

    def _write(self, rows: DataFrame) -> None:
        # Rows of a bucket meet in one file or, where they are many, in several.
        rows.hint("rebalance", self._bucket).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self._bucket).parquet(self.path)

    def create(self, spark: SparkSession) -> Table:
        """Makes the table, without rows, where there is none."""
        self._write(self._placed(spark.createDataFrame([], self.schema).withColumns({VERSION: F.lit(0).cast("long"), GONE: F.lit(False)})))
        return self

    def read(self, spark: SparkSession) -> DataFrame:
        return self._whole(spark).where(~F.col(GONE)).drop(VERSION, GONE, self._bucket)

    def change(self, changes: DataFrame, version: int, when: Column | None = None, staged: bool = True) -> list[int]:
        """Puts changes (the key and any other columns) into the table; returns the buckets that were rewritten.

        Columns that changes has not keep their values, and are null in new rows. Of several changes of a key the greatest counts,
        by the columns that are neither maps nor binary; null keys are left out. when: the rows of the table that may be changed (those that are new always are).
        staged: the changes are made once and written to the shared folder; else they are made up to three times, without what is not needed,
        which is better for large values that cost little."""
        return self._put(changes, version, F.col(GONE) | (F.lit(True) if when is None else F.coalesce(when, F.lit(False))), False, staged)

    def delete(self, keys: DataFrame, version: int) -> list[int]:
        """Takes the rows with these keys out; returns the buckets that were rewritten. The key stays, with the version."""
        return self._put(keys.select(self.key), version, ~F.col(GONE), True, True)

    def _put(self, changes: DataFrame, version: int, when: Column, gone: bool, staged: bool) -> list[int]:
        spark, key = changes.sparkSession, self.key
        columns = [c for c in changes.columns if c != key]
        order = [f.name for f in changes.schema if "map<" not in f.dataType.simpleString() and "binary" not in f.dataType.simpleString()]
        new = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns, F.lit(gone).alias(GONE)), F.struct(*order)).alias("new"))
        new = self._placed(new).withColumnRenamed(self._bucket, "b")
        if staged:
            path, schema = shared_folder(spark), new.schema
            new.write.parquet(path)
            new = spark.read.schema(schema).parquet(path)
        old = self._whole(spark)
        may = (F.col(VERSION) < version) & when
        asked = [r.b for r in new.select("b").distinct().collect()]  # at most as many as there are buckets
        known = old.where(F.col(self._bucket).isin(asked)).select(F.col(key), may.alias("may"))
        open_ = new.join(known, key, "left").where(F.coalesce("may", F.lit(not gone)))
        touched = sorted(r.b for r in open_.select("b").distinct().collect())
        if touched:
            own = old.where(F.col(self._bucket).isin(touched)).withColumn("may", may)
            merged = own.join(new.where(F.col("b").isin(touched)).drop("b"), key, "left" if gone else "full_outer")
            put = F.col("new").isNotNull() & F.coalesce("may", F.lit(True))
            before = lambda c: F.when(~(put & F.coalesce(GONE, F.lit(False))), F.col(c))  # noqa: E731  a row that was gone begins anew
            out = [F.when(put, F.col(f"new.{f.name}")).otherwise(F.col(f.name)).alias(f.name) if f.name in columns else (F.col(key) if f.name == key else before(f.name).alias(f.name)) for f in self.schema.fields]
            marks = {VERSION: F.when(put, F.lit(version)).otherwise(F.col(VERSION)).cast("long"), GONE: F.when(put, F.lit(gone)).otherwise(F.col(GONE))}
            self._write(self._placed(merged.select(*out, *[c.alias(n) for n, c in marks.items()])))
        return touched
