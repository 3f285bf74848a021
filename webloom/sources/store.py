"""Tables that are written to: rows by key in hash buckets, of which a write replaces those that hold a changed key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from webloom.session import shared_folder


class KeyedTable:
    """A Parquet table with a directory for each bucket of its key, for one writer at a time.

    A write reads the buckets of the keys that it is given, makes their new rows, settles these in the shared folder, and
    then replaces these buckets by dynamic partition overwrite; other buckets' files stay as they are. A job that fails
    before the overwrite has changed nothing. One that fails in it leaves whole buckets, old or new, and can be run again
    wherever the change gives the same rows when applied twice, as all below do.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.crc32(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _path(self, bucket: int | None = None):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path if bucket is None else f"{self.path}/bucket={bucket}")

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _all(self) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        if not self._files().exists(self._path()):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self._all().drop("bucket")

    def of(self, keys: list) -> DataFrame:
        """The rows of a few keys, from their buckets alone."""
        named = self.spark.createDataFrame([(k,) for k in keys], f"`{self.key}` {self.schema[self.key].dataType.simpleString()}")
        buckets = [r["bucket"] for r in named.select(self._bucket().alias("bucket")).distinct().collect()]
        return self._all().where(F.col("bucket").isin(buckets) & F.col(self.key).isin(keys)).drop("bucket")

    def change(self, rows: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replaces the buckets of the keys in `rows` by combine(their old rows, rows); returns these buckets. Null keys are left out.

        The list of buckets is as long as the table has buckets at most.
        """
        shared_folder(self.spark)
        rows = rows.where(F.col(self.key).isNotNull()).checkpoint()
        touched = sorted(r["bucket"] for r in rows.select(self._bucket().alias("bucket")).distinct().collect())
        if not touched:
            return []
        made = combine(self._all().where(F.col("bucket").isin(touched)).drop("bucket"), rows)
        made = made.select(*self.schema.fieldNames()).withColumn("bucket", self._bucket()).checkpoint()
        made.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)
        left = {r["bucket"] for r in made.select("bucket").distinct().collect()}
        for bucket in set(touched) - left:  # an overwrite leaves a bucket that lost all its rows
            self._files().delete(self._path(bucket), True)
        return touched

    def put(self, rows: DataFrame, newest: list[str]) -> list[int]:
        """Puts rows in by key: of the old and new rows of a key the one that is greatest in the columns `newest` stays, and so
        the order of writes doesn't matter."""
        names = self.schema.fieldNames()
        order = F.struct(*newest, *[c for c in names if c not in newest])

        def combine(old: DataFrame, new: DataFrame) -> DataFrame:
            best = old.unionByName(new.select(*names)).groupBy(self.key).agg(F.max(order).alias("x"))
            return best.select("x.*")

        return self.change(rows, combine)

    def remove(self, keys: DataFrame) -> list[int]:
        """Removes the rows of the keys in `keys`."""
        return self.change(keys.select(self.key).distinct(), lambda old, new: old.join(new, self.key, "left_anti"))

    def clear(self) -> int:
        """Removes all rows; returns how many there were."""
        n = self.read().count()
        self._files().delete(self._path(), True)
        return n
