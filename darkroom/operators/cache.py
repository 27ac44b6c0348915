"""The metric cache: which scanned items need computing, and the cache after a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.functions.paths import parent
from darkroom.runtime import discard, materialise
from darkroom.schema import CACHE, METRICS_VERSION

#: Bits of computed_mask by optional output.
OUTPUT_BITS = {"aesthetic": 1, "is_utility": 2, "face_quality": 4, "fprint": 8}


def output_mask(outputs) -> int:
    """The mask of a set of optional outputs."""
    return sum(OUTPUT_BITS[o] for o in outputs)


def valid(outputs=frozenset(), version: int = METRICS_VERSION) -> Column:
    """Whether a cache row (size, mtime, ver, computed_mask as c_*) serves a scanned item: nothing changed, and all outputs were computed."""
    mask = output_mask(outputs)
    return F.coalesce(
        (F.col("size") == F.col("c_size")) & (F.col("mtime") == F.col("c_mtime")) & (F.col("c_ver") == version) & (F.col("c_mask").bitwiseAND(F.lit(mask)) == mask), F.lit(False)
    )


def split(scan: DataFrame, cache: DataFrame, outputs=frozenset(), version: int = METRICS_VERSION) -> DataFrame:
    """The scan with ``is_hit``: one left join on the item, whichever way Spark plans it."""
    keys = cache.select("cache_id", F.col("size").alias("c_size"), F.col("mtime").alias("c_mtime"), F.col("ver").alias("c_ver"), F.col("computed_mask").alias("c_mask"))
    return scan.join(keys, "cache_id", "left").withColumn("is_hit", valid(outputs, version)).drop("c_size", "c_mtime", "c_ver", "c_mask")


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cache rows after a run: fresh rows without error replace rows of the same item."""
    new = fresh.where(F.coalesce(F.col("error"), F.lit("")) == "")
    return cache.join(new.select("cache_id"), "cache_id", "left_anti").unionByName(new)


def bucket_of(cache_id: Column, buckets: int) -> Column:
    """The bucket of an item: by its folder, so that new files of one folder touch one bucket; by its id if that has no folder."""
    return F.pmod(F.xxhash64(F.when(F.contains(cache_id, F.lit("/")), parent(cache_id)).otherwise(cache_id)), F.lit(buckets)).cast("int")


class BucketedCache:
    """The cache as a table of buckets, of which a run reads and rewrites only those that it touches.

    Buckets are folders; touched ones are replaced together when all of them have been written (Spark's dynamic partition overwrite). A run that dies leaves each bucket
    as it was or as it would be, and every row that is there is judged by ``valid`` anyway. A missing folder is an empty cache. The number of buckets is part of the layout.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256, schema: str = CACHE):
        self.spark, self.path, self.buckets, self.schema = spark, path.rstrip("/"), buckets, schema

    def touched(self, items: DataFrame) -> list[int]:
        """Buckets of some items: at most as many as there are."""
        return sorted(r["bucket"] for r in items.select(bucket_of(F.col("cache_id"), self.buckets).alias("bucket")).distinct().collect())

    def read(self, only: list[int] | None = None) -> DataFrame:
        """Rows of the cache, or of some buckets."""
        names = [c.split()[0] for c in self.schema.split(", ")]
        jvm = self.spark.sparkContext._jvm
        fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        there = [b for b in (range(self.buckets) if only is None else only) if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={b}"))]
        if not there:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(f"{self.schema}, bucket int").option("basePath", self.path).parquet(*[f"{self.path}/bucket={b}" for b in there]).select(*names)

    def upsert(self, fresh: DataFrame) -> list[int]:
        """Put fresh rows without error in the place of rows of the same items; returns the buckets that were rewritten."""
        new = materialise(fresh.where(F.coalesce(F.col("error"), F.lit("")) == ""), "cache-fresh")
        touched = self.touched(new)
        if touched:
            rows = materialise(upsert(self.read(touched), new).withColumn("bucket", bucket_of(F.col("cache_id"), self.buckets)), "cache-buckets")
            # large buckets are written by several tasks
            spread = rows.hint("rebalance", F.col("bucket"))
            spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
            discard(rows)
        discard(new)
        return touched
