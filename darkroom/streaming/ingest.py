"""Incremental ingest: new image files of a folder, analysed batch by batch into the metric cache and into near-duplicate clusters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.operators import cache as cache_ops
from darkroom.operators.report import numbered_rows
from darkroom.operators.similarity import Clusters
from darkroom.runtime import materialise
from darkroom.schema import METRIC_NAMES, METRICS_VERSION
from darkroom.sources import files


def listen(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of a folder's image files: path, size, mtime; contents aren't read."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    found = stream.load(folder).select(files.plain(F.col("path")).alias("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"))
    return found.where(files.has_image_extension(F.col("path")))


def into(stream: DataFrame, table: str, checkpoint: str):
    """Append the stream's listing to a Parquet table, each file once; stops when all present files are in."""
    query = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def each_batch(stream: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand every micro-batch of what is there to ``take``, by number; an interrupted batch is handed over again."""
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class Ingest:
    """What a stream of files is taken into: the cache, ids of its files, and clusters of near-duplicates.

    A file gets its id with the batch that it came in: ids follow the order of paths in a batch, and batches follow each other. A file whose cache row is valid isn't decoded again.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: float, outputs: frozenset[str] = frozenset({"fprint"}), scorer=None):
        self.spark, self.path, self.outputs, self.scorer = spark, path.rstrip("/"), outputs, scorer
        self.cache = cache_ops.BucketedCache(spark, f"{self.path}/cache")
        self.clusters = Clusters(spark, f"{self.path}/clusters", threshold)

    def take(self, listing: DataFrame, batch: int) -> None:
        """Take in one micro-batch of a listing (path, size, mtime)."""
        seen = self.clusters._before("items", batch, "id bigint, path string")
        rows = materialise(listing.dropDuplicates(["path"]).join(seen.select("path"), "path", "left_anti").withColumn("cache_id", F.col("path")), "batch-files")
        first = (seen.agg(F.max("id")).first()[0] or 0) + 1
        items = numbered_rows(rows.select("path"), [F.col("path")], "id").select((F.col("id") + first).alias("id"), "path")
        self.clusters._write(items, "items", batch)
        old = self.cache.read(self.cache.touched(rows))
        split = materialise(cache_ops.split(rows, old, self.outputs), "batch-split")
        fresh = files.analyse(split.where("NOT is_hit").select("path", "size"), self.outputs, self.scorer).join(rows.select("path", "cache_id", "size", "mtime"), "path")
        fresh = fresh.select("cache_id", "size", "mtime", F.lit(METRICS_VERSION).alias("ver"), F.lit(cache_ops.output_mask(self.outputs)).alias("computed_mask"), *METRIC_NAMES)
        fresh = materialise(fresh, "batch-fresh")
        self.cache.upsert(fresh)
        known = fresh.select("cache_id", "fprint").unionByName(old.join(split.where("is_hit").select("cache_id"), "cache_id", "left_semi").select("cache_id", "fprint"))
        named = self.spark.read.schema("id bigint, path string").parquet(f"{self.clusters.path}/items/batch={batch}")
        self.clusters.add(known.join(named, F.col("cache_id") == F.col("path")).select("id", "fprint"), batch)

    def labels(self) -> DataFrame:
        """path, root: files in clusters, with the smallest id of their cluster."""
        items = self.clusters._before("items", 1 << 62, "id bigint, path string")
        return self.clusters.labels().join(items, F.col("node") == F.col("id")).select("path", "root")
