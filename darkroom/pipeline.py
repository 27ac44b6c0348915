"""The scan pipeline: listing, cache split, metrics, verdicts, dedupe, order; and its sinks."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from darkroom.functions.paths import human_bytes
from darkroom.operators import cache as cache_ops
from darkroom.operators import dedupe as dedupe_ops
from darkroom.operators.moves import absolute, execute, quarantine_plan
from darkroom.operators.report import albums_by_signal, albums_by_tier, delete_reasons, numbered_rows, reclaimable, replace_albums, tier_summary
from darkroom.params import RunOptions
from darkroom.progress import Progress, followed
from darkroom.runtime import drop_path, materialise
from darkroom.schema import CACHE, METRIC_NAMES, METRICS, METRICS_VERSION
from darkroom.signals import Thresholds, with_verdict
from darkroom.sources import files, library
from darkroom.sources.report import write_report


class Source(Protocol):
    """An input medium."""

    def collect(self, spark: SparkSession) -> DataFrame:
        """Items to judge: seq, cache_id, path, asset_id, size, mtime."""

    def analyse(self, items: DataFrame, outputs: frozenset[str], counter=None) -> DataFrame:
        """Metrics of items: cache_id and the metric columns. ``counter``, an accumulator, counts images."""


class FilesystemSource:
    """Image files under roots."""

    def __init__(self, roots: list[str], recursive: bool = False, skip: str | None = None, scorer=None):
        self.roots, self.recursive, self.scorer, self.missing = [absolute(r) for r in roots], recursive, scorer, []
        self.skip = absolute(skip) if skip else None

    def collect(self, spark: SparkSession) -> DataFrame:
        """The listing in root and path order."""
        found, self.missing = files.scan(spark, self.roots, self.recursive, self.skip)
        numbered = numbered_rows(found, [F.col("root_ord"), F.split("path", "/")], "seq")
        return numbered.select("seq", F.col("path").alias("cache_id"), "path", F.lit("").alias("asset_id"), "size", "mtime")

    def analyse(self, items: DataFrame, outputs: frozenset[str], counter=None) -> DataFrame:
        """Metrics of listed files, read by the executors."""
        return files.analyse(items.select("path", "size"), outputs, self.scorer, counter=counter).withColumnRenamed("path", "cache_id")


class LibrarySource:
    """Images of a photo library's catalogue: tables of assets, albums and membership, and where the assets' pixels are.

    ``fetch`` are the options of ``library.enumerate_assets``. An asset has ``location`` (a file) unless its pixels are in the cloud only; then it comes out
    with an error, unless the network may be used and ``location`` is where they are downloaded to.
    """

    def __init__(self, assets: DataFrame, albums: DataFrame | None = None, membership: DataFrame | None = None, allow_network: bool = False, scorer=None, **fetch):
        self.assets, self.albums, self.membership, self.allow_network, self.scorer, self.fetch = assets, albums, membership, allow_network, scorer, fetch
        self.missing: list[str] = []

    def collect(self, spark: SparkSession) -> DataFrame:
        """The fetched assets, newest first, by asset_id; their mtime is the modification date, their size the pixels'."""
        found = library.enumerate_assets(self.assets, self.albums, self.membership, **self.fetch)
        when = F.unix_micros(F.coalesce("modification_date", "creation_date"))
        area = F.col("pixel_width").cast("bigint") * F.col("pixel_height")
        found = found.select(
            "creation_date", F.col("asset_id").alias("cache_id"), library.display_name().alias("path"), "asset_id", F.coalesce(area, F.lit(0)).alias("size"), F.coalesce(when, F.lit(0)).alias("mtime"),
            library.cloud_error(self.allow_network).alias("gate"), "location",
        )
        return numbered_rows(found, [F.desc("creation_date"), F.col("asset_id")], "seq").drop("creation_date")

    def analyse(self, items: DataFrame, outputs: frozenset[str], counter=None) -> DataFrame:
        """Metrics of fetched assets: those whose pixels are here are decoded, the others are errors."""
        here = materialise(items.where("gate = '' AND location IS NOT NULL").select("cache_id", F.col("location").alias("path"), "size"), "assets-here")
        names = [n for n in METRIC_NAMES]
        done = materialise(here.select("cache_id", "path").join(files.analyse(here, outputs, self.scorer, counter=counter), "path").select("cache_id", *names), "assets-metrics")
        gone = items.join(done.select("cache_id"), "cache_id", "left_anti")
        why = F.when(F.col("gate") != "", F.col("gate")).otherwise("no pixels")
        blank = {n: F.lit("") if k == "string" else F.lit(None).cast(k) if n in ("aesthetic", "is_utility", "face_quality", "fprint") else F.lit(0).cast(k) for n, k in (x.split() for x in METRICS.split(", "))}
        failed = gone.select("cache_id", *[(why if n == "error" else blank[n]).alias(n) for n in names])
        return done.unionByName(failed)


class Counts:
    """What a run came to: items, hits, misses, errors and bytes, all taken while it ran."""

    def __init__(self):
        self.split, self.fresh = Observation(), Observation()

    def get(self) -> dict[str, int]:
        """The counts, once the run is over."""
        return {k: v or 0 for k, v in {**self.split.get, **self.fresh.get}.items()}


def run(
    spark: SparkSession, source: Source, options: RunOptions = RunOptions(), thresholds: Thresholds = Thresholds(), cache_path: str | None = None,
    counts: Counts | None = None, progress: Callable[[int], Progress] | None = None,
) -> DataFrame:
    """Judged photos: items with metrics, reasons, recommendation and cluster columns.

    Only items without a valid cache row are analysed; fresh rows are written to the cache before verdicts are taken, so that other thresholds never
    cost another scan. ``counts`` is filled in the same pass; ``progress`` makes a teller of progress for a number of items.
    """
    items = materialise(source.collect(spark), "items")
    outputs = options.wanted_outputs
    cache = cache_ops.BucketedCache(spark, cache_path) if cache_path else None
    old = cache.read(cache.touched(items)) if cache else spark.createDataFrame([], CACHE)
    counts = counts or Counts()
    found = cache_ops.split(items, old, outputs).observe(
        counts.split, F.count(F.lit(1)).alias("items"), F.count_if("is_hit").alias("hits"), F.count_if(~F.col("is_hit")).alias("misses"), F.sum("size").alias("bytes")
    )
    split = materialise(found, "split")
    misses = split.where("NOT is_hit")
    with followed(spark.sparkContext, progress(counts.split.get["misses"]) if progress else None) as counter:
        fresh = source.analyse(misses, outputs, counter).join(items.select("cache_id", "size", "mtime"), "cache_id")
        fresh = fresh.select("cache_id", "size", "mtime", F.lit(METRICS_VERSION).alias("ver"), F.lit(cache_ops.output_mask(outputs)).alias("computed_mask"), *METRIC_NAMES)
        fresh = materialise(fresh.observe(counts.fresh, F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors")), "fresh")
    hits = old.join(split.where("is_hit").select("cache_id"), "cache_id", "left_semi")
    metrics = materialise(hits.unionByName(fresh), "metrics")
    if cache:
        cache.upsert(fresh)
    rows = items.drop("size", "mtime", "gate", "location").join(metrics.drop("size", "mtime", "ver", "computed_mask"), "cache_id").drop("cache_id")
    judged = with_verdict(rows, options.enabled, thresholds)
    if options.dedupe:
        judged = materialise(judged, "judged")
        return dedupe_ops.with_duplicates(judged, dedupe_ops.clusters(judged.select("seq", "fprint"), options.dedupe_threshold))
    return judged.withColumns({"cluster_id": F.lit(-1), "cluster_size": F.lit(1), "is_keeper": F.lit(True)})


def swap(spark: SparkSession, table: DataFrame, path: str) -> None:
    """Replace a folder by a table: written beside it, then both are renamed, so at any time the old or the new one is there in full.

    If a run dies between the two renames, the old one is in ``path``.old; the next swap puts it back first.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    here, new, old = hadoop(path), hadoop(path + ".new"), hadoop(path + ".old")
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old) and not fs.exists(here):
        fs.rename(old, here)
    table.write.mode("overwrite").parquet(path + ".new")
    drop_path(spark, path + ".old")
    if fs.exists(here):
        fs.rename(here, old)
    if not fs.rename(new, here):
        raise OSError(f"could not rename {path}.new to {path}")
    drop_path(spark, path + ".old")


class Sink(Protocol):
    """An output medium."""

    def emit(self, photos: DataFrame) -> object:
        """Deliver judged photos."""


class CsvReportSink:
    """The report as CSV, in order over its files; ``files`` = 1 asks for a single one, written by one task."""

    def __init__(self, path: str, files: int | None = None):
        self.path, self.files = path, files

    def emit(self, photos: DataFrame) -> str:
        """Write and return the path."""
        write_report(photos, self.path, self.files)
        return self.path


class SummarySink:
    """Tier counts, reasons of deletion and reclaimable bytes, as lines of text."""

    def emit(self, photos: DataFrame) -> list[str]:
        """Lines of the summary; all tables behind it have a few rows."""
        size = lambda name: human_bytes(F.coalesce(F.col(name), F.lit(0))).alias("size")
        lines = [f"{r['recommendation']:<10} {r['photos']:>8} {r['size']:>10}" for r in tier_summary(photos).select("recommendation", "photos", size("bytes"), "ord").orderBy("ord").collect()]
        lines += [f"  {r['reason']:<18} {r['n']}" for r in delete_reasons(photos).collect()]
        r = reclaimable(photos).select("delete_bytes", "with_duplicates_bytes", human_bytes(F.col("delete_bytes")).alias("frees"), human_bytes(F.col("with_duplicates_bytes")).alias("all")).first()
        if r["delete_bytes"]:
            lines.append(f"deleting frees {r['frees']}")
        if r["with_duplicates_bytes"] > r["delete_bytes"]:
            lines.append(f"with duplicates {r['all']}")
        return lines


class QuarantineSink:
    """Moves of flagged photos."""

    def __init__(self, dest: str, tiers: tuple[str, ...], roots: list[str], dry_run: bool = True, log_path: str | None = None):
        self.dest, self.tiers, self.roots, self.dry_run, self.log_path = absolute(dest), tiers, [absolute(r) for r in roots], dry_run, log_path
        self.log: DataFrame | None = None

    def emit(self, photos: DataFrame) -> DataFrame:
        """The plan, carried out unless this is a dry run; ``log`` says what became of each file.

        Files that are gone since the scan drop, and names that the target folder has already are numbered past.
        """
        spark = photos.sparkSession
        listing, _ = files.scan(spark, [r for r in self.roots if files.exists(spark, r)], True, None)
        existing = files.scan_all(spark, self.dest) if files.exists(spark, self.dest) else None
        plan = materialise(quarantine_plan(photos, self.tiers, self.roots, self.dest, listing, existing), "plan")
        self.log = execute(plan, self.dry_run, log_path=self.log_path)
        return plan


class AlbumsSink:
    """Album memberships by tier or by signal, added to a table; with ``replace``, our albums of earlier runs go first."""

    def __init__(self, path: str, assets: DataFrame, template: str, prefix: str, session: str, by: str = "tier", enabled: frozenset[str] | None = None, replace: bool = False):
        self.path, self.assets, self.naming, self.by, self.enabled, self.replace = path, assets, (template, prefix, session), by, enabled, replace

    def emit(self, photos: DataFrame) -> str:
        """Write and return the path."""
        rows = albums_by_tier(photos, self.assets, *self.naming) if self.by == "tier" else albums_by_signal(photos, self.assets, *self.naming, self.enabled)
        rows, spark = rows.withColumn("is_ours", F.lit(True)), photos.sparkSession
        if files.exists(spark, self.path):
            old = spark.read.schema(rows.schema).parquet(self.path)
            rows = replace_albums(old, rows, self.naming[1]) if self.replace else old.unionByName(rows)
        swap(spark, materialise(rows, "albums"), self.path)
        return self.path
