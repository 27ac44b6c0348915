"""Gallery queries over judged photos: facets, filters, sorts, pages, marks and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from darkroom.functions.paths import basename
from darkroom.operators.report import numbered_rows, tier_rank
from darkroom.operators.skew import join_counted
from darkroom.runtime import shuffle_partitions
from darkroom.signals import SIGNALS, reason_table

PAGE = 120
#: Items of a run: what one task orders, and one folder of a written view has.
RUN = 1 << 16
SHOWN_TIERS = ("delete", "duplicate", "review")


def signals_of(reasons: Column) -> Column:
    """Signals behind reasons, each once."""
    table = F.create_map(*[F.lit(x) for s in SIGNALS.values() for r in s.reasons for x in (r, s.key)])
    return F.array_distinct(F.array_compact(F.transform(reasons, lambda r: table[r])))


def facets_tier(items: DataFrame) -> DataFrame:
    """Items not removed, by tier; other filters have no say."""
    return items.where("NOT removed").groupBy("recommendation").agg(F.count(F.lit(1)).alias("n"))


def facets_signal(items: DataFrame) -> DataFrame:
    """Items not removed, by signal (each item once a signal), for signals that occur: signal, label, n, ord."""
    one = items.where("NOT removed").select(F.explode(signals_of(F.col("reasons"))).alias("signal")).groupBy("signal").agg(F.count(F.lit(1)).alias("n"))
    table = reason_table(items.sparkSession).select("signal", "label", "ord").distinct()
    return one.join(F.broadcast(table), "signal")


def visible(items: DataFrame, tiers=SHOWN_TIERS, signals=(), name: str = "") -> DataFrame:
    """Items not removed, of the tiers, with any of the signals (none: all), whose base name contains a text in any case."""
    out = items.where(~F.col("removed") & F.col("recommendation").isin(*tiers))
    if signals:
        out = out.where(F.arrays_overlap(signals_of(F.col("reasons")), F.array(*map(F.lit, signals))))
    if name:
        out = out.where(F.contains(F.lower(basename(F.col("path"))), F.lit(name.lower())))
    return out


def sort_columns(key: str) -> list[Column]:
    """Sort columns by key: tier, cluster, name, ``name:`` and a collation (names in the order of a language, such as ``name:de`` or ``name:UNICODE``), or any numeric column with blanks as 0."""
    if key == "tier":
        return [tier_rank().asc(), F.coalesce("sharpness", F.lit(0.0)).asc(), F.asc("seq")]
    if key == "cluster":
        return [F.asc("cluster_id"), F.desc("is_keeper"), F.coalesce("sharpness", F.lit(0.0)).asc(), F.asc("seq")]
    if key == "name":
        return [F.lower(basename(F.col("path"))).asc(), F.asc("seq")]
    if key.startswith("name:"):
        return [F.collate(basename(F.col("path")), key.removeprefix("name:")).asc(), F.asc("seq")]
    return [F.coalesce(F.col(key).try_cast("double"), F.lit(0.0)).asc(), F.asc("seq")]


def ranked(items: DataFrame, key: str) -> DataFrame:
    """Items with ``pos`` from 0 in the order of ``key``; the order is range-partitioned."""
    return numbered_rows(items, sort_columns(key), "pos")


def page(items: DataFrame, key: str, number: int, size: int = PAGE) -> DataFrame:
    """One page, from 0, held at the last one."""
    total = items.count()
    last = max(0, -(-total // size) - 1)
    number = min(max(number, 0), last)
    return items.orderBy(*sort_columns(key)).offset(number * size).limit(size)


def range_ids(view: DataFrame, start: int, end: int) -> DataFrame:
    """seq of the rows between two items of a ranked view; if one isn't visible, of the target ``end`` alone."""
    ends = view.where(F.col("seq").isin(start, end)).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count(F.lit(1)).alias("n"))
    both = view.join(F.broadcast(ends)).where(F.when(F.col("n") == (2 if start != end else 1), F.col("pos").between(F.col("lo"), F.col("hi"))).otherwise(F.col("seq") == end))
    return both.select("seq")


def neighbours(view: DataFrame, rows: int = RUN) -> DataFrame:
    """Previous and next item of each item of a ranked view. The order is cut into runs of ``rows`` items; the items beside a run take part in it as guests."""
    run, at = F.floor(F.col("pos") / rows), F.col("pos") % rows
    homes = F.array(F.struct(run.alias("run"), F.lit(False).alias("guest")))
    before = F.when((at == 0) & (run > 0), F.array(F.struct((run - 1).alias("run"), F.lit(True).alias("guest")))).otherwise(F.array().cast("array<struct<run:bigint,guest:boolean>>"))
    after = F.when(at == rows - 1, F.array(F.struct((run + 1).alias("run"), F.lit(True).alias("guest")))).otherwise(F.array().cast("array<struct<run:bigint,guest:boolean>>"))
    one = view.select("seq", "pos", F.explode(F.concat(homes, before, after)).alias("home")).select("seq", "pos", "home.run", "home.guest")
    w = Window.partitionBy("run").orderBy("pos")
    return one.withColumns({"prev_seq": F.lag("seq").over(w), "next_seq": F.lead("seq").over(w)}).where("NOT guest").select("seq", "pos", "prev_seq", "next_seq")


def headers(view: DataFrame, size: int = PAGE) -> DataFrame:
    """Ranked rows with their page, whether a cluster's header stands before them, and members in view of their cluster."""
    w = Window.partitionBy("page").orderBy("pos")
    inside = (F.col("cluster_id") >= 0) & (F.col("cluster_size") > 1)
    paged = view.withColumn("page", F.floor(F.col("pos") / size))
    paged = paged.withColumn("has_header", inside & ~F.lag("cluster_id").over(w).eqNullSafe(F.col("cluster_id")))
    members = view.where(inside).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"))
    counted = join_counted(paged.where(inside), members, ["cluster_id"], "members").unionByName(paged.where(~F.coalesce(inside, F.lit(False))).withColumn("members", F.lit(0).cast("bigint")))
    return counted.select("seq", "pos", "page", "has_header", F.col("members").alias("members_in_view"))


class View:
    """A ranked view, written so that a page reads the files it lies in and no others.

    Rows are numbered in the order of a key and written in runs, each a folder by its number; the folder's name tells which rows it has, so
    other runs aren't even opened. Extra columns stay. An empty view has one empty page.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, items: DataFrame, key: str, rows: int = RUN) -> "View":
        """Write the items in the order of ``key``, in runs of ``rows``."""
        view = ranked(items, key).withColumn("run", F.floor(F.col("pos") / rows))
        n = shuffle_partitions(self.spark)
        view.repartitionByRange(n, "run").sortWithinPartitions("run", "pos").write.partitionBy("run").mode("overwrite").parquet(f"{self.path}/rows")
        total = view.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("total"), F.lit(rows).alias("run_rows"))
        total.write.mode("overwrite").parquet(f"{self.path}/total")
        view.limit(0).drop("run").write.mode("overwrite").parquet(f"{self.path}/columns")
        return self

    def page(self, number: int, size: int = PAGE) -> DataFrame:
        """One page, from 0, held at the last one, in order."""
        total, rows = self.spark.read.parquet(f"{self.path}/total").first()
        number = min(max(number, 0), max(0, -(-total // size) - 1))
        first, last = number * size, min((number + 1) * size, total) - 1
        schema = self.spark.read.parquet(f"{self.path}/columns").schema
        if last < first:
            return self.spark.createDataFrame([], schema)
        runs = [f"{self.path}/rows/run={k}" for k in range(first // rows, last // rows + 1)]
        return self.spark.read.schema(schema).parquet(*runs).where(F.col("pos").between(first, last)).orderBy("pos")


def compare(items: DataFrame, cluster: int) -> DataFrame:
    """Members of a cluster, keeper first, then sharpest first: seq, pos."""
    order = Window.orderBy(F.desc("is_keeper"), F.desc("sharpness"), "seq")
    return items.where((F.col("cluster_id") == cluster) & ~F.col("removed")).withColumn("pos", F.row_number().over(order) - 1).select("seq", "is_keeper", "pos")


def set_marks(marks: DataFrame, touched: DataFrame) -> DataFrame:
    """Marks after some were set; a null mark clears."""
    return marks.join(touched.select("seq"), "seq", "left_anti").unionByName(touched.where("mark IS NOT NULL").select("seq", "mark"))


def toggle(marks: DataFrame, seq: int, mark: str) -> DataFrame:
    """Marks after one item's mark was pressed; the same one again clears."""
    spark = marks.sparkSession
    touched = spark.createDataFrame([(seq,)], "seq bigint").join(marks.withColumnRenamed("mark", "old"), "seq", "left")
    return set_marks(marks, touched.select("seq", F.when(F.col("old") == mark, F.lit(None)).otherwise(F.lit(mark)).alias("mark")))


def mark_others(view: DataFrame, cluster: int) -> DataFrame:
    """Rejects for all but the keeper of a cluster within the view."""
    return view.where((F.col("cluster_id") == cluster) & ~(F.col("is_keeper") & (F.col("cluster_size") > 1))).select("seq", F.lit("reject").alias("mark"))


def keep_best(items: DataFrame, cluster: int, keep: int | None = None) -> DataFrame:
    """keep for the keeper (or the chosen item) and reject for the rest of a cluster, whatever the filter shows."""
    best = F.col("is_keeper") if keep is None else F.col("seq") == keep
    return items.where((F.col("cluster_id") == cluster) & ~F.col("removed")).select("seq", F.when(best, "keep").otherwise("reject").alias("mark"))


def rejected(items: DataFrame, marks: DataFrame) -> DataFrame:
    """Items marked for rejection that are still there."""
    return items.where("NOT removed").join(marks.where("mark = 'reject'").select("seq"), "seq", "left_semi")


def mark_totals(items: DataFrame, marks: DataFrame) -> DataFrame:
    """One row: rejects, keeps and bytes of rejects."""
    m = items.where("NOT removed").join(marks, "seq")
    return m.agg(F.count_if(F.col("mark") == "reject").alias("rejects"), F.count_if(F.col("mark") == "keep").alias("keeps"), F.coalesce(F.sum(F.when(F.col("mark") == "reject", F.col("file_bytes"))), F.lit(0)).alias("bytes"))


def json_feed(items: DataFrame) -> DataFrame:
    """One JSON text an item."""
    return items.select("seq", F.to_json(F.struct(*[c for c in items.columns if c != "fprint"])).alias("json"))


#: Fixed format: fields of an item in the gallery's feed, in order; companions come last.
FEED_FIELDS = (
    "id", "name", "recommendation", "reasons", "sharpness", "brightness", "contrast", "noise", "aesthetic", "is_utility", "face_quality", "cluster_id",
    "cluster_size", "is_keeper", "megapixels", "file_bytes", "exists", "removed",
)


def item_feed(items: DataFrame, companions: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """One row an item with the feed's fields and ``companions``, the base names of (path, companions); ``exists`` says whether a listing still has the file."""
    rows = items.withColumnRenamed("seq", "id").withColumn("name", basename(F.col("path"))).join(companions.select("path", F.col("companions").alias("own")), "path", "left")
    if listing is None:
        rows = rows.withColumn("exists", F.lit(True))
    else:
        rows = rows.join(listing.select("path", F.lit(True).alias("there")).distinct(), "path", "left").withColumn("exists", F.coalesce("there", F.lit(False)))
    names = F.coalesce(F.transform("own", lambda p: basename(p)), F.array().cast("array<string>"))
    return rows.select(*FEED_FIELDS, names.alias("companions"))


def view_counts(items: DataFrame, view: DataFrame) -> DataFrame:
    """One row: items shown and items that could be shown."""
    return view.agg(F.count(F.lit(1)).alias("shown")).join(F.broadcast(items.where("NOT removed").agg(F.count(F.lit(1)).alias("total"))))  # one row each


def present_counts(items: DataFrame, listing: DataFrame) -> DataFrame:
    """One row: items whose file a listing has, and those it lacks."""
    there = items.join(listing.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
    return there.agg(F.count_if(F.col("there").isNotNull()).alias("present"), F.count_if(F.col("there").isNull()).alias("missing"))


def clear_marks(marks: DataFrame) -> DataFrame:
    """No marks."""
    return marks.limit(0)


def clear_cluster(items: DataFrame, marks: DataFrame, cluster: int) -> DataFrame:
    """Marks without those of a cluster's members."""
    return marks.join(items.where(F.col("cluster_id") == cluster).select("seq"), "seq", "left_anti")


def clamped(value: Column, default: float, low: float, high: float) -> Column:
    """A request's number within limits; what isn't a number is the default."""
    return F.least(F.greatest(F.coalesce(value.try_cast("double"), F.lit(float(default))), F.lit(float(low))), F.lit(float(high)))


def nearest_option(value: Column, options: list[float]) -> Column:
    """The option next to a value, the first of equally near ones."""
    return F.array_min(F.transform(F.array(*[F.struct(F.abs(value - F.lit(float(o))).alias("d"), F.lit(i).alias("i"), F.lit(float(o)).alias("o")) for i, o in enumerate(options)]), lambda x: x))["o"]


def thumbnail_key(path: Column, pixels: Column, quality: Column) -> Column:
    """Fixed format: the key of a cached thumbnail."""
    return F.concat(path, F.lit("@"), pixels.cast("string"), F.lit("q"), quality.cast("string"))


def evicted(accesses: DataFrame, capacity: int) -> DataFrame:
    """Keys that a cache of the ``capacity`` last used ones has dropped, from (key, at). A cache is one session's, so one task orders its keys."""
    last = accesses.groupBy("key").agg(F.max("at").alias("at"))
    return last.withColumn("n", F.row_number().over(Window.orderBy(F.desc("at"), "key"))).where(F.col("n") > capacity).select("key")
