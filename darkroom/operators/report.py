"""Order, report, summaries and albums of judged photos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.params import album_title
from darkroom.schema import REPORT_FIELDS, TIER_ORDER
from darkroom.signals import SIGNALS, TIER_LABELS, reason_table


def tier_rank(recommendation: Column | str = "recommendation") -> Column:
    """Position of a tier in worst-first order; 9 for any other."""
    c = F.col(recommendation) if isinstance(recommendation, str) else recommendation
    return F.coalesce(F.create_map(*[F.lit(x) for kv in TIER_ORDER.items() for x in kv])[c], F.lit(9))


def worst_first() -> list[Column]:
    """Sort columns: worst tier, least sharp, earliest."""
    return [tier_rank().asc(), F.asc("sharpness"), F.asc("seq")]


def with_position(photos: DataFrame) -> DataFrame:
    """Position in the report, from 0."""
    return numbered_rows(photos, worst_first(), "pos")


def numbered_rows(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their number in an order, from 0, without sorting everything in one task.

    Rows are range-partitioned and numbered in their partition; partitions start where the ones before them end.
    """
    from darkroom.runtime import materialise, shuffle_partitions

    ranged = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged, "row-order")  # fixes which row lies in which partition
    found, at = [], 0
    for r in sorted(ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["_part"]):  # one row a partition
        found.append((r["_part"], at))
        at += r["n"]
    starts = rows.sparkSession.createDataFrame(found, "_part int, _start bigint")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    ranged = ranged.withColumn("_inside", inside).join(F.broadcast(starts), "_part")  # one row a partition
    return ranged.withColumn(name, (F.col("_start") + F.col("_inside")).cast("bigint")).drop("_part", "_start", "_inside")


def report_rows(photos: DataFrame) -> DataFrame:
    """The CSV report's columns as text: reasons joined by ';', booleans True or False, nulls empty."""
    out = []
    kinds = dict(photos.dtypes)
    for name in REPORT_FIELDS:
        c = F.col(name)
        if kinds[name] == "boolean":
            c = F.initcap(c.cast("string"))
        elif kinds[name].startswith("array"):
            c = F.concat_ws(";", c)
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(name))
    return photos.select(*out)


def tier_summary(photos: DataFrame) -> DataFrame:
    """Photos and bytes of each tier that occurs, in worst-first order: recommendation, photos, bytes, ord."""
    return photos.groupBy("recommendation").agg(F.count(F.lit(1)).alias("photos"), F.sum("file_bytes").alias("bytes")).withColumn("ord", tier_rank()).orderBy("ord")


def delete_reasons(photos: DataFrame) -> DataFrame:
    """How often each reason occurs among photos to delete, most frequent first, ties in the order first seen."""
    one = photos.where("recommendation = 'delete'").select(F.explode("reasons").alias("reason"), "seq")
    return one.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")).orderBy(F.desc("n"), "first_seq")


def reclaimable(photos: DataFrame) -> DataFrame:
    """One row: bytes of photos to delete, and of those with duplicates."""
    size = lambda *t: F.coalesce(F.sum(F.when(F.col("recommendation").isin(*t), F.col("file_bytes"))), F.lit(0))
    return photos.agg(size("delete").alias("delete_bytes"), size("delete", "duplicate").alias("with_duplicates_bytes"))


def _positions(members: DataFrame) -> DataFrame:
    order = Window.partitionBy("album_key").orderBy("sharpness", tier_rank(), "seq")
    return members.withColumn("pos", F.row_number().over(order) - 1)


def albums_by_tier(photos: DataFrame, assets: DataFrame, template: str, prefix: str, session: str) -> DataFrame:
    """Members of an album for each flagged tier, least sharp first: album_key, title, pos, asset_id. Rows without an asset drop."""
    titles = F.create_map(*[F.lit(x) for k, v in TIER_LABELS.items() for x in (k, album_title(template, prefix, session, v))])
    members = photos.where(F.col("recommendation").isin(*TIER_LABELS)).join(assets.select("asset_id"), "asset_id").withColumn("album_key", F.col("recommendation"))
    return _positions(members).select("album_key", titles[F.col("album_key")].alias("title"), "pos", "asset_id")


def albums_by_signal(photos: DataFrame, assets: DataFrame, template: str, prefix: str, session: str, enabled: frozenset[str]) -> DataFrame:
    """Members of an album for each enabled signal that they triggered, and of one for duplicates."""
    table = F.broadcast(reason_table(photos.sparkSession).where(F.col("signal").isin(*enabled)))  # one row a reason
    own = photos.join(assets.select("asset_id"), "asset_id")
    flagged = own.where("recommendation IN ('delete', 'review')").withColumn("reason", F.explode("reasons")).join(table.select("reason", F.col("signal").alias("album_key")), "reason").drop("reason")
    duplicates = own.where("recommendation = 'duplicate'").withColumn("album_key", F.lit("duplicate"))
    names = {k: SIGNALS[k].label for k in SIGNALS if k in enabled} | {"duplicate": TIER_LABELS["duplicate"]}
    titles = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, album_title(template, prefix, session, v))])
    return _positions(flagged.unionByName(duplicates)).select("album_key", titles[F.col("album_key")].alias("title"), "pos", "asset_id")


def replace_albums(old: DataFrame, new: DataFrame, prefix: str, owned: bool = True) -> DataFrame:
    """Album rows after a run that replaces earlier ones: old albums whose title starts with the prefix go (only our own, if ``owned``)."""
    goes = F.col("title").startswith(prefix) & (F.col("is_ours") if owned else F.lit(True)) if prefix else F.lit(False)
    return old.where(~F.coalesce(goes, F.lit(False))).unionByName(new)
