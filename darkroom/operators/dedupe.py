"""Near-duplicate clusters of photos: keeper, numbering, verdicts and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.functions.paths import basename
from darkroom.operators.components import connected_components
from darkroom.operators.report import numbered_rows
from darkroom.operators.similarity import similarity_links


def keeper_order() -> list[Column]:
    """Best first: no error, best face (none: -1), sharpest, most aesthetic (none: 0), most pixels, most bytes, earliest."""
    return [
        F.desc(F.coalesce(F.col("error"), F.lit("")) == ""), F.desc(F.coalesce("face_quality", F.lit(-1.0))), F.desc("sharpness"),
        F.desc(F.coalesce("aesthetic", F.lit(0.0))), F.desc("megapixels"), F.desc("file_bytes"), F.asc("seq"),
    ]


def clusters(photos: DataFrame, threshold: float, vector: str = "fprint") -> DataFrame:
    """Single-link clusters of two or more photos: seq, component (its smallest seq), cluster_id, cluster_size.

    Photos are linked below ``threshold``; ids count from 0 in the order of first members.
    """
    labels = connected_components(similarity_links(photos, threshold, "seq", vector)).select(F.col("node").alias("seq"), F.col("root").alias("component"))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).cast("int").alias("cluster_size"))
    numbered = numbered_rows(sizes, [F.col("component")], "cluster_id").withColumn("cluster_id", F.col("cluster_id").cast("int"))
    return labels.join(numbered, "component").select("seq", "component", "cluster_id", "cluster_size")


def with_duplicates(photos: DataFrame, found: DataFrame) -> DataFrame:
    """Photos with cluster_id, cluster_size and is_keeper; in a cluster all but the keeper become ``duplicate`` of it.

    The keeper keeps its own verdict, whatever it is. Photos outside clusters have -1, 1 and true.
    """
    best = Window.partitionBy("cluster_id").orderBy(*keeper_order())
    inside = photos.join(found.select("seq", "cluster_id", "cluster_size"), "seq")
    inside = inside.withColumn("is_keeper", F.row_number().over(best) == 1).withColumn("_keeper", F.first(basename(F.col("path"))).over(best))
    inside = inside.withColumn("recommendation", F.when(F.col("is_keeper"), F.col("recommendation")).otherwise("duplicate")).withColumn(
        "reasons", F.when(F.col("is_keeper"), F.col("reasons")).otherwise(F.array(F.concat(F.lit("near_dup_of:"), "_keeper")))
    )
    outside = photos.join(found.select("seq"), "seq", "left_anti").withColumns({"cluster_id": F.lit(-1), "cluster_size": F.lit(1), "is_keeper": F.lit(True)})
    return inside.drop("_keeper").unionByName(outside.select(*[c for c in inside.columns if c != "_keeper"]))


def dedupe_stats(photos: DataFrame) -> DataFrame:
    """One row: clusters, redundant photos and bytes that removing them frees."""
    extra = (F.col("cluster_size") > 1) & ~F.col("is_keeper")
    return photos.agg(
        F.countDistinct(F.when(F.col("cluster_size") > 1, F.col("cluster_id"))).alias("clusters"), F.count_if(extra).alias("redundant"),
        F.coalesce(F.sum(F.when(extra, F.col("file_bytes"))), F.lit(0)).alias("reclaim"),
    )
