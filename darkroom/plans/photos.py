"""Test relations derived from the supplied tables, in Spark and as DuckDB SQL."""

from __future__ import annotations

import os
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.functions import pixels
from darkroom.functions.png import png_bytes
from darkroom.runtime import materialise, scratch_path, ship, shuffle_partitions
from darkroom.signals import with_verdict

T = 1.10

_COLUMNS = {
    "amp": "CASE vec_id % 5 WHEN 0 THEN 6 WHEN 1 THEN 14 WHEN 2 THEN 40 WHEN 3 THEN 90 ELSE 320 END",
    "base": "CASE vec_id % 7 WHEN 0 THEN 10 WHEN 1 THEN 35 WHEN 2 THEN 70 WHEN 3 THEN 128 WHEN 4 THEN 128 WHEN 5 THEN 200 ELSE 252 END",
    "ramp": "CASE vec_id % 3 WHEN 1 THEN 0 ELSE 8 END",
    "aesthetic": "CASE WHEN vec_id % 11 = 0 THEN NULL ELSE (label - CAST(2.5 AS DOUBLE)) / 5 END",
    "is_utility": "CASE WHEN vec_id % 11 = 0 THEN NULL ELSE vec_id % 13 = 0 END",
    "face_quality": "CASE WHEN vec_id % 3 = 0 THEN ((vec_id * 37) % 100) / CAST(100 AS DOUBLE) END",
    "file_bytes": "1000 + (vec_id * 7919) % 100000",
    "width": "CAST(640 + (vec_id % 4) * 320 AS INT)",
    "height": "CAST(480 + (vec_id % 3) * 240 AS INT)",
    "path": "concat('roll', CAST(vec_id % 10 AS VARCHAR(9)), '/IMG_', CAST(vec_id AS VARCHAR(20)), CASE vec_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPG' WHEN 2 THEN '.heic' ELSE '.arw' END)",
    "asset_id": "concat('A', CAST(vec_id AS VARCHAR(20)))",
}


def pixels_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8x8 gray image a row of ``embeddings``: seq, px, fprint and catalogue columns."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cols = [F.expr(v).alias(k) for k, v in _COLUMNS.items()]
    e = e.select(F.col("vec_id").alias("seq"), F.col("embedding").alias("fprint"), *cols)
    px = "transform(sequence(0, 63), k -> cast(least(greatest(floor(base + ramp * (k % 8 + k div 8 - 7) + amp * cast(fprint[k] AS double)), 0), 255) AS double))"
    return e.withColumn("px", F.expr(px)).drop("amp", "base", "ramp")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos with unrounded metrics from their pixels."""
    own = {
        "sharpness": pixels.sharpness("px", "8", "8"), "brightness": pixels.brightness(), "contrast": pixels.contrast(), "noise": pixels.noise("px", "8", "8"),
        "black_frac": pixels.clipped(), "white_frac": pixels.clipped(white=True), "megapixels": F.round(F.col("width") * F.col("height") / 1e6, 2), "error": F.lit(""),
    }
    return pixels_table(spark, sf_dir).withColumns(own).drop("px")


def written_files(rows: DataFrame) -> str:
    """A new folder in the shared scratch folder with a file for each row (name, data), written by executors. The scratch folder must be a mounted one."""
    spark = rows.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "files"))
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if not folder.startswith("file:"):
        raise ValueError("files are written to a mounted folder only; set spark.checkpoint.dir to a file: path")
    ship(spark)
    place = re.sub("^file:(//)?", "", folder)
    os.makedirs(place, exist_ok=True)
    rows.select("name", "data").mapInArrow(_file_writer(place), "n bigint").agg(F.sum("n")).collect()
    return place


def _file_writer(place: str):
    def run(batches):
        for batch in batches:
            os.makedirs(place, exist_ok=True)
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = f"{place}/.{uuid.uuid4().hex}"  # a second attempt writes the same file again
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, f"{place}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return run


def _as_png(batches):
    for batch in batches:
        images = [png_bytes(np.array(px, np.uint8).reshape(8, 8)) for px in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.binary())], ["name", "data"])


def image_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the derived images as PNG files, ``seq``.png."""
    ship(spark)
    rows = pixels_table(spark, sf_dir).repartition(shuffle_partitions(spark), "seq")  # a table of few files is a few tasks, and a row becomes a file
    px = rows.select(F.concat(F.col("seq").cast("string"), F.lit(".png")).alias("name"), F.transform("px", lambda x: x.cast("int")).alias("px"))
    return written_files(px.mapInArrow(_as_png, "name string, data binary"))


_written: dict = {}


def judged(spark: SparkSession, sf_dir: str, enabled: frozenset[str] | None = None) -> DataFrame:
    """Photos with verdicts. Metrics are written once a session, as verdicts refer to them many times and are cheap to redo."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _written:
        _written[key] = materialise(metrics(spark, sf_dir), "metrics")
    return with_verdict(_written[key], enabled)


def _duck_stencil(terms: str) -> str:
    return f"[{terms} for p in range(64) if p % 8 BETWEEN 1 AND 6 AND p // 8 BETWEEN 1 AND 6]"


_LAP = _duck_stencil("px[p + 1 - 8] + px[p] - 4 * px[p + 1] + px[p + 2] + px[p + 1 + 8]")
_NOI = _duck_stencil("abs(px[p - 8] - 2 * px[p - 7] + px[p - 6] - 2 * px[p] + 4 * px[p + 1] - 2 * px[p + 2] + px[p + 8] - 2 * px[p + 9] + px[p + 10])")

#: CTEs ``p`` (pixels), ``m`` (metrics) and, from ``verdict_sql``, ``j`` (judged).
METRICS_SQL = f"""
e AS (SELECT vec_id, vec_id AS seq, embedding AS fprint, {', '.join(f'{v} AS {k}' for k, v in _COLUMNS.items())} FROM embeddings),
p AS (SELECT *, [CAST(least(greatest(floor(base + ramp * (k % 8 + k // 8 - 7) + amp * CAST(fprint[k + 1] AS DOUBLE)), 0), 255) AS DOUBLE) for k in range(64)] AS px FROM e),
m AS MATERIALIZED (
  SELECT seq, fprint, path, asset_id, width, height, file_bytes, aesthetic, is_utility, face_quality,
         round(width * height / CAST(1000000 AS DOUBLE), 2) AS megapixels,
         list_aggregate({_LAP}, 'var_pop') AS sharpness, list_avg(px) AS brightness, list_aggregate(px, 'stddev_pop') AS contrast,
         {pixels.NOISE_SCALE!r} * list_avg({_NOI}) AS noise,
         len([x for x in px if x <= 5]) / CAST(64 AS DOUBLE) AS black_frac, len([x for x in px if x >= 250]) / CAST(64 AS DOUBLE) AS white_frac
  FROM p)"""

_SOFT = {
    "blur": "sharpness < 100", "dark": "brightness < 50", "contrast": "contrast < 18", "noise": "noise > 7", "exposure": "(black_frac >= 0.55 OR white_frac >= 0.55)",
    "aesthetic": "coalesce(aesthetic < -0.10, false)", "utility": "coalesce(is_utility, false)", "face": "coalesce(face_quality < 0.30, false)",
}
_REASON = {
    "blur": "CASE WHEN sharpness < 35 THEN 'very_blurry' ELSE 'blurry' END", "dark": "CASE WHEN brightness < 25 THEN 'very_dark' ELSE 'dark' END", "contrast": "'low_contrast'",
    "noise": "'noisy'", "exposure": "'bad_exposure'", "aesthetic": "'low_aesthetic'", "utility": "'utility'", "face": "'low_face_quality'",
}


def verdict_sql(enabled=tuple(_SOFT)) -> str:
    """CTEs up to ``j``: reasons (list) and recommendation under some signals."""
    on = lambda k: _SOFT[k] if k in enabled else "false"
    reasons = ", ".join(f"CASE WHEN {_SOFT[k]} THEN {_REASON[k]} END" for k in _SOFT if k in enabled)
    strong = f"({'sharpness < 35' if 'blur' in enabled else 'false'}) OR ({'brightness < 25' if 'dark' in enabled else 'false'}) OR ({on('blur')} AND ({on('dark')} OR {on('exposure')} OR {on('contrast')})) OR {on('face')}"
    return f"""{METRICS_SQL},
r AS (SELECT *, [x for x in [{reasons}] if x IS NOT NULL] AS reasons, {strong} AS strong FROM m),
j AS MATERIALIZED (SELECT *, CASE WHEN strong THEN 'delete' WHEN len(reasons) > 0 THEN 'review' ELSE 'keep' END AS recommendation FROM r)"""


#: CTEs ``prs`` (linked pairs), ``lab`` (component labels), ``cl`` (clusters) and ``dd`` (photos after dedupe).
PAIRS_SQL = f"""
prs AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
        WHERE list_sum([(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2 for z in list_zip(a.embedding, b.embedding)]) < {T} * {T})"""
CLUSTER_SQL = f"""{PAIRS_SQL},
sym AS MATERIALIZED (SELECT a, b FROM prs UNION SELECT b, a FROM prs),
reach AS (SELECT a AS seq, a AS r FROM sym UNION SELECT reach.seq, sym.b FROM reach JOIN sym ON reach.r = sym.a),
lab AS MATERIALIZED (SELECT seq, min(r) AS component FROM reach GROUP BY seq),
siz AS (SELECT component, count(*) AS cluster_size, row_number() OVER (ORDER BY component) - 1 AS cluster_id FROM lab GROUP BY component),
cl AS MATERIALIZED (SELECT seq, component, cluster_id, cluster_size FROM lab JOIN siz USING (component))"""
DEDUPE_SQL = f"""{CLUSTER_SQL},
ko AS MATERIALIZED (SELECT j.seq, row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(face_quality, -1) DESC, sharpness DESC, coalesce(aesthetic, 0) DESC, megapixels DESC, file_bytes DESC, j.seq) AS rn,
              cluster_id, cluster_size FROM j JOIN cl ON cl.seq = j.seq),
kn AS (SELECT ko.cluster_id, regexp_extract(path, '[^/]*$') AS keeper FROM ko JOIN j ON j.seq = ko.seq WHERE rn = 1),
dd AS MATERIALIZED (
  SELECT j.* EXCLUDE (recommendation, reasons), coalesce(ko.cluster_id, -1) AS cluster_id, coalesce(ko.cluster_size, 1) AS cluster_size, coalesce(rn, 1) = 1 AS is_keeper,
         CASE WHEN rn > 1 THEN 'duplicate' ELSE recommendation END AS recommendation, CASE WHEN rn > 1 THEN ['near_dup_of:' || keeper] ELSE reasons END AS reasons
  FROM j LEFT JOIN ko ON ko.seq = j.seq LEFT JOIN kn ON kn.cluster_id = ko.cluster_id)"""
