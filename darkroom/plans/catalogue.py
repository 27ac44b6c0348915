"""Named queries over the supplied tables, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from darkroom.functions import paths
from darkroom.operators import cache, dedupe, gallery, moves, report
from darkroom.operators.similarity import Clusters, dominant_length, similarity_pairs
from darkroom.plans import photos as P
from darkroom.runtime import many_files, materialise, scratch_path, shuffle_partitions
from darkroom.signals import SIGNALS, Thresholds, flag
from darkroom.sources import files
from darkroom.streaming.ingest import each_batch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ALL = frozenset(SIGNALS)
RANK = "CASE recommendation WHEN 'delete' THEN 0 WHEN 'duplicate' THEN 1 WHEN 'review' THEN 2 WHEN 'keep' THEN 3 WHEN 'error' THEN 4 ELSE 9 END"
JOINED = "array_to_string(reasons, ';')"


def query(sql: str | None = None, name: str | None = None):
    """Register a query and its oracle."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _d6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_written: dict = {}


def _deduped(spark: SparkSession, d: str) -> DataFrame:
    """Photos after dedupe, written once a session: the expensive stage that cheaper queries share."""
    key = spark.sparkContext.applicationId, d
    if key not in _written:
        p = P.judged(spark, d)
        _written[key] = materialise(dedupe.with_duplicates(p, dedupe.clusters(p.select("seq", "fprint"), P.T)), "deduped")
    return _written[key]


def _gallery(spark: SparkSession, d: str) -> DataFrame:
    """Items of the gallery: deduped photos; every 17th was removed."""
    return _deduped(spark, d).withColumn("removed", F.col("seq") % 17 == 0)


_J = f"WITH {P.verdict_sql()}"
_D = f"WITH RECURSIVE {P.verdict_sql()}, {P.DEDUPE_SQL}"
_G = f"{_D}, g AS (SELECT *, seq % 17 = 0 AS removed FROM dd)"
_VIS = "NOT removed AND recommendation IN ('delete', 'duplicate', 'review')"


# metrics
@query(f"WITH {P.METRICS_SQL} SELECT seq, {_d6('brightness', 'contrast')} FROM m")
def img_brightness_contrast(spark, d):
    return P.metrics(spark, d).select("seq", *_r6("brightness", "contrast"))


@query(f"WITH {P.METRICS_SQL} SELECT seq, {_d6('black_frac', 'white_frac')} FROM m")
def img_clipping(spark, d):
    return P.metrics(spark, d).select("seq", *_r6("black_frac", "white_frac"))


@query(f"WITH {P.METRICS_SQL} SELECT seq, {_d6('sharpness')} FROM m")
def img_sharpness(spark, d):
    return P.metrics(spark, d).select("seq", *_r6("sharpness"))


@query(f"WITH {P.METRICS_SQL} SELECT seq, {_d6('noise')} FROM m")
def img_noise(spark, d):
    return P.metrics(spark, d).select("seq", *_r6("noise"))


@query(f"WITH {P.METRICS_SQL} SELECT seq, width, height, megapixels FROM m")
def img_dimensions(spark, d):
    return P.metrics(spark, d).select("seq", "width", "height", "megapixels")


@query(
    f"""WITH {P.METRICS_SQL}, px AS (SELECT vec_id AS seq, unnest(px) AS v, unnest(range(64)) AS k FROM p),
s AS (SELECT seq, k // 8 AS y, k % 8 AS x, v, lag(v) OVER r AS l, lead(v) OVER r AS rt, lag(v) OVER c AS u, lead(v) OVER c AS dn FROM px
      WINDOW r AS (PARTITION BY seq, k // 8 ORDER BY k % 8), c AS (PARTITION BY seq, k % 8 ORDER BY k // 8))
SELECT seq, round(var_pop(l + rt + u + dn - 4 * v), 6) AS sharpness FROM s WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 GROUP BY seq"""
)
def img_sharpness_windows(spark, d):
    """The Laplacian by windows over rows and columns of pixels."""
    px = P.pixels_table(spark, d).select("seq", F.posexplode("px").alias("k", "v")).withColumns({"y": F.expr("k div 8"), "x": F.expr("k % 8")})
    row, col = Window.partitionBy("seq", "y").orderBy("x"), Window.partitionBy("seq", "x").orderBy("y")
    lap = F.lag("v").over(row) + F.lead("v").over(row) + F.lag("v").over(col) + F.lead("v").over(col) - 4 * F.col("v")
    return px.withColumn("lap", lap).where("x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6").groupBy("seq").agg(F.round(F.var_pop("lap"), 6).alias("sharpness"))


# verdicts
@query(f"WITH {P.METRICS_SQL} SELECT seq, {', '.join(f'{c} AS {k}' for k, c in P._SOFT.items())}, sharpness < 35 AS blur_hard, brightness < 25 AS dark_hard FROM m")
def signal_flags(spark, d):
    t = Thresholds()
    return P.metrics(spark, d).select("seq", *[flag(k, ALL, t).alias(k) for k in SIGNALS], flag("blur", ALL, t, True).alias("blur_hard"), flag("dark", ALL, t, True).alias("dark_hard"))


@query(f"{_J} SELECT seq, {JOINED} AS reasons, len(reasons) AS n FROM j")
def signal_reasons(spark, d):
    return P.judged(spark, d).select("seq", F.concat_ws(";", "reasons").alias("reasons"), F.size("reasons").cast("bigint").alias("n"))


def _verdict(name: str, enabled: frozenset[str]) -> None:
    sql = f"WITH {P.verdict_sql(tuple(k for k in SIGNALS if k in enabled))} SELECT seq, recommendation, {JOINED} AS reasons FROM j"

    @query(sql, name)
    def run(spark, d):
        return P.judged(spark, d, enabled).select("seq", "recommendation", F.concat_ws(";", "reasons").alias("reasons"))


_verdict("verdict_all", ALL)
_verdict("verdict_subset_blur_dark", frozenset({"blur", "dark"}))
_verdict("verdict_exclude_aesthetic", ALL - {"aesthetic"})


# report and summaries
@query(f"{_J} SELECT seq, path, recommendation, {JOINED} AS reasons, {_d6('sharpness')}, row_number() OVER (ORDER BY {RANK}, sharpness, seq) - 1 AS pos FROM j")
def report_worst_first(spark, d):
    return report.with_position(P.judged(spark, d)).select("seq", "path", "recommendation", F.concat_ws(";", "reasons").alias("reasons"), *_r6("sharpness"), "pos")


@query(f"{_D} SELECT recommendation, count(*) AS photos, CAST(sum(file_bytes) AS BIGINT) AS bytes, {RANK} AS ord FROM dd GROUP BY recommendation")
def summary_tiers(spark, d):
    return report.tier_summary(_deduped(spark, d))


@query(f"{_J}, x AS (SELECT unnest(reasons) AS reason, seq FROM j WHERE recommendation = 'delete') SELECT reason, count(*) AS n, min(seq) AS first_seq FROM x GROUP BY reason")
def summary_delete_reasons(spark, d):
    return report.delete_reasons(P.judged(spark, d))


@query(
    f"""{_D} SELECT CAST(coalesce(sum(file_bytes) FILTER (recommendation = 'delete'), 0) AS BIGINT) AS delete_bytes,
CAST(coalesce(sum(file_bytes) FILTER (recommendation IN ('delete', 'duplicate')), 0) AS BIGINT) AS with_duplicates_bytes FROM dd"""
)
def summary_reclaim(spark, d):
    return report.reclaimable(_deduped(spark, d))


# near-duplicates
@query(f"WITH {P.PAIRS_SQL} SELECT a, b FROM prs")
def near_dup_pairs(spark, d):
    return similarity_pairs(P.pixels_table(spark, d), P.T, "seq").select("a", "b")


@query(f"WITH RECURSIVE {P.CLUSTER_SQL} SELECT seq, cluster_id, cluster_size FROM cl")
def near_dup_clusters(spark, d):
    return dedupe.clusters(P.pixels_table(spark, d).select("seq", "fprint"), P.T).select("seq", F.col("cluster_id").cast("bigint"), F.col("cluster_size").cast("bigint"))


@query(f"{_D} SELECT cluster_id, seq FROM dd WHERE cluster_size > 1 AND is_keeper")
def near_dup_keepers(spark, d):
    return _deduped(spark, d).where("cluster_size > 1 AND is_keeper").select(F.col("cluster_id").cast("bigint"), "seq")


@query(f"{_D} SELECT seq, recommendation, {JOINED} AS reasons, cluster_id, cluster_size, is_keeper FROM dd")
def near_dup_report(spark, d):
    return _deduped(spark, d).select("seq", "recommendation", F.concat_ws(";", "reasons").alias("reasons"), F.col("cluster_id").cast("bigint"), F.col("cluster_size").cast("bigint"), "is_keeper")


@query(
    f"""{_D} SELECT count(DISTINCT cluster_id) FILTER (cluster_size > 1) AS clusters, count(*) FILTER (cluster_size > 1 AND NOT is_keeper) AS redundant,
CAST(coalesce(sum(file_bytes) FILTER (cluster_size > 1 AND NOT is_keeper), 0) AS BIGINT) AS reclaim FROM dd"""
)
def dedupe_stats(spark, d):
    return dedupe.dedupe_stats(_deduped(spark, d))


@query(
    """WITH RECURSIVE c AS (SELECT unnest([0, 1, 2, 3]) AS c),
b AS (SELECT vec_id + 1000000 * c AS seq, [CAST(embedding[k + 1] AS DOUBLE) * (1 + CAST(0.001 AS DOUBLE) * c * ((k % 3) - 1)) for k in range(64)] AS v FROM embeddings, c WHERE c = 0 OR vec_id % 10 = 0),
prs AS (SELECT a.seq AS a, b.seq AS b FROM b a JOIN b b ON a.seq < b.seq WHERE list_sum([(z[1] - z[2]) ** 2 for z in list_zip(a.v, b.v)]) < 0.09),
sym AS (SELECT a, b FROM prs UNION SELECT b, a FROM prs),
reach AS (SELECT a AS seq, a AS r FROM sym UNION SELECT reach.seq, sym.b FROM reach JOIN sym ON reach.r = sym.a),
lab AS (SELECT seq, min(r) AS component FROM reach GROUP BY seq)
SELECT component, count(*) AS cluster_size FROM lab GROUP BY component"""
)
def near_dup_bursts(spark, d):
    """Clusters at the default threshold, over embeddings with perturbed copies."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("c", F.explode(F.array(*map(F.lit, range(4))))).where("c = 0 OR vec_id % 10 = 0")
    v = F.transform("embedding", lambda x, k: x.cast("double") * (1 + F.lit(0.001) * F.col("c") * ((k % 3) - 1)))
    found = dedupe.clusters(e.select((F.col("vec_id") + 1000000 * F.col("c")).alias("seq"), v.alias("fprint")), 0.3)
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("cluster_size"))


@query("SELECT len(embedding) AS dominant, count(*) AS n FROM embeddings GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1")
def fprint_mode_length(spark, d):
    p = P.pixels_table(spark, d)
    length = dominant_length(p)
    return p.where(F.size("fprint") == length).groupBy(F.size("fprint").cast("bigint").alias("dominant")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, min(CASE WHEN event_type = 'error' THEN NULL ELSE value / 500 END) AS face_quality FROM events GROUP BY user_id")
def face_min(spark, d):
    q = F.when(F.col("event_type") != "error", F.col("value") / 500)
    return spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.min(q).alias("face_quality"))


# cache
def _scan(spark, d):
    return P.pixels_table(spark, d).select(F.col("path").alias("cache_id"), "seq", F.col("file_bytes").alias("size"), (F.col("seq") * 10).alias("mtime"))


def _cache(spark, d):
    s = F.col("seq") % 4
    return _scan(spark, d).where(s != 0).select(
        "cache_id", F.when(s == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime", F.when(s == 2, 0).otherwise(1).alias("ver"),
        F.when(F.col("seq") % 8 == 3, 7).otherwise(15).alias("computed_mask"), F.lit("").alias("error"),
    )


_CACHE = f"""WITH {P.METRICS_SQL}, sc AS (SELECT path AS cache_id, seq, file_bytes AS size, seq * 10 AS mtime FROM m),
ca AS (SELECT cache_id, CASE WHEN seq % 4 = 1 THEN size + 1 ELSE size END AS size, mtime, CASE WHEN seq % 4 = 2 THEN 0 ELSE 1 END AS ver, CASE WHEN seq % 8 = 3 THEN 7 ELSE 15 END AS computed_mask FROM sc WHERE seq % 4 <> 0),
sp AS (SELECT sc.*, coalesce(sc.size = ca.size AND sc.mtime = ca.mtime AND ver = 1 AND (computed_mask & 8) = 8, false) AS is_hit FROM sc LEFT JOIN ca USING (cache_id))"""


@query(f"{_CACHE} SELECT seq, is_hit FROM sp")
def cache_split(spark, d):
    return cache.split(_scan(spark, d), _cache(spark, d), {"fprint"}).select("seq", "is_hit")


@query(f"{_CACHE}, fr AS (SELECT * FROM sp WHERE NOT is_hit AND seq % 10 <> 9) SELECT cache_id, size, mtime, 1 AS ver, 15 AS computed_mask FROM fr UNION ALL SELECT cache_id, size, mtime, ver, computed_mask FROM ca WHERE cache_id NOT IN (SELECT cache_id FROM fr)")
def cache_upsert(spark, d):
    missing = cache.split(_scan(spark, d), _cache(spark, d), {"fprint"}).where("NOT is_hit")
    fresh = missing.select("cache_id", "size", "mtime", F.lit(1).alias("ver"), F.lit(15).alias("computed_mask"), F.when(F.col("seq") % 10 == 9, "unreadable").otherwise("").alias("error"))
    return cache.upsert(_cache(spark, d), fresh).select("cache_id", "size", "mtime", "ver", "computed_mask")


# scans, over the pages' addresses as paths
def _files(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("seq"), F.regexp_replace("url", r"[?#].*$", "").alias("path"))


_FILES = "WITH f AS (SELECT page_id AS seq, regexp_replace(url, '[?#].*$', '') AS path FROM pages)"


@query(f"{_FILES} SELECT seq, regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1) AS ext, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM f")
def path_parts(spark, d):
    p = F.col("path")
    return _files(spark, d).select("seq", paths.suffix(p).alias("ext"), paths.parent(p).alias("dir"))


@query(f"WITH {P.METRICS_SQL} SELECT seq, path FROM m WHERE lower(regexp_extract(path, '\\.[^.]+$')) IN ('.jpg', '.jpeg', '.png', '.bmp', '.gif', '.tif', '.tiff', '.webp', '.heic', '.heif', '.dng')")
def scan_filter_ext(spark, d):
    from darkroom.sources.files import has_image_extension

    return P.pixels_table(spark, d).where(has_image_extension(F.col("path"))).select("seq", "path")


@query(f"{_FILES}, g AS (SELECT *, row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1) ORDER BY seq) AS n FROM f) SELECT seq, path FROM g WHERE n = 1")
def scan_dedup_path(spark, d):
    from darkroom.sources.files import first_of_each

    f = _files(spark, d).withColumn("key", paths.parent(F.col("path")))
    return first_of_each(f, "key").select("seq", "path")


@query(f"WITH {P.METRICS_SQL} SELECT seq, path FROM m WHERE NOT starts_with(path, 'roll3/')")
def scan_skip_subtree(spark, d):
    return P.pixels_table(spark, d).where(~paths.is_under(F.col("path"), "roll3")).select("seq", "path")


# library
def _assets(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(
        F.col("event_id").cast("string").alias("asset_id"), F.col("event_id").alias("n"), F.lit(None).cast("string").alias("filename"), F.lit("image").alias("media_type"),
        (F.col("user_id") % 5 == 0).alias("favorite"), F.col("ts").alias("creation_date"), (F.col("event_id") % 7 == 0).alias("in_cloud"), F.col("event_type").alias("album"),
    )


@query(
    """SELECT CAST(event_id AS VARCHAR) AS asset_id, row_number() OVER (ORDER BY ts DESC, event_id) - 1 AS pos FROM events
WHERE event_type = 'view' AND user_id % 5 <> 0 AND ts >= (SELECT min(ts) FROM events) + INTERVAL 1 DAY QUALIFY pos < 50"""
)
def library_subset(spark, d):
    from darkroom.sources.library import fetch

    a = _assets(spark, d)
    since = a.agg(F.min("creation_date")).first()[0]
    from datetime import timedelta

    out = fetch(a.where("album = 'view'"), since=since + timedelta(days=1), limit=50)
    return out.select("asset_id", (F.row_number().over(Window.orderBy(F.desc("creation_date"), "n")) - 1).cast("bigint").alias("pos"))


@query("SELECT CAST(event_id AS VARCHAR) AS asset_id, CASE WHEN event_id % 7 = 0 THEN 'in cloud, download is off' ELSE '' END AS error, CAST(event_id AS VARCHAR) AS name FROM events")
def library_cloud_gate(spark, d):
    from darkroom.sources.library import cloud_error, display_name

    return _assets(spark, d).select("asset_id", cloud_error(False).alias("error"), display_name().alias("name"))


# albums
def _assets_of(spark, d):
    return P.pixels_table(spark, d).where("seq % 9 <> 4").select("asset_id")


@query(
    f"""{_D}, x AS (SELECT recommendation AS album_key, asset_id, sharpness, {RANK} AS rk, seq FROM dd WHERE recommendation IN ('delete', 'duplicate', 'review') AND seq % 9 <> 4)
SELECT album_key, 'PQ 2024-05-01 ' || CASE album_key WHEN 'delete' THEN 'Delete candidates' WHEN 'duplicate' THEN 'Duplicates' ELSE 'Review' END AS title,
row_number() OVER (PARTITION BY album_key ORDER BY sharpness, rk, seq) - 1 AS pos, asset_id FROM x"""
)
def albums_by_tier(spark, d):
    return report.albums_by_tier(_deduped(spark, d), _assets_of(spark, d), "{prefix} {date} {tier}", "PQ", "2024-05-01").withColumn("pos", F.col("pos").cast("bigint"))


_SIG = "CASE r WHEN 'blurry' THEN 'blur' WHEN 'very_blurry' THEN 'blur' WHEN 'dark' THEN 'dark' WHEN 'very_dark' THEN 'dark' WHEN 'low_contrast' THEN 'contrast' WHEN 'noisy' THEN 'noise' WHEN 'bad_exposure' THEN 'exposure' WHEN 'low_aesthetic' THEN 'aesthetic' WHEN 'utility' THEN 'utility' WHEN 'low_face_quality' THEN 'face' END"
_LABEL = "CASE k WHEN 'blur' THEN 'Blurry' WHEN 'dark' THEN 'Too dark' WHEN 'contrast' THEN 'Low contrast' WHEN 'noise' THEN 'Noisy' WHEN 'exposure' THEN 'Bad exposure' WHEN 'aesthetic' THEN 'Low aesthetic' WHEN 'utility' THEN 'Utility/screenshot' WHEN 'face' THEN 'Poor face capture' ELSE 'Duplicates' END"


@query(
    f"""{_D}, o AS (SELECT *, {RANK} AS rk FROM dd WHERE seq % 9 <> 4),
x AS (SELECT {_SIG} AS k, asset_id, sharpness, rk, seq FROM (SELECT unnest(reasons) AS r, * FROM o WHERE recommendation IN ('delete', 'review'))
      UNION ALL SELECT 'duplicate', asset_id, sharpness, rk, seq FROM o WHERE recommendation = 'duplicate')
SELECT k AS album_key, 'PQ 2024-05-01 ' || {_LABEL} AS title, row_number() OVER (PARTITION BY k ORDER BY sharpness, rk, seq) - 1 AS pos, asset_id FROM x"""
)
def albums_by_signal(spark, d):
    return report.albums_by_signal(_deduped(spark, d), _assets_of(spark, d), "{prefix} {date} {tier}", "PQ", "2024-05-01", ALL).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    """WITH old AS (SELECT CASE WHEN page_id % 3 = 0 THEN 'PQ ' ELSE 'Trip ' END || CAST(page_id % 7 AS VARCHAR) AS title, CAST(page_id AS VARCHAR) AS asset_id, page_id % 2 = 0 AS is_ours FROM pages)
SELECT title, asset_id FROM old WHERE NOT (starts_with(title, 'PQ') AND is_ours) UNION ALL SELECT 'PQ new', CAST(page_id AS VARCHAR) FROM pages WHERE page_id % 10 = 0"""
)
def album_replace(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    i = F.col("page_id")
    old = p.select(F.concat(F.when(i % 3 == 0, "PQ ").otherwise("Trip "), (i % 7).cast("string")).alias("title"), i.cast("string").alias("asset_id"), (i % 2 == 0).alias("is_ours"))
    new = p.where("page_id % 10 = 0").select(F.lit("PQ new").alias("title"), i.cast("string").alias("asset_id"), F.lit(True).alias("is_ours"))
    return report.replace_albums(old, new, "PQ").select("title", "asset_id")


# files and moves
_STEM = "regexp_replace(regexp_extract({0}, '[^/]*$'), '\\.[^.]+$', '')"


@query(
    f"""WITH {P.METRICS_SQL}, fi AS (SELECT path FROM m UNION SELECT regexp_replace(path, '\\.[^.]+$', '.XMP') FROM m WHERE seq % 6 = 0 UNION SELECT regexp_replace(path, '\\.[^.]+$', '.aae') FROM m WHERE seq % 15 = 0),
k AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, lower({_STEM.format('path')}) AS st FROM fi),
c AS (SELECT a.path, array_to_string(list_sort(list(DISTINCT b.path)), ';') AS companions FROM k a JOIN k b ON a.dir = b.dir AND a.st = b.st AND a.path <> b.path GROUP BY a.path)
SELECT m.path, coalesce(companions, '') AS companions FROM m LEFT JOIN c USING (path)"""
)
def companions(spark, d):
    items = P.pixels_table(spark, d).select("seq", "path")
    side = lambda n, ext: items.where(F.col("seq") % n == 0).select(F.regexp_replace("path", r"\.[^.]+$", ext).alias("path"))
    files = items.select("path").unionAll(side(6, ".XMP")).unionAll(side(15, ".aae"))
    return moves.companions(items, files).select("path", F.concat_ws(";", "companions").alias("companions"))


@query(
    f"""{_D}, x AS (SELECT seq, path FROM dd WHERE recommendation IN ('delete', 'duplicate') AND seq % 5 <> 2)
SELECT seq, path, 'Q/' || CASE WHEN starts_with(path, 'roll1/') THEN substr(path, 7) WHEN starts_with(path, 'roll2/') THEN substr(path, 7) ELSE regexp_extract(path, '[^/]*$') END AS target FROM x"""
)
def move_plan_roots(spark, d):
    p = _deduped(spark, d)
    return moves.quarantine_plan(p, ("delete", "duplicate"), ["roll1", "roll2"], "Q", p.where("seq % 5 <> 2").select("path"))


@query(
    """WITH x AS (SELECT page_id AS seq, 'Q/p' || CAST(page_id % 40 AS VARCHAR) || '.jpg' AS want FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY want ORDER BY seq) - 1 AS k FROM x)
SELECT seq, CASE WHEN k = 0 THEN want ELSE replace(want, '.jpg', '__' || CAST(k AS VARCHAR) || '.jpg') END AS target FROM n"""
)
def move_plan_collisions(spark, d):
    plan = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("seq"), F.concat(F.lit("Q/p"), (F.col("page_id") % 40).cast("string"), F.lit(".jpg")).alias("target"))
    return moves.resolve_collisions(plan)


def _log(spark, d):
    i = F.col("event_id")
    return spark.read.parquet(f"{d}/events.parquet").select(
        (i % 50).alias("action_id"), (i % 90).alias("owner"), F.concat(F.lit("f"), i.cast("string")).alias("orig"), F.concat(F.lit("Q/f"), i.cast("string")).alias("dest"),
        (i % 11 == 0).alias("undone"), (i % 13 != 5).alias("ok"), (i * 3).alias("stat_bytes"),
    )


_LOG = "WITH l AS (SELECT event_id % 50 AS action_id, event_id % 90 AS owner, 'f' || CAST(event_id AS VARCHAR) AS orig, 'Q/f' || CAST(event_id AS VARCHAR) AS dest, event_id % 11 = 0 AS undone, event_id % 13 <> 5 AS ok, event_id * 3 AS sb, event_id FROM events)"


@query(f"{_LOG} SELECT action_id, count(DISTINCT owner) AS owners, count(*) AS files, CAST(sum(CASE WHEN ok THEN (CASE WHEN event_id % 2 = 0 THEN 7 ELSE sb END) * (CASE WHEN undone THEN -1 ELSE 1 END) ELSE 0 END) AS BIGINT) AS freed, bool_and(ok) AS all_ok FROM l GROUP BY action_id")
def action_accounting(spark, d):
    log = _log(spark, d)
    items = spark.read.parquet(f"{d}/events.parquet").where("event_id % 2 = 0").select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), F.lit(7).cast("bigint").alias("file_bytes"))
    return moves.accounting(log, items)


@query(f"{_LOG} SELECT owner, dest AS path, orig AS target FROM l WHERE ok AND action_id = (SELECT max(action_id) FROM l WHERE NOT undone)")
def undo_accounting(spark, d):
    return moves.undo_plan(_log(spark, d))


@query(f"{_D}, o AS (SELECT seq AS owner, path FROM dd WHERE seq % 7 = 3) SELECT owner, path, false AS is_companion FROM o UNION ALL SELECT owner, path || '.xmp', true FROM o WHERE owner % 2 = 0")
def action_plan(spark, d):
    items = _deduped(spark, d).select("seq", "path")
    side = items.select("path", F.when(F.col("seq") % 2 == 0, F.array(F.concat("path", F.lit(".xmp")))).otherwise(F.array().cast("array<string>")).alias("companions"))
    return moves.action_plan(items.where("seq % 7 = 3").select("seq"), items, side)


# gallery
@query(f"{_G} SELECT recommendation, count(*) AS n FROM g WHERE NOT removed GROUP BY 1")
def gallery_facets_tier(spark, d):
    return gallery.facets_tier(_gallery(spark, d))


@query(f"{_G}, s AS (SELECT DISTINCT seq, {_SIG} AS k FROM (SELECT seq, unnest(reasons) AS r FROM g WHERE NOT removed)) SELECT k AS signal, {_LABEL} AS label, count(*) AS n FROM s WHERE k IS NOT NULL GROUP BY k")
def gallery_facets_signal(spark, d):
    return gallery.facets_signal(_gallery(spark, d)).select("signal", "label", "n")


@query(f"{_G} SELECT seq FROM g WHERE NOT removed AND recommendation IN ('delete', 'review') AND list_has_any(reasons, ['blurry', 'very_blurry', 'noisy']) AND contains(lower(regexp_extract(path, '[^/]*$')), 'img_1')")
def gallery_filter(spark, d):
    return gallery.visible(_gallery(spark, d), ("delete", "review"), ("blur", "noise"), "IMG_1").select("seq")


_SORTS = {
    "tier": f"{RANK}, sharpness, seq", "cluster": "cluster_id, is_keeper DESC, sharpness, seq", "name": "lower(regexp_extract(path, '[^/]*$')), seq", "sharpness": "sharpness, seq",
    "aesthetic": "coalesce(aesthetic, 0), seq", "face_quality": "coalesce(face_quality, 0), seq", "file_bytes": "file_bytes, seq",
}


def _sort(key: str) -> None:
    @query(f"{_G} SELECT seq, row_number() OVER (ORDER BY {_SORTS[key]}) - 1 AS pos FROM g WHERE {_VIS}", f"gallery_sort_{key}")
    def run(spark, d):
        return gallery.ranked(gallery.visible(_gallery(spark, d)), key).select("seq", F.col("pos").cast("bigint").alias("pos"))


for _k in _SORTS:
    _sort(_k)


@query(f"{_G} SELECT seq FROM (SELECT seq, row_number() OVER (ORDER BY {_SORTS['tier']}) - 1 AS pos FROM g WHERE {_VIS}) WHERE pos >= 120 AND pos < 240")
def gallery_page(spark, d):
    return gallery.page(gallery.visible(_gallery(spark, d)), "tier", 1).select("seq")


_V = f"{_G}, v AS (SELECT *, row_number() OVER (ORDER BY {_SORTS['tier']}) - 1 AS pos FROM g WHERE {_VIS})"


@query(f"{_V} SELECT seq FROM v WHERE pos BETWEEN (SELECT min(pos) FROM v WHERE seq IN (23, 301)) AND (SELECT max(pos) FROM v WHERE seq IN (23, 301)) AND (SELECT count(*) FROM v WHERE seq IN (23, 301)) = 2 OR seq = 301 AND (SELECT count(*) FROM v WHERE seq IN (23, 301)) < 2")
def gallery_range_mark(spark, d):
    return gallery.range_ids(gallery.ranked(gallery.visible(_gallery(spark, d)), "tier"), 23, 301)


@query(f"{_V} SELECT seq, pos, lag(seq) OVER (ORDER BY pos) AS prev_seq, lead(seq) OVER (ORDER BY pos) AS next_seq FROM v")
def gallery_focus_nav(spark, d):
    return gallery.neighbours(gallery.ranked(gallery.visible(_gallery(spark, d)), "tier")).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    f"""{_G}, v AS (SELECT *, row_number() OVER (ORDER BY {_SORTS['cluster']}) - 1 AS pos FROM g WHERE {_VIS}),
w AS (SELECT *, pos // 120 AS page, cluster_id >= 0 AND cluster_size > 1 AS ins FROM v)
SELECT seq, pos, page, ins AND lag(cluster_id) OVER (PARTITION BY page ORDER BY pos) IS DISTINCT FROM cluster_id AS has_header,
CASE WHEN ins THEN count(*) OVER (PARTITION BY cluster_id) ELSE 0 END AS members_in_view FROM w"""
)
def cluster_headers(spark, d):
    v = gallery.headers(gallery.ranked(gallery.visible(_gallery(spark, d)), "cluster"))
    return v.select("seq", F.col("pos").cast("bigint"), F.col("page").cast("bigint"), "has_header", "members_in_view")


@query(f"{_G} SELECT seq, is_keeper, row_number() OVER (ORDER BY is_keeper DESC, sharpness DESC, seq) - 1 AS pos FROM g WHERE cluster_id = 0 AND NOT removed")
def cluster_compare(spark, d):
    return gallery.compare(_gallery(spark, d), 0).withColumn("pos", F.col("pos").cast("bigint"))


_OLD = "om AS (SELECT seq, CASE WHEN seq % 2 = 0 THEN 'reject' ELSE 'keep' END AS mark FROM g WHERE seq % 4 = 1 OR seq % 8 = 0)"


def _old_marks(items):
    return items.where("seq % 4 = 1 OR seq % 8 = 0").select("seq", F.when(F.col("seq") % 2 == 0, "reject").otherwise("keep").alias("mark"))


@query(f"{_V}, {_OLD}, tm AS (SELECT seq FROM v WHERE pos < 120) SELECT seq, 'reject' AS mark FROM tm UNION ALL SELECT seq, mark FROM om WHERE seq NOT IN (SELECT seq FROM tm)")
def marks_after_page(spark, d):
    g = _gallery(spark, d)
    return gallery.set_marks(_old_marks(g), gallery.page(gallery.visible(g), "tier", 0).select("seq", F.lit("reject").alias("mark")))


@query(f"{_G}, {_OLD}, tm AS (SELECT seq, CASE WHEN is_keeper THEN 'keep' ELSE 'reject' END AS mark FROM g WHERE cluster_id = 1 AND NOT removed) SELECT * FROM tm UNION ALL SELECT seq, mark FROM om WHERE seq NOT IN (SELECT seq FROM tm)")
def marks_after_keep_best(spark, d):
    g = _gallery(spark, d)
    return gallery.set_marks(_old_marks(g), gallery.keep_best(g, 1))


@query(f"{_V}, {_OLD}, tm AS (SELECT seq FROM v WHERE cluster_id = 2 AND NOT is_keeper) SELECT seq, 'reject' AS mark FROM tm UNION ALL SELECT seq, mark FROM om WHERE seq NOT IN (SELECT seq FROM tm)")
def marks_after_mark_others(spark, d):
    g = _gallery(spark, d)
    return gallery.set_marks(_old_marks(g), gallery.mark_others(gallery.visible(g), 2))


@query(f"{_G}, {_OLD} SELECT count(*) FILTER (mark = 'reject') AS rejects, count(*) FILTER (mark = 'keep') AS keeps, CAST(coalesce(sum(file_bytes) FILTER (mark = 'reject'), 0) AS BIGINT) AS bytes FROM g JOIN om USING (seq) WHERE NOT removed")
def mark_totals(spark, d):
    g = _gallery(spark, d)
    return gallery.mark_totals(g, _old_marks(g))


@query(f"{_G} SELECT seq, regexp_extract(path, '[^/]*$') AS name, recommendation, {JOINED} AS reasons, cluster_id, is_keeper, file_bytes, removed FROM g")
def json_feed(spark, d):
    """Items as JSON texts, read back."""
    fields = "seq bigint, path string, recommendation string, reasons array<string>, cluster_id bigint, is_keeper boolean, file_bytes bigint, removed boolean"
    j = gallery.json_feed(_gallery(spark, d)).select(F.from_json("json", fields).alias("j")).select("j.*")
    return j.select("seq", paths.basename(F.col("path")).alias("name"), "recommendation", F.concat_ws(";", "reasons").alias("reasons"), "cluster_id", "is_keeper", "file_bytes", "removed")


@query(
    f"""{_G} SELECT seq AS id, regexp_extract(path, '[^/]*$') AS name, recommendation, {JOINED} AS reasons, {_d6('sharpness', 'brightness', 'contrast', 'noise')}, aesthetic, is_utility, face_quality,
cluster_id, cluster_size, is_keeper, megapixels, file_bytes, seq % 5 <> 2 AS exists, removed, CASE WHEN seq % 6 = 0 THEN regexp_extract(path, '[^/]*$') || '.xmp' ELSE '' END AS companions FROM g"""
)
def item_feed(spark, d):
    g = _gallery(spark, d)
    side = g.where("seq % 6 = 0").select("path", F.array(F.concat("path", F.lit(".xmp"))).alias("companions"))
    feed = gallery.item_feed(g, side, g.where("seq % 5 <> 2").select("path"))
    text = {"reasons": F.concat_ws(";", "reasons"), "companions": F.concat_ws(";", "companions"), "cluster_id": F.col("cluster_id").cast("bigint"), "cluster_size": F.col("cluster_size").cast("bigint")}
    return feed.withColumns(text | {c: F.round(c, 6) for c in ("sharpness", "brightness", "contrast", "noise")})


@query(f"{_G} SELECT count(*) FILTER ({_VIS}) AS shown, count(*) FILTER (NOT removed) AS total FROM g")
def gallery_view_counts(spark, d):
    g = _gallery(spark, d)
    return gallery.view_counts(g, gallery.visible(g))


@query(f"{_G} SELECT count(*) FILTER (seq % 5 <> 2) AS present, count(*) FILTER (seq % 5 = 2) AS missing FROM g")
def present_counts(spark, d):
    g = _gallery(spark, d)
    return gallery.present_counts(g, g.where("seq % 5 <> 2").select("path"))


@query(f"{_G}, {_OLD} SELECT seq, mark FROM om WHERE seq NOT IN (SELECT seq FROM g WHERE cluster_id = 1)")
def marks_after_clear_cluster(spark, d):
    g = _gallery(spark, d)
    return gallery.clear_cluster(g, _old_marks(g), 1)


@query("SELECT event_id, least(greatest(coalesce(TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'x' ELSE CAST(value AS VARCHAR) END AS DOUBLE), 320), 160), 2000) AS size FROM events")
def request_clamp(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    given = F.when(F.col("event_id") % 4 == 0, F.lit("x")).otherwise(F.col("value").cast("string"))
    return e.select("event_id", gallery.clamped(given, 320, 160, 2000).alias("size"))


@query("SELECT event_id, CASE WHEN event_id % 1000 <= 240 THEN 160 WHEN event_id % 1000 <= 480 THEN 320 ELSE 640 END::DOUBLE AS option FROM events")
def thumbnail_option(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", gallery.nearest_option(F.col("event_id") % 1000, [160, 320, 640]).alias("option"))


@query("WITH k AS (SELECT 'f' || CAST(event_id % 900 AS VARCHAR) || '@320q9' AS key, max(event_id) AS t FROM events GROUP BY 1) SELECT key FROM k QUALIFY row_number() OVER (ORDER BY t DESC, key) > 600")
def thumbnails_evicted(spark, d):
    i = F.col("event_id")
    key = gallery.thumbnail_key(F.concat(F.lit("f"), (i % 900).cast("string")), F.lit(320), F.lit(9))
    return gallery.evicted(spark.read.parquet(f"{d}/events.parquet").select(key.alias("key"), i.alias("at")), 600)


@query(f"{_D} SELECT CAST(sum(CASE WHEN seq % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n_companions FROM dd WHERE seq % 7 = 3")
def expected_companions(spark, d):
    items = _deduped(spark, d).select("seq", "path")
    names = F.when(F.col("seq") % 2 == 0, F.array(F.concat("path", F.lit(".xmp")), F.concat("path", F.lit(".aae")))).otherwise(F.array(F.concat("path", F.lit(".xmp"))))
    return moves.expected_companions(items.where("seq % 7 = 3").select("seq"), items.select("path", names.alias("companions")), items)


@query(f"{_D} SELECT seq, path, 'Q/' || regexp_extract(path, '[^/]*$') AS target FROM dd WHERE recommendation IN ('delete', 'duplicate')")
def move_plan(spark, d):
    return moves.quarantine_plan(_deduped(spark, d), ("delete", "duplicate"), [], "Q")


@query("SELECT vec_id AS seq, len(embedding) AS n, CAST(embedding[1] AS FLOAT) AS first_value FROM embeddings")
def fprint_bytes(spark, d):
    """Fingerprints as bytes with a few bytes too many, read as floats."""
    from darkroom.operators.similarity import float_vectors

    @F.pandas_udf("binary")
    def packed(column):
        return column.map(lambda v: v.astype("<f4").tobytes() + b"ab")

    b = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("seq"), packed("embedding").alias("fprint"))
    return float_vectors(b).select("seq", F.size("fprint").cast("bigint").alias("n"), F.col("fprint")[0].alias("first_value"))


@query(f"{_D} SELECT path, recommendation, {JOINED} AS reasons, {_d6('sharpness')}, width, file_bytes, is_keeper FROM dd")
def csv_roundtrip(spark, d):
    """The report written as CSV and read back with types."""
    from darkroom.runtime import scratch_path
    from darkroom.sources.report import read_report, write_report

    path = scratch_path(spark, "report")
    write_report(_deduped(spark, d), path)
    r = read_report(spark, path)
    return r.select("path", "recommendation", F.concat_ws(";", "reasons").alias("reasons"), *_r6("sharpness"), "width", "file_bytes", "is_keeper")


@query(f"{_G} SELECT seq, pos FROM (SELECT seq, row_number() OVER (ORDER BY {_SORTS['tier']}) - 1 AS pos FROM g WHERE {_VIS}) WHERE pos >= 120 AND pos < 240")
def gallery_view_page(spark, d):
    view = gallery.View(spark, scratch_path(spark, "view")).write(gallery.visible(_gallery(spark, d)), "tier", 50)
    return view.page(1).select("seq", "pos")


def _number(path):
    return F.regexp_extract(path, r"(\d+)[.]png$", 1).cast("bigint")


def _image_metrics(spark, d, outputs=frozenset()):
    listing, _ = files.scan(spark, [P.image_files(spark, d)])
    return files.analyse(listing, outputs).withColumn("seq", _number(F.col("path")))


@query(
    f"""WITH {P.METRICS_SQL}, q AS (SELECT m.seq, list_sum(px) / 64 AS b, m.black_frac, m.white_frac FROM m JOIN p ON p.seq = m.seq)
SELECT seq, 8 AS width, 8 AS height, round_even(b, 1) AS brightness, round_even(black_frac, 3) AS black_frac, round_even(white_frac, 3) AS white_frac, '' AS error FROM q"""
)
def decode_real_images(spark, d):
    return _image_metrics(spark, d).select("seq", "width", "height", "brightness", "black_frac", "white_frac", "error")


@query(
    f"""WITH {P.METRICS_SQL}, c AS (SELECT seq, [px[(k // 96) * 8 + (k % 32) // 4 + 1] for k in range(768)] AS cells FROM p)
SELECT seq, CAST(len(cells) AS BIGINT) AS n_dims, CAST(len([x for x in cells if x > 0]) AS BIGINT) AS n_lit, CAST(CASE WHEN list_max(cells) > 0 THEN list_position(cells, list_max(cells)) ELSE 1 END AS BIGINT) AS brightest FROM c"""
)
def embed_standin(spark, d):
    v = _image_metrics(spark, d, frozenset({"fprint"}))
    return v.select("seq", F.size("fprint").cast("bigint").alias("n_dims"), F.size(F.filter("fprint", lambda x: x > 0)).cast("bigint").alias("n_lit"), F.array_position("fprint", F.array_max("fprint")).cast("bigint").alias("brightest"))


@query(f"WITH {P.METRICS_SQL} SELECT seq, 4 AS width, 4 AS height, 4 AS read_width, 1 AS read_channels FROM m")
def thumbnail_files(spark, d):
    """Thumbnails of real images, written and decoded again by Spark's image reader."""
    listing, _ = files.scan(spark, [P.image_files(spark, d)])
    small = materialise(files.thumbnails(listing, 4).withColumn("seq", _number(F.col("path"))), "thumbnails")
    folder = P.written_files(small.select(F.concat(F.col("seq").cast("string"), F.lit(".png")).alias("name"), F.col("png").alias("data")))
    with many_files(spark, 0):  # thumbnails of 4 pixels are small
        back = spark.read.format("image").load(folder).select(_number(F.col("image.origin")).alias("seq"), F.col("image.width").alias("read_width"), F.col("image.nChannels").alias("read_channels"))
        back = materialise(back, "thumbnails-read")
    return small.select("seq", "width", "height").join(back, "seq").select("seq", "width", "height", "read_width", "read_channels")


@query(f"WITH RECURSIVE {P.CLUSTER_SQL} SELECT seq, component FROM lab")
def incremental_stream(spark, d):
    """Clusters of vectors that come as a stream, in at least three micro-batches: those of one run over all."""
    vectors, n = scratch_path(spark, "stream-vectors"), shuffle_partitions(spark)
    P.pixels_table(spark, d).select("seq", "fprint").repartition(3 * n).write.parquet(vectors)
    state = Clusters(spark, scratch_path(spark, "stream-clusters"), P.T)
    stream = spark.readStream.schema("seq bigint, fprint array<float>").option("maxFilesPerTrigger", n).parquet(vectors)
    each_batch(stream, lambda rows, batch: state.add(rows, batch, "seq"), scratch_path(spark, "stream-checkpoint"))
    return state.labels().select(F.col("node").alias("seq"), F.col("root").alias("component"))


_TITLES = "SELECT doc_id AS seq, 'n/' || replace(left(text, 24), '/', ' ') AS path FROM documents WHERE text IS NOT NULL"


@query(f"SELECT seq, row_number() OVER (ORDER BY substr(path, 3) COLLATE de, seq) - 1 AS pos FROM ({_TITLES})")
def gallery_sort_name_language(spark, d):
    """Beginnings of texts in four languages as names, in the order of a language."""
    titles = spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL").select(F.col("doc_id").alias("seq"), F.concat(F.lit("n/"), F.translate(F.left("text", F.lit(24)), "/", " ")).alias("path"))
    return gallery.ranked(titles, "name:de").select("seq", "pos")
