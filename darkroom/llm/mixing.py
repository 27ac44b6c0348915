"""Mixing sources to target weights, natively: hash-random order, prefix sums by key range, exact budgets.

Every document gets a hash-random key. Within each source, documents are ordered by key; prefix sums of their
sizes say which of them fall into the source's budget. The key space of each source is cut into equal ranges, as many as the
source's rows ask for, so a source with a third of all rows is spread like any other data: range totals are summed first
(pre-aggregated), a running sum over the few ranges gives each range its start, and only then are rows ordered inside their range.

Only DataFrame functions are used; no Python code runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from darkroom.runtime import materialise, shuffle_partitions

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
EPOCHS = 2
SEED = "mix"
ROWS_PER_RANGE = (256, 65536)


def n_words(text: Column) -> Column:
    """Words of a whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: its size, its target and the whole budget that is cut from it.

    ``sizes`` has (source, rows, source_size). Sources take the weights in turn, by code point order, null last. The mix holds
    ``share_percent`` of all sizes; a target stops at ``epochs`` times its source's size and the excess is shared again by weight.
    That fixed point is found in one pass over sources ordered by (limit / weight): a source is at its limit exactly if
    its limit per weight is at most the level that the mix would have with all earlier ones at theirs.
    The windows run over one row per source, never over documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "rows", "source_size", w.alias("w"), (F.col("source_size") * epochs).alias("most"))
    everything = Window.partitionBy()
    by_limit = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranked.select(
        "*",
        (F.sum("source_size").over(everything) * share_percent).alias("want_x100"),
        F.sum("w").over(everything).alias("all_w"),
        F.coalesce(F.sum("most").over(by_limit), F.lit(0)).alias("most_before"),
        F.coalesce(F.sum("w").over(by_limit), F.lit(0)).alias("w_before"),
    )
    level = (F.col("want_x100") / 100.0 - F.col("most_before")) / (F.col("all_w") - F.col("w_before"))
    free = F.col("most") / F.col("w") > F.col("level")
    first = F.min(F.when(free, F.struct(F.col("most") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(everything)
    settled = summed.withColumn("level", level).withColumn("first", first)
    target = F.when(F.col("first").isNull(), F.col("most").cast("double")).otherwise(
        F.least(F.col("most").cast("double"), F.col("w") * F.col("first")["level"])
    )
    return settled.select("source", "rows", "source_size", "w", target.alias("target"))


def mix(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS, seed: str = SEED,
) -> DataFrame:
    """How many words of every document the mix takes.

    Returns one row per input row: doc_id, source, tie, size, source_size, target, taken. A source's whole epochs take all of its
    documents; the rest of its budget is taken in key order, and the document at the budget's end gives only
    its first words, so a source's taken words add up to the whole part of its target.

    Null text counts as empty (size 0, taken 0). Null source is a source of its own. Null or repeated doc_id
    rows are rows like others; rows that tie in key, doc_id and size are interchangeable. An empty table gives an empty table;
    other columns are ignored. Reruns agree, because keys depend on doc_id and seed only (without doc_id on the text).
    """
    spark = docs.sparkSession
    narrow = materialise(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
            F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":" + seed), F.when(F.col(doc_id).isNull(), F.concat(F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))).otherwise("")).cast("binary")).alias("key"),
            F.xxhash64(F.col(text)).alias("tie"),
        ),
        "mix-sizes",
    )
    targets = source_targets(narrow.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size")), weights, share_percent, epochs)
    targets = materialise(targets, "mix-targets")
    total = narrow.count()
    low, high = ROWS_PER_RANGE
    per_range = min(max(total // (4 * shuffle_partitions(spark)), low), high)
    keyed = narrow.join(targets, narrow["source"].eqNullSafe(targets["source"])).select(
        "doc_id", narrow["source"], "size", "key", "tie", "source_size", "target",
        F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * F.ceil(F.col("rows") / per_range) / F.lit(1 << 32)).alias("range"),
    )
    here = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size")).select(
        F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("range_size").over(here), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, placed["source"].eqNullSafe(starts["s"]) & (placed["range"] == starts["r"]))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - whole * F.col("source_size") - F.col("start") - F.col("inside")
    return placed.select(
        "doc_id", "source", "tie", "size", "source_size", "target",
        (whole * F.col("size") + F.least(F.greatest(rest, F.lit(0)), F.col("size"))).cast("bigint").alias("taken"),
    )


def _first_words(text: Column, n: Column) -> Column:
    """The part of a text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), n.cast("int")), "")


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", n_chars: str | None = "n_chars", **parameters) -> DataFrame:
    """The rows of the mix, with the columns of ``docs`` (of any names): each document as often as its source's epochs take it.

    The document at the end of a budget comes once with its first words only, and ``n_chars`` (if there is such a column) is counted again there.
    Documents without words stay once. Of rows that agree in doc_id, source and text, each is taken on its own.
    """
    taken = mix(docs, text, doc_id, source, **parameters)
    # equal rows are taken alike but for the one at the budget's end: number them
    order = Window.partitionBy("doc_id", "source", "tie").orderBy("taken")
    taken = taken.select(F.col("doc_id").alias("its_id"), F.col("source").alias("its_source"), F.col("tie").alias("its_tie"), "size", "taken", F.row_number().over(order).alias("its_n"))
    taken = materialise(taken, "mix-taken")
    repeated = taken.where("its_n > 1").limit(1).count() > 0
    rows = docs.select(F.struct(F.expr("*")).alias("row"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{source}`").alias("source"), F.xxhash64(F.col(f"`{text}`")).alias("tie"))
    same = (F.col("tie") == F.col("its_tie")) & F.col("id").eqNullSafe(F.col("its_id")) & F.col("source").eqNullSafe(F.col("its_source"))
    if repeated:
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("id", "source", "tie").orderBy(F.lit(0))))
        same = same & (F.col("n") == F.col("its_n"))
    joined = rows.join(taken.where("taken > 0 OR size = 0"), same)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(1))
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0))
    pieces = F.concat(F.array_repeat(F.lit(-1).cast("bigint"), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    copies = joined.select("row", F.explode(pieces).alias("first"))
    cut = F.col("first") >= 0
    own = lambda c: F.col("row")[c]
    short = F.when(cut, _first_words(own(text), F.col("first"))).otherwise(own(text))
    out = []
    for c in docs.columns:
        value = own(c)
        if c == text:
            value = short
        elif c == n_chars:
            value = F.when(cut, F.char_length(short).cast(docs.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return copies.select(*out)


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents`` by weights 3, 1, 2 at 150% of all words: doc_id, size, source_size, target, taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':mix', CASE WHEN doc_id IS NULL THEN concat(':', md5(coalesce(text, ''))) ELSE '' END)) AS k, text
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 2 * source_size AS most,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM s),
o AS (
  SELECT *, sum(source_size) OVER () * 150 / CAST(100 AS DOUBLE) AS want, sum(w) OVER () AS all_w,
         coalesce(sum(most) OVER (ORDER BY most / CAST(w AS DOUBLE), source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mb,
         coalesce(sum(w) OVER (ORDER BY most / CAST(w AS DOUBLE), source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb
  FROM w),
l AS (SELECT *, (CAST(want AS DOUBLE) - CAST(mb AS DOUBLE)) / CAST(all_w - wb AS DOUBLE) AS level FROM o),
f AS (SELECT level FROM l WHERE most / CAST(w AS DOUBLE) > level ORDER BY most / CAST(w AS DOUBLE), source IS NULL, source LIMIT 1),
t AS (
  SELECT source, source_size,
         least(CAST(most AS DOUBLE), CAST(w AS DOUBLE) * coalesce((SELECT level FROM f), CAST('infinity' AS DOUBLE))) AS target
  FROM l),
p AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE
         (budget // source_size) * size + least(greatest(budget - (budget // source_size) * source_size - before, 0), size) END AS BIGINT) AS taken
FROM p
"""
