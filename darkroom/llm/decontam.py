"""Benchmark decontamination, natively: prefix-filtered set join of item windows with documents.

A window is ``size`` consecutive words of an item; its set is made of word shingles. A document holds a window only if it holds all of
its shingles, so at full containment the necessary prefix is one token: the window's rarest shingle.

1. Documents become word arrays, written once. Their shingles are met with the shingles of the items; what meets gives the exact
   frequency of every item shingle over all documents.
2. Every window is represented by its rarest shingle (least frequent, then first). Places of that shingle are the candidates; the place must leave
   room for the words before it (positional bound) and after it (length bound).
3. Candidates of a document are verified by comparing all words of the window, so 64-bit shingle hashes decide nothing.

Only DataFrame functions are used; no Python code runs on executors.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.operators.skew import join_counted
from darkroom.runtime import discard, materialise

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3
#: So many distinct shingles of the items (16 bytes each) are broadcast at most; more are joined by a shuffle.
BROADCAST_SHINGLES = 1 << 20


def ascii_lower(text: Column) -> Column:
    """A text with A-Z in lower case and all other characters as they are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    """Words of a whole text, A-Z in lower case; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _shingle_hashes(words: Column, n: Column, width: int) -> Column:
    """Hashes of all shingles of a word array with at least ``width`` words."""
    return F.transform(F.sequence(F.lit(0).cast("bigint"), n - width), lambda i: F.xxhash64(F.lit(width), *[F.get(words, (i + k).cast("int")) for k in range(width)]))


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Windows of items: item (its id as text, null: empty), window (its words joined by spaces), length. Items without words have none."""
    words = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("words"))
    words = words.withColumn("n", F.size("words")).where("n > 0")
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - size, F.lit(0))), lambda i: F.slice("words", i + 1, size))
    one = words.select("item", F.explode(windows).alias("words"))
    return one.select("item", F.array_join("words", " ").alias("window"), F.size("words").alias("length"), "words").dropDuplicates(["item", "window"])


def _prefix_places(words: DataFrame, windows: DataFrame, shingle: int) -> DataFrame | None:
    """Candidates: uid, window, length, start (from 0). None if there is no window."""
    tokens = []
    for width in sorted({min(shingle, r["length"]) for r in windows.select("length").distinct().collect()}):  # at most as many rows as a window has words
        own = windows.where(F.col("length") == width if width < shingle else F.col("length") >= width)
        tokens.append(own.select("window", "length", F.lit(width).alias("width"), F.posexplode(_shingle_hashes(F.col("words"), F.col("length").cast("bigint"), width)).alias("at", "h")))
    if not tokens:
        return None
    tokens = materialise(reduce(DataFrame.unionByName, tokens), "leak-tokens")
    found = []
    for width in [r["width"] for r in tokens.select("width").distinct().collect()]:  # at most ``shingle`` rows
        known = tokens.where(F.col("width") == width).select("h").distinct()
        few = known.limit(BROADCAST_SHINGLES + 1).count() <= BROADCAST_SHINGLES
        here = words.where(F.col("n") >= width).select("uid", "n", F.posexplode(_shingle_hashes(F.col("words"), F.col("n"), width)).alias("pos", "h"))
        found.append(here.join(F.broadcast(known) if few else known, "h", "left_semi"))  # size checked above
    places = materialise(reduce(DataFrame.unionByName, found), "leak-places")
    frequency = places.groupBy("h").agg(F.count(F.lit(1)).alias("f"))
    # the rarest shingle of each window; windows with a shingle that no document has drop here
    ranked = tokens.join(frequency, "h", "left").groupBy("window", "length").agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "at", "h")).alias("rarest"))
    prefix = ranked.where("rarest.f > 0").select("rarest.h", "rarest.f", F.struct("window", "length", "rarest.at").alias("w"))
    prefix = materialise(prefix.groupBy("h").agg(F.max("f").alias("f"), F.collect_list("w").alias("ws")), "leak-prefix")  # windows that share their rarest shingle
    met = join_counted(places, prefix, ["h"], "f").select("uid", "n", "pos", F.explode("ws").alias("w"))
    start = F.col("pos") - F.col("w.at")
    out = met.select("uid", "w.window", "w.length", start.alias("start"), "n").where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n"))).drop("n")
    out = materialise(out, "leak-candidates")
    discard(tokens, places, prefix)
    return out


def _verified(words: Column, candidates: Column) -> Column:
    """Candidates of a document whose words all equal the window's."""
    def equal(c: Column) -> Column:
        here = F.transform(F.sequence(c["start"], c["start"] + c["length"] - 1), lambda k: F.get(words, k.cast("int")))
        return F.array_join(here, " ") == c["window"]

    return F.filter(candidates, equal)


def _merged(occurrences: Column) -> Column:
    """Disjoint word ranges (start, end) covered by occurrences, ascending."""
    ranges = F.array_sort(F.array_distinct(F.transform(occurrences, lambda c: F.struct(c["start"].cast("bigint").alias("start"), (c["start"] + c["length"]).cast("bigint").alias("end")))))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(done: Column, r: Column) -> Column:
        joined = F.struct(done["last"]["start"].alias("start"), F.greatest(done["last"]["end"], r["end"]).alias("end"))
        apart = done["last"].isNull() | (r["start"] > done["last"]["end"])
        return F.struct(
            F.when(apart & done["last"].isNotNull(), F.concat(done["spans"], F.array(done["last"]))).otherwise(done["spans"]).alias("spans"),
            F.when(apart, r).otherwise(joined).alias("last"),
        )

    start = F.struct(nothing.alias("spans"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("last"))
    return F.aggregate(ranges, start, step, lambda done: F.when(done["last"].isNull(), done["spans"]).otherwise(F.concat(done["spans"], F.array(done["last"]))))


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """What every document holds of a benchmark: doc_id, n_words, spans (array of word ranges start, end), items (array of item ids as text, ascending).

    A window is ``size`` consecutive words of an item, or all words of a shorter one. Spans are the words inside any occurrence of a window, as disjoint ranges from 0; items are those
    with an occurring window. One row an input row: null or repeated doc_ids and repeated rows are rows like others. Null and empty texts have no words.
    A null item_id reads as an empty one; items that share an id are one item; items without words never occur. Empty tables give empty results or empty spans.
    Other columns are ignored.
    """
    words = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), words_of(F.col(f"`{text}`")).alias("words"))
    words = materialise(words.select("doc_id", F.monotonically_increasing_id().alias("uid"), F.size("words").cast("bigint").alias("n"), "words"), "leak-words")
    windows = materialise(item_windows(benchmark, f"`{item_id}`", f"`{item_text}`", size), "leak-windows")
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>"), F.array().cast("array<string>")
    candidates = _prefix_places(words, windows.select("window", "length", "words").dropDuplicates(["window"]), shingle)
    if candidates is None:
        return words.select("doc_id", F.col("n").alias("n_words"), nothing[0].alias("spans"), nothing[1].alias("items"))
    listed = candidates.groupBy("uid").agg(F.collect_list(F.struct("start", "length", "window")).alias("candidates"))  # bounded by a text's words
    checked = words.select("uid", "words").join(listed, "uid").select("uid", _verified(F.col("words"), F.col("candidates")).alias("found")).where(F.size("found") > 0)
    checked = materialise(checked.select("uid", _merged(F.col("found")).alias("spans"), F.array_distinct(F.transform("found", lambda c: c["window"])).alias("windows")), "leak-found")
    one = checked.select("uid", F.explode("windows").alias("window"))
    holders = windows.groupBy("window").agg(F.collect_set("item").alias("own")).join(one.groupBy("window").agg(F.count(F.lit(1)).alias("n")), "window")
    items = join_counted(one, holders, ["window"]).select("uid", F.explode("own").alias("item")).groupBy("uid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = checked.select("uid", "spans").join(items, "uid")
    return words.select("doc_id", "uid", F.col("n").alias("n_words")).join(found, "uid", "left").select(
        "doc_id", "n_words", F.coalesce("spans", nothing[0]).alias("spans"), F.coalesce("items", nothing[1]).alias("items")
    )


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items in all ``documents``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contaminated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, r: s + r["end"] - r["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


_DUCK_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_DUCK_WORDS} AS ws FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_DUCK_WORDS} AS ws FROM benchmark),
w AS MATERIALIZED (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[k : k + 9], ' ') AS win FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM i WHERE len(ws) > 0)),
g AS (SELECT r, k, s.n, array_to_string(ws[k : k + s.n - 1], ' ') AS win FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n) AS s),
o AS MATERIALIZED (SELECT r, k, g.n, item FROM g JOIN w ON g.win = w.win AND g.n = w.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM o) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM o) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN t ON t.r = d.r
"""
