"""Quality rules with host verdicts: failures by host, shrunk by an empirical beta prior, joined back to documents.

Base rules judge a document by itself. A host (here the source of a document) whose documents mostly fail is then rejected as a whole: its
failure rate is shrunk towards the rate of all hosts by a beta prior fitted to the hosts' own counts (method of moments), so a
host with few documents isn't rejected on thin evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from darkroom.llm import _text
from darkroom.runtime import materialise, ship

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected if its shrunk failure rate is above this.
HOST_LIMIT = 0.6
SYMBOLS = "#*$%&|<>"
STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def text_stats(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row of a slice."""
    rows = len(offsets) - 1
    start, end, pointer = _text.word_spans(buf, offsets)
    words = np.diff(pointer)

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    chars = per_row(((buf & 0xC0) != 0x80) & ~_text.SPACE[buf])
    symbol = np.zeros(256, dtype=bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    symbols = per_row(symbol[buf])
    rolling = _text.Rolling(buf)
    hashes = rolling.of(start, end)

    first, last, lines = _text.line_spans(buf, offsets)
    solid = np.searchsorted(start, last) > np.searchsorted(start, first)
    owner = _text.row_of(lines)[solid]
    keys = rolling.of(first[solid], last[solid])
    dup = np.bincount(owner, minlength=rows) - _distinct_per_row(keys, owner, rows)

    repeat = np.zeros(rows, np.int64)
    if len(start):
        windows = _text.shingles(hashes, pointer, 3)[0]
        pieces = np.where(words >= 3, words - 2, np.minimum(words, 1))
        long_enough = np.repeat(words >= 3, pieces)
        row = np.repeat(np.arange(rows), pieces)[long_enough]
        windows = windows[long_enough]
        at = np.concatenate([[0], np.cumsum(pieces)])
        place = (np.arange(at[-1]) - np.repeat(at[:-1] - pointer[:-1], pieces))[long_enough]
        order = np.lexsort((windows, row))
        w, r = windows[order], row[order]
        same = np.zeros(len(w) + 1, dtype=bool)
        same[1:-1] = (w[1:] == w[:-1]) & (r[1:] == r[:-1])
        found = place[order[same[:-1] | same[1:]]]
        covered = np.zeros(len(start), dtype=bool)
        for k in range(3):
            covered[found + k] = True
        total = np.zeros(len(start) + 1, np.int64)
        np.cumsum(covered, out=total[1:])
        repeat = total[pointer[1:]] - total[pointer[:-1]]
    return [words, chars, symbols, dup, repeat]


def _distinct_per_row(keys: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=rows)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, buf, offsets in _text.slices(batches):
        own = [pa.array(x.astype(np.int64)) for x in text_stats(buf, offsets)]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + own, [batch.schema.names[i] for i in keep] + names)


def base_failed() -> F.Column:
    """The base rules: too few words, or more than half of them in repeated three-word windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(judged: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: host, n, failed, rate (shrunk), rejected.

    With mean m and variance v of the hosts' rates, the prior is beta(m s, (1 - m) s), s = m (1 - m) / v - 1, held at 1 to 1000
    (1000 if the hosts don't differ). The shrunk rate is (failed + m s) / (n + s).
    """
    totals = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("failed"))
    return _shrunk(totals, limit)


def _shrunk(hosts: DataFrame, limit: float) -> DataFrame:
    share = F.col("failed") / F.col("n")
    m, v = hosts.agg(F.avg(share), F.var_pop(share)).first()  # two numbers
    m, v = m or 0.0, v or 0.0
    s = max(1.0, min(1000.0, m * (1 - m) / v - 1)) if v > 0 else 1000.0
    rate = (F.col("failed") + F.lit(m * s)) / (F.col("n") + F.lit(s))
    return hosts.select("host", "n", "failed", rate.alias("rate"), (rate > limit).alias("rejected"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Counts, base verdict and final verdict of every row: doc_id, tie, host, the five counts, base_failed, kept.

    ``tie`` is xxhash64(text). Null and empty texts have no words and fail. A null host is a host of its own. Null or repeated
    doc_id rows are judged like others; an empty table gives an empty table; other columns are ignored.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("tie"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    judged = texts.mapInArrow(_stats, "doc_id bigint, tie bigint, host string, " + STATS).withColumn("base_failed", base_failed())
    judged = materialise(judged, "quality-counts")
    hosts = materialise(host_verdicts(judged, limit).select(F.col("host").alias("_host"), "rejected"), "quality-hosts")
    # hosts are few against documents; Spark broadcasts the table while it is under its size limit
    out = judged.join(hosts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))).drop("rejected")


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that pass base rules and host verdict, unchanged, with all columns (of any names).

    Verdicts depend on text and host only. One pass judges all texts and writes the rows that pass the base rules; the rows of hosts that
    are then rejected are left out when these are read. No text is shuffled.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.struct(F.expr("*")).alias("row"), F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{text}`").alias("text"))
    schema = StructType([StructField("row", rows.schema["row"].dataType), rows.schema["host"], StructField("base_failed", BooleanType())])
    judged = materialise(rows.mapInArrow(_passing, schema), "quality-rows")
    totals = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("failed"))
    # rejected hosts; a table that Spark broadcasts while it is under its size limit
    hosts = materialise(_shrunk(totals, limit).where("rejected").select(F.col("host").alias("bad_host")), "quality-hosts")
    passing = judged.where("NOT base_failed")
    return passing.join(hosts, F.col("host").eqNullSafe(F.col("bad_host")), "left_anti").select("row.*")


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, host, base_failed); rows that fail are null."""
    for batch, buf, offsets in _text.slices(batches):
        words, _, _, _, repeat = text_stats(buf, offsets)
        failed = pa.array((words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * words))
        row = pc.if_else(failed, pa.scalar(None, batch.schema.field("row").type), batch.column(0))
        yield pa.RecordBatch.from_arrays([row, batch.column(1), failed], ["row", "host", "base_failed"])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all ``documents``, with the source as host."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d),
words AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w),
grams AS (SELECT r, i, w, lead(w, 1) OVER (PARTITION BY r ORDER BY i) AS w1, lead(w, 2) OVER (PARTITION BY r ORDER BY i) AS w2 FROM words),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w, w1, w2) AS c FROM grams WHERE w2 IS NOT NULL) WHERE c >= 2),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
lines AS (SELECT r, unnest(ls) AS l FROM w),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
s AS (
  SELECT w.r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN dup ON dup.r = w.r LEFT JOIN cov ON cov.r = w.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
h AS (SELECT source, count(*) AS n, CAST(sum(CAST(base_failed AS INT)) AS DOUBLE) AS failed FROM b GROUP BY source),
p AS (SELECT avg(failed / n) AS m, var_pop(failed / n) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 0 THEN greatest(1.0, least(1000.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS s FROM p),
x AS (SELECT source, (failed + m * s) / (n + s) > 0.6 AS rejected FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM b JOIN x ON b.source IS NOT DISTINCT FROM x.source
"""
