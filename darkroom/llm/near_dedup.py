"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets, components.

1. Each whole text becomes its set of distinct word shingles; equal sets are one class (two 64-bit set fingerprints, ``cid`` and
   ``check``), so exact copies never become pairs.
2. SuperMinHash signatures of the sets are cut into bands; classes that share a band are candidates. With 64 components in 16 bands of 4
   a pair at similarity 0.85 is a candidate with probability 0.99999.
3. Candidates are verified on their full shingle sets, and verified links are grouped (see ``_near``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.llm import _near, _text
from darkroom.operators.components import connected_components
from darkroom.operators.skew import join_counted
from darkroom.runtime import materialise, ship

SIZE, ROWS = 64, 4
WIDTH = 5
SIMILARITY_PERCENT = 80


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word shingles of each row, ascending, with a row pointer."""
    start, end, pointer = _text.word_spans(buf, offsets)
    hashes = _text.Rolling(buf, _text.CODES_LOWER if lower else _text.CODES).of(start, end)
    return _text.distinct_sorted(*_text.shingles(hashes, pointer, width))


def set_keys(values: np.ndarray, pointer: np.ndarray, seed: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """A 64-bit fingerprint of each row's set."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(_text.mix(values + np.uint64(seed)), out=sums[1:])
    return _text.mix(sums[pointer[1:]] - sums[pointer[:-1]] + np.diff(pointer).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def _sketch(width: int, size: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in _text.slices(batches):
            values, pointer = shingle_sets(buf, offsets, width)
            count = np.diff(pointer)
            sig = _text.super_minhash(values, pointer, size)
            keys, own = _text.band_keys(sig, rows), _text.nibbles(sig).view(np.int64)
            some = count > 0
            cid, check = (pa.array(set_keys(values, pointer, seed).view(np.int64), mask=~some) for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
            per_row = np.zeros(len(some) + 1, np.int64)
            np.cumsum(np.where(some, keys.shape[1], 0), out=per_row[1:])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(count.astype(np.int64)), cid, check, _text.list_array(keys[some].ravel(), per_row), *[pa.array(x, mask=~some) for x in own.T]],
                ["doc_id", "tie", "n_shingles", "cid", "check", "bands", *_near.signature(own.shape[1])],
            )

    return run


def near_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = SIMILARITY_PERCENT, size: int = SIZE, rows: int = ROWS
) -> DataFrame:
    """Near-duplicate component of every row: doc_id, tie, n_shingles, cid, check, component_id, kept.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; a text with fewer words than ``width`` is one shingle. Two rows
    are linked if 100 * |intersection| >= ``percent`` * |union| of their shingle sets. component_id is the smallest doc_id reachable;
    kept says doc_id = component_id. ``tie`` is xxhash64(text); ``cid`` and ``check`` tell the class of equal shingle sets.

    Null or empty texts, and texts without words, have no shingles, are linked with nothing and kept. Repeated rows are
    equal in all columns. Rows with null doc_id take part as copies; a component of only such rows has a null component_id and keeps
    them. An empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    signs = _near.signature(-(-size // 16))
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).alias("text"))
    sketches = materialise(
        texts.mapInArrow(_sketch(width, size, rows), ", ".join(["doc_id bigint, tie bigint, n_shingles bigint, cid bigint, check bigint, bands array<bigint>", *[f"{s} bigint" for s in signs]])), "near-sketches"
    )
    some = sketches.where("cid IS NOT NULL")
    key = ["cid", "check"]
    classes = materialise(
        some.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "tie")).alias("first"), F.any_value("bands").alias("bands"), F.count(F.lit(1)).alias("n"), *[F.max(s).alias(s) for s in signs]), "near-classes"
    )
    buckets = materialise(_near.shared_buckets(classes.select(F.explode("bands").alias("band"), "cid")).join(classes.select("cid", *signs), "cid"), "near-shared")

    def fetch(cids: DataFrame) -> DataFrame:
        # of a class, the text of its first row stands for all
        wanted = classes.join(cids, "cid", "left_semi").groupBy("cid").agg(F.min(F.struct("check", "first")).alias("one"))
        wanted = wanted.select("cid", "one.check", F.col("one.first.doc_id").alias("its_id"), F.col("one.first.tie").alias("its_tie"))
        same = (F.col("tie") == F.col("its_tie")) & F.col("doc_id").eqNullSafe(F.col("its_id"))
        return texts.join(wanted.hint("shuffle_hash"), same).select("cid", "check", "text").dropDuplicates(["cid"])

    links, checks = _near.near_links(buckets, fetch, partial(shingle_sets, width=width), percent, size)
    labels = connected_components(links).join(checks.withColumnRenamed("cid", "node"), "node").select(F.col("node").alias("cid"), "check", "root")
    rooted = classes.join(labels, key).select(*key, "root", "rep")
    low = rooted.groupBy("root").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("members"))
    joined = join_counted(rooted, low, ["root"], "members").select(*key, "low")
    whole = classes.select(*key, "rep", "n").join(joined, key, "left").select(*key, "n", F.coalesce("low", "rep").alias("low"))
    out = join_counted(sketches.drop("bands", *signs), materialise(whole, "near-groups"), key, how="left").select(
        "doc_id", "tie", "n_shingles", *key,
        F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component, the row with the smallest doc_id stays.

    All columns (of any names) and texts of kept rows are unchanged. Of repeated rows (equal doc_id and text) one stays.
    """
    found = materialise(near_components(docs, **parameters), "near-kept")
    doc_id, text = parameters.get("doc_id", "doc_id"), parameters.get("text", "text")
    named, nameless = found.where("kept AND cid IS NOT NULL AND doc_id IS NOT NULL"), found.where("kept AND cid IS NOT NULL AND doc_id IS NULL")
    first = (
        found.where("cid IS NULL").select("doc_id", "tie")
        .unionAll(named.groupBy("doc_id").agg(F.min("tie").alias("tie")))
        .unionAll(nameless.groupBy("cid", "check").agg(F.min("tie").alias("tie")).select(F.lit(None).cast("bigint").alias("doc_id"), "tie"))
    )
    first = first.distinct().withColumnsRenamed({"doc_id": "kept_id", "tie": "kept_tie"})
    out = docs.select(F.struct(F.expr("*")).alias("row"), F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("tie"))
    out = out.join(first, (F.col("tie") == F.col("kept_tie")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    repeated = found.groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if repeated:
        out = out.dropDuplicates(["id", "tie"])
    return out.select("row.*")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all ``documents``: 3-word shingles, similarity 0.85 or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_components(docs, width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")
