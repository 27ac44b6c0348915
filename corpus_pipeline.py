"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing sources, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the columns of
``documents``. ``run`` writes each stage's rows as Parquet in the cluster's shared folder and reads them again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from darkroom.llm import line_dedup, mixing, near_dedup, packing, quality
from darkroom.runtime import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and come from a host (source) that isn't rejected; others go.

    Null and empty texts fail the base rules. Kept rows are unchanged; extra columns go; an empty table stays empty.
    """
    return quality.keep_good(docs.select(COLUMNS))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are similar to an earlier line of any document; n_chars follows the text.

    Similar are lines with 80% of their 5-character shingles in common, short ones too (under 5 characters: equal lines); blank lines stay. A text may end up empty.
    """
    return line_dedup.dedup_lines(docs.select(COLUMNS))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more, smallest doc_id stays.

    Texts without words are in no group and stay.
    """
    return near_dedup.keep_one(docs.select(COLUMNS))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weights 3, 1, 2 at 150% of all words: a document is repeated as often as the mix takes it.

    The document at the end of a source's budget appears with its first words only; documents the mix doesn't take go,
    documents without words stay once.
    """
    return mixing.mixed(docs.select(COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of at most 2048 ids, along a Hilbert curve. Repeated documents are documents of their own."""
    return packing.pack(docs.select(COLUMNS), str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("minhash near-dedup", minhash_near_dedup),
    ("mixing sources", mixing_sources),
    ("packing", packing_stage),
]

#: The stages of similar lines and documents can't be put in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
