"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

1. A rotation is learned on a bounded sample (iterative quantisation, Gong and Lazebnik 2011) and every vector becomes a 256-bit code. For largest inner
   products, candidates are first lifted to equal length with one more coordinate, so that order by angle is order by inner product.
2. Codes are split into 16-bit substrings, each with an index from value to rows. If two codes differ in at most r bits, some of the m
   substrings differs in at most r/m (the pigeonhole), so probing all values of that many flipped bits retrieves every code in the radius. Where more values
   would be probed than a block's index holds, the held values are compared with the probe instead, which finds the same.
3. The radius is set from the true neighbours of a few sampled queries among all rows. Retrieved rows within the radius are reranked by their
   exact inner products in double precision. Queries with too few rows in the radius are compared with all rows.

Queries meet the index in blocks: a task holds one block of rows with its four indexes and one block of queries.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from darkroom.runtime import materialise, ship

TOP = 20
BITS = 256
PARTS = 16
#: Rows that the rotation is fitted on, and queries that the radius is set from; chosen by hash of vec_id.
SAMPLE_ROWS = 20_000
SAMPLE_QUERIES = 128
#: Share of the sampled queries' true neighbours that the radius takes in.
COVER = 0.97
INDEX_BLOCK = 16_384
QUERY_BLOCK = 4_096
RESULT = "query_id bigint, vec_id bigint, score double, distance int"


def fit_rotation(sample: np.ndarray, bits: int = BITS, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """A (dimensions, bits) matrix whose signs code vectors: principal directions, rotated to fit their signs best."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    if d >= bits:
        axes = np.linalg.svd(sample, full_matrices=False)[2][:bits].T if len(sample) >= bits else np.linalg.qr(rng.standard_normal((d, d)))[0][:, :bits]
    else:
        axes = np.linalg.qr(rng.standard_normal((bits, bits)))[0][:d]
    v = sample @ axes
    r = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return axes @ r


def codes(vectors: np.ndarray, rotation: np.ndarray, scale: float, most: float, lift: bool) -> np.ndarray:
    """Codes of vectors as (rows, words); ``lift`` adds the coordinate that makes lengths, in units of ``scale``, equal to ``most``.

    A query's length doesn't matter, so each is taken in units of its own largest component.
    """
    v = vectors / (scale if lift else np.abs(vectors).max(axis=1, keepdims=True))
    extra = np.sqrt(np.maximum(most * most - (v * v).sum(axis=1), 0)) if lift else np.zeros(len(v))
    return np.packbits(np.column_stack([v, extra]) @ rotation >= 0, axis=1, bitorder="little").view("<u8")


def ball(bits: int, radius: int) -> np.ndarray:
    """All masks of ``bits`` bits with at most ``radius`` set."""
    masks = [sum(1 << i for i in c) for k in range(min(radius, bits) + 1) for c in combinations(range(bits), k)]
    return np.array(masks, dtype=np.int64)


class MultiIndex:
    """Substring indexes over a block of codes."""

    def __init__(self, values: np.ndarray, parts: int = PARTS):
        self.codes, self.parts, self.width = values, parts, 64 * values.shape[1] // parts
        self.tables = []
        sub = self.split(values)
        for i in range(parts):
            order = np.argsort(sub[:, i], kind="stable")
            held, place = np.unique(sub[:, i], return_inverse=True)
            first = np.searchsorted(sub[order, i], held)
            self.tables.append((order, held, np.append(first, len(order)), place))
        self.cache: dict[int, np.ndarray] = {}

    def split(self, values: np.ndarray) -> np.ndarray:
        """Substrings of codes, as (rows, parts)."""
        return values.view("<u2").astype(np.int64) if self.width == 16 else np.packbits(np.unpackbits(values.view(np.uint8), axis=1, bitorder="little").reshape(len(values), self.parts, self.width), axis=2, bitorder="little").astype(np.int64) @ (1 << 8 * np.arange(-(-self.width // 8)))

    def radii(self, radius: int) -> list[int]:
        """How far to probe each substring, so that no code within the radius is missed; -1 is not at all."""
        each, rest = divmod(radius, self.parts)
        return [each if i <= rest else each - 1 for i in range(self.parts)]

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows within the Hamming radius of a code, and their distances."""
        hit = np.zeros(len(self.codes), dtype=bool)
        for i, (value, near) in enumerate(zip(self.split(code[None])[0].tolist(), self.radii(radius))):
            if near < 0 or not len(self.codes):
                continue
            order, held, offsets, place = self.tables[i]
            if 16 * sum(comb(self.width, k) for k in range(near + 1)) > len(held):  # a probe costs about that many comparisons
                hit |= (np.bitwise_count(held ^ value) <= near)[place]
                continue
            if near not in self.cache:
                self.cache[near] = ball(self.width, near)
            wanted = value ^ self.cache[near]
            at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
            at = at[held[at] == wanted]
            start, count = offsets[at], offsets[at + 1] - offsets[at]
            if len(start):
                hit[order[np.arange(count.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count)]] = True
        rows = np.flatnonzero(hit)
        distance = np.bitwise_count(self.codes[rows] ^ code).sum(axis=1, dtype=np.int64)
        near = distance <= radius
        return rows[near], distance[near]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _code(rotation: np.ndarray, scale: float, most: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(1))
                own = [pa.array([c.tobytes() for c in codes(v, rotation, scale, most, lift)], pa.binary()) for lift in (True, False)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *own], ["vec_id", "vector", "code", "query_code"])

    return run


def _search(radius: int | None, top: int):
    """Best ``top`` of a block of rows for each query of a block; without a radius, over all rows."""

    def run(table: pa.Table) -> pa.Table:
        is_query = table.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
        ids, code = table.column("vec_id").to_numpy(), np.frombuffer(b"".join(table.column("code").to_pylist()), "<u8").reshape(table.num_rows, -1)
        vectors = _matrix(table.column("vector"))
        order = np.argsort(ids[~is_query], kind="stable")
        row_ids, rows, row_codes = ids[~is_query][order], vectors[~is_query][order], code[~is_query][order]
        index = MultiIndex(row_codes) if radius is not None else None
        out: list[tuple] = []
        for q, v, c in zip(ids[is_query], vectors[is_query], code[is_query]):
            if index:
                near, distance = index.within(c, radius)
            else:
                near, distance = np.arange(len(rows)), np.bitwise_count(row_codes ^ c).sum(axis=1, dtype=np.int64)
            other = row_ids[near] != q
            near, distance = near[other], distance[other]
            if not len(near):
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                score = (rows[near] * v).sum(axis=1)
            best = np.lexsort((row_ids[near], -score))[:top]
            out.append((np.full(len(best), q), row_ids[near][best], score[best], distance[best].astype(np.int32)))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)]
        return pa.table(dict(zip(["query_id", "vec_id", "score", "distance"], columns)))

    return run


def _meet(queries: DataFrame, rows: DataFrame, n_queries: int, n_rows: int, radius: int | None, top: int) -> DataFrame:
    """Results of every query over every row, in blocks."""
    ni, nq = max(1, -(-n_rows // INDEX_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    own = lambda n: F.pmod(F.xxhash64("vec_id", F.hash("vector")), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = rows.select(own(ni).alias("i"), every(nq).alias("j"), F.lit(False).alias("is_query"), "vec_id", "vector", "code")
    right = queries.select(every(ni).alias("i"), own(nq).alias("j"), F.lit(True).alias("is_query"), "vec_id", "vector", F.col("query_code").alias("code"))
    found = left.unionAll(right).groupBy("i", "j").applyInArrow(_search(radius, top), RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def search(embeddings: DataFrame, is_query: F.Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding", top: int = TOP, cover: float = COVER) -> DataFrame:
    """The ``top`` nearest rows found for every query: query_id, rank, vec_id, score.

    Queries are the rows where ``is_query`` holds (by default: vec_id divisible by 20), candidates all rows with
    another vec_id; nearest is the largest inner product, ties go to the smaller vec_id. A query with fewer candidates gets all of them.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without vec_id. Vectors have inner products with
    those of their own length only, so each length is searched by itself. Rows that
    repeat a vec_id are candidates each; of repeated query rows one stands for all. An empty table gives an empty table; other columns are ignored.
    """
    spark = embeddings.sparkSession
    ship(spark)
    raw = embeddings.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("vector"),
        F.coalesce(is_query if is_query is not None else F.col(vec_id) % 20 == 0, F.lit(False)).alias("asked"),
    )
    valid = raw.where("vec_id IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(vector, x -> x <> 0)")
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    sizes = valid.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(largest).alias("scale")).orderBy("d").collect()  # a row for each length
    out = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for s in sizes:
        out = out.unionByName(_search_length(valid.where(F.size("vector") == s["d"]), s["n"], s["scale"], top, cover))
    return out


def _search_length(valid: DataFrame, n_rows: int, scale: float, top: int, cover: float) -> DataFrame:
    """``search`` among valid vectors of one length, whose largest component is ``scale``."""
    spark = valid.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x.cast("double") / scale) * (x.cast("double") / scale))
    most = valid.agg(F.max(squares)).first()[0] ** 0.5
    sample = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vector").toArrow()
    fitted = _matrix(sample.column(0)) / scale
    extra = np.sqrt(np.maximum(most * most - (fitted * fitted).sum(axis=1), 0))
    rotation = fit_rotation(np.column_stack([fitted, extra]) / most)
    kind = dict(valid.dtypes)["vector"]
    coded = valid.select("vec_id", "vector").mapInArrow(_code(rotation, scale, most), f"vec_id bigint, vector {kind}, code binary, query_code binary")
    coded = materialise(coded, "ann-codes")
    asked = valid.where("asked").select("vec_id").distinct()
    queries = materialise(coded.join(asked, "vec_id", "left_semi").dropDuplicates(["vec_id"]), "ann-queries")
    n_queries = queries.count()
    if not n_queries:
        return empty
    probe = materialise(queries.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(SAMPLE_QUERIES), "ann-probe")
    seen = _meet(probe, coded, SAMPLE_QUERIES, n_rows, None, top).agg(F.expr(f"percentile_disc({cover}) WITHIN GROUP (ORDER BY distance)").alias("r")).first()
    radius = int(seen["r"] or 0)
    found = materialise(_meet(queries, coded, n_queries, n_rows, radius, top), "ann-found")
    counts = queries.select("vec_id").join(found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n")), "vec_id", "left")
    short = counts.where(F.coalesce("n", F.lit(0)) < top).select("vec_id")
    n_short = short.count()
    if n_short:  # too few rows in the radius: these are compared with all rows
        again = materialise(_meet(queries.join(short, "vec_id", "left_semi"), coded, n_short, n_rows, None, top), "ann-again")
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every 20th row of ``embeddings``."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
