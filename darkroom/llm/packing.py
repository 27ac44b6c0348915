"""Packing along a space-filling curve: similar documents share sequences, nearly without padding.

A document's words are hashed into a signed vector (square roots of counts, unit length), projected by a fixed random matrix to a few
dimensions and placed on a Hilbert curve. Documents are range-sorted by their Hilbert key and laid end to end, so neighbours on the
curve are packed together. Each range is one task's stream of ids, cut at every ``length`` ids; what is left at a
range's end is split into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.llm import _text, _tokens
from darkroom.runtime import materialise, ship, shuffle_partitions

LENGTH = 2048
END_ID = 1
BUCKETS = 256
DIMENSIONS = 4
BITS = 15
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def vectors(buf: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Unit vectors of hashed words, lower-cased; rows without words are zero."""
    start, end, pointer = _text.word_spans(buf, offsets)
    rows = len(offsets) - 1
    h = _text.Rolling(buf, _text.CODES_LOWER).of(start, end)
    cell = _text.row_of(pointer) * buckets + (h % np.uint64(buckets)).astype(np.int64)
    sign = 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
    v = np.bincount(cell, weights=sign, minlength=rows * buckets).reshape(rows, buckets)
    v = np.sign(v) * np.sqrt(np.abs(v))
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def projection(buckets: int = BUCKETS, dimensions: int = DIMENSIONS, seed: int = 7) -> np.ndarray:
    """A fixed random matrix; a unit vector's coordinates are standard normal over matrices."""
    return np.random.default_rng(seed).standard_normal((buckets, dimensions))


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert indexes of points in [0, 2**bits) per axis (Skilling 2004), as (rows) unsigned integers."""
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:
        p, uq = np.uint64(q - 1), np.uint64(q)
        for i in range(n):
            high = (x[i] & uq) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    matrix = projection()
    for batch, buf, offsets in _text.slices(batches):
        # coordinates beyond 4 deviations share the outermost cells
        cells = np.clip((vectors(buf, offsets) @ matrix + 4) * (2**BITS / 8), 0, 2**BITS - 1)
        key = hilbert_keys(cells.astype(np.uint64))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64))], [*batch.schema.names, "curve"])


def layout(total: int, length: int) -> list[int]:
    """Sizes of the sequences that hold the last ``total`` < ``length`` ids: its powers of two, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if total >> b & 1]


class Packer:
    """Lays documents end to end and returns their pieces."""

    def __init__(self, length: int, first: int):
        self.length, self.sequence, self.used = length, first, 0
        self.open: list[tuple] = []

    def add(self, doc: int | None, ids: np.ndarray) -> list[tuple]:
        """Pieces of sequences that this document fills."""
        done, at = [], 0
        while at < len(ids):
            n = min(self.length - self.used, len(ids) - at)
            self.open.append((doc, at, ids[at : at + n], len(ids)))
            self.used += n
            at += n
            if self.used == self.length:
                done += self._close([self.length])
        return done

    def finish(self) -> list[tuple]:
        """Pieces of what is left."""
        return self._close(layout(self.used, self.length))

    def _close(self, sizes: list[int]) -> list[tuple]:
        out, sizes, offset = [], list(sizes), 0
        for doc, start, ids, total in self.open:
            while len(ids):
                n = min(sizes[0] - offset, len(ids))
                out.append((doc, start, n, zlib.crc32(ids[:n].tobytes()), total, self.sequence, offset))
                start, ids, offset = start + n, ids[n:], offset + n
                if offset == sizes[0]:
                    sizes.pop(0)
                    self.sequence += 1
                    offset = 0
        self.open, self.used = [], 0
        return out


def _pack(tokenizer: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = _tokens.encoder(tokenizer).encode, np.array([end_id], "<u4")
        packer = Packer(length, TaskContext.get().partitionId() << 32)

        def table(pieces: list[tuple]) -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*pieces)], names)

        for batch, _, _ in _text.slices(batches):
            pieces: list[tuple] = []
            texts = batch.column(1).fill_null("").to_pylist()
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts)):
                pieces += packer.add(doc, np.concatenate([np.frombuffer(ids, "<u4"), tail]))
            if pieces:
                yield table(pieces)
        pieces = packer.finish()
        if pieces:
            yield table(pieces)

    return run


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``; null texts count as empty (the end id alone). Each id lies in exactly one
    piece; pieces of a sequence are gapless from offset 0. Sequences hold ``length`` ids, or a power of two at a range's end.
    Rows that repeat a doc_id, or have none, are documents of their own. An empty table gives an empty table; other columns are ignored.
    Ties on the curve are spread by a hash of doc_id and text, so many equal documents don't meet in one range.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    # written, as the ranges are sampled from it before it is dealt
    placed = materialise(rows.mapInArrow(_keys, "doc_id bigint, text string, curve bigint"), "pack-keys")
    order = [F.col("curve"), F.xxhash64("doc_id", "text")]
    dealt = placed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    return dealt.mapInArrow(_pack(tokenizer, length, end_id), SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 2048 ids."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))
