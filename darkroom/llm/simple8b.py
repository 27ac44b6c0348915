"""Token ids in Simple-8b files: word-aligned coding with escapes and per-block offsets.

Coding. A 64-bit word holds a selector in its upper 4 bits and equal-width ids in the lower 60, first id lowest:

    selector  1   2   3   4   5   6  7  8  9  10  11  12  13  14
    ids      60  30  20  15  12  10  8  7  6   5   4   3   2   1
    bits      1   2   3   4   5   6  7  8 10  12  15  20  30  60

Selector 0 is an escape: the next word is one raw 64-bit id. Each word takes as many ids as fit. Ids are cut into blocks of
``BLOCK``; every block starts at a word of its own, so blocks are coded and decoded side by side in vector operations; the last word of a
block may hold unused zeros.

File. One section after another, each closed by a line feed. A section holds whole documents: ``MAGIC``; the words, little-endian; word offset of
each block (unsigned 64-bit), ids of each document (signed 64-bit), doc_id of each document (signed 64-bit), one byte a document that is 1 if
its doc_id is null; then eight signed 64-bit integers (range of doc_id, section in the range, documents, ids, words, blocks, ids a block, bytes of the section)
and ``MAGIC`` again. Sections and files, by their names, ascend by doc_id; ids are counted over sections by their ranges and numbers. Files are written
and read by Spark, so they lie wherever its file systems reach, and tasks commit them whole or not at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from darkroom.llm import _text, _tokens
from darkroom.runtime import materialise, scratch_path, ship, shuffle_partitions, shuffles_dropped

MAGIC = b"S8BIDS01"
BLOCK = 1024
#: Ids of a section at about, and sections of a file at most.
SECTION, SECTIONS = 1 << 20, 16
#: Fixed values of the code: ids and bits by selector; selector 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0], dtype=np.int64)
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0], dtype=np.int64)
END_ID = 1
U64 = np.uint64
#: Bits of values under 2**16; ids of most tokenizers are.
SHORT_LENGTHS = np.array([v.bit_length() for v in range(1 << 16)], dtype=np.uint8)


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    if values.max(initial=0) < len(SHORT_LENGTHS):
        return SHORT_LENGTHS[values]
    out = np.zeros(values.shape, dtype=np.uint8)
    left = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = left >= (U64(1) << U64(step))
        out += big.astype(np.uint8) * np.uint8(step)
        left = np.where(big, left >> U64(step), left)
    return out + (left > 0)


def encode_blocks(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Code ids as (words, word offset of each block).

    An empty array has no words and no blocks; any unsigned 64-bit values are allowed.
    """
    values = np.asarray(values, dtype=U64)
    blocks = -(-len(values) // block)
    if not blocks:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    width = block + 60
    grid = np.zeros((blocks, width), dtype=U64)
    padded = np.zeros(blocks * block, dtype=U64)
    padded[: len(values)] = values
    grid[:, :block] = padded.reshape(blocks, block)
    need = _bit_lengths(grid)
    # widest of the next n ids, for every n of the code, from smaller n
    widest = {1: need}
    for n, (a, b) in {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (4, 1), 6: (3, 3), 7: (4, 3), 8: (4, 4), 10: (5, 5), 12: (6, 6), 15: (10, 5), 20: (10, 10), 30: (15, 15), 60: (30, 30)}.items():
        x = np.full_like(need, 255)
        np.maximum(widest[a][:, : width - a], widest[b][:, a:], out=x[:, : width - a])
        widest[n] = x
    select = np.zeros(need.shape, dtype=np.uint8)
    for s in range(14, 0, -1):
        np.copyto(select, np.uint8(s), where=widest[int(COUNTS[s])] <= np.uint8(BITS[s]))
    # walk all blocks in step; one step is one coded group
    lengths = np.full(blocks, block)
    lengths[-1] = len(values) - (blocks - 1) * block
    flat_select, base = select.ravel(), np.arange(blocks) * width
    at, ends = base.copy(), base + lengths
    taken = []
    while len(at):
        taken.append(at)
        at = at + COUNTS[flat_select[at]]
        if (done := at >= ends).any():
            at, ends = at[~done], ends[~done]
    start = np.sort(np.concatenate(taken))
    row = start // width
    s = flat_select[start].astype(np.int64)
    place = np.cumsum(1 + (s == 0)) - 1 - (s == 0)
    words = np.zeros(len(s) + int((s == 0).sum()), dtype=U64)
    words[place] = s.astype(U64) << U64(60)
    flat = grid.ravel()
    for k in np.unique(s):
        here = np.flatnonzero(s == k)
        if k == 0:
            words[place[here] + 1] = flat[start[here]]
            continue
        packed = np.zeros(len(here), dtype=U64)
        for i in range(COUNTS[k]):
            packed |= flat[start[here] + i] << U64(int(BITS[k]) * i)
        words[place[here]] |= packed
    first = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1])
    return words, place[first]


def decode_blocks(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids of coded blocks."""
    blocks = len(offsets)
    if not blocks:
        return np.zeros(0, U64)
    select = (words >> U64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    if (select == 0).any():
        # an escape's raw word may look like any word, also like an escape
        for i in np.flatnonzero(select == 0):
            if not raw[i]:
                raw[i + 1] = True
    coded = np.flatnonzero(~raw)
    select = select[coded]
    owner = np.searchsorted(offsets, coded, side="right") - 1
    total = np.zeros(len(coded) + 1, np.int64)
    np.cumsum(COUNTS[select], out=total[1:])
    base = total[:-1] - total[np.searchsorted(coded, offsets)][owner]
    width = block + 60
    out = np.zeros(blocks * width, dtype=U64)
    start = owner * width + base
    for k in np.unique(select):
        here = np.flatnonzero(select == k)
        if k == 0:
            out[start[here]] = words[coded[here] + 1]
            continue
        w, mask = words[coded[here]], U64((1 << int(BITS[k])) - 1)
        for i in range(COUNTS[k]):
            out[start[here] + i] = (w >> U64(int(BITS[k]) * i)) & mask
    return out.reshape(blocks, width)[:, :block].ravel()[:n]


TRAILER = 8 * 8 + len(MAGIC)


def pack_section(part: int, seq: int, docs: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A section of whole documents."""
    words, offsets = encode_blocks(np.concatenate([np.zeros(0, U64), *ids]).astype(U64))
    lengths = np.array([len(x) for x in ids], "<i8")
    parts = [
        MAGIC, words.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), lengths.tobytes(), np.array([d or 0 for d in docs], "<i8").tobytes(),
        np.array([d is None for d in docs], "u1").tobytes(),
    ]
    size = sum(map(len, parts)) + TRAILER
    return b"".join([*parts, np.array([part, seq, len(docs), int(lengths.sum()), len(words), len(offsets), BLOCK, size], "<i8").tobytes(), MAGIC])


def trailers(data: bytes) -> Iterator[tuple[int, list[int]]]:
    """Begin and trailer of every section of a file, last section first."""
    end = len(data)
    while end:
        if data[end - 1 : end] != b"\n" or data[end - 9 : end - 1] != MAGIC:
            raise ValueError("no file of this format, or not whole")
        end -= 1
        numbers = np.frombuffer(data, "<i8", 8, end - TRAILER).tolist()
        end -= numbers[-1]
        if end < 0 or data[end : end + 8] != MAGIC:
            raise ValueError("no file of this format, or not whole")
        yield end, numbers


def read_section(data: bytes, at: int, numbers: list[int]) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids of each document (lengths) and all ids of a section."""
    _, _, docs, n, words, blocks, block, _ = numbers
    at += 8
    coded = np.frombuffer(data, "<u8", words, at)
    offsets = np.frombuffer(data, "<u8", blocks, at := at + 8 * words).astype(np.int64)
    lengths = np.frombuffer(data, "<i8", docs, at := at + 8 * blocks)
    ids = np.frombuffer(data, "<i8", docs, at := at + 8 * docs)
    null = np.frombuffer(data, "u1", docs, at + 8 * docs)
    return [None if z else int(i) for i, z in zip(ids, null)], lengths, decode_blocks(coded, offsets, n, block)


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        encode, tail = _tokens.encoder(tokenizer).encode, np.array([end_id], "<u4")
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def section() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"data": pa.array([pack_section(part, seq, docs, ids)], pa.binary())})

        for batch, _, _ in _text.slices(batches):
            for doc, x in zip(batch.column(0).to_pylist(), encode(batch.column(1).fill_null("").to_pylist())):
                docs.append(doc)
                ids.append(np.concatenate([np.frombuffer(x, "<u4"), tail]))
                held += len(ids[-1])
                if held >= SECTION:
                    yield section()
                    seq += 1
                    docs, ids, held = [], [], 0
        if docs:
            yield section()

    return run


def write_ids(docs: DataFrame, target: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> str:
    """Encode whole texts and write their ids, each document closed by ``end_id``, in ascending doc_id order. Returns ``target``, a new folder.

    Documents are dealt to sections by ranges of (doc_id, text hash), null doc_id first, so rows that repeat a doc_id may spread. Null texts count
    as empty (the end id alone). An empty table gives no sections. Other columns are ignored. A section holds about ``SECTION`` ids, a
    file at most ``SECTIONS`` sections, so neither grows with the table (one document is never cut).
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    sections = dealt.mapInArrow(_encode(tokenizer, end_id), "data binary").select(F.col("data").cast("string").alias("value"))  # bytes as they are
    with shuffles_dropped(spark):
        sections.write.option("maxRecordsPerFile", SECTIONS).text(target)
    return target


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            found = [numbers for _, numbers in trailers(batch.column(0)[i].as_py())]
            yield pa.RecordBatch.from_pydict({n: pa.array([x[k] for x in found], pa.int64()) for n, k in (("part", 0), ("seq", 1), ("n_ids", 3))})


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            data = batch.column(0)[i].as_py()
            for at, numbers in trailers(data):
                docs, lengths, ids = read_section(data, at, numbers)
                ends = np.cumsum(lengths)
                view = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                columns = {"part": np.full(len(docs), numbers[0]), "seq": np.full(len(docs), numbers[1]), "inside": ends - lengths, "n_tokens": lengths.astype(np.int64)}
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64())} | {k: pa.array(v, pa.int64()) for k, v in columns.items()} | {"ids_crc32": pa.array(crc, pa.int64())})


def read_digest(spark: SparkSession, target: str) -> DataFrame:
    """Read files back: doc_id, start, n_tokens and ids_crc32 (of ids as little-endian unsigned 32-bit) of every document."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(target).select("content")
    counts = materialise(files.mapInArrow(_counts, "part bigint, seq bigint, n_ids bigint"), "token-counts")
    # one row a range, then one a section: ids before it
    before = lambda *o: F.coalesce(F.sum("n_ids").over(Window.partitionBy(*o[:-1]).orderBy(o[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before("part").alias("part_start"))
    starts = counts.select("part", "seq", before("part", "seq").alias("start")).join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("start")).alias("before"))
    rows = files.mapInArrow(_read, "doc_id bigint, part bigint, seq bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(materialise(starts, "token-starts"), ["part", "seq"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all ``documents``, written as Simple-8b files and read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    target = scratch_path(spark, "token-ids")
    return read_digest(spark, write_ids(docs, target, str(public_tokenizers.path("word_bpe_49k.json"))))
