"""Fuzzy line deduplication by MinHash: of each group of similar lines, over all documents, one stays.

1. Lines of whole texts are hashed twice with 64 bits (``cid``, ``check``); equal lines are one class at once (sketched once in each task).
2. Distinct lines get MinHash signatures of their character shingles (the one-pass SuperMinHash variant, see ``_text``), cut into
   many short bands: 12 bands of 5 make a pair at similarity 0.8 a candidate with probability 0.991, at 0.85 with 0.999.
3. Candidates are verified by exact Jaccard similarity of their shingle sets, and components are found by distributed union-find
   (see ``_near``). The first line of a component, by doc_id and position, stays; the others are removed from their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.llm import _near, _text
from darkroom.operators.components import connected_components
from darkroom.operators.skew import join_counted
from darkroom.runtime import discard, materialise, ship

#: One changed character leaves 80% of 5-character shingles from about 50 characters up.
WIDTH = 5
SIMILARITY_PERCENT = 80
SIZE, ROWS = 60, 5
#: Text that is sketched at once: few enough for the shingles' arrays to stay in a processor's cache.
SLICE_BYTES = 1 << 18
SIGNS = _near.signature(-(-SIZE // 16))
#: ``bands`` are a line's band keys, as bytes; they and its signature are null where it isn't sketched. ``sampled`` are those of a sample of classes again, so that it is read alone.
LINES = ", ".join(["doc_id bigint, tie bigint, position int, place binary, cid bigint, check bigint, bands binary, sampled binary", *[f"{s} bigint" for s in SIGNS]])
#: Lines that a task knows as sketched already.
KNOWN = 1 << 18
#: Lines with fewer characters are one shingle of their own, so only equal lines are similar, and those are one class without a signature.
MIN_CHARS = WIDTH


def line_sets(buf: np.ndarray, start: np.ndarray, end: np.ndarray, width: int = WIDTH, rolling: _text.Rolling | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character shingles of byte ranges (not distinct), with a row pointer; a shorter range is one shingle."""
    rolling = rolling or _text.Rolling(buf)
    n = len(buf)
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    first, last = np.searchsorted(lead, start), np.searchsorted(lead, end)
    chars = last - first
    pieces = np.where(chars >= width, chars - width + 1, np.minimum(chars, 1))
    pointer = np.zeros(len(start) + 1, np.int64)
    np.cumsum(pieces, out=pointer[1:])
    if not pointer[-1]:
        return np.zeros(0, np.uint64), pointer
    # fingerprints of all windows of the buffer in one go, then those that lie in a line
    ends = np.append(lead, n)
    m = max(0, len(lead) - width + 1)
    if len(lead) == n:
        h = (rolling.sums[width:] - rolling.sums[: n + 1 - width]) * rolling.down[: n + 1 - width] if m else np.zeros(0, np.uint64)
    else:
        h = (rolling.sums[ends[width : width + m]] - rolling.sums[lead[:m]]) * rolling.down[lead[:m]] if m else np.zeros(0, np.uint64)
    long = chars >= width
    inside = np.zeros(m + 1, np.int8)
    np.add.at(inside, first[long], 1)
    np.add.at(inside, np.minimum(last[long] - width + 1, m), -1)
    values = np.zeros(pointer[-1], dtype=np.uint64)
    slot = np.repeat(long, pieces)
    values[slot] = _text.mix(h[np.cumsum(inside[:-1]) > 0] + np.uint64(width))
    short = ~long & (chars > 0)
    if short.any():
        values[pointer[:-1][short]] = rolling.of(start[short], end[short])
    return values, pointer


def whole_sets(buf: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct character shingles of rows that are lines."""
    return _text.distinct_sorted(*line_sets(buf, offsets[:-1], offsets[1:], width))


def _candidate_lines(buf: np.ndarray, offsets: np.ndarray, min_chars: int) -> tuple[np.ndarray, ...]:
    """Start, end, row, position and hash of lines with a word, which have ``min_chars`` characters, and the hashing; white space around a line doesn't count."""
    start, end, pointer = _text.line_spans(buf, offsets)
    row = _text.row_of(pointer)
    position = np.arange(len(start)) - pointer[row]
    solid = np.flatnonzero(~_text.SPACE[buf])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = b > a
    start, end, row, position = solid[a[some]], solid[b[some] - 1] + 1, row[some], position[some]
    lead = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    rolling = _text.Rolling(buf)
    return start, end, row, position, rolling.of(start, end).view(np.int64), lead[end] - lead[start] >= min_chars, rolling


def _places(doc: pa.Array, tie: pa.Array, position: np.ndarray) -> pa.Array:
    """Places of lines as 16 bytes in the order of (doc_id, 31 bits of tie, position), null doc_id last: big-endian doc_id with its sign turned, then the rest."""
    d = doc.fill_null(2**63 - 1).to_numpy(zero_copy_only=False).astype(np.int64)
    both = np.empty((len(d), 2), ">u8")
    both[:, 0] = d.view(np.uint64) ^ np.uint64(1 << 63)
    both[:, 1] = ((tie.to_numpy(zero_copy_only=False).astype(np.int64) & (2**31 - 1)) << 31) | position
    return _packed(both, np.ones(len(d), dtype=bool))


def _placed() -> tuple[Column, Column]:
    """What ``_places`` has of doc_id and tie."""
    return F.coalesce("doc_id", F.lit((1 << 63) - 1)), F.col("tie").bitwiseAND(F.lit((1 << 31) - 1))


def _read_places(rows: DataFrame, place: str, *keep: str) -> DataFrame:
    """Columns ``keep``, and its_id, its_tie and its_position of a place."""
    # never null, or a filter on it would be computed for all rows
    number = lambda at: F.expr(f"coalesce(CAST(conv(hex(substring({place}, {at}, 8)), 16, -10) AS bigint), 0L)")
    rows = rows.select(*keep, number(1).bitwiseXOR(F.lit(-(1 << 63))).alias("its_id"), number(9).alias("rest"))
    return rows.select(*keep, "its_id", F.shiftright("rest", 31).alias("its_tie"), F.col("rest").bitwiseAND(F.lit((1 << 31) - 1)).alias("its_position"))


def _packed(words: np.ndarray, some: np.ndarray) -> pa.Array:
    """Rows of 64-bit words as bytes; null where ``some`` is false."""
    ends = np.zeros(len(some) + 1, np.int32)
    np.cumsum(some * (8 * words.shape[1]), out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(some), [pa.py_buffer(np.packbits(some, bitorder="little").tobytes()), pa.py_buffer(ends.tobytes()), pa.py_buffer(words[some].tobytes())])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = _text.unpacked(batch.column(1), SIZE // ROWS)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), SIZE // ROWS))], ["band", "cid"])


def _sketch(min_chars: int, width: int, size: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set = set()
        for batch, buf, offsets in _text.slices(batches, most=SLICE_BYTES):
            start, end, row, position, cid, long, rolling = _candidate_lines(buf, offsets, min_chars)
            doc = pa.array(row)
            keys, own = np.zeros((len(cid), size // rows), np.int64), np.zeros((len(cid), -(-size // 16)), np.int64)
            sketched = np.zeros(len(cid), dtype=bool)
            check = np.zeros(len(cid), np.int64)
            if len(cid):
                # each line once, in the order of the text
                _, first, same = np.unique(cid, return_index=True, return_inverse=True)
                order = np.argsort(first)
                values, pointer = line_sets(buf, start[first[order]], end[first[order]], width, rolling)
                sums = np.add.reduceat(values, pointer[:-1])
                pieces = np.diff(pointer)
                its_check = _text.mix(sums + pieces.astype(np.uint64)).view(np.int64)
                check[:] = its_check[np.argsort(order)][same]
                long = long[first[order]]
                if len(known) > KNOWN:
                    known.clear()
                # of a task's equal lines, the first is sketched
                at = np.flatnonzero(long)
                names = list(zip(cid[first[order][at]].tolist(), its_check[at].tolist()))
                long[at] = [x not in known for x in names]
                known.update(names)
                values, pointer = values[np.repeat(long, pieces)], np.concatenate([[0], np.cumsum(pieces[long])])
                sig = _text.super_minhash(values, pointer, size)
                sketched[first[order][long]] = True
                keys[sketched] = _text.band_keys(sig, rows).view(np.int64)
                own[sketched] = _text.nibbles(sig).view(np.int64)
            ids, ties = batch.column(0).take(doc), batch.column(1).take(doc)
            yield pa.RecordBatch.from_arrays(
                [ids, ties, pa.array(position.astype(np.int32)), _places(ids, ties, position), pa.array(cid), pa.array(check), _packed(keys, sketched), _packed(keys, sketched & _near.sampled(cid)), *[pa.array(x, mask=~sketched) for x in own.T]],
                ["doc_id", "tie", "position", "place", "cid", "check", "bands", "sampled", *SIGNS],
            )

    return run


def _listed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, check, text) of listed lines, without white space around them. A list may be another text's, as a place tells texts by 31 bits: lines of another hash are left out."""
    for batch in batches:
        found = []
        for text, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lines = text.split("\n")
            found += [(x["cid"], x["check"], lines[x["position"]].strip(" \t\n\r\v\f")) for x in listed if x["position"] < len(lines)]
        columns = list(zip(*found)) if found else [()] * 3
        cid, check, text = (pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string())))
        buf, offsets = _text.text_buffers(_text.text_array(text))
        same = _text.Rolling(buf).of(offsets[:-1], offsets[1:]).view(np.int64) == cid.to_numpy()
        yield pa.RecordBatch.from_arrays([cid, check, text], ["cid", "check", "text"]).filter(pa.array(same))


def duplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """Lines to remove: doc_id, tie (xxhash64 of the text), position (from 0).

    Compared are \\n-split lines without white space around them; blank lines stay. Equal lines are linked at any length. Lines of at least
    ``min_chars`` characters are also linked if 100 * |intersection| >= ``percent`` * |union| of their sets of ``width``-character shingles. Of a component, the line with
    the smallest (doc_id, tie, position) stays, null doc_id last. Rows that repeat doc_id and text count once.
    """
    return _duplicates(docs, doc_id, text, **parameters).distinct()


def _duplicates(docs: DataFrame, doc_id: str, text: str, percent: int = SIMILARITY_PERCENT, width: int = WIDTH, min_chars: int = MIN_CHARS) -> DataFrame:
    """``duplicate_lines``, where rows that repeat doc_id and text give their lines again."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).alias("text"))
    lines = materialise(texts.mapInArrow(_sketch(min_chars, width, SIZE, ROWS), LINES), "line-sketches")
    key, placed = ["cid", "check"], _placed()
    # a class's signature is the same wherever it was made
    classes = materialise(lines.groupBy(*key).agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("n"), *[F.max(s).alias(s) for s in SIGNS]), "line-lows")
    sketched = lines.where("bands IS NOT NULL")
    sample = lines.where("sampled IS NOT NULL").select("cid", "sampled").mapInArrow(_bands, "band bigint, cid bigint")
    signs = classes.where(f"{SIGNS[0]} IS NOT NULL").select("cid", *SIGNS)
    found = materialise(_near.dealt_buckets(sketched.select("cid", "bands"), sample, SIZE // ROWS), "line-classes")
    # one shuffle by ``a`` serves both; hashing what was found spares sorting the signatures
    marked = materialise(signs.withColumnRenamed("cid", "a").join(found.repartition("a").distinct().hint("shuffle_hash"), "a"), "line-marked")
    discard(found)
    pairs = materialise(_near.agreeing(marked.where("b IS NOT NULL"), signs, percent, SIZE), "line-pairs")
    buckets = materialise(marked.where("b IS NULL").select("band", F.col("a").alias("cid"), "hot", *SIGNS), "line-shared")
    discard(marked)

    def fetch(cids: DataFrame) -> DataFrame:
        # of a class, its first line stands for all; its place says where it is
        wanted = _read_places(classes.join(cids.hint("shuffle_hash"), "cid", "left_semi"), "low", *key).withColumnRenamed("its_position", "position")
        listed = wanted.groupBy("its_id", "its_tie").agg(F.collect_list(F.struct("cid", "check", "position")).alias("listed"))  # bounded by a text's lines
        keyed = texts.select("text", placed[0].alias("its_id"), placed[1].alias("its_tie"))
        here = keyed.join(listed.hint("shuffle_hash"), ["its_id", "its_tie"]).select("text", "listed")
        return here.mapInArrow(_listed_lines, "cid bigint, check bigint, text string").groupBy("cid").agg(F.min("check").alias("check"), F.min_by("text", "check").alias("text"))

    links, checks = _near.near_links(buckets, fetch, partial(whole_sets, width=width), percent, SIZE, pairs)
    labels = connected_components(links).join(checks.withColumnRenamed("cid", "node"), "node").select(F.col("node").alias("cid"), "check", "root")
    # classes of one line and no link lose nothing
    rooted = materialise(classes.drop(*SIGNS).join(labels, key, "left").where("root IS NOT NULL OR n > 1"), "line-linked")
    first = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("low").alias("first"), F.count(F.lit(1)).alias("members"))
    linked = join_counted(rooted.where("root IS NOT NULL"), first, ["root"], "members").select(*key, "n", "first")
    repeated = rooted.where("root IS NULL").select(*key, "n", F.col("low").alias("first"))
    listed = materialise(_read_places(repeated.unionAll(linked), "first", *key, "n"), "line-repeated")
    discard(buckets, pairs, classes, rooted)
    out = join_counted(lines.select("doc_id", "tie", "position", *key), listed.hint("shuffle_hash"), key)
    out = out.where((F.col("position") != F.col("its_position")) | (placed[1] != F.col("its_tie")) | (placed[0] != F.col("its_id")))
    return out.select("doc_id", "tie", "position")


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of positions as a byte a line, 1 where it is listed, and their lengths."""
    for batch in batches:
        flags = []
        for positions in batch.column(2):
            at = positions.values.to_numpy()
            own = np.zeros(at.max() + 1, np.uint8)
            own[at] = 1
            flags.append(own.tobytes())
        n = pc.list_value_length(batch.column(2)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flags, pa.binary()), n], ["gone_id", "gone_tie", "gone", "removed"])


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", removed: str | None = None, **parameters) -> DataFrame:
    """``docs`` with duplicate lines removed from their texts.

    All rows and columns (of any names) stay; the text loses removed lines with their line breaks, and ``n_chars`` (if there is such a column) is counted
    again where lines went. ``removed`` names a column for the number of lines removed. Null and empty texts are unchanged; an empty table gives an empty
    table; rows that repeat doc_id and text all keep the same lines.
    """
    gone = _duplicates(docs, doc_id, text, **parameters).groupBy(F.col("doc_id").alias("gone_id"), F.col("tie").alias("gone_tie"))
    gone = gone.agg(F.collect_set("position").alias("gone"))  # bounded by a text's lines
    gone = materialise(gone.mapInArrow(_flags, "gone_id bigint, gone_tie bigint, gone binary, removed bigint"), "line-gone")
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    rows = docs.select(others.alias("row"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("tie"), F.col(f"`{doc_id}`").cast("bigint").alias("id"))
    # hashing what goes spares sorting the texts
    rows = rows.join(gone.hint("shuffle_hash"), (F.col("tie") == F.col("gone_tie")) & F.col("id").eqNullSafe(F.col("gone_id")), "left")
    stays = lambda x, i: F.substring(F.col("gone"), i + 1, F.lit(1)) != F.lit(b"\x01")
    left = F.array_join(F.filter(F.split("text", "\n", -1), stays), "\n")
    new = F.when(F.col("gone").isNotNull(), left).otherwise(F.col("text"))
    out = rows.select("row", new.alias("text"), F.coalesce("removed", F.lit(0).cast("bigint")).alias("removed"))
    columns = []
    for c in docs.columns:
        own = F.col(f"row.`{c}`") if c != text else F.col("text")
        if c == n_chars and c != text:
            own = F.when((F.col("removed") > 0) & F.col("text").isNotNull(), F.char_length("text").cast(docs.schema[c].dataType)).otherwise(own)
        columns.append(own.alias(c))
    return out.select(*columns, *([F.col("removed").alias(removed)] if removed else []))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without duplicate lines: doc_id, n_lines_kept, n_removed, kept_sha256 (of the text that is left)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    left = dedup_lines(docs, removed="n_removed")
    text = F.coalesce("text", F.lit(""))
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    lines = F.when(text == "", 0).otherwise(breaks + 1).cast("bigint")
    return left.select("doc_id", lines.alias("n_lines_kept"), "n_removed", F.sha2(text, 256).alias("kept_sha256"))
