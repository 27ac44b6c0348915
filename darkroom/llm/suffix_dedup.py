"""Exact removal of long repeated passages with a logarithmic family of suffix arrays.

A suffix array of all positions of 100 TB is out of reach, so arrays are sparse: they hold suffixes at anchors only, chosen by content
(the smallest k-mer hash of every window of ``w`` positions), so equal passages have equal anchors. Every string of ``length`` bytes holds the
anchor of its first window and the ``length - w + 1`` bytes after it; an array is in the order of the fingerprint of those bytes (``f``),
then of that of all bytes around the anchor that any such string can cover (``c``). It is an order of fingerprints within the ranges that Spark deals them to, not
the order of the bytes: equal passages lie together, similar ones don't. For exact matches of a fixed length nothing else is asked of the order.

Documents come in batches. A batch gets its suffix array; the array is merge-scanned against every level of the family, which tells the
passages that an earlier batch has; then it joins the family, and levels of equal rank merge, so a suffix is merged a logarithmic number of times.
Suffixes whose ``f`` never repeats can't lie in a repeated string. Of the others, those whose ``c`` repeats are repeated in full; for the
rest, fingerprints of their single strings are compared. Texts are fingerprinted with 64 bits twice (``f`` with ``c``, or with the string's own).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.llm import _text
from darkroom.operators.skew import join_counted
from darkroom.runtime import drop_path, materialise, scratch_path, ship

LENGTH = 400
#: Batches at least, and bytes of a batch's texts at about.
BATCHES, BATCH_BYTES = 4, 256 << 30
#: Strings whose anchors are looked for at once; a position in a piece takes 22 bits of the 64 that order anchors.
PIECE = 1 << 21
#: Strings compared in one task's group at about, and suffixes of one fingerprint that stay together at about.
GROUP = 1 << 17
TOGETHER = 256
U64 = np.uint64


def _sizes(length: int) -> tuple[int, int]:
    """k-mer and window sizes: k + w - 1 <= length."""
    k = 16 if length >= 64 else max(1, length // 4)
    return k, max(1, (length - k) // 2)


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchored suffixes of a slice: row, first string's start (in the row), number of strings, f, c.

    A suffix stands for the consecutive strings of ``length`` bytes whose first window has its anchor. Strings never cross rows.
    """
    k, w = _sizes(length)
    n = len(buf)
    if n > PIECE + length:
        # pieces overlap by a string's length, so each string is in one of them with all of its bytes; anchors depend on their windows only
        found = []
        for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            for at in range(a, b, PIECE):
                _, begin, strings, f, c = anchors(buf[at : min(b, at + PIECE + length - 1)], np.array([0, min(b, at + PIECE + length - 1) - at]), length)
                found.append((np.full(len(begin), row), begin + at - a, strings, f, c))
        return tuple(np.concatenate(x) for x in zip(*found))
    count = np.maximum(np.diff(offsets) - length + 1, 0)
    if not count.sum():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(U64), empty.astype(U64)
    rolling = _text.Rolling(buf)
    m = n - k + 1
    low = _text.mix((rolling.sums[k:] - rolling.sums[:m]) * rolling.down[:m])
    # the hash's upper 42 bits decide, then the place: the same in every slice
    mask = U64((1 << 22) - 1)
    key = (low & ~mask) | np.arange(m, dtype=U64)
    # sliding minimum, leftmost first, from running minima of blocks
    blocks = np.concatenate([key, np.full(-m % w, 2**64 - 1, U64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    q = m - w + 1
    anchor = (np.minimum(behind[:q], ahead[w - 1 : w - 1 + q]) & mask).astype(np.int64)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - offsets[:-1], count)
    row = np.repeat(np.arange(len(count)), count)
    at = anchor[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    strings = np.diff(np.append(first, len(start)))
    begin, at, row = start[first], at[first], row[first]
    f = rolling.of(at, at + (length - w + 1))
    c = _text.mix(rolling.of(begin, begin + strings - 1 + length) + (at - begin).astype(U64) * U64(0x9E3779B97F4A7C15))
    return row, begin - offsets[row], strings, f, c


def _suffixes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in _text.slices(batches):
            row, begin, strings, f, c = anchors(buf, offsets, length)
            rid = batch.column(0).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([rid, pa.array(begin), pa.array(strings.astype(np.int32)), pa.array(f.view(np.int64)), pa.array(c.view(np.int64))], ["rid", "begin", "strings", "f", "c"])

    return run


class SuffixFamily:
    """A family of suffix arrays in levels; a level of rank r holds 2**r batches.

    A level is a table (f, c, n) in the order of f and c, with the number of suffixes that share both. Levels of equal rank merge when a
    batch is added, so there are at most log2(batches) + 1 levels.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[tuple[int, str]] = []

    def _write(self, array: DataFrame) -> str:
        path = scratch_path(self.spark, "suffix-level")
        array.groupBy("f", "c").agg(F.sum("n").alias("n")).sortWithinPartitions("f", "c").write.parquet(path)
        return path

    def read(self, path: str) -> DataFrame:
        """A level's table."""
        return self.spark.read.schema("f bigint, c bigint, n bigint").parquet(path)

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Add a batch's suffixes (f, c). Returns f that now repeat because of this batch, within it or against a level, with numbers of suffixes."""
        path = self._write(suffixes.select("f", "c", F.lit(1).cast("bigint").alias("n")))
        array = self.read(path)
        own = array.groupBy("f").agg(F.sum("n").alias("n"))
        hits = own.where("n > 1")
        for _, level in self.levels:
            other = self.read(level).groupBy("f").agg(F.sum("n").alias("more"))
            hits = hits.unionAll(other.join(own, "f").select("f", (F.col("n") + F.col("more")).alias("n")))
        hits = materialise(hits.groupBy("f").agg(F.sum("n").alias("n")), "suffix-hits")
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            _, other = self.levels.pop()
            merged = self._write(self.read(path).unionAll(self.read(other)))
            drop_path(self.spark, path)
            drop_path(self.spark, other)
            path, rank = merged, rank + 1
        self.levels.append((rank, path))
        return hits


def _strings(length: int):
    """Fingerprints of the strings of listed suffixes, dealt to groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in _text.slices(batches):
            rolling = _text.Rolling(buf)
            out: dict[str, list] = {"g": [], "rid": [], "f": [], "at": [], "h": []}
            lists = batch.column(batch.schema.get_field_index("list")).to_pylist()
            for i, (rid, own) in enumerate(zip(batch.column(0).to_pylist(), lists)):
                for x in own:
                    begin = np.arange(x["begin"], x["begin"] + x["strings"])
                    h = rolling.of(offsets[i] + begin, offsets[i] + begin + length)
                    part = (h >> U64(20)) % U64(x["parts"])
                    group = _text.mix(part + U64(x["f"] & (2**64 - 1))) % U64(x["groups"])
                    for g in np.unique(group).tolist():
                        here = group == g
                        for name, value in (("g", g), ("rid", rid), ("f", x["f"]), ("at", begin[here]), ("h", h[here].view(np.int64))):
                            out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["g"], pa.int64()), pa.array(out["rid"], pa.int64()), pa.array(out["f"], pa.int64()), pa.array(out["at"], pa.list_(pa.int64())), pa.array(out["h"], pa.list_(pa.int64()))],
                ["g", "rid", "f", "at", "h"],
            )

    return run


def _repeats(length: int):
    """Runs of strings that occur twice or more in a group: rid, start and end of the bytes they cover."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        count = np.array([len(x) for x in table.column("h")], dtype=np.int64) if table.num_rows else np.zeros(0, np.int64)
        at, h = (table.column(n).combine_chunks().flatten().to_numpy() for n in ("at", "h"))
        rid = np.repeat(table.column("rid").to_numpy(), count)
        f = np.repeat(table.column("f").to_numpy(), count)
        order = np.lexsort((at, rid, h, f))
        a, b = f[order], h[order]
        # equal rows list the same places again
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (rid[order][1:] != rid[order][:-1]) | (at[order][1:] != at[order][:-1])
        order, a, b = order[new], a[new], b[new]
        same = np.zeros(len(a) + 1, dtype=bool)
        same[1:-1] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        hit = order[same[:-1] | same[1:]]
        rid, at = rid[hit], at[hit]
        order = np.lexsort((at, rid))
        rid, at = rid[order], at[order]
        new = np.ones(len(rid), dtype=bool)
        new[1:] = (rid[1:] != rid[:-1]) | (at[1:] > at[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(rid)) - 1 if len(first) else first
        return pa.table({"rid": rid[first], "start": at[first], "end": at[last] + length})

    return run


def _cut(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, ranges in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = (text or "").encode()
                spans: list[list[int]] = []
                for r in sorted((x["start"], x["end"]) for x in ranges or ()):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append(list(r))
                at, kept = 0, []
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                left = b"".join([*kept, data[at:]])
                rows.append((doc, len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left))
            types = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
            columns = list(zip(*rows)) if rows else [()] * 6
            used = types if with_bytes else types[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, used)], [n for n, _ in used])

    return run


def repeated_ranges(docs: DataFrame, length: int = LENGTH, batches: int | None = None) -> DataFrame:
    """Byte ranges covered by strings of ``length`` bytes that also start elsewhere: rid, start, end (they may overlap).

    ``docs`` has rid (a hash of a row's doc_id and text; equal for equal rows, which count as different places) and text.
    """
    spark = docs.sparkSession
    if batches is None:
        batches = max(BATCHES, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BATCH_BYTES))
    path = scratch_path(spark, "suffixes")
    suffixes = docs.mapInArrow(_suffixes(length), "rid bigint, begin bigint, strings int, f bigint, c bigint")
    suffixes.withColumn("batch", F.pmod("rid", F.lit(batches))).write.partitionBy("batch").parquet(path)
    suffixes = spark.read.schema("rid bigint, begin bigint, strings int, f bigint, c bigint, batch int").parquet(path)
    family = SuffixFamily(spark)
    hits = None
    for b in range(batches):
        new = family.add(suffixes.where(F.col("batch") == b).select("f", "c"))
        hits = new if hits is None else hits.unionAll(new)
    for _, level in family.levels:
        drop_path(spark, level)
    hits = materialise(hits.groupBy("f").agg(F.sum("n").alias("n")), "suffix-hits")
    repeated = materialise(join_counted(suffixes.drop("batch"), hits, ["f"]).drop("n"), "suffix-repeated")
    drop_path(spark, path)
    contexts = materialise(repeated.groupBy("f", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "begin", "strings")).alias("one")), "suffix-contexts")
    whole = join_counted(repeated, contexts.where("n > 1").select("f", "c", "n"), ["f", "c"])
    whole = whole.select("rid", F.col("begin").alias("start"), (F.col("begin") + F.col("strings") - 1 + length).alias("end"))
    # one suffix of each context stands for it where contexts differ
    per_f = contexts.groupBy("f").agg(F.count(F.lit(1)).alias("d"), F.sum("one.strings").alias("strings")).where("d > 1")
    per_f = materialise(per_f, "suffix-open")
    total = per_f.agg(F.sum("strings")).first()[0] or 0
    groups = max(1, -(-total // GROUP))
    listed = contexts.join(per_f.select("f", "d"), "f").select(
        "one.rid",
        F.struct("f", "one.begin", "one.strings", F.ceil(F.col("d") / TOGETHER).cast("bigint").alias("parts"), F.lit(groups).cast("bigint").alias("groups")).alias("x"),
    ).groupBy("rid").agg(F.collect_list("x").alias("list"))  # bounded by a text's length
    listed = materialise(listed, "suffix-listed")
    texts = docs.join(listed, "rid").select("rid", "text", "list")
    strings = materialise(texts.mapInArrow(_strings(length), "g bigint, rid bigint, f bigint, at array<bigint>, h array<bigint>"), "suffix-strings")
    single = strings.groupBy("g").applyInArrow(_repeats(length), "rid bigint, start bigint, end bigint")
    found = materialise(whole.unionAll(single), "suffix-ranges")
    return found


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, batches: int | None = None, with_bytes: bool = False) -> DataFrame:
    """Every text without its repeated passages: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that are left).

    A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else, in any row; strings are judged on
    the input and overlaps count. Texts are UTF-8 bytes; null counts as empty; shorter texts lose nothing. Rows that repeat doc_id and
    text are copies of each other. Null doc_id rows take part. An empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "text"))
    found = repeated_ranges(rows.select("rid", "text"), length, batches)
    ranges = found.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))  # bounded by a text's length
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_bytes else "")
    return rows.join(ranges, "rid", "left").select("doc_id", "text", "ranges").mapInArrow(_cut(with_bytes), schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without bytes in repeated 400-byte strings."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
