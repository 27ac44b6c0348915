"""Phrase collocation mining on vertical positional inverted lists.

Texts are laid out as blocks of about a million words of one language. An inverted list holds the positions of a word, or phrase, in a block; the length of all its
lists is its exact frequency.

1. Words get their lists. A window over each word's lists (at most one a block, so no word has many) sums their lengths; lists of rare words go.
2. Frequent phrases of k words are extended block by block: their occurrences are merge-joined, by position, with the occurrences that start one word later. Both
   parts of a longer frequent phrase are frequent, so this finds every one of them with its positions. The lengths of a block's lists are summed with those of other blocks by ranges of hashes;
   only frequent phrases keep their lists, and those stay with their block.
3. Phrases know the frequency of all their first and last parts, so cuts are scored without counting again.

Words are told apart by their characters, phrases by the ids of their two parts. A word's id is the least tag (block and first position) of its lists, a phrase's its range and number in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from darkroom.llm import _text
from darkroom.runtime import discard, materialise, ship

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
#: Words of a block; it ends at the next end of a piece.
BLOCK_WORDS = 1 << 20
#: Bits of a position in its block, of a block's number in its task, and of a task's number.
PLACE_BITS, BLOCK_BITS, PART_BITS = 29, 14, 20
#: No position, which stands for a whole block.
END = (1 << PLACE_BITS) - 1
#: Words for each range of hashes of pairs.
RANGE_WORDS = 1 << 21
ROWS = 1 << 15

_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = 2


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of a slice, in order, and whether a piece begins with each."""
    if not len(buf):
        return pa.array([], pa.large_string()), np.zeros(0, bool)
    kind = _KIND[buf]
    solid = kind == 0
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return pa.array([], pa.large_string()), np.zeros(0, bool)
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=at[1:])
    data = _text.LOWER[buf[solid]]
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(at), pa.py_buffer(data)])
    # ends of pieces up to each word: separators, and ends of rows
    cuts = np.cumsum(kind == 2)[start] + np.searchsorted(offsets, start, side="right")
    new = np.ones(len(start), bool)
    new[1:] = cuts[1:] != cuts[:-1]
    return words, new


def _tags(block: int, first: np.ndarray) -> np.ndarray:
    """Tags of lists: their block and their first position, at which nothing of the same length but this phrase begins."""
    if len(first) and first.max() >= END:
        raise ValueError("a piece of a text has too many words for one block")
    return (np.int64(block) << PLACE_BITS) + first


def _coded(positions: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Lists of ascending positions that lie one after another, without their first ones: differences, seven bits a byte."""
    begin = np.ones(len(positions), bool)
    begin[1:] = False
    begin[(np.cumsum(counts) - counts)] = True
    value = np.diff(positions.astype(np.int32), prepend=np.int32(0))[~begin]
    size = np.ones(len(value), np.int8)
    for k in range(1, 5):
        size += value >= 1 << 7 * k
    end = np.cumsum(size, dtype=np.int64)
    data = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(5):
        some = size > k
        data[(end - size)[some] + k] = (value[some] >> 7 * k & 127) | np.where(size[some] > k + 1, 128, 0)
    at = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(counts - 1)])]
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _decoded(first: np.ndarray, counts: np.ndarray, rest: bytes) -> np.ndarray:
    """Positions of lists, one list after another, from their first ones and the coded rest of them all."""
    data = np.frombuffer(rest, np.uint8)
    step = np.zeros(int(counts.sum()), np.int64)
    begin = np.cumsum(counts) - counts
    later = np.ones(len(step), bool)
    later[begin] = False
    if len(data):
        start = np.flatnonzero(np.concatenate([[True], data[:-1] < 128]))
        shift = 7 * (np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data)))))
        step[later] = np.add.reduceat((data & 127).astype(np.int64) << shift, start)
    total = np.cumsum(step)
    return total + np.repeat(first - total[begin], counts)


def _batches(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    yield from pa.table(columns).to_batches(max_chunksize=ROWS)


class _Block:
    """Words of one language, as they come."""

    def __init__(self):
        self.words, self.new, self.n = [], [], 0

    def add(self, words: pa.Array, new: np.ndarray) -> None:
        self.words.append(words)
        self.new.append(new)
        self.n += len(new)

    def lists(self, lang: str, block: int) -> Iterator[pa.RecordBatch]:
        """(lang, word, tag, n, rest): the lists of a block, and a row without a word that counts them all."""
        words = pa.concat_arrays(self.words).dictionary_encode()
        own, new = words.indices.to_numpy(zero_copy_only=False), np.concatenate(self.new)
        self.words, self.new = [], []
        place = np.arange(len(own), dtype=np.int32) + np.cumsum(new, dtype=np.int32)  # a free place before every piece
        order = np.argsort(own, kind="stable")
        counts = np.bincount(own, minlength=len(words.dictionary))
        place = place[order]
        known = words.dictionary.cast(pa.string())
        tags = np.append(_tags(block, place[np.cumsum(counts) - counts]), (np.int64(block) << PLACE_BITS) + END)
        yield from _batches({
            "lang": pa.array([lang] * len(tags), pa.string()), "word": pa.concat_arrays([known, pa.nulls(1, pa.string())]), "tag": pa.array(tags),
            "n": pa.array(np.append(counts, len(own)).astype(np.int64)), "rest": pa.concat_arrays([_coded(place, counts), pa.array([b""], pa.binary())]),
        })


def _word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, _Block] = {}
    total, made = 0, 0
    part = 0

    def close(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal made, total
        block = held.pop(lang)
        total -= block.n
        if made >= 1 << BLOCK_BITS:
            raise ValueError(f"{made} blocks in one task")
        if part >= 1 << PART_BITS:
            raise ValueError(f"{part} tasks")
        made += 1
        yield from block.lists(lang, (part << BLOCK_BITS) + made - 1)

    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part")[0].as_py()
        langs = batch.column("lang").dictionary_encode()
        codes = langs.indices.to_numpy(zero_copy_only=False)
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            for _, buf, offsets in _text.slices([batch.filter(pa.array(codes == i))]):
                words, new = _words(buf, offsets)
                while len(new):
                    # up to the first piece that begins where the block is full
                    room = max(BLOCK_WORDS - (held[lang].n if lang in held else 0), 0)
                    later = np.flatnonzero(new[room:])
                    take = room + int(later[0]) if len(later) else len(new)
                    if take:
                        held.setdefault(lang, _Block()).add(words.slice(0, take), new[:take])
                        total += take
                        words, new = words.slice(take), new[take:]
                    if len(new) or held[lang].n >= BLOCK_WORDS:
                        yield from close(lang)
                if total >= 2 * BLOCK_WORDS:
                    yield from close(max(held, key=lambda k: held[k].n))
    for lang in list(held):
        yield from close(lang)


PACKED = "block bigint, ids binary, counts binary, first binary, rest binary"
SKETCH = "range int, block bigint, prefix binary, suffix binary, n binary"
VERDICT = "range int, block bigint, prefix binary, suffix binary, ids binary, n binary"


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _bytes(arrays) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes() for x in arrays], pa.binary())


class _Pairs:
    """Pairs of occurrences of which one starts a word after the other, in a block: the phrases one word longer, with their positions."""

    def __init__(self, table: pa.Table):
        if "ids" in table.column_names:
            self.block = table.column("block")[0].as_py()
            ids, counts, first = _joined(table, "ids", np.int64), _joined(table, "counts", np.int32).astype(np.int64), _joined(table, "first", np.int32)
        else:
            ids, tags, counts = (table.column(c).to_numpy() for c in ("id", "tag", "n"))
            self.block, first = int(tags[0] >> PLACE_BITS), tags & END
        positions = _decoded(first, counts, b"".join(table.column("rest").to_pylist()))
        own = np.repeat(np.arange(len(ids)), counts)
        order = np.argsort(positions, kind="stable")
        positions, own = positions[order], own[order]
        met = np.flatnonzero(positions[1:] == positions[:-1] + 1)
        pair = own[met].astype(np.int64) * len(ids) + own[met + 1]
        order = np.argsort(pair, kind="stable")
        pair, self.places = pair[order], positions[met[order]]
        begin = np.flatnonzero(np.diff(pair, prepend=-1))
        self.counts = np.diff(np.append(begin, len(pair)))
        self.prefix, self.suffix = ids[pair[begin] // len(ids)], ids[pair[begin] % len(ids)]


def _sketched(ranges: int):
    def run(table: pa.Table) -> pa.Table:
        """How often each pair occurs in a block, by ranges of the pairs' hashes."""
        p = _Pairs(table)
        h = _text.mix(p.prefix.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _text.mix(p.suffix.astype(np.uint64)))
        part = (h % np.uint64(ranges)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part = part[order]
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        split = lambda x, kind: _bytes(np.split(x[order].astype(kind), cut[1:]) if len(cut) else [])
        return pa.table({
            "range": pa.array(part[cut]), "block": pa.array(np.full(len(cut), p.block, np.int64)), "prefix": split(p.prefix, np.int64), "suffix": split(p.suffix, np.int64), "n": split(p.counts, np.int32),
        })

    return run


def _popular(min_count: int):
    def run(table: pa.Table) -> pa.Table:
        """Of each block, its pairs that are frequent over all blocks, with their ids; and a row of no block with all of them and their frequencies.

        A pair has at most one entry a block; a range has about as many entries as it was given words.
        """
        prefix, suffix, n = _joined(table, "prefix", np.int64), _joined(table, "suffix", np.int64), _joined(table, "n", np.int32)
        part = table.column("range")[0].as_py()
        order = np.lexsort((suffix, prefix))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(prefix[order]) != 0) | (np.diff(suffix[order]) != 0)
        begin = np.flatnonzero(new)
        total = np.add.reduceat(n[order].astype(np.int64), begin)
        good = total >= min_count
        number = np.cumsum(good) - 1 + (part << 32)
        ids = np.full(len(order), -1, np.int64)
        ids[order] = np.where(good, number, -1)[np.cumsum(new) - 1]
        ends = np.cumsum([len(x) // 4 for x in table.column("n").to_pylist()])
        rows = [(b, slice(a, e)) for b, a, e in zip(table.column("block").to_pylist(), np.append(0, ends[:-1]).tolist(), ends.tolist())]
        rows = [(b, np.arange(x.start, x.stop)[ids[x] >= 0]) for b, x in rows]
        rows = [(b, x) for b, x in rows if len(x)]
        all_of = order[begin[good]]
        own = [x for _, x in rows] + [all_of]
        counts = [np.zeros(0, np.int64)] * len(rows) + [total[good]]
        return pa.table({
            "range": pa.array([part] * len(own), pa.int32()), "block": pa.array([b for b, _ in rows] + [-1], pa.int64()), "prefix": _bytes(prefix[x] for x in own), "suffix": _bytes(suffix[x] for x in own),
            "ids": _bytes(ids[x] for x in own), "n": _bytes(counts),
        })

    return run


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, prefix, suffix, a) of frequent pairs."""
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(_joined(batch, c, np.int64)) for c in ("ids", "prefix", "suffix", "n")], ["id", "prefix", "suffix", "a"])


def _extended(lists: pa.Table, popular: pa.Table) -> pa.Table:
    """The lists, in a block, of frequent phrases one word longer, many a row."""
    out = []
    if len(lists) and len(popular):
        p = _Pairs(lists)
        prefix, suffix, ids = (_joined(popular, c, np.int64) for c in ("prefix", "suffix", "ids"))
        known = np.unique(np.concatenate([p.prefix, p.suffix]))
        at = lambda x, y: np.searchsorted(known, x) * len(known) + np.searchsorted(known, y)
        key, own = at(prefix, suffix), at(p.prefix, p.suffix)
        order = np.argsort(key)
        key, ids = key[order], ids[order]
        found = np.minimum(np.searchsorted(key, own), len(key) - 1)
        good = key[found] == own
        ids, counts, places = ids[found[good]], p.counts[good], p.places[np.repeat(good, p.counts)]
        first = places[np.cumsum(counts) - counts]
        _tags(p.block, first)  # positions fit
        rest = _coded(places, counts)
        for a in range(0, len(ids), ROWS):
            x = slice(a, a + ROWS)
            out.append((p.block, ids[x].tobytes(), counts[x].astype(np.int32).tobytes(), first[x].astype(np.int32).tobytes(), b"".join(rest[x.start : x.stop].to_pylist())))
    kinds = pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()
    return pa.table({c.split()[0]: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate(zip(PACKED.split(", "), kinds))})


def _frequent(lists: DataFrame, key: list[str], min_count: int, label: str) -> DataFrame:
    """Lists whose word or phrase is frequent, with its frequency ``a`` and ``id``. A key has at most one list a block."""
    w = Window.partitionBy(*key)
    return materialise(lists.withColumn("a", F.sum("n").over(w)).where(F.col("a") >= min_count).withColumn("id", F.min("tag").over(w)), label)


def _scored(a: Column, n: Column, heads: Column, tails: Column) -> Column:
    """(score, k, l, r) of the lowest-scoring cut, the first of equal ones. Products are decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")

    def cut(both: Column, k: Column) -> Column:
        product = (wide(a) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(19,0)") * wide(n)
        score = F.call_function("div", product, wide(both["heads"]) * wide(both["tails"]))
        return F.struct(score.alias("score"), k.alias("k"), both["heads"].alias("l"), both["tails"].alias("r"))

    return F.array_min(F.transform(F.arrays_zip(heads.alias("heads"), tails.alias("tails")), cut))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z count as a-z. Texts are cut into pieces at ``.,;:!?`` and line breaks (U+000A to U+000D), pieces into words at spaces and tabs. Candidates are phrases of 2 to ``longest`` words with
    a >= ``min_count`` occurrences within pieces, overlapping ones included. With n words in the language, a cut into parts of frequencies l and r scores floor(1000 a n / (l r)); a phrase's
    lowest score counts. Candidates that always stand in one longer candidate go. Order: score and a descending, phrase ascending by its bytes.
    Null texts are empty, a null lang is ``und``; repeated rows count as often as they stand there; an empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"), F.spark_partition_id().alias("part"))
    lists = _frequent(texts.mapInArrow(_word_lists, "lang string, word string, tag bigint, n bigint, rest binary"), ["lang", "word"], min_count, "phrase-words")
    own = lists.where("tag = id")
    totals = materialise(own.where("word IS NULL").select("lang", F.col("a").alias("n")), "phrase-totals")  # one row a language
    ranges = max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // RANGE_WORDS))
    none = F.array().cast("array<bigint>")
    known = materialise(own.where("word IS NOT NULL").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", none.alias("heads"), none.alias("tails")), "phrases")
    lists_now, levels = lists.where("word IS NOT NULL").select("id", "tag", "n", "rest", F.shiftright("tag", PLACE_BITS).alias("block")), []
    for k in range(2, longest + 1):
        blocks = lists_now.groupBy("block")
        verdict = blocks.applyInArrow(_sketched(ranges), SKETCH).groupBy("range").applyInArrow(_popular(min_count), VERDICT)
        verdict = materialise(verdict, "phrase-verdict")
        found = verdict.where("block < 0").mapInArrow(_phrases, "id bigint, prefix bigint, suffix bigint, a bigint")
        later = materialise(blocks.cogroup(verdict.where("block >= 0").groupBy("block")).applyInArrow(_extended, PACKED), "phrase-lists") if k < longest else None
        discard(lists)
        begin = known.select(F.col("id").alias("prefix"), "lang", "phrase", F.col("heads").alias("before"), F.col("a").alias("first"))
        end = known.select(F.col("id").alias("suffix"), F.col("last"), F.col("tails").alias("after"), F.col("a").alias("second"))
        named = found.join(begin, "prefix").join(end, "suffix")
        known = materialise(
            named.select(
                "id", "prefix", "suffix", "lang", F.concat("phrase", F.lit(" "), "last").alias("phrase"), "last", "a",
                F.concat("before", F.array("first")).alias("heads"), F.concat(F.array("second"), "after").alias("tails"), "first", "second",
            ),
            "phrases",
        )
        levels.append(known)
        discard(verdict)
        lists = lists_now = later
    kept = None
    for k, level in enumerate(levels):
        own = level
        if k + 1 < len(levels):
            # a phrase that always stands in a longer one always stands in one that is a word longer
            above = levels[k + 1]
            inside = above.where("a = first").select(F.col("prefix").alias("id")).unionAll(above.where("a = second").select(F.col("suffix").alias("id")))
            own = own.join(inside.distinct(), "id", "left_anti")
        own = own.select("lang", "phrase", "a", "heads", "tails")
        kept = own if kept is None else kept.unionAll(own)
    scored = kept.join(totals, "lang").withColumn("cut", _scored(F.col("a"), F.col("n"), F.col("heads"), F.col("tails")))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of all ``documents``: lang, rank, phrase, a, l, r, n, score."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_LENGTHS = range(2, LONGEST + 1)
OP12_SQL = rf"""
WITH p AS (
  SELECT r, lang, unnest(ps) AS piece, unnest(range(len(ps))) AS k FROM (
    SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
           string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents)),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, m, ws[i : i + m - 1] AS ph FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest(range(1, {LONGEST + 1})) AS m) WHERE len(ws) >= m)),
f AS MATERIALIZED (SELECT lang, m, ph, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT f.lang, f.m, f.ph, f.a, n, unnest(range(1, f.m)) AS k FROM f JOIN t ON t.lang = f.lang WHERE f.m > 1),
s AS (
  SELECT c.lang, c.m, c.ph, c.a, x.a AS l, y.a AS r, n, k, CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM c JOIN f AS x ON x.lang = c.lang AND x.m = k AND x.ph = c.ph[1 : k] JOIN f AS y ON y.lang = c.lang AND y.m = c.m - k AND y.ph = c.ph[k + 1 : c.m]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
d AS (SELECT DISTINCT lang, ph[i : i + n - 1] AS ph, a FROM (SELECT lang, ph, a, n, unnest(range(1, m - n + 2)) AS i FROM (SELECT lang, ph, m, a, unnest(range(2, m)) AS n FROM f WHERE m > 2)))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ph, ' ')) AS rank, array_to_string(ph, ' ') AS phrase, a, l, r, n, score
FROM b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.lang = b.lang AND d.ph = b.ph AND d.a >= b.a)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ph, ' ')) <= {TOP}
"""
