"""From band keys to near-duplicate components, exact within the candidates, without all pairs of a group.

Members of a bucket (classes that share a band key) are candidates of each other. Small buckets are paired
directly, which makes at most a constant number of pairs per row. In a large bucket a few random members are
centres: each is compared with every member, and verified links give components. Only candidates in different
components can still matter, and of those at least one stands outside its bucket's largest component: the signatures of such members are
compared with the whole bucket's, block by block, inside tasks. Few candidates are listed and verified; where they are many, whole texts are compared inside
tasks that return a spanning forest of the links they find. So no candidate pair between different components is skipped, no pairs beyond a
constant number a member are emitted, and no task holds more than two blocks.

Class numbers (cid) are 64-bit fingerprints. Two classes that share one by chance share buckets, but only one of them lends its text, and callers give links to
the class with that text's second fingerprint only (``check``), so chance never links texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.llm import _text
from darkroom.operators.components import connected_components
from darkroom.runtime import discard, materialise, shuffle_partitions

SMALL = 12
CENTRES = 4
#: Members of a block and its bytes of text at about, and shingles that are compared at once.
BLOCK, BLOCK_BYTES = 256, 8 << 20
COLUMNS = 8192
#: Text whose pairs are verified at once.
VERIFIED_BYTES = 1 << 18
#: Members of a block whose signatures are compared, and candidates that are listed for each of them at most.
SIGN_BLOCK, LISTED = 2048, 4
#: Bands that 16 or more classes of every 32nd have are hot; the hottest, at most so many, are handled by broadcast.
SAMPLE, SAMPLED, HOT_BANDS = 32, 16, 4096
#: Band keys that a task cuts by ranges at once.
DEALT = 1 << 20
#: Members of a large bucket that are compared with a centre in one task at about.
STAR = 4096


def in_sample() -> Column:
    """Whether a class is in the sample in which hot bands are looked for."""
    return F.pmod(F.xxhash64("cid"), F.lit(SAMPLE)) == 0


def sampled(cid: np.ndarray) -> np.ndarray:
    """Another such sample, for callers that deal with classes in tasks."""
    return _text.mix(cid.view(np.uint64)) % np.uint64(SAMPLE) == 0


def _hot_bands(rows: DataFrame) -> DataFrame:
    """The hottest bands by the rows (band, cid) of classes in a sample; at most ``HOT_BANDS``."""
    sample = rows.select("band", "cid").distinct()
    counted = sample.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SAMPLED)
    return materialise(counted.orderBy(F.desc("n"), "band").limit(HOT_BANDS).select("band"), "near-hot")


def shared_buckets(bands: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """(band, cid, hot) rows of buckets with two or more different classes; columns that depend on cid stay.

    ``sample``: the rows of classes that are ``in_sample``, where a caller has them at less cost than all rows.

    Hot bands are found in a sample of classes, which only decides how they are dealt: their rows stay where they are. For all
    others, one shuffle on the band serves both the count and the join; both stream.
    """
    spark = bands.sparkSession
    some = bands.where("band IS NOT NULL AND cid IS NOT NULL")
    sample = (some if sample is None else sample.where("band IS NOT NULL AND cid IS NOT NULL")).where(in_sample())
    hot = _hot_bands(sample)
    if hot.isEmpty():
        rest, apart = some, None
    else:
        rest = some.join(F.broadcast(hot), "band", "left_anti")  # at most HOT_BANDS rows
        apart = some.join(F.broadcast(hot), "band", "left_semi").select(*bands.columns).distinct().withColumn("hot", F.lit(True))
    dealt = rest.repartition(shuffle_partitions(spark), "band")
    ends = dealt.groupBy("band").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo <> hi").select("band")
    # shared bands are the smaller side of every partition: hashing them spares sorting all rows
    found = dealt.join(ends.hint("shuffle_hash"), "band").select(*bands.columns).distinct().withColumn("hot", F.lit(False))
    return found if apart is None else found.unionAll(apart)


def _deal(bands: int, parts: int, hot: np.ndarray):
    """Band keys and their classes, cut by ranges of keys; those of hot bands, which aren't paired, are dealt by class."""

    def cut(keys: list, cids: list) -> pa.RecordBatch:
        key, cid = np.concatenate(keys), np.concatenate(cids)
        by = key.view(np.uint64)
        if len(hot):
            by = np.where(_among(hot, key), _text.mix(cid.view(np.uint64)), by)
        part = ((by >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts <= 1 << 16 else np.int32)
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = pa.py_buffer((8 * np.append(first, len(part))).astype(np.int32))
        packed = [pa.Array.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(x[order])]) for x in (key, cid)]
        return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), *packed], ["part", "keys", "cids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, cids, n = [], [], 0
        for batch in batches:
            if batch.num_rows:
                keys.append(_text.unpacked(batch.column(1), bands).ravel())
                cids.append(np.repeat(batch.column(0).to_numpy(), bands))
                n += len(keys[-1])
            if n >= DEALT:
                yield cut(keys, cids)
                keys, cids, n = [], [], 0
        if n:
            yield cut(keys, cids)

    return run


def _among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in an ascending array that isn't empty."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _pair_up(hot: np.ndarray, small: int = SMALL):
    """Of a range of keys: pairs (a, b) of buckets of up to ``small`` classes, and rows (band, a) of larger and of hot ones."""

    def run(table: pa.Table) -> pa.Table:
        key, cid = (np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x.as_buffer(), np.int64) for x in table.column(c)]]) for c in ("keys", "cids"))
        order = np.argsort(key)
        ahead = np.diff(key[order]) == 0
        shared = order[np.concatenate([ahead, [False]]) | np.concatenate([[False], ahead])] if len(key) else order
        if len(hot):
            shared = np.union1d(shared, np.flatnonzero(_among(hot, key)))
        key, cid = key[shared], cid[shared]
        order = np.lexsort((cid, key))
        key, cid = key[order], cid[order]
        new = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(cid) != 0)])[: len(key)]  # other tasks' rows of a class
        key, cid = key[new], cid[new]
        first = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0])[: len(key)])
        size = np.diff(np.append(first, len(key)))
        n, is_hot = np.repeat(size, size), _among(hot, key) if len(hot) else np.zeros(len(key), bool)
        large, few = is_hot | (n > small), ~is_hot & (n <= small)
        last = np.repeat(first + size, size)
        at = np.arange(len(key))
        a, b = [cid[large]], []
        for d in range(1, small):
            i = np.flatnonzero(few & (at + d < last))
            a.append(cid[i])
            b.append(cid[i + d])
        pairs = sum(len(x) for x in b)
        alone = np.arange(len(a[0]) + pairs) < len(a[0])
        fill = np.zeros(pairs, np.int64)
        return pa.table({
            "band": pa.array(np.concatenate([key[large], fill]), mask=~alone), "hot": pa.array(np.concatenate([is_hot[large], fill > 0])),
            "a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate([np.zeros(len(a[0]), np.int64), *b]), mask=alone),
        })

    return run


def dealt_buckets(rows: DataFrame, sample: DataFrame, bands: int) -> DataFrame:
    """Pairs and large buckets of (cid, keys), where keys are ``bands`` 64-bit band keys as bytes: (band, hot, a, b).

    Pairs of different classes of buckets of up to ``SMALL`` have no band and may come again; rows of larger and of hot buckets have no ``b``. ``sample`` has the rows
    (band, cid) of classes that are ``sampled``. Keys are shuffled by ranges, many a row; a range holds about half of what a shuffle's task does. A hot
    band's rows are dealt over all ranges.
    """
    # a band with few rows has few classes: different ones are counted for the others only
    often = materialise(sample.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SAMPLED).select("band"), "near-often")
    hot = _hot_bands(sample.join(often.hint("shuffle_hash"), "band", "left_semi"))
    hot = np.sort(np.array([r["band"] for r in hot.collect()], np.int64))  # at most HOT_BANDS
    discard(often)
    dealt = rows.mapInArrow(_deal(bands, 2 * shuffle_partitions(rows.sparkSession), hot), "part int, keys binary, cids binary")
    return dealt.groupBy("part").applyInArrow(_pair_up(hot), "band bigint, hot boolean, a bigint, b bigint")


def agreeing(pairs: DataFrame, signs: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs (a, b, signature of a) whose signatures agree in ``least_agreement`` components or more; ``signs`` has a row a class."""
    words = -(-size // 16)
    names = signature(words)
    # hashing the pairs spares sorting the signatures
    both = signs.select(F.col("cid").alias("b"), F.struct(*names).alias("q")).join(pairs.select("a", "b", F.struct(*names).alias("p")).hint("shuffle_hash"), "b")
    return both.where(_agreement("p", "q", words, size) >= least_agreement(percent, size)).select("a", "b")


def _by_band(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Bucket rows joined with a table of a few rows a band; rows of hot bands stay where they are. Both have ``hot``."""
    keys = ["band", "hot"]
    few = F.broadcast(table.where("hot"))  # at most CENTRES * HOT_BANDS rows
    return rows.where("NOT hot").join(table.where("NOT hot"), keys).unionByName(rows.where("hot").join(few, keys))


def signature(words: int) -> list[str]:
    """Names of the columns that hold a class's signature (``_text.nibbles``)."""
    return [f"s{k}" for k in range(words)]


def least_agreement(percent: int, size: int) -> int:
    """Of ``size`` components, how many agree in four bits at least where sets are that similar: 3.7 standard deviations below what is expected."""
    q = percent / 100 + (1 - percent / 100) / 16
    return int(size * q - 3.7 * (size * q * (1 - q)) ** 0.5)


def _agreement(x: str, y: str, words: int, size: int) -> Column:
    """Components in which the signatures of two aliased rows agree."""
    apart = F.lit(0)
    for s in signature(words):
        d = F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x1111111111111111))
        apart = apart + F.bit_count(d)
    return F.lit(size) - apart


def _small_pairs(buckets: DataFrame, sizes: DataFrame, words: int, size: int, least: int) -> DataFrame:
    """All pairs of small buckets whose signatures agree."""
    small = buckets.where("NOT hot").join(sizes.where(f"n <= {SMALL}").select("band"), "band")
    return small.alias("p").join(small.alias("q"), (F.col("p.band") == F.col("q.band")) & (F.col("p.cid") < F.col("q.cid")) & (_agreement("p", "q", words, size) >= least)).select(
        F.col("p.cid").alias("a"), F.col("q.cid").alias("b"), F.lit(None).cast("bigint").alias("deal")
    )


def near_links(buckets: DataFrame, fetch: Callable, sets: Callable, percent: int, size: int, given: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Verified links that connect the same classes as all verified pairs of the buckets would.

    ``buckets``: (band, cid, hot, and the class's signature of ``size`` components), already written. ``fetch``: from a table of distinct cid to (cid, check, text),
    one row each, the same whenever it is asked. ``sets``: from the bytes and offsets of rows to their shingle sets (ascending hashes and a row pointer). Linked
    are classes with 100 * |intersection| >= percent * |union|. Candidates whose signatures agree in fewer components than ``least_agreement`` are as
    good as never that similar, so their texts aren't fetched. ``given``: agreeing pairs (a, b) of small buckets, already written, where ``buckets`` holds large ones only; texts
    of all members are then fetched at once. Returns links (a, b), where a class may be linked with itself, and (cid, check) of compared classes.
    """
    words = -(-size // 16)
    signs, least = signature(words), least_agreement(percent, size)

    sizes = buckets.groupBy("band", "hot").agg(F.count(F.lit(1)).alias("n"), *[F.min_by("cid", F.xxhash64("cid", F.lit(k))).alias(f"c{k}") for k in range(CENTRES)])
    sizes = materialise(sizes, "near-sizes")
    if given is not None:
        pairs = given.withColumn("deal", F.lit(None).cast("bigint"))
    else:
        pairs = _small_pairs(buckets, sizes, words, size, least)
    centres = sizes.where(f"n > {SMALL}").select("band", "hot", "n", F.explode(F.array_distinct(F.array(*[f"c{k}" for k in range(CENTRES)]))).alias("cid"))
    centres = materialise(_by_band(buckets, centres.withColumnRenamed("cid", "centre")).where("cid = centre").select("band", "hot", "n", "centre", *signs), "near-centres")
    # a centre's text is copied for every STAR members, whichever of its buckets they are in
    wide = materialise(centres.groupBy("centre").agg(F.ceil(F.max("n") / STAR).cast("bigint").alias("copies")).where("copies > 1"), "near-wide")
    stars = _by_band(buckets.select("band", "hot", "cid", F.struct(*signs).alias("q")), centres.select("band", "hot", "centre", F.struct(*signs).alias("p")))
    stars = stars.where((F.col("centre") != F.col("cid")) & (_agreement("p", "q", words, size) >= least)).select("centre", "cid")
    if wide.isEmpty():
        stars = stars.select(F.least("centre", "cid").alias("a"), F.greatest("centre", "cid").alias("b"), F.lit(None).cast("bigint").alias("deal"))
    else:
        stars = stars.distinct().join(wide, "centre", "left").select(F.col("centre").alias("a"), F.col("cid").alias("b"), F.pmod(F.xxhash64("cid"), "copies").alias("deal"))
    pairs = materialise(pairs.unionAll(stars).distinct(), "near-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid"))
    if given is not None:
        wanted = wanted.unionAll(buckets.select("cid"))
    content = materialise(fetch(wanted.distinct()), "near-content")
    left = content.select("cid", F.lit(0).cast("bigint").alias("copy"), "text")
    if not wide.isEmpty():
        copies = content.join(wide.withColumnRenamed("centre", "cid"), "cid").select("cid", F.explode(F.expr("sequence(1L, copies - 1)")).alias("copy"), "text")
        left = left.unionAll(copies)
    links = _compare(pairs.withColumn("copy", F.coalesce("deal", F.lit(0).cast("bigint"))), left, content, sets, percent)
    checks = content.select("cid", "check")
    if centres.isEmpty():
        discard(sizes, centres, wide, pairs)
        return links, checks

    labels = connected_components(links)
    big = _by_band(buckets, sizes.where(f"n > {SMALL}").select("band", "hot"))
    members = big.join(labels, big["cid"] == labels["node"], "left").select("band", "hot", "cid", F.coalesce("root", "cid").alias("label"), *signs)
    members = materialise(members, "near-members")
    open_rows = materialise(_open_rows(members), "near-open")
    dealt = open_rows.groupBy("band", "hot").agg(F.ceil(F.count_if("out") / SIGN_BLOCK).alias("lefts"), F.ceil(F.count(F.lit(1)) / SIGN_BLOCK).alias("rights"))
    pairs2 = _in_blocks(open_rows, materialise(dealt, "near-blocks"), *signs).applyInArrow(_block_pairs(signs, size, least), "band bigint, a bigint, b bigint")
    pairs2 = materialise(pairs2, "near-block-pairs")
    # too many candidates to list: whole texts are compared inside tasks
    dense = materialise(pairs2.where("a IS NULL").select("band").distinct(), "near-dense")
    pairs2, any_dense = pairs2.where("a IS NOT NULL").select("a", "b").distinct(), not dense.isEmpty()
    wanted = pairs2.select(F.explode(F.array("a", "b")).alias("cid"))
    if any_dense:
        rows = open_rows.drop(*signs).join(dense, "band", "left_semi")
        wanted = wanted.unionAll(rows.select("cid"))
    more = content if given is not None else materialise(fetch(wanted.distinct()), "near-more")
    found = _compare(pairs2, more, more, sets, percent)
    if any_dense:
        rows = rows.join(more, "cid").withColumn("bytes", F.octet_length("text").cast("bigint"))
        blocks = lambda own: F.greatest(F.ceil(F.count_if(own) / BLOCK), F.ceil(F.sum(F.when(own, F.col("bytes"))) / BLOCK_BYTES))
        dealt = rows.groupBy("band", "hot").agg(blocks(F.col("out")).alias("lefts"), blocks(F.lit(True)).alias("rights"))
        inside = _in_blocks(rows, materialise(dealt, "near-dense-blocks"), "text").applyInArrow(_block_links(sets, percent), "a bigint, b bigint")
        found = found.unionAll(materialise(inside, "near-block-links"))
    checks = checks.unionAll(more.select("cid", "check"))
    discard(sizes, centres, wide, pairs, members)
    # stars say the same as the links behind them, and are settled already
    return labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(found), checks.distinct()


def _compare(pairs: DataFrame, left: DataFrame, right: DataFrame, sets: Callable, percent: int) -> DataFrame:
    """Verified pairs (a, b) of those listed; ``left`` and ``right`` have the texts of a and b, ``left`` by ``copy`` too if pairs have one."""
    keys = ["a", "copy"] if "copy" in pairs.columns else ["a"]
    left = left.select(F.col("cid").alias("a"), *keys[1:], F.col("text").alias("text_a"))
    both = pairs.join(left, keys).join(right.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return materialise(both.mapInArrow(_verifier(sets, percent), "a bigint, b bigint"), "near-links")


def _open_rows(members: DataFrame) -> DataFrame:
    """Members of buckets that hold several components; ``out`` are those outside the bucket's largest one."""
    per_label = members.groupBy("band", "hot", "label").agg(F.count(F.lit(1)).alias("k"))
    per_band = per_label.groupBy("band", "hot").agg(F.max_by("label", F.struct("k", "label")).alias("top"), F.sum("k").alias("n"), F.max("k").alias("k"))
    per_band = materialise(per_band.where("k < n").select("band", "hot", "top"), "near-tops")
    return _by_band(members, per_band).withColumn("out", F.col("label") != F.col("top")).drop("top")


def _in_blocks(rows: DataFrame, dealt: DataFrame, *columns: str):
    """Every block of members outside their bucket's largest component, grouped with every block of the bucket."""
    rows = _by_band(rows, dealt)
    own = lambda c: F.pmod(F.xxhash64("cid", "band"), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    outside = rows.where("out").select("band", own("lefts").alias("i"), every("rights").alias("j"), F.lit(True).alias("is_left"), "cid", "label", *columns)
    whole = rows.select("band", every("lefts").alias("i"), own("rights").alias("j"), F.lit(False).alias("is_left"), "cid", "label", *columns)
    return outside.unionAll(whole).groupBy("band", "i", "j")


def _block_pairs(signs: list[str], size: int, least: int):
    """Pairs of a pair of blocks whose signatures agree enough and whose components differ; if they are more than ``LISTED`` a member, one row without a pair."""
    low = np.uint64(0x1111111111111111)

    def run(table: pa.Table) -> pa.Table:
        left = table.column("is_left").to_numpy(zero_copy_only=False).astype(bool)
        cid, label = table.column("cid").to_numpy(), table.column("label").to_numpy()
        words = [table.column(s).to_numpy().view(np.uint64) for s in signs]
        lefts, rights = np.flatnonzero(left), np.flatnonzero(~left)
        found, count = [], 0
        for at in range(0, len(lefts), 128):
            own = lefts[at : at + 128]
            apart = np.zeros((len(own), len(rights)), np.uint8)
            for w in words:
                d = w[own][:, None] ^ w[rights][None, :]
                d |= d >> np.uint64(1)
                d |= d >> np.uint64(2)
                d &= low
                apart += np.bitwise_count(d)
            i, j = np.nonzero((size - apart.astype(np.int16) >= least) & (label[own][:, None] != label[rights][None, :]))
            found.append((cid[own[i]], cid[rights[j]]))
            count += len(i)
            if count > LISTED * table.num_rows:
                return pa.table({"band": pa.array([table.column("band")[0].as_py()], pa.int64()), "a": pa.array([None], pa.int64()), "b": pa.array([None], pa.int64())})
        x, y = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        band = np.full(len(x), table.column("band")[0].as_py() if table.num_rows else 0, np.int64)
        return pa.table({"band": band, "a": np.minimum(x, y), "b": np.maximum(x, y)})

    return run


def _verifier(sets: Callable, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in _text.slices([batch], "text_a", VERIFIED_BYTES):
                # each text's set once
                texts = [_text.text_array(part.column(part.schema.get_field_index(c))).dictionary_encode() for c in ("text_a", "text_b")]
                (a, pa_), (b, pb) = (sets(*_text.text_buffers(t.dictionary)) for t in texts)
                keep = np.zeros(part.num_rows, dtype=bool)
                for i, (ia, ib) in enumerate(zip(*(t.indices.to_pylist() for t in texts))):
                    x, y = a[pa_[ia] : pa_[ia + 1]], b[pb[ib] : pb[ib + 1]]
                    if len(x) and len(y):
                        both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                        keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return run


def _block_links(sets: Callable, percent: int):
    """Compare all left with all right members of a pair of blocks; of the links found, a spanning forest is returned."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        values, pointers = [], [0]
        for batch in table.to_batches():
            for _, buf, offsets in _text.slices([batch]):
                v, p = sets(buf, offsets)
                values.append(v)
                pointers += (p[1:] + pointers[-1]).tolist()
        flat, pointer = np.concatenate(values), np.array(pointers)
        row, size = _text.row_of(pointer), np.diff(pointer)
        is_left = table.column("is_left").to_numpy(zero_copy_only=False).astype(bool)
        cid, label = table.column("cid").to_numpy(), table.column("label").to_numpy()
        lefts, rights = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        shared, column = np.unique(flat, return_inverse=True)
        # only shingles on both sides count
        on_left, on_right = np.zeros(len(shared), bool), np.zeros(len(shared), bool)
        on_left[column[is_left[row]]] = True
        on_right[column[~is_left[row]]] = True
        both = on_left & on_right
        number = np.cumsum(both) - 1
        use = both[column]
        row, column = row[use], number[column[use]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        place = np.zeros(len(is_left), np.int64)
        place[lefts], place[rights] = np.arange(len(lefts)), np.arange(len(rights))
        common = np.zeros((len(lefts), len(rights)), np.float32)
        for at in range(0, int(both.sum()), COLUMNS):
            x, y = np.searchsorted(column, [at, at + COLUMNS])
            r, c = row[x:y], column[x:y] - at
            a, b = np.zeros((len(lefts), COLUMNS), np.float32), np.zeros((len(rights), COLUMNS), np.float32)
            l = is_left[r]  # noqa: E741
            a[place[r[l]], c[l]] = 1
            b[place[r[~l]], c[~l]] = 1
            common += a @ b.T
        linked = 100 * common >= percent * (size[lefts][:, None] + size[rights][None, :] - common)
        linked &= (label[lefts][:, None] != label[rights][None, :]) & (common > 0)
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for i, j in np.argwhere(linked).tolist():
            x, y = root(int(label[lefts[i]])), root(int(label[rights[j]]))
            if x != y:
                parent[x] = y
                out.append((int(cid[lefts[i]]), int(cid[rights[j]])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run
