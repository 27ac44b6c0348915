"""The ten operators and the pipeline against brute force, on small and on awkward tables."""

import hashlib
import html
import json
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from darkroom.llm import _near, _text, _tokens, ann, html_text, line_dedup, mixing, near_dedup, packing, quality, registry, simple8b, suffix_dedup, toxicity
from darkroom.runtime import materialise

SF = "/root/testdata/sf0.001"
WORDS = "the of and house tree river stone light water mountain garden silver window letter summer winter morning evening paper music".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tie bigint, cid string, band string, rid string, f int, size string, key string, label string, `range` int, vector string"


def _rows(seed=1, n=60):
    rnd = random.Random(seed)
    line = lambda k: " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 99)) for _ in range(k))
    out, base = [], [line(70) for _ in range(6)]
    for i in range(n):
        text = "\n".join(line(rnd.randint(1, 40)) for _ in range(rnd.randint(1, 4)))
        if i % 4 == 0:  # near copies
            w = rnd.choice(base).split()
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = "x" + str(rnd.randint(0, 9))
            text = " ".join(w) + "\n" + (text if i % 8 else "")
        out.append((i, text, "en", "s" + str(rnd.choice([0, 0, 0, 1, 2, 3]))))
    out += [(100, None, None, None), (101, "", "en", None), (102, " \n\t ", "en", "s1"), (103, "two words", "de", "s9"), (103, "two words", "de", "s9"), (None, out[4][1], None, "s1"), (None, None, None, None)]
    out += [(104, out[0][1], "en", "s0"), (105, out[0][1].upper(), "fr", "s2"), (106, "é" * 5000 + " über Straße ’ naïve — 日本語 🙂", "de", "s2"), (107, "word " * 3000, "en", "s0")]
    return out


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, lang, s, len(t or ""), 1, "c", "b", "r", 2, "z", "k", "l", 3, "v") for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_encoder_equals_library():
    rnd = random.Random(3)
    alphabet = list("aBéß²'.,!12 \n\t*s \xa0\x85\x1cªµ×À½") + ["'s", "'LL", "  ", "th", "’", "́"]
    cases = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 16))) for _ in range(4000)] + ["<|endoftext|> a"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = str(public_tokenizers.path(name))
        t = Tokenizer.from_file(path)
        for text, got in zip(cases, _tokens.Encoder(path).encode(cases)):
            assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("most, values", [(1 << 20, 1 << 64), (300, 1 << 64), (20, 1 << 64), (1 << 20, 7)])
def test_encoder_in_chunks(monkeypatch, most, values):
    # cuts between chunks, a cache that is emptied, more pre-tokens than it holds, and hashes that many pre-tokens share
    monkeypatch.setattr(_tokens, "CHUNK", 24)
    monkeypatch.setattr(_tokens, "CACHE", most)
    of = _text.Rolling.of
    monkeypatch.setattr(_text.Rolling, "of", lambda self, a, b: of(self, a, b) % np.uint64(values) if values < 1 << 64 else of(self, a, b))
    rnd = random.Random(4)
    alphabet = ["a", "Bé", "ß", "'s", "'ll", "don't", "'", " '", "''", ".", "!!", "12", "7", " ", "  ", "\n", " \t", "\xa0", "\x00", "re"]
    cases = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(600)] + ["", " ", "x,y." * 50, "w" * 3000, "日本 a"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = str(public_tokenizers.path(name))
        t, e = Tokenizer.from_file(path), _tokens.Encoder(path)
        got = [x for at in range(0, len(cases), 50) for x in e.encode(cases[at : at + 50])]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(c, add_special_tokens=False).ids for c in cases]


def test_encoder_of_unknown_form(tmp_path):
    path = tmp_path / "t.json"
    written = json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    written["normalizer"] = {"type": "Lowercase"}
    written["pre_tokenizer"]["add_prefix_space"] = True
    path.write_text(json.dumps(written), encoding="utf-8")
    t, cases = Tokenizer.from_file(str(path)), ["Hello World", "", "É a\n  b", "x <|endoftext|>"]
    assert [np.frombuffer(x, "<u4").tolist() for x in _tokens.Encoder(str(path)).encode(cases)] == [t.encode(c, add_special_tokens=False).ids for c in cases]


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 60, 1023, 1024, 1025, 5000):
        for most in (1, 2, 300, 49408, 2**40, 2**61, 2**64 - 1):
            v = rng.integers(0, most, n, dtype=np.uint64)
            words, offsets = simple8b.encode_blocks(v)
            assert (simple8b.decode_blocks(words, offsets, n) == v).all()
    v = np.where(rng.random(9000) < 0.02, 2**64 - 1, rng.integers(0, 2**14, 9000)).astype(np.uint64)
    assert (simple8b.decode_blocks(*simple8b.encode_blocks(v), len(v)) == v).all()
    data = b"".join(x + b"\n" for x in (simple8b.pack_section(0, 0, [5, None], [v[:3000], v[3000:3000]]), simple8b.pack_section(0, 1, [7], [v[3000:]])))
    (ids2, lengths2, back2), (ids, lengths, back) = (simple8b.read_section(data, at, numbers) for at, numbers in simple8b.trailers(data))
    assert ids == [5, None] and lengths.tolist() == [3000, 0] and ids2 == [7]
    assert (np.concatenate([back, back2]) == v).all()
    with pytest.raises(ValueError):
        list(simple8b.trailers(data[:-5]))


@pytest.mark.parametrize("section", [1 << 20, 500])
def test_token_ids(spark, docs, none, rows, tmp_path, monkeypatch, section):
    monkeypatch.setattr(simple8b, "SECTION", section)
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    t = Tokenizer.from_file(path)
    got = simple8b.read_digest(spark, simple8b.write_ids(docs, f"file://{tmp_path}/ids", path)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert ids == sorted(ids)
    assert simple8b.read_digest(spark, simple8b.write_ids(none, f"file://{tmp_path}/none", path)).count() == 0


def test_mixing(spark, docs, none, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for i, t, _, s in rows:
        size[s] += len(_words(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, want, target = set(order), 1.5 * sum(size.values()), {}
    while True:
        level = (want - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if 2 * size[s] <= level * weight[s]}
        target |= {s: 2.0 * size[s] for s in full}
        left -= full
        if not full or not left:
            target |= {s: level * weight[s] for s in left}
            break
    taken = defaultdict(int)
    for r in got:
        assert r["size"] * 2 >= r["taken"] and abs(r["target"] - target[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(target[s] + 1e-9) for s in size)
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], str(r["source"]), r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, got))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == sum(taken.values())
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def _suffix_brute(rows, n):
    c = Counter()
    for _, t, *_ in rows:
        b = (t or "").encode()
        c.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = Counter()
    for k, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if c[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out[k, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("length", [24, 100])
def test_suffix_dedup(docs, none, rows, length):
    got = suffix_dedup.remove_repeats(docs, length=length).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == _suffix_brute(rows, length)
    assert suffix_dedup.remove_repeats(none, length=length).count() == 0


def test_suffix_dedup_at_full_length(spark, monkeypatch):
    """400-byte strings: passages in many texts with many contexts, and texts of several slices and pieces."""
    rnd = random.Random(11)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, other = word(450), word(900)
    rows = [(i, word(rnd.randint(0, 300)) + passage + word(rnd.randint(0, 300))) for i in range(300)]
    rows += [(1000 + i, word(50) + other[rnd.randint(0, 400) :] + word(30)) for i in range(20)] + [(2000, word(3000) + other[100:700] + word(9000) + passage + "é" * 500)]
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 11)
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 16)
    monkeypatch.setattr(suffix_dedup, "GROUP", 1 << 12)
    k, w = suffix_dedup._sizes(400)
    text = rows[-1][1].encode()
    buf, whole = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    cut = suffix_dedup.anchors(buf, whole)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 21)
    full = suffix_dedup.anchors(buf, whole)
    at = lambda x: {(b + i): f for b, n, f in zip(x[1].tolist(), x[2].tolist(), x[3].tolist()) for i in range(n)}
    assert at(cut) == at(full) and len(at(full)) == len(text) - 399
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 11)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == _suffix_brute(rows, 400)


def _components(sets, percent):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = [k for k in sets if sets[k]]
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def test_line_dedup(docs, none, rows):
    out = line_dedup.dedup_lines(docs, removed="gone")
    assert out.columns == [*docs.columns, "gone"]
    order = sorted({(i is None, i or 0, t) for i, t, *_ in rows if t}, key=lambda x: x[:2])
    lines = [x.strip(" \t\n\r\x0b\x0c") for _, _, t in order for x in t.split("\n")]
    lines = {x for x in lines if len(x) >= line_dedup.MIN_CHARS}
    comp = _components({x: {x[i : i + 5] for i in range(len(x) - 4)} for x in lines}, 80)
    # one line of every component is left, and nothing else went
    kept = Counter()
    texts = {(r["doc_id"], r["text"], r["gone"]) for r in out.collect()}
    for _, t, _ in texts:
        kept.update(comp[x] for x in {y.strip(" \t\n\r\x0b\x0c") for y in (t or "").split("\n")} if x in comp)
    assert set(kept) == set(comp.values()) and max(kept.values()) == 1
    all_lines = sum(len(t.split("\n")) for _, _, t in order)
    left = sum(g + (0 if t is None else t.count("\n") + 1) for _, t, g in texts if t or g)
    assert abs(left - all_lines) <= sum(1 for _, t, g in texts if g and not t) + 1
    assert out.count() == len(rows) and line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_keeps_no_sketches(docs, monkeypatch):
    # classes' sketches go before texts are shuffled
    written, before, links = {}, line_dedup.materialise, line_dedup._near.near_links

    def write(df, label):
        written[label] = before(df, label)
        return written[label]

    def linked(*args):
        assert not os.path.exists(written["line-classes"].scratch.removeprefix("file://"))
        assert os.path.exists(written["line-shared"].scratch.removeprefix("file://"))
        return links(*args)

    monkeypatch.setattr(line_dedup, "materialise", write)
    monkeypatch.setattr(line_dedup._near, "near_links", linked)
    assert line_dedup.duplicate_lines(docs).count() > 0


def test_lines_are_sketched_once_a_task():
    line, other = "a line that stands in many texts", "another line, in one text only"
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([i]), pa.array([t])], ["doc_id", "tie", "text"]) for i, t in enumerate([line, f"{line}\n{other}", line])]
    out = [x for b in line_dedup._sketch(20, 5, 60, 5)(iter(batches)) for x in b.to_pylist()]
    assert [x["bands"] is not None for x in out] == [x["s0"] is not None for x in out] == [True, False, True, False]
    assert len({(x["cid"], x["check"]) for x in out}) == 2


def test_sampled_lines_have_a_column():
    # the sample for hot bands is read without the other lines' bands
    text = "\n".join(f"line number {i} of quite some" for i in range(400))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], ["doc_id", "tie", "text"])
    out = [x for b in line_dedup._sketch(20, 5, 60, 5)(iter([batch])) for x in b.to_pylist()]
    some = [x for x in out if x["sampled"] is not None]
    assert 0 < len(some) < 40 and all(x["sampled"] == x["bands"] for x in some)
    assert {x["cid"] for x in some} == {x["cid"] for x in out if _near.sampled(np.array([x["cid"]]))[0]}


def test_dealt_buckets():
    # keys that are dealt in many a row give the pairs of small buckets, and the rows of large and hot ones
    rnd = np.random.default_rng(5)
    keys = rnd.choice(rnd.integers(-(2**63), 2**63, 60), (400, 3), p=np.arange(1, 61) / 1830)
    hot = np.sort(keys[:3, 0])
    hot = hot[np.concatenate([[True], np.diff(hot) != 0])]
    cids = rnd.integers(-(2**63), 2**63, 400)
    cids[300:350], keys[300:350] = cids[:50], keys[:50]  # classes of several tasks
    rows = [pa.RecordBatch.from_arrays([pa.array(cids[i : i + 50]), pa.array([k.tobytes() for k in keys[i : i + 50]], pa.binary())], ["cid", "keys"]) for i in range(0, 400, 50)]
    dealt = [pa.Table.from_batches(list(_near._deal(3, 4, hot)(iter(x)))) for x in (rows[:4], rows[4:])]
    dealt = pa.concat_tables(dealt)
    pairs, large = set(), set()
    for part in sorted(set(dealt["part"].to_pylist())):
        found = _near._pair_up(hot)(dealt.filter(pc.equal(dealt["part"], part))).to_pylist()
        pairs |= {(x["a"], x["b"]) for x in found if x["b"] is not None}
        here = [(x["band"], x["a"], x["hot"]) for x in found if x["b"] is None]
        assert len(here) == len(set(here)) and not large & set(here)
        large |= set(here)
    members = {}
    for c, own in zip(cids.tolist(), keys.tolist()):
        for k in own:
            members.setdefault(k, set()).add(c)
    small = {k: m for k, m in members.items() if k not in hot and len(m) <= _near.SMALL}
    assert small and pairs == {(a, b) for m in small.values() for a in m for b in m if a < b}
    assert len(large) and large == {(k, c, k in hot) for k, m in members.items() if k not in small for c in m}
    empty = _near._pair_up(hot)(dealt.slice(0, 0))
    assert empty.num_rows == 0


def test_listed_lines_of_another_text():
    # a place tells texts by 31 bits, so a list may come with another text's lines
    cid = int(line_dedup._candidate_lines(np.frombuffer(b"a line", np.uint8), np.array([0, 6]), 0)[4][0])
    listed = [[{"cid": cid, "check": 1, "position": 1}, {"cid": cid, "check": 1, "position": 0}, {"cid": cid, "check": 1, "position": 9}], []]
    kind = pa.list_(pa.struct([("cid", pa.int64()), ("check", pa.int64()), ("position", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(["other\n a line \nlast", ""]), pa.array(listed, kind)], ["text", "listed"])
    assert [x for out in line_dedup._listed_lines(iter([batch])) for x in out.to_pylist()] == [{"cid": cid, "check": 1, "text": "a line"}]


def test_line_dedup_one_edit(spark, tmp_path):
    rnd = random.Random(7)
    pairs = []
    for n in range(50, 91, 5):
        a = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n - 2)).join("xy")
        at = rnd.randrange(15, n - 15)
        pairs.append((a, a[:at] + "#" + a[at + 1 :]))
    apart = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(68)).join("xy") for _ in range(5)]
    rows = [(1, "\n".join([a for a, _ in pairs] + apart)), (2, "\n".join(b for _, b in pairs))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: 0, 2: len(pairs)}
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup_stage(spark, df, str(tmp_path)).collect()} == {1: rows[0][1], 2: ""}


def test_line_dedup_short(spark):
    rows = [(1, "Read more\n\nHello\n é \na line that is long enough to be compared"), (2, "Hello\nRead more\n\nRead mole\né"), (3, " Read more \n}")]
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out == {1: rows[0][1], 2: "\nRead mole", 3: "}"}


def test_line_dedup_short_similar(spark, tmp_path):
    # short lines are compared as long ones are: 5 of 6 shingles in common, one shingle only, 14 of 15; 4 of 6, 1 of 3 and single ones stay
    rows = [(1, "Read more\n------\nAll rights reserved\nPage 17\nabc\nContact"), (2, "Read more!\n------------\nAll rights reserve\nPage 18\nabd\nContacts us")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_dedup_stage(spark, df, str(tmp_path)).collect()}
    left = "Page 18\nabd\nContacts us"
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: (left, len(left))}


def _near_brute(rows, width, percent):
    sets = {}
    for k, (_, t, *_) in enumerate(rows):
        w = _words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    return sets, _components(sets, percent)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_dedup(docs, none, rows, width, percent):
    sets, comp = _near_brute(rows, width, percent)
    low = {}
    for k, c in comp.items():
        if sets[k] and rows[k][0] is not None:
            low[c] = min(low.get(c, 10**9), rows[k][0])
    want = Counter()
    for k, (i, *_) in enumerate(rows):
        component = low.get(comp[k]) if sets[k] else i
        want[i, len(sets[k]), component, i == component] += 1
    got = near_dedup.near_components(docs, width=width, percent=percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == want
    kept = near_dedup.keep_one(docs, width=width, percent=percent)
    assert kept.columns == docs.columns
    groups = Counter(comp[k] for k in comp if sets[k])
    assert kept.where("text IS NOT NULL AND text RLIKE '[^\\\\s]'").count() == len(groups)
    assert near_dedup.near_components(none).count() == 0 and near_dedup.keep_one(none).count() == 0


def test_large_buckets_lose_no_link(spark):
    """A group of many different texts around the limit: blocks must find the same components as all pairs."""
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randint(1, 9)):
            w[rnd.randrange(len(w))] = f"v{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    _, comp = _near_brute(rows, 3, 85)
    got = near_dedup.near_components(spark.createDataFrame(rows, "doc_id bigint, text string"), width=3, percent=85)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == comp


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(3000, 24))
    v[:40] = v[0]
    v[40] = v[60] = 0
    rows = [(i, [float(x) for x in r], i % 5) for i, r in enumerate(v)]
    rows += [(20000, None, 1), (20020, [None] * 24, 1), (20040, [float("nan")] * 24, 1), (20060, [1.0], 1), (None, [1.0] * 24, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = ann.search(df).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r["query_id"]].append(r)
    asked = [i for i in range(0, 3000, 20) if v[i].any()]
    assert sorted(by) == asked
    hit = 0
    for q in asked:
        s = (v * v[q]).sum(axis=1)
        s[[q, *np.flatnonzero(~v.any(axis=1))]] = -np.inf
        best = np.lexsort((np.arange(len(v)), -s))[:20]
        assert [r["rank"] for r in by[q]] == list(range(1, 21)) and all(abs(r["score"] - s[r["vec_id"]]) < 1e-9 for r in by[q])
        assert by[q] == sorted(by[q], key=lambda r: (-r["score"], r["vec_id"]))
        hit += len(set(best.tolist()) & {r["vec_id"] for r in by[q]})
    assert hit >= 0.9 * 20 * len(asked)
    few = ann.search(df.where("vec_id IN (0, 100, 200)")).collect()
    assert Counter(r["query_id"] for r in few) == {0: 2, 100: 2, 200: 2}
    assert ann.search(df.limit(0)).count() == 0


def test_nearest_neighbours_extreme(spark):
    rng = np.random.default_rng(1)
    for size in (1e-170, 1e200, 1e-310):
        rows = [(i, [float(x) for x in r * size], 0) for i, r in enumerate(rng.normal(size=(60, 8)))] + [(100, [1.0, 2.0], 0), (101, [3.0, 1.0], 0)]
        got = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
        assert Counter(r["query_id"] for r in got) == {0: 20, 20: 20, 40: 20, 100: 1}


def test_multi_index_is_exact():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 2**63, (3000, 4), dtype=np.uint64)
    near = codes[:50].copy()
    for k in range(50):
        for b in rng.choice(256, rng.integers(0, 60), replace=False):
            near[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    index = ann.MultiIndex(codes)
    for radius in (0, 3, 20, 40, 100, 115):
        for c in near:
            rows, _ = index.within(c, radius)
            assert rows.tolist() == np.flatnonzero(np.bitwise_count(codes ^ c).sum(axis=1) <= radius).tolist()


def test_toxicity(spark, docs, none):
    rnd = random.Random(4)
    text = lambda: " ".join(rnd.choice(WORDS) + rnd.choice("abcdefgh") + rnd.choice("abcdefgh") for _ in range(60))
    bad = ["idiot", "moron", "scum"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        t = text().split()
        if toxic:
            t[rnd.randrange(60)] = rnd.choice(bad)
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(toxic)))
    disguised = ["you 1d10t go", "what a m.o.r.o.n he", "s c u m bag", "idiooooot now", "$cum here"]
    clean = ["a plain word", "in the 1990s", "thnd*** iner***", "", None]
    rows += [(2000 + i, t) for i, t in enumerate(disguised)] + [(3000 + i, t) for i, t in enumerate(clean)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels + [(1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(d, lab, with_text=True).collect()}
    flagged = {k for k, r in got.items() if r["score"] >= toxicity.CUT}
    out = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((i in flagged) == (i % 6 == 0) for i in out)
    assert {2000, 2001, 2002, 2003, 2004} <= flagged and not flagged & set(range(3000, 3005))
    assert got[2000]["restored"] == "you idiot go" and all(0 <= r["score"] <= 1 for r in got.values())
    swapped = lab.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(d, swapped).collect()} == {k: r["score"] for k, r in got.items()}
    assert toxicity.score_toxicity(docs, lab.limit(0)).count() == docs.count() and toxicity.score_toxicity(none, lab).count() == 0


def _scorer(words, share=0.9):
    rnd = random.Random(1)
    text = " ".join(rnd.choice(WORDS) for _ in range(4000)).encode()
    counts = np.zeros(toxicity.CLASSES**3, np.int64)
    for batch in toxicity._trigrams([pa.RecordBatch.from_pydict({"text": [text.decode()]})]):
        counts[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    lexicon = {toxicity.entry_hash(w): share for w in words}
    return toxicity.Scorer(counts, lexicon, set(lexicon), 0.1, {w: share for w in words})


def test_toxicity_windows():
    scorer = _scorer(["idiot", "abominations", "scum"])

    def score(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return scorer.score(data, np.array([0, len(data)]))[0]

    bad = ["y o u i d i o t", " ".join("nowwewillseewhatyouarelikeandthatisanidiotforsure"), " ".join("whatabominationsare"), "idi" + "o" * 60 + "t"]
    bad += ["this_is_what_we_all_call_" + "x_" * 20 + "1d10t_here", "I a m s c u m", "x y z w s c u m", "q r t y u s c u m ok", "he is s c u m bag", "you_1d10t", "such sc um here", "ѕсum", "an idiоt", "sсսm"]
    for text in bad:
        assert score(text) >= toxicity.CUT, text
    for text in ("y o u a r e k i n d", "this_is_what_we_all_call_" + "x_" * 20 + "nice_here", "o" * 80, "река stone", "house and garden"):
        assert score(text) < toxicity.CUT, text


def test_toxicity_depends_on_the_text_alone():
    """The same score alone, in a slice, and in another order; also where stand-ins touch the ends of texts."""
    scorer = _scorer(["idiot", "scum"])
    texts = ["5cum there", "5cum there", "he is idio7", "7 days", "1diot x", "on page 1", "a", "5", "idiot5", "", "5cum", "x idio7", "s c u m", "u m", "s c", "days", "iii", "diot", "í", "idiot\u0301"]
    rnd = random.Random(6)
    alone = {}
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        alone[t] = scorer.score(data, np.array([0, len(data)]))[0]
    assert all(alone[t] >= toxicity.CUT for t in ("5cum there", "he is idio7", "1diot x", "5cum"))
    for _ in range(30):
        some = [rnd.choice(texts) for _ in range(rnd.randint(1, 12))]
        data = [t.encode() for t in some]
        got = scorer.score(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        assert list(got) == [alone[t] for t in some], some


def test_lattice_against_all_readings():
    """Both searches against every path through the lattice."""
    decoder = _scorer(["stone", "light", "ston", "gar"]).decoder
    rnd = random.Random(5)
    for _ in range(300):
        token = "".join(rnd.choice("st0n3gar1l!*.7") for _ in range(rnd.randint(4, 7)))
        paths = [("", 0.0, (toxicity.EDGE, toxicity.EDGE))]
        least = [0.0]
        for choices in decoder.lattice(token):
            new = []
            for w, c, (p, q) in paths:
                for letter, cost in choices:
                    if not letter:
                        new.append((w, c + cost, (p, q)))
                        continue
                    k = decoder._class(letter)
                    new.append((w + letter, c + cost + decoder.cost[p][q][k], (q, k)))
                    if w[-1:] == letter:
                        new.append((w, c + cost + toxicity.REPEAT_COST, (p, q)))
            paths = new
            least.append(min(c for _, c, _ in paths))
        word, best = decoder.read(token)
        assert np.allclose(best, least)
        end = {}
        for w, c, (p, q) in paths:
            end[w] = min(end.get(w, 1e9), c + decoder.cost[p][q][toxicity.EDGE])
        assert end[word] <= min(end.values()) + 1e-9
        whole = {w: c for w, c in ((w, c) for i, w, c in decoder.spelled(token) if i == len(token))}
        want = {}
        for w, c, _ in paths:
            if w in decoder.entries:
                want[w] = min(want.get(w, 1e9), c)
        assert whole.keys() == want.keys() and all(abs(whole[w] - want[w]) < 1e-9 for w in want)


def test_quality(spark, docs, none, rows):
    got = quality.judge(docs).collect()
    want = Counter()
    for i, t, *_ in rows:
        w = _words(t)
        three = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if _words(x)]
        want[i, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    assert all(not r["kept"] for r in got if r["base_failed"])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    # a host that mostly fails is rejected as a whole
    long = " ".join(f"w{k}" for k in range(60))
    hosts = [(i, long if i % 10 == 0 else "short", "a", "bad", 1) for i in range(200)] + [(1000 + i, long if i % 10 else "short", "a", f"h{i % 4}", 1) for i in range(400)]
    judged = quality.judge(spark.createDataFrame(hosts, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()
    assert not any(r["kept"] for r in judged if r["host"] == "bad") and all(r["kept"] for r in judged if r["host"] != "bad" and not r["base_failed"])
    assert quality.judge(none).count() == 0 and quality.keep_good(none).count() == 0


def test_html():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header><p>Site header that is long enough to look like the text of an article but isn't one.</p></header>"
        "<nav><ul><li><a href=x>Home</a></ul></nav><article><h1>Title &amp; more</h1><p>The first  paragraph of the story is\n here<br>and it goes on for some time with the words of a story.</p>"
        "<p>Short.</p><div class='ad-slot'>Buy the thing that is on sale in the shop by the river today and tomorrow.</div><p>x &lt; y &#233;&nbsp;z | no stop words here qwe asd zxc rty fgh vbn uio jkl</p>"
        "<script>var a='<p>no</p>';</script><section id=comments><p>I think this is the best thing that was ever written by anyone on the net.</p></section></article>"
        "<aside>See also the other stories of the day.</aside><form><p>Mail us and we will write to you about the news of the week.</p></form><footer>&copy; us</footer></body>"
    )
    assert html_text.main_text(page).split("\n\n") == [
        "Title & more", "The first paragraph of the story is here and it goes on for some time with the words of a story.", "Short.", "x < y é z | no stop words here qwe asd zxc rty fgh vbn uio jkl",
    ]
    plain = "<body><div class=menu><a href=x>A</a></div><h2>A title</h2><p>The cat sat on the mat and it was a very good day for the cat and for all of the others.</p><p>Yes.</p><div><a href=y>more links</a> <a href=z>and more</a></div></body>"
    assert html_text.main_text(plain).split("\n\n")[0] == "A title" and "more links" not in html_text.main_text(plain)
    for odd in ("", "<", "<p", "<!-- x", "<script>", "text only", "</p></p>", "<a href='x>y"):
        html_text.main_text(odd)


def test_html_outside_article():
    main = "The story of the town is told here and it is the main text of the page, with all of the words that belong to it."
    page = f"<body><div><p>{main}</p><p>Then.</p><p>Later.</p></div><div>{'qwe asd zxc rty ' * 8}</div><article><h2>Teaser</h2></article></body>"
    assert main in html_text.main_text(page) and "Then." in html_text.main_text(page) and "qwe" not in html_text.main_text(page)


LONG = "The story of the town is told here and it is the main text of the page, with all of the words that belong to it."


@pytest.mark.parametrize(
    "page,want",
    [
        (f'<div class="wrap has-sidebar"><article><p>{LONG}</p></article></div>', [LONG]),
        (f'<div class="post no-comments"><p>{LONG}</p></div>', [LONG]),
        (f'<div class="layout-sidebar"><article><p>{LONG}</p></article><div class="sidebar"><p>{LONG}</p></div></div>', [LONG]),
        (f"<article><p>© {LONG}</p><p>{LONG}</p><p>© us</p></article>", ["© " + LONG, LONG]),
        (f"<article><svg><style>x</style><text>Axis label</text></svg><template><script>x</script><p>Hidden</p></template><p>{LONG}</p></article>", [LONG]),
        (f"<article><header><h1>Title</h1><p>By us</p></header><p>{LONG}</p><aside><h3>See also</h3></aside></article>", ["Title", LONG]),
        (f"<form><article><p>{LONG}</p></article><select><option>one<option>two</select></form>", [LONG]),
        (f'<article><p>{LONG}</p><div class="related"><article><p>{LONG}</p></article></div><p>qwe asd zxc rty {"fgh vbn " * 10}</p></article>', [LONG, f'qwe asd zxc rty {"fgh vbn " * 10}'.strip()]),
        (f'<article><p class="ad">Buy this<div>{LONG}</div></article>', [LONG]),
    ],
)
def test_html_structure(page, want):
    assert html_text.main_text(f"<html><body>{page}</body></html>").split("\n\n") == want


def test_html_is_linear():
    for page in ("<div>" * 40000 + "x", "<a " * 40000, "</p>" * 40000 + "<i>" * 20000, "<svg>" * 20000 + "x", "<div>" * 20000 + "</b>" * 20000):
        at = time.time()
        html_text.main_text(page)
        assert time.time() - at < 2


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<article><p>Hé</p></article>", "x")], "page_id bigint, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(df).collect()}
    assert got == {1: ("", 0), 2: ("", 0), None: ("Hé", 2)} and html_text.extract(df.limit(0)).count() == 0
    for r in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall():
        body = re.search(r"<article>(.*?)</article>", r[0], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert html_text.main_text(r[0]) == "\n\n".join(x for x in parts if x)


def test_packing(docs, none, rows):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    want = Counter()
    for i, text, *_ in rows:
        want[i, len(t.encode(text or "", add_special_tokens=False).ids) + 1] += 1
    assert {k: sum(r["length"] for r in v) for k, v in by_doc.items()} == {k: k[1] * n for k, n in want.items()}
    single = {i: text for i, text, *_ in rows if sum(1 for x in rows if x[0] == i) == 1}
    for (i, n), pieces in by_doc.items():
        if i in single:
            ids, at = np.array(t.encode(single[i] or "", add_special_tokens=False).ids + [1], "<u4"), 0
            for r in sorted(pieces, key=lambda r: r["start"]):
                assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
                at += r["length"]
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(none, path).count() == 0


def test_hilbert_neighbours():
    grid = np.array([(a, b, c) for a in range(4) for b in range(4) for c in range(4)])
    key = packing.hilbert_keys(grid, 2)
    walk = grid[np.argsort(key)]
    assert sorted(key.tolist()) == list(range(64)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_super_minhash_estimates():
    rng = np.random.default_rng(0)
    for n, inter in ((300, 240), (10, 8)):
        found = []
        for _ in range(150):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = np.concatenate([a[:inter], rng.integers(0, 2**63, n - inter).astype(np.uint64)])
            s = _text.super_minhash(np.concatenate([a, b]), np.array([0, n, 2 * n]), 64)
            found.append((s[0] == s[1]).mean())
        assert abs(np.mean(found) - inter / (2 * n - inter)) < 0.02


def test_pipeline_stages(spark, docs, none, rows):
    now = docs.select(corpus_pipeline.COLUMNS)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "minhash near-dedup", "mixing sources", "packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = materialise(stage(spark, now, SF), "stage")
        if k < 4:
            assert now.columns == corpus_pipeline.COLUMNS
    assert now.count() > 0
    empty = none.select(corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


CLASHES = "rejected host row base_failed _hash _words _i _taken size taken id n tie its_id _near_hash _near_id kept_id _line_hash _line_gone _line_removed removed gone chars first _".split()


def test_clashing_columns(spark, rows):
    """All operators that return whole rows keep columns of any names."""
    full = [(i, t, lang, s, len(t or ""), *[f"{c}{k}" for c in CLASHES]) for k, (i, t, lang, s) in enumerate(rows)]
    clash = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHES))
    for operator in (quality.keep_good, line_dedup.dedup_lines, near_dedup.keep_one, mixing.mixed):
        out = operator(clash)
        assert out.columns == clash.columns
        for r in out.collect():
            number = {r[c][len(c) :] for c in CLASHES}
            assert len(number) == 1 and rows[int(number.pop())][0] == r["doc_id"]


def test_registry():
    names = registry.queries()
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)} | {"pipeline"}
    assert set(registry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op2_mixing_sources", "op7_quality_rules"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df, own = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    a = sorted(tuple(fix(r[c]) for c in sorted(df.columns)) for r in df.collect())
    b = sorted(tuple(fix(r[own.columns.index(c)]) for c in sorted(own.columns)) for r in own.fetchall())
    assert a == b
