"""Decontamination, collocations and conversation repair against brute force, on small and on awkward tables."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from darkroom.llm import collocations, conversations, decontam, registry

SF = "/root/testdata/sf0.001"
#: Columns whose names the operators use inside.
EXTRA = "uid int, words string, window string, h string, n string, part string, block string, `a b` string, ck string, key string, copies string, kind string"
CLASH = [1, "w", "i", "h", "n", "p", "b", "ab", "c", "k", "x", "y"]


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def _collected(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# --- decontamination


def _leak_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t))


def _leaks(docs, bench, size):
    windows = defaultdict(set)
    for item, text in bench:
        w = _leak_words(text)
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            windows[tuple(w[i : i + size])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = _leak_words(text)
        hit, items = set(), set()
        for win, own in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    items |= own
        spans = [(g[0], g[-1] + 1) for g in (list(x for _, x in g) for _, g in itertools.groupby(enumerate(sorted(hit)), lambda p: p[1] - p[0]))]
        # ranges that touch are one span
        out.append((doc, len(w), spans, sorted(items)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,size,vocabulary", [(2, 4, 8), (3, 10, 2), (5, 1, 30)])
def test_decontamination(spark, seed, size, vocabulary):
    rnd = random.Random(seed)
    words = ["Éa", "éa", "Ab", "ab", "x1", "日本", "o", "the", "I", "z9"] + [f"w{i}" for i in range(40)]
    line = lambda k: "".join(rnd.choice(words[:vocabulary] if rnd.random() < 0.9 else words) + rnd.choice([" ", ", ", "\n", "—" if vocabulary > 6 else "-", "'"]) for _ in range(k))
    bench = [(i % 25, line(rnd.randint(0, 2 * size + 3))) for i in range(30)] + [(None, line(size)), (7, None), (8, ""), (9, "..."), (10, "ab")]
    docs = [(i, line(rnd.randint(0, 60))) for i in range(50)] + [(50, None), (51, ""), (3, "ab ab"), (3, "ab ab"), (None, line(30)), (52, line(4000))]
    docs += [(53 + i, bench[3][1]) for i in range(30)]
    d = spark.createDataFrame([(*x, *CLASH) for x in docs], "doc_id bigint, text string, " + EXTRA).repartition(3)
    b = spark.createDataFrame([(*x, *CLASH) for x in bench], "item_id bigint, text string, " + EXTRA)
    found = decontam.contaminated_spans(d, b, size=size)
    got = sorted(((r["doc_id"], r["n_words"], [tuple(s) for s in r["spans"]], list(r["items"])) for r in found.collect()), key=str)
    assert got == _leaks(docs, bench, size)


def test_decontamination_of_nothing(spark):
    docs, none = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert _collected(decontam.contaminated_spans(docs, none), ["doc_id", "n_words"]) == [(1, 2), (2, 0)]
    assert decontam.contaminated_spans(docs.limit(0), none).count() == 0
    assert decontam.contaminated_spans(docs.limit(0), spark.createDataFrame([(1, "a b")], none.schema)).count() == 0
    assert [r["spans"] for r in decontam.contaminated_spans(docs, spark.createDataFrame([(1, "q r")], none.schema)).collect()] == [[], []]


def test_decontamination_shuffled(spark, monkeypatch):
    """Beyond the size that is broadcast, shingles are joined by a shuffle."""
    monkeypatch.setattr(decontam, "BROADCAST_SHINGLES", 0)
    docs, bench = [(1, "a b c d e f g"), (2, "x y")], [(1, "b c d e"), (2, "x y")]
    found = decontam.contaminated_spans(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string"))
    assert _collected(found, ["doc_id", "items"]) == [(1, ["1"]), (2, ["2"])]


# --- collocations


def _phrases(docs, least, longest, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, own in f.items():
        good = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        inside = {q[i : i + m] for q, a in good.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if good[q[i : i + m]] <= a}
        rows = []
        for p, a in good.items():
            if p in inside:
                continue
            cuts = [(1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out, key=str)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("seed,least,longest,top", [(1, 3, 5, 2000), (3, 2, 3, 7)])
def test_collocations(spark, seed, least, longest, top):
    rnd = random.Random(seed)
    words = ["the", "The", "é", "É", "日本", "b-c", "d e", "f\x00"] + [f"w{i}" for i in range(20)]
    text = lambda k: "".join(rnd.choice(words[: rnd.choice([3, 8, 28])]) + rnd.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b", "!? "]) for _ in range(k))
    docs = [(rnd.choice(["en", "de", None, "und"]), text(rnd.randint(0, 80))) for _ in range(60)]
    docs += [("en", None), (None, ""), ("xx", " . , "), ("en", "same words here again"), ("en", "same words here again"), ("en", "the " * 3000), ("fr", "a" * 100_000 + " b")]
    df = spark.createDataFrame([(*x, *CLASH) for x in docs], "lang string, text string, " + EXTRA).repartition(5)
    got = _collected(collocations.collocations(df, min_count=least, longest=longest, top=top).select(COLUMNS), COLUMNS)
    assert got == _phrases(docs, least, longest, top)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_blocks_lose_no_phrase(monkeypatch):
    """Blocks end between pieces, whatever their size; a piece longer than a block stays whole."""
    texts = ["a b c a b c. a b", "c a b", "a " * 50 + ". b a", "b"] * 5
    batch = pa.record_batch({"lang": pa.array(["en", "de"] * 10), "text": pa.array(texts), "part": pa.array([3] * 20, pa.int32())})
    counts = []
    for size in (1 << 21, 7, 1):
        monkeypatch.setattr(collocations, "BLOCK_WORDS", size)
        pairs, blocks = Counter(), defaultdict(list)
        for b in collocations._word_lists(iter([batch])):
            for r in b.to_pylist():
                if r["word"] is not None:
                    blocks[r["lang"], r["tag"] >> collocations.PLACE_BITS].append(r)
        for (lang, _), own in blocks.items():
            places = {int(p): r["word"] for r in own for p in collocations._decoded(np.array([r["tag"] & collocations.END]), np.array([r["n"]]), r["rest"])}
            pairs.update((lang, places[p], places[p + 1]) for p in places if p + 1 in places)
        counts.append((pairs, len(blocks)))
    assert counts[0][0] == counts[1][0] == counts[2][0] and counts[0][1] == 2 < counts[1][1] < counts[2][1]


def test_lists_round_trip():
    rng = np.random.default_rng(1)
    lists = [np.unique(rng.integers(0, high, n)) for n, high in [(1, 5), (300, 400), (40, 1 << 28), (1, 1), (7, 1 << 14), (2, 200)]] + [np.array([0, (1 << 28) + 5])]
    counts = np.array([len(x) for x in lists])
    coded = collocations._coded(np.concatenate(lists), counts).to_pylist()
    first = np.array([x[0] for x in lists])
    assert (collocations._tags(9, first) & collocations.END == first).all()
    assert (collocations._decoded(first, counts, b"".join(coded)) == np.concatenate(lists)).all()


def test_exact_scores(spark):
    """Products beyond 64 bits are exact."""
    row = [(3_000_000_007, 9_000_000_000_037, [4_000_000_009], [5_000_000_021])]
    df = spark.createDataFrame(row, "a bigint, n bigint, heads array<bigint>, tails array<bigint>")
    got = df.select(collocations._scored(df["a"], df["n"], df["heads"], df["tails"]).alias("s")).first()["s"]
    assert got["score"] == 1000 * row[0][0] * row[0][1] // (row[0][2][0] * row[0][3][0])


# --- conversations


def _edits(rows, most):
    """All edit sequences that give role initials of the form: (cost, audit, repaired rows)."""
    best = None

    def go(i, cost, said, out):
        nonlocal best
        if cost > most or len(out) > len(rows) + 4:
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for r, _ in out)):
            best = min(best or (cost, said, out), (cost, said, out))
        for role in ("user", "assistant"):
            go(i, cost + 5, said + "I", out + [(role, "")])
        if i < len(rows):
            role, text, gone, late = rows[i]
            go(i + 1, cost + 2, said + "D", out)
            if not gone:
                go(i + 1, cost + 5 * late, said + "K", out + [(role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, cost + 1 + 5 * late, said + "R", out + [(new, text)])

    go(0, 0, "", [])
    return best


def _judged(rows):
    """Rows of one conversation, in order, as (role, text, gone, truncated), and its counts."""
    seen, out = set(), []
    blank = duplicate = truncated = 0
    for role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        if not solid:
            blank += 1
        elif (role, text) in seen:
            duplicate += 1
        elif solid[-1] not in ".!?":
            truncated += 1
        out.append((role, text, not solid or (role, text) in seen, bool(solid) and solid[-1] not in ".!?"))
        seen.add((role, text))
    pairs = [a[:1] + b[:1] for (a, _), (b, _) in zip(rows, rows[1:])]
    return out, [blank, duplicate, truncated, sum(p not in ("su", "ua", "au") for p in pairs)]


def test_automaton():
    """Costs and audits of all short conversations equal those of all edit sequences."""
    roles, automaton = ["system", "user", "assistant", "tool"], conversations.Automaton()
    codes = [c for c in range(8)] + [8]
    for n in range(4):
        for combination in itertools.product(codes, repeat=n):
            rows = [(roles[c & 3], "t", c == 8, bool(c & 4)) for c in combination]
            cost, audit, _ = _edits(rows, 2 * n)
            assert automaton.repair(bytes(combination), {}) == (cost, audit)
    rnd = random.Random(5)
    for _ in range(40):
        combination = [rnd.choice([0, 1, 2, 3, 1, 2, 5, 6]) for _ in range(5)]
        cost, audit, _ = _edits([(roles[c & 3], "t", False, bool(c & 4)) for c in combination], 10)
        assert automaton.repair(bytes(combination), {}) == (cost, audit)
    assert len(automaton.states) < 100


def _long(codes):
    """Cheapest cost and least audit by plain dynamic programming over (cost, audit)."""
    step = {0: 2, 1: 2, 2: 3, 3: 2}
    now = {0: (0, "")}
    for c in [*codes, None]:
        for _ in range(3):
            for q, (cost, said) in list(now.items()):
                now[step[q]] = min(now.get(step[q], (10**9, "")), (cost + 5, said + "I"))
        if c is None:
            return min(now[q] for q in (0, 3) if q in now)
        new = {}
        for q, (cost, said) in now.items():
            ways = [(q, 2, "D")]
            if not c & 8:
                late = 5 if c & 4 else 0
                ways.append((step[q], 1 + late, "R"))
                if (c & 3 == 0 and q == 0) or (c & 3 == 1 and step[q] == 2) or (c & 3 == 2 and step[q] == 3):
                    ways.append((1 if c & 3 == 0 else step[q], late, "K"))
            for z, more, letter in ways:
                new[z] = min(new.get(z, (10**9, "")), (cost + more, said + letter))
        now = new


def test_automaton_on_long_conversations():
    rnd, automaton = random.Random(9), conversations.Automaton()
    for weights in ([1] * 9, [0, 9, 9, 0, 0, 2, 2, 0, 1], [5, 1, 1, 1, 5, 0, 0, 0, 3]):
        for n in (50, 400):
            codes = bytes(rnd.choices(range(9), weights, k=n))
            assert automaton.repair(codes, {}) == _long(codes)
            copied = {i: rnd.randint(1, 3) for i in range(0, n, 7)}
            plain = b"".join(bytes([c]) + bytes([8]) * copied.get(i, 0) for i, c in enumerate(codes))
            assert automaton.repair(codes, copied) == _long(plain)


def _repaired(rows):
    """Expected results by conversation, of rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text, turn))
    out = []
    for c, all_rows in own.items():
        all_rows.sort()
        turns = [r[5] for r in all_rows if r[5] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        judged, counts = _judged([r[3:5] for r in all_rows])
        cost, audit, kept = _edits(judged, 2 * len(judged))
        out.append((c, gaps, *counts, cost, audit, kept))
    return out


CONV = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def test_conversation_repair(spark):
    rnd = random.Random(3)
    texts = ["Yes.", "No!", "Well", " ", "", "Why? \n", "é…", None, "a.\t\nb"]
    rows = [(c, rnd.choice([None, *range(5)]), rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", None, "u2", "User", "", "S"]), rnd.choice(texts)) for c in [*range(40), None] for _ in range(rnd.randint(1, 5))]
    rows = [r if r[2] != "" else (r[0], r[1], "-", r[3]) for r in rows] + [(900, 1, "user", "Hi.")] * 4
    df = spark.createDataFrame([(*r, *CLASH) for r in rows], "conv_id bigint, turn bigint, role string, text string, " + EXTRA).repartition(3)
    want = _repaired(rows)
    repair = conversations.Repair(df)
    assert _collected(repair.audits(), CONV) == sorted((w[:-1] for w in want), key=str)
    got = defaultdict(list)
    for r in sorted(repair.rows().collect(), key=lambda r: (str(r["conv_id"]), r["n"])):
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert got == {w[0]: w[-1] for w in want if w[-1]}
    digests = {r["ck"]: r["repaired_sha256"] for r in repair.digests().collect()}
    assert digests == {"n" if w[0] is None else f"v{w[0]}": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in w[-1]).encode()).hexdigest() for w in want if w[-1]}
    nothing = conversations.Repair(df.limit(0))
    assert nothing.audits().count() == nothing.rows().count() == 0


def test_one_huge_conversation(spark):
    """A conversation over all ranges, with many equal rows: its bytes meet in their order."""
    rnd = random.Random(4)
    rows = [("c", i, rnd.choice(["user", "assistant"]), f"Line {i}" + rnd.choice([".", ".", ""])) for i in range(3000)] + [("c", 17, "user", "Copied.")] * 500 + [("d", 1, "user", "Hello."), ("d", 2, "assistant", "Yes.")]
    repair = conversations.Repair(spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string"))
    got = {r["conv_id"]: r for r in repair.audits().collect()}
    ordered = sorted(((r[1], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest(), r[2], r[3]) for r in rows if r[0] == "c"))
    judged, counts = _judged([r[2:] for r in ordered])
    codes = bytes((1 if r == "user" else 2) + 4 * late + 8 * gone for r, _, gone, late in judged)
    assert (got["c"]["cost"], got["c"]["audit"]) == _long(codes) and [got["c"][k] for k in CONV[2:6]] == counts
    assert got["d"]["audit"] == "KK"


def test_pieces(monkeypatch):
    """Pieces end with a conversation, a range or at their greatest length."""
    monkeypatch.setattr(conversations, "PIECE", 4)
    batch = lambda ck, n: pa.record_batch({"ck": pa.array([ck] * n), "copies": pa.array(list(range(1, n + 1)), pa.int64()), "code": pa.array([1] * n, pa.int32()), "part": pa.array([2] * n, pa.int32())})
    out = [r for b in conversations._pieces(iter([batch("a", 3), batch("a", 3), batch("a", 1), batch("b", 1)])) for r in b.to_pylist()]
    assert [(r["ck"], r["part"], r["no"], len(r["codes"]), r["at"], r["more"]) for r in out] == [("a", 2, 0, 6, [1, 2, 4, 5], [1, 2, 1, 2]), ("a", 2, 1, 1, [], []), ("b", 2, 2, 1, [], [])]


@pytest.mark.parametrize("name", ["op11_benchmark_decontamination", "op12_phrase_collocations", "op13_conversation_repair"])
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df, own = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    a = sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    b = sorted(tuple(r[own.columns.index(c)] for c in sorted(own.columns)) for r in own.fetchall())
    assert a == b and sorted(df.columns) == sorted(own.columns)
