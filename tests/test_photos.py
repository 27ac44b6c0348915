"""Kernels, verdicts, components, cache, moves and an end-to-end scan."""

import itertools
import math
import os
import random
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from darkroom import pipeline
from darkroom.functions import pixels
from darkroom.operators import cache, components, moves, report, similarity
from darkroom.operators.components import connected_components
from darkroom.operators.similarity import similarity_pairs
from darkroom.params import RunOptions, album_title, resolve_signals
from darkroom.plans import catalogue
from darkroom.runtime import materialise
from darkroom.signals import SIGNALS, Thresholds, with_verdict

SF = "/root/testdata/sf0.001"


def test_kernels_closed_form():
    flat = pixels.classical(np.full((64, 64), 128.0))
    assert (flat["sharpness"], flat["contrast"], flat["noise"], flat["brightness"]) == (0, 0, 0, 128)
    ramp = pixels.classical(np.tile(np.arange(64.0), (64, 1)))
    assert ramp["sharpness"] == 0 and ramp["noise"] == 0
    edge = pixels.classical(np.repeat([[5.0, 6.0]], 64, axis=0))
    assert edge["black_frac"] == 0.5 and math.isnan(edge["sharpness"]) and edge["noise"] == 0
    assert pixels.classical(np.repeat([[249.0, 250.0]], 64, axis=0))["white_frac"] == 0.5
    assert pixels.shrink(np.zeros((2000, 1000))).shape == (1024, 512) and pixels.centre_crop(np.zeros((2000, 1000))).shape == (768, 768)


def test_column_twin_equals_kernel(spark):
    g = np.random.default_rng(0).integers(0, 256, (9, 7)).astype(float)
    row = spark.createDataFrame([(g.ravel().tolist(),)], "px array<double>").select(
        pixels.sharpness("px", "7", "9").alias("s"), pixels.noise("px", "7", "9").alias("n"), pixels.contrast().alias("c"), pixels.brightness().alias("b")
    ).first()
    k = pixels.classical(g)
    assert [round(row["s"], 1), round(row["n"], 2), round(row["c"], 1), round(row["b"], 1)] == [k["sharpness"], k["noise"], k["contrast"], k["brightness"]]
    tiny = spark.createDataFrame([([1.0, 2.0],)], "px array<double>").select(pixels.sharpness("px", "2", "1").alias("s"), pixels.noise("px", "2", "1").alias("n")).first()
    assert math.isnan(tiny["s"]) and tiny["n"] == 0


def _verdict(m, on, t=Thresholds()):
    below = lambda v, x: v is not None and v < x
    soft = {
        "blur": below(m["sharpness"], t.blur), "dark": below(m["brightness"], t.dark), "contrast": below(m["contrast"], t.contrast), "noise": m["noise"] > t.noise,
        "exposure": m["black_frac"] >= t.clip or m["white_frac"] >= t.clip, "aesthetic": below(m["aesthetic"], t.aesthetic), "utility": bool(m["is_utility"]), "face": below(m["face_quality"], t.face),
    }
    soft = {k: v and k in on for k, v in soft.items()}
    vb, vd = "blur" in on and below(m["sharpness"], t.blur_hard), "dark" in on and below(m["brightness"], t.dark_hard)
    names = {"blur": "very_blurry" if vb else "blurry", "dark": "very_dark" if vd else "dark", "contrast": "low_contrast", "noise": "noisy", "exposure": "bad_exposure", "aesthetic": "low_aesthetic", "utility": "utility", "face": "low_face_quality"}
    reasons = [names[k] for k in names if soft[k]]
    strong = vb or vd or soft["blur"] and (soft["dark"] or soft["exposure"] or soft["contrast"]) or soft["face"]
    return "delete" if strong else "review" if reasons else "keep", reasons


def test_verdict_truth_table(spark):
    nan = float("nan")
    rnd = random.Random(5)
    choices = {
        "sharpness": [nan, 34.9, 35.0, 99.9, 100.0, 200.0], "brightness": [24.9, 25.0, 49.9, 50.0, 99.0], "contrast": [17.9, 18.0, 40.0], "noise": [nan, 7.0, 7.1], "black_frac": [0.549, 0.55],
        "white_frac": [0.0, 0.55], "aesthetic": [None, nan, -0.11, -0.10], "is_utility": [None, False, True], "face_quality": [None, nan, 0.29, 0.30],
    }
    rows = [{k: rnd.choice(v) for k, v in choices.items()} for _ in range(150)]
    schema = ", ".join(f"{k} {'boolean' if k == 'is_utility' else 'double'}" for k in choices)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema).coalesce(1)
    subsets = [frozenset(c) for n in (1, 2, 8) for c in itertools.combinations(SIGNALS, n)]
    for on in rnd.sample(subsets, 12) + [frozenset(SIGNALS)]:
        got = with_verdict(df, on).select("recommendation", "reasons").collect()
        assert [(g[0], g[1]) for g in got] == [_verdict(r, on) for r in rows]
    # a hard limit above the soft one deletes without a reason
    odd = with_verdict(df.limit(1).withColumns({"sharpness": F.lit(150.0), "brightness": F.lit(99.0), "face_quality": F.lit(None).cast("double")}), frozenset({"blur"}), Thresholds(blur_hard=200.0)).first()
    assert odd["recommendation"] == "delete" and odd["reasons"] == []


def test_parameters():
    assert resolve_signals("blur, dark", "dark") == {"blur"} and resolve_signals() == set(SIGNALS)
    for bad in (("x", None), ("blur", "blur")):
        with pytest.raises(ValueError):
            resolve_signals(*bad)
    with pytest.raises(ValueError):
        RunOptions(dedupe=True, with_models=False)
    with pytest.raises(ValueError):
        album_title("{prefix}", "a", "b", "c")
    assert album_title("{prefix} {tier}", "a", "b", "c") == "a c"


def test_components_match_union_find(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7), (200, 200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges + [(None, 3)], "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for n in {x for e in edges for x in e}}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_tasks_contract_links(spark, monkeypatch):
    # a chain takes no rounds where a task has all of it, and few where tasks contract a few links at once
    written, before = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, label: written.append(label) or before(df, label))
    chain = list(range(2000))
    random.Random(3).shuffle(chain)
    links = spark.createDataFrame(list(itertools.pairwise(chain)), "a bigint, b bigint").coalesce(1)
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == dict.fromkeys(chain, 0) and written.count("cc-round") <= 3
    rows = [pa.RecordBatch.from_pylist([{"u": max(x), "v": min(x)} for x in itertools.pairwise(chain[at : at + 51])]) for at in range(0, 2000, 50)]
    monkeypatch.setattr(components, "CONTRACTED", 100)
    stars = list(components._contract(iter(rows)))
    assert len(stars) == 20
    for k, found in enumerate(stars):
        own = chain[100 * k : 100 * k + 101]
        assert {(x["u"], x["v"]) for x in found.to_pylist()} == {(x, min(own)) for x in own if x != min(own)}


def test_similarity_is_exact(spark):
    v = np.random.default_rng(1).normal(size=(80, 5))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [1.0])]
    for t in (0.3, 1.2, 5.0):
        want = {(i, j) for i in range(80) for j in range(i + 1, 80) if ((v[i] - v[j]) ** 2).sum() < t * t}
        got = similarity_pairs(spark.createDataFrame(rows, "id bigint, fprint array<double>"), t)
        pairs = [(r["a"], r["b"]) for r in got.collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want
    with pytest.raises(ValueError):
        similarity_pairs(spark.createDataFrame(rows, "id bigint, fprint array<double>"), -1)


def test_cache_and_collisions(spark):
    scan = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 2, 1), ("d", 1, 1)], "cache_id string, size bigint, mtime bigint")
    rows = spark.createDataFrame([("a", 1, 1, 1, 15, ""), ("b", 1, 1, 1, 7, ""), ("c", 1, 1, 1, 15, "")], "cache_id string, size bigint, mtime bigint, ver int, computed_mask int, error string")
    hits = {r["cache_id"]: r["is_hit"] for r in cache.split(scan, rows, {"fprint"}).collect()}
    assert hits == {"a": True, "b": False, "c": False, "d": False}
    fresh = rows.where("cache_id = 'b'").withColumn("computed_mask", F.lit(15)).unionByName(spark.createDataFrame([("d", 1, 1, 1, 15, "bad")], rows.schema))
    assert {(r["cache_id"], r["computed_mask"]) for r in cache.upsert(rows, fresh).collect()} == {("a", 15), ("b", 15), ("c", 15)}
    plan = spark.createDataFrame([(1, "q/a.jpg"), (2, "q/a.jpg"), (3, "q/a__1.jpg"), (4, "q/b")], "seq bigint, target string")
    existing = spark.createDataFrame([("q/b",)], "path string")
    got = {r["seq"]: r["target"] for r in moves.resolve_collisions(plan, existing).collect()}
    assert got[1] == "q/a.jpg" and got[3] == "q/a__1.jpg" and got[4] == "q/b__1" and len(set(got.values())) == 4


def _png(path, g):
    h, w = g.shape
    raw = b"".join(b"\0" + g[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_scan_end_to_end(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    rng = np.random.default_rng(0)
    _png(tmp_path / "in/flat.png", np.full((64, 64), 128))
    noisy = rng.integers(0, 256, (64, 64))
    _png(tmp_path / "in/a.PNG", noisy)
    _png(tmp_path / "in/sub/b.png", noisy)
    (tmp_path / "in/bad.jpg").write_bytes(b"no image")
    (tmp_path / "in/note.txt").write_text("x")
    source = pipeline.FilesystemSource([str(tmp_path / "in"), str(tmp_path / "gone")], recursive=True)
    options = RunOptions(dedupe=True, dedupe_threshold=0.1)
    photos = pipeline.run(spark, source, options, cache_path=str(tmp_path / "cache")).collect()
    got = {r["path"].rsplit("/", 1)[1]: r for r in photos}
    assert set(got) == {"flat.png", "a.PNG", "b.png", "bad.jpg"} and source.missing == [str(tmp_path / "gone")]
    assert got["bad.jpg"]["recommendation"] == "error" and got["flat.png"]["recommendation"] == "delete" and "very_blurry" in got["flat.png"]["reasons"]
    pair = [got["a.PNG"], got["b.png"]]
    assert sorted(r["is_keeper"] for r in pair) == [False, True] and any(r["reasons"] == ["near_dup_of:a.PNG"] for r in pair)
    again = pipeline.run(spark, source, options, cache_path=str(tmp_path / "cache"))
    strip = lambda rows: sorted(tuple(str(r[c]) for c in sorted(r.asDict()) if c != "fprint") for r in rows)
    assert strip(again.collect()) == strip(photos)
    pipeline.CsvReportSink(str(tmp_path / "report")).emit(again)
    from darkroom.sources.report import read_report

    assert read_report(spark, str(tmp_path / "report")).count() == 4
    assert any(x.startswith("delete") for x in pipeline.SummarySink().emit(again))
    plan = pipeline.QuarantineSink(str(tmp_path / "q"), options.sink_tiers, [str(tmp_path / "in")], dry_run=False).emit(again)
    assert {r["target"] for r in plan.collect()} == {str(p) for p in (tmp_path / "q").rglob("*.*")}


def test_many_equal_names(spark):
    """One window numbers any number of copies; generated names that exist are numbered past."""
    plan = spark.range(500).selectExpr("id AS seq", "'q/a.jpg' AS target").unionAll(spark.createDataFrame([(500, "q/a__3.jpg"), (501, "q/b.jpg")], "seq bigint, target string"))
    existing = spark.createDataFrame([("q/b.jpg",), ("q/a__7.jpg",), ("q/b__1.jpg",)], "path string")
    got = {r["seq"]: r["target"] for r in moves.resolve_collisions(plan, existing).collect()}
    names = set(got.values())
    assert len(got) == 502 == len(names) and not names & {"q/b.jpg", "q/a__7.jpg", "q/b__1.jpg"}
    assert got[0] == "q/a.jpg" and got[1] == "q/a__1.jpg" and got[500] == "q/a__3.jpg" and got[501] == "q/b__2.jpg"
    assert all(n.startswith("q/a") for s, n in got.items() if s < 500)


def test_moves_never_replace(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "q").mkdir()
    for name, data in (("in/a.jpg", b"new"), ("in/sub/b.jpg", b"b"), ("q/a.jpg", b"old"), ("in/c.jpg", b"c")):
        (tmp_path / name).write_bytes(data)
    at = lambda x: str(tmp_path / x)
    photos = spark.createDataFrame(
        [(0, at("in/a.jpg"), "delete"), (1, at("in/sub/b.jpg"), "delete"), (2, at("in/gone.jpg"), "delete"), (3, at("in/c.jpg"), "keep")], "seq bigint, path string, recommendation string"
    )
    here = os.getcwd()
    os.chdir(tmp_path)
    try:
        sink = pipeline.QuarantineSink("q", ("delete",), ["in"], dry_run=False)
    finally:
        os.chdir(here)
    plan = {r["seq"]: r["target"] for r in sink.emit(photos).collect()}
    assert plan == {0: at("q/a__1.jpg"), 1: at("q/sub/b.jpg")}
    assert (tmp_path / "q/a.jpg").read_bytes() == b"old" and (tmp_path / "q/a__1.jpg").read_bytes() == b"new" and (tmp_path / "in/c.jpg").exists()
    # a plan that is out of date moves what it can and replaces nothing
    stale = spark.createDataFrame([(0, at("in/c.jpg"), at("q/a.jpg")), (1, at("in/gone.jpg"), at("q/x.jpg"))], "seq bigint, path string, target string")
    log = moves.execute(stale, False).collect()
    assert not any(r["ok"] for r in log) and all(r["error"] for r in log) and (tmp_path / "q/a.jpg").read_bytes() == b"old"
    log, back = moves.undo(materialise(sink.log, "log"), dry_run=False)
    assert {r["undone"] for r in log.collect()} == {True} and (tmp_path / "in/a.jpg").read_bytes() == b"new" and back.where("ok").count() == 2


def test_companions_of_a_request(spark):
    items = spark.createDataFrame([(0, "d/a.jpg"), (1, "d/a.png"), (2, "d/b.jpg")], "seq bigint, path string")
    listing = spark.createDataFrame([("d/a.jpg",), ("d/a.png",), ("d/A.xmp",), ("d/b.jpg",)], "path string")
    found = moves.companions(items, listing.unionAll(spark.createDataFrame([("d/b.xmp",)], "path string")))
    still = moves.existing_companions(found, listing)
    assert {r["path"]: r["companions"] for r in still.collect()} == {"d/a.jpg": ["d/A.xmp", "d/a.png"], "d/a.png": ["d/A.xmp", "d/a.jpg"], "d/b.jpg": []}
    requested = spark.createDataFrame([(0,), (1,)], "seq bigint")
    assert moves.expected_companions(requested, still, items).first()[0] == 1
    files = {(r["owner"], r["path"]) for r in moves.action_plan(requested, items, still).collect()}
    assert files == {(0, "d/a.jpg"), (1, "d/a.png"), (0, "d/A.xmp")}


def test_library_scan(spark, tmp_path):
    noisy = np.random.default_rng(3).integers(0, 256, (80, 80))
    _png(tmp_path / "a.png", noisy)
    rows = [("x", "IMG.png", 80, 80, "image", False, "2024-05-02", str(tmp_path / "a.png"), False), ("y", None, 80, 80, "image", False, "2024-05-01", None, True), ("z", "v.mov", 1, 1, "video", False, "2024-05-01", None, False)]
    assets = spark.createDataFrame(rows, "asset_id string, filename string, pixel_width int, pixel_height int, media_type string, favorite boolean, creation_date string, location string, in_cloud boolean")
    assets = assets.withColumn("creation_date", F.to_timestamp("creation_date")).withColumn("modification_date", F.col("creation_date"))
    got = {r["asset_id"]: r for r in pipeline.run(spark, pipeline.LibrarySource(assets), RunOptions(dedupe=False)).collect()}
    assert set(got) == {"x", "y"} and got["x"]["seq"] == 0 and got["x"]["path"] == "IMG.png" and got["x"]["error"] == ""
    assert got["y"]["recommendation"] == "error" and "cloud" in got["y"]["error"] and got["y"]["path"] == "y"


def test_order_is_global(spark):
    df = spark.range(500).select(F.col("id").alias("seq"), (F.col("id") * 37 % 101).cast("double").alias("sharpness"), F.when(F.col("id") % 3 == 0, "keep").otherwise("delete").alias("recommendation"))
    rows = report.with_position(df).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(500))
    key = [({"delete": 0, "keep": 3}[r["recommendation"]], r["sharpness"], r["seq"]) for r in rows]
    assert key == sorted(key)


ORACLED = ["img_sharpness", "verdict_all", "report_worst_first", "near_dup_clusters", "near_dup_report", "cache_upsert", "companions", "gallery_facets_signal", "gallery_page", "action_accounting", "csv_roundtrip"]


@pytest.mark.parametrize("name", ORACLED)
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "events", "pages", "documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    own = con.sql(catalogue.ORACLES[name])
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    names = sorted(df.columns)
    assert names == sorted(own.columns)
    a = sorted(tuple(str(fix(r[c])) for c in names) for r in df.collect())
    b = sorted(tuple(str(fix(r[own.columns.index(c)])) for c in names) for r in own.fetchall())
    assert a == b


def _clustered(seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 6)) * 2
    x = np.concatenate([centres[rng.integers(0, 12, 160)] + rng.normal(size=(160, 6)) * 0.25, np.repeat(rng.normal(size=(3, 6)), 20, 0), centres[0] + rng.normal(size=(100, 6)) * 0.02])
    return np.round(x, 3)


@pytest.mark.parametrize("t", [0.05, 1.0])
def test_similarity_of_cells_and_cores(spark, monkeypatch, t):
    """Small blocks, many pivots, copies and crowded cores: pairs are all there, and links have the same components."""
    for name, value in (("BLOCK", 32), ("PIVOTS", 9), ("CORE", 20)):
        monkeypatch.setattr(similarity, name, value)
    x = _clustered()
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9000, None), (9001, [1.0]), (9002, [float("nan")] * 6), (9003, [float("inf")] * 6), (None, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id bigint, fprint array<double>")
    near = ((x[:, None] - x[None]) ** 2).sum(2) < t * t
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(near, 1)))}
    got = [(r["a"], r["b"]) for r in similarity_pairs(df, t).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    label = np.arange(len(x))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    links = similarity.similarity_links(df, t)
    found = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert found == {i: label[i] for i in {k for p in want for k in p}}
    assert links.count() < 16 * len(x)


def test_equal_vectors_cost_no_pairs(spark):
    df = spark.range(3000).selectExpr("id", "array(1.0D, 2.0D) AS fprint").unionAll(spark.range(3000, 6000).selectExpr("id", "array(1.0D + (id % 97) / 1e4, 2.0D) AS fprint"))
    assert similarity.similarity_links(df, 0.5).count() <= 6000
    work = similarity.similarity_work(df, 0.5).first()
    assert work["vectors"] == 97 and work["met"] <= 97 * 96 // 2


def test_links_of_a_larger_input_grow_no_faster(spark, monkeypatch):
    """A vector meets a fixed number of blocks, whatever the size of the input, where no cell can be left out."""
    for name, value in (("BLOCK", 32), ("PIVOTS", 40), ("PARTS", 4)):
        monkeypatch.setattr(similarity, name, value, raising=False)
    x = np.random.default_rng(3).normal(size=(1200, 12))
    for n in (300, 1200):
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x[:n])], "id bigint, fprint array<double>")
        near = ((x[:n, None] - x[None, :n]) ** 2).sum(2) < 16
        links = similarity.similarity_links(df, 4.0)
        assert links.count() < 9 * n
        assert similarity_pairs(df, 4.0).count() == np.triu(near, 1).sum()
