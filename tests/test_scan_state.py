"""What a scan keeps and tells: cache buckets, counts, progress, streams, slices of paths, thumbnails and written views."""

import io
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom import pipeline
from darkroom.functions import pixels
from darkroom.functions.png import png_bytes
from darkroom.operators import cache, gallery
from darkroom.operators.components import connected_components
from darkroom.operators import similarity
from darkroom.operators.similarity import Clusters, similarity_links
from darkroom.params import RunOptions
from darkroom.plans import catalogue
from darkroom.progress import Progress
from darkroom.sources import files
from darkroom.streaming.ingest import Ingest, each_batch, listen

ROWS = "cache_id string, size bigint, error string"


def _stamps(path):
    return {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("bucket=")}


def test_cache_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "cache")
    kept = cache.BucketedCache(spark, path, 16, ROWS)
    assert kept.read().count() == 0 and kept.upsert(spark.createDataFrame([], ROWS)) == []
    first = [(f"d{i % 12}/{i}.jpg", i, "") for i in range(200)] + [("bare", 7, ""), ("bad", 1, "no image")]
    touched = kept.upsert(spark.createDataFrame(first, ROWS))
    before = _stamps(path)
    assert {int(d.split("=")[1]) for d in before} == set(touched) and kept.read().count() == 201
    again = kept.upsert(spark.createDataFrame([("d3/3.jpg", 1003, ""), ("d3/new.jpg", 5, ""), ("d3/15.jpg", 9, "broken")], ROWS))
    after = _stamps(path)
    assert len(again) == 1 and [d for d in after if after[d] != before[d]] == [f"bucket={again[0]}"]
    got = {r["cache_id"]: r["size"] for r in kept.read().collect()}
    assert len(got) == 202 and got["d3/3.jpg"] == 1003 and got["d3/new.jpg"] == 5 and got["d3/15.jpg"] == 15 and got["d4/4.jpg"] == 4
    assert {r["cache_id"] for r in kept.read(kept.touched(spark.createDataFrame([("d3/x", 1, "")], ROWS))).collect()} >= {"d3/3.jpg", "d3/new.jpg"}


def test_progress_line():
    now, out = [0.0], io.StringIO()
    told = Progress(120, ": ", stream=out, clock=lambda: now[0])
    for at, done in ((1, 10), (2, 49), (5, 50), (6, 99), (8, 100), (9, 90), (10, 150), (11, 150)):
        now[0] = at
        told.advance_to(done)
    assert out.getvalue().splitlines() == [": 50/120  (10.0/s, eta 0.1 min)", ": 100/120  (12.5/s, eta 0.0 min)", ": 120/120  (12.0/s, eta 0.0 min)"]


def _images(folder, n, seed=0):
    rng = np.random.default_rng(seed)
    os.makedirs(folder, exist_ok=True)
    base = [rng.integers(0, 256, (48, 64)) for _ in range(4)]
    for i in range(n):
        g = base[i % 4] if i % 3 else rng.integers(0, 256, (48, 64))
        with open(f"{folder}/{i:03}.png", "wb") as f:
            f.write(png_bytes(np.clip(g + rng.integers(0, 3, g.shape), 0, 255)))
    with open(f"{folder}/broken.jpg", "wb") as f:
        f.write(b"no image")
    return folder


def test_counts_in_the_same_pass(spark, tmp_path):
    folder, out = _images(str(tmp_path / "in"), 7), io.StringIO()
    source, options = pipeline.FilesystemSource([folder]), RunOptions()
    counts = pipeline.Counts()
    pipeline.run(spark, source, options, cache_path=str(tmp_path / "cache"), counts=counts, progress=lambda n: Progress(n, every=3, stream=out)).count()
    size = sum(os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder))
    assert counts.get() == {"items": 8, "hits": 0, "misses": 8, "bytes": size, "errors": 1}
    assert out.getvalue().splitlines()[-1].startswith("  8/8  (")
    again = pipeline.Counts()
    pipeline.run(spark, source, options, cache_path=str(tmp_path / "cache"), counts=again).count()
    assert again.get() == {"items": 8, "hits": 7, "misses": 1, "bytes": size, "errors": 1}  # errors aren't kept


def test_slices_of_paths(spark, tmp_path):
    listing, _ = files.scan(spark, [_images(str(tmp_path / "in"), 9)])
    with open(tmp_path / "in/999.png", "wb") as f:  # not listed when the listing is read
        f.write(b"x")
    listing = listing.where("path NOT LIKE '%999%'")
    whole, cut = (sorted(map(str, files.analyse(listing, frozenset({"fprint"}), slice_paths=k).collect())) for k in (100, 3))
    assert whole == cut and len(whole) == 10
    assert files.analyse(listing.limit(0)).count() == 0


def test_thumbnails(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rng = np.random.default_rng(2)
    colour = rng.integers(0, 256, (30, 100, 3))
    (folder / "c.png").write_bytes(png_bytes(colour))
    (folder / "g.png").write_bytes(png_bytes(np.full((9, 4), 200)))
    (folder / "bad.png").write_bytes(b"?")
    listing, _ = files.scan(spark, [str(folder)])
    got = {os.path.basename(r["path"]): r for r in files.thumbnails(listing, 20).collect()}
    assert (got["c.png"]["width"], got["c.png"]["height"]) == (20, 6) and (got["g.png"]["width"], got["g.png"]["height"]) == (4, 9) and got["bad.png"]["png"] is None
    out = tmp_path / "out"
    out.mkdir()
    for name in ("c.png", "g.png"):
        (out / name).write_bytes(bytes(got[name]["png"]))
    back = {os.path.basename(r["origin"]): r for r in spark.read.format("image").load(str(out)).select("image.*").collect()}
    a = np.frombuffer(back["c.png"]["data"], np.uint8).reshape(6, 20, 3)[:, :, ::-1]
    assert (a == np.rint(colour.reshape(6, 5, 20, 5, 3).mean((1, 3)))).all() and set(back["g.png"]["data"]) == {200}


def test_stream_equals_one_run(spark, tmp_path):
    """Three batches of files, one of them delivered twice, give the clusters and the cache of one run."""
    folder = _images(str(tmp_path / "in"), 15)
    state = Ingest(spark, str(tmp_path / "state"), 0.05)
    batches = []

    def take(rows, number):
        state.take(rows, number)
        batches.append(number)
        if number == 1:
            state.take(rows, number)

    each_batch(listen(spark, folder, 6), take, str(tmp_path / "checkpoint"))
    assert batches == [0, 1, 2]
    listing, _ = files.scan(spark, [folder])
    metrics = files.analyse(listing, frozenset({"fprint"}))
    ids = metrics.select("fprint", F.regexp_extract("path", r"(\d+)[.]png$", 1).try_cast("bigint").alias("id"))
    want = {}
    for r in connected_components(similarity_links(ids, 0.05)).collect():
        want.setdefault(r["root"], set()).add(r["node"])
    got = {}
    for r in state.labels().collect():
        got.setdefault(r["root"], set()).add(int(os.path.basename(r["path"])[:3]))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(want) == 4
    assert state.cache.read().count() == 15


@pytest.mark.parametrize("t", [0.3])
def test_clusters_grow_batch_by_batch(spark, tmp_path, t):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(9, 4)) * 2
    x = np.round(centres[rng.integers(0, 9, 240)] + rng.normal(size=(240, 4)) * 0.2, 2)
    state = Clusters(spark, str(tmp_path / "state"), t)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, [1.0]), (901, None)], "id bigint, fprint array<double>")
    for k in range(4):
        state.add(df.where(F.col("id") % 4 == k), k)
    near = ((x[:, None] - x[None]) ** 2).sum(2) < t * t
    label = np.arange(len(x))
    while (new := np.array([label[near[i]].min() for i in range(len(x))])).tolist() != label.tolist():
        label = new
    want = {i: label[i] for i in range(len(x)) if near[i].sum() > 1}
    assert {r["node"]: r["root"] for r in state.labels().collect()} == want


def test_batches_of_a_larger_input_link_no_more(spark, tmp_path, monkeypatch):
    """A vector of a batch meets a fixed number of blocks of earlier ones, so links (each pair of blocks gives some) grow with the input."""
    for name, value in (("BLOCK", 32), ("PIVOTS", 20), ("PARTS", 4)):
        monkeypatch.setattr(similarity, name, value, raising=False)
    written, keep = [], similarity.materialise
    monkeypatch.setattr(similarity, "materialise", lambda df, label: written.append((label, keep(df, label))) or written[-1][1])
    x = np.random.default_rng(3).normal(size=(1200, 12))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, fprint array<double>")
    state = Clusters(spark, str(tmp_path / "state"), 4.0)
    for k in range(2):
        state.add(df.where(F.col("id") % 2 == k), k)
    assert sum(t.count() for label, t in written if label == "batch-links") < 12 * len(x)
    near = ((x[:, None] - x[None]) ** 2).sum(2) < 16
    assert state.labels().count() == (near.sum(1) > 1).sum()


def test_neighbours_over_runs(spark):
    seqs = list(range(100, 161))
    random.Random(1).shuffle(seqs)
    view = spark.createDataFrame([(s, i) for i, s in enumerate(seqs)], "seq bigint, pos bigint")
    for run in (1, 2, 7, 61, 1000):
        got = {r["pos"]: (r["prev_seq"], r["next_seq"]) for r in gallery.neighbours(view, run).collect()}
        assert got == {i: (seqs[i - 1] if i else None, seqs[i + 1] if i < 60 else None) for i in range(61)}, run


def test_written_view_reads_few_files(spark, tmp_path):
    items = spark.range(1000).selectExpr("id AS seq", "cast(pmod(id * 7919, 1000) AS double) AS sharpness", "'x' AS run")
    view = gallery.View(spark, str(tmp_path / "view")).write(items.drop("run"), "sharpness", 100)
    for number, want in ((0, (0, 30)), (3, (90, 120)), (33, (990, 1000)), (99, (990, 1000)), (-5, (0, 30))):
        page = view.page(number, 30)
        assert [r["pos"] for r in page.collect()] == list(range(*want)) and len(page.inputFiles()) <= 2
        assert [r["sharpness"] for r in page.collect()] == [float(i) for i in range(*want)]
    assert gallery.View(spark, str(tmp_path / "none")).write(items.drop("run").limit(0), "sharpness").page(4).count() == 0


def test_many_small_images_take_few_tasks(spark, tmp_path):
    """Paths are listed in as many tasks as a shuffle has, not in one each; settings are as they were afterwards."""
    for k in range(60):
        (tmp_path / f"{k}.png").write_bytes(png_bytes(np.full((8, 8), k, np.uint8)))
    listing, _ = files.scan(spark, [str(tmp_path)])
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    sc = spark.sparkContext
    sc.setJobGroup("small-images", "")
    rows = files.thumbnails(listing, 4).collect()
    sc.setJobGroup("others", "")
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("small-images") for s in tracker.getJobInfo(j).stageIds]
    assert len(rows) == 60 and max(s.numTasks for s in stages if s) < 40
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


@pytest.mark.parametrize("shape", [(8, 8), (1, 1), (25, 31), (60, 100)])
def test_stand_in_embedding_equals_means_of_cells(shape):
    g = np.rint(np.random.default_rng(5).uniform(0, 255, shape))
    h, w = shape
    cells = [g[i * h // 24 : max((i + 1) * h // 24, i * h // 24 + 1), j * w // 32 : max((j + 1) * w // 32, j * w // 32 + 1)].mean() for i in range(24) for j in range(32)]
    v = np.array(cells, np.float32)
    assert np.allclose(pixels.stand_in_embedding(g), v / np.linalg.norm(v), rtol=1e-6, atol=0)


def test_images_are_read_without_code_for_every_file(spark, monkeypatch):
    """Listings and image reads run without generated code, which Spark's image reader makes anew for each file; settings are as they were afterwards."""
    mode, seen, read = "spark.sql.codegen.factoryMode", {}, files._images
    before = spark.conf.get(mode)
    for module in (files, catalogue):
        monkeypatch.setattr(module, "materialise", lambda df, label, keep=module.materialise: seen.update({label: spark.conf.get(mode)}) or keep(df, label))
    monkeypatch.setattr(files, "_images", lambda paths: seen.update(images=spark.conf.get(mode)) or read(paths))
    rows = catalogue.QUERIES["thumbnail_files"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 500 and all(r["read_width"] == 4 and r["read_channels"] == 1 for r in rows)
    assert {k for k, v in seen.items() if v == "NO_CODEGEN"} == {"wanted", "images", "thumbnails-read"} and spark.conf.get(mode) == before
