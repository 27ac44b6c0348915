"""Names for moved files, and moves that survive being cut short."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from darkroom.operators import moves


def _parts(name):
    folder, base = name.rsplit("/", 1) if "/" in name else (None, name)
    m = re.fullmatch(r"(.+)(\.[^.]+)", base)
    stem, ext = (m[1], m[2]) if m else (base, "")
    return (folder + "/" if folder is not None else "") + stem, ext


def _brute(plan, existing):
    """Names by trying one number after another: first come those that want a name as it is, then the rest in order."""
    taken, wants, out = set(existing), {t for _, t in plan}, {}
    for seq, want in sorted(plan):
        if want not in taken:
            out[seq] = want
            taken.add(want)
    for seq, want in sorted(plan):
        if seq not in out:
            stem, ext = _parts(want)
            n = 1
            while (name := f"{stem}__{n}{ext}") in taken or name in wants:
                n += 1
            out[seq] = name
            taken.add(name)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_names_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    name = lambda: rnd.choice(["q/", "q/r/", ""]) + rnd.choice(["a", "b", "a__1", "a__2", "a__1__1", ".b", "c.d", "__1", "a__01", "a__0"]) + rnd.choice([".jpg", "", ".x"])
    plan, existing = [(i, name()) for i in range(150)], [name() for _ in range(60)]
    existing += [f"q/a__{i}.jpg" for i in rnd.sample(range(1, 30), 12)] + ["q/a__999999999999999999999.jpg"]
    got = moves.resolve_collisions(spark.createDataFrame(plan, "seq bigint, target string"), spark.createDataFrame([(e,) for e in existing], "path string"))
    assert {r["seq"]: r["target"] for r in got.collect()} == _brute(plan, existing)


def test_ten_thousand_taken_numbers(spark):
    """Numbers that are taken cost no rounds; columns of the plan stay."""
    n = 10_000
    existing = spark.range(1, n + 1).selectExpr("concat('q/a__', id, '.jpg') AS path").unionAll(spark.createDataFrame([("q/a.jpg",)], "path string")).where("path <> 'q/a__77.jpg'")
    plan = spark.range(n).selectExpr("id AS seq", "'q/a.jpg' AS target", "id * 2 AS want", "'x' AS row").unionAll(spark.createDataFrame([(n, None, 1, "y")], "seq bigint, target string, want bigint, row string"))
    got = moves.resolve_collisions(plan, existing)
    assert got.columns == plan.columns
    rows = {r["seq"]: r for r in got.collect()}
    assert rows[0]["target"] == "q/a__77.jpg" and rows[n]["target"] is None and rows[5]["want"] == 10
    assert [rows[i]["target"] for i in range(1, n)] == [f"q/a__{n + i}.jpg" for i in range(1, n)]


def test_no_rows(spark):
    none = spark.createDataFrame([], "seq bigint, target string")
    assert moves.resolve_collisions(none).count() == 0 and moves.resolve_collisions(none, spark.createDataFrame([("a",)], "path string")).count() == 0


def _files(tmp_path, n):
    (tmp_path / "in").mkdir()
    for i in range(n):
        (tmp_path / f"in/{i}.jpg").write_bytes(b"x" * (i + 1))
    return [(i, f"{tmp_path}/in/{i}.jpg", f"{tmp_path}/out/{i % 3}/{i}.jpg") for i in range(n)]


PLAN = "seq bigint, path string, target string"


def test_a_run_that_is_cut_short_goes_on(spark, tmp_path):
    """Whatever had happened to each file when the run died, all files arrive once."""
    rows = _files(tmp_path, 40)
    log = moves.MoveLog(spark, str(tmp_path / "log"))
    action = log.begin(spark.createDataFrame(rows, PLAN))
    assert log.log().count() == 0
    for i, source, target in rows[:30]:
        os.makedirs(os.path.dirname(target), exist_ok=True)
        if i < 10:  # moved, but the outcome wasn't written
            os.rename(source, target)
        elif i < 20:  # linked, not yet unlinked
            os.link(source, target)
        elif i < 25:  # a copy between file systems had begun
            with open(f"{target}.part-{i}", "wb") as f:
                f.write(b"?")
    with open(rows[39][2], "wb") as f:  # someone else's file
        f.write(b"other")
    again = moves.MoveLog(spark, str(tmp_path / "log"))
    assert again.resume() == [action] and again.resume() == []
    done = {r["owner"]: r for r in again.log().collect()}
    assert len(done) == 40 and [i for i, r in done.items() if not r["ok"]] == [39] and "already" in done[39]["error"]
    for i, source, target in rows[:39]:
        assert not os.path.exists(source) and os.path.getsize(target) == i + 1
    assert os.path.exists(rows[39][1]) and os.path.getsize(rows[39][2]) == 5


def test_intents_that_were_not_finished_do_not_count(spark, tmp_path):
    rows = _files(tmp_path, 3)
    log = moves.MoveLog(spark, str(tmp_path / "log"))
    log.begin(spark.createDataFrame(rows, PLAN))
    os.remove(tmp_path / "log/intents/action_id=0/_SUCCESS")
    assert moves.MoveLog(spark, str(tmp_path / "log")).resume() == []
    assert log.begin(spark.createDataFrame(rows, PLAN)) == 0
    with pytest.raises(ValueError):
        log.begin(spark.createDataFrame(rows, PLAN), 0)


def test_copy_between_file_systems(tmp_path, monkeypatch):
    def no_links(*a, **k):
        raise OSError(18, "cross-device link")

    monkeypatch.setattr(os, "link", no_links)
    (tmp_path / "a").write_bytes(b"1")
    stamp = os.lstat(tmp_path / "a").st_mtime_ns
    assert moves.move_file(f"{tmp_path}/a", f"{tmp_path}/b/c", 1, stamp, 7) == "" and os.listdir(tmp_path / "b") == ["c"] and not os.path.exists(tmp_path / "a")
    assert moves.move_file(f"{tmp_path}/a", f"{tmp_path}/b/c", 1, stamp, 7) == ""  # a second attempt
    assert "no such file" in moves.move_file(f"{tmp_path}/a", f"{tmp_path}/b/d", None, None)


def test_commit_and_restore(spark, tmp_path):
    """Unknown and removed items are refused; companions that are items are removed too; undoing twice takes back one action."""
    folder = tmp_path / "in"
    folder.mkdir()
    names = ["a.jpg", "a.raw", "b.jpg", "c.jpg", "a.xmp"]
    for name in names:
        (folder / name).write_bytes(b"12345")
    items = spark.createDataFrame([(i, str(folder / n), 100 + i, n == "c.jpg") for i, n in enumerate(names[:4])], "seq bigint, path string, file_bytes bigint, removed boolean")
    listing = spark.createDataFrame([(str(folder / n),) for n in names], "path string")
    found = moves.companions(items, listing)
    log = moves.MoveLog(spark, str(tmp_path / "log"))
    first = moves.commit(log, spark.createDataFrame([(2,)], "seq bigint"), items, str(tmp_path / "bin"))
    assert {r["seq"] for r in first.items.where("removed").collect()} == {2, 3}
    second = moves.commit(log, spark.createDataFrame([(0,), (3,), (77,)], "seq bigint"), first.items, str(tmp_path / "bin"), found)
    assert {(r["seq"], r["ok"], r["error"]) for r in second.results.collect()} == {(0, True, ""), (3, False, "not allowed"), (77, False, "bad id")}
    assert {r["seq"] for r in second.items.where("removed").collect()} == {0, 1, 2, 3}
    assert second.totals.first().asDict() == {"freed": 100 + 101 + 5, "companions_moved": 1, "owners": 1}
    assert sorted(os.listdir(tmp_path / "bin")) == ["a.jpg", "a.raw", "a.xmp", "b.jpg"]
    back = moves.restore(log, second.items)
    assert {r["seq"] for r in back.where("removed").collect()} == {2, 3} and os.listdir(tmp_path / "bin") == ["b.jpg"]
    assert moves.restore(log, back) is back and os.listdir(tmp_path / "bin") == ["b.jpg"]
    nothing = moves.commit(log, spark.createDataFrame([(77,)], "seq bigint"), back, str(tmp_path / "bin"))
    assert nothing.action is None and nothing.totals.first()["freed"] == 0
    assert log.log().where(F.col("undone")).count() == 3
