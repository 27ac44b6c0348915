"""The three command lines, over real files."""

import os

import numpy as np

from darkroom import cli
from darkroom.functions.png import png_bytes
from darkroom.sources.report import options_of_line, read_report


def _folder(tmp_path):
    (tmp_path / "in").mkdir()
    rng = np.random.default_rng(1)
    (tmp_path / "in/flat.png").write_bytes(png_bytes(np.full((64, 64), 3)))
    (tmp_path / "in/flat.xmp").write_text("side")
    (tmp_path / "in/fine.png").write_bytes(png_bytes(rng.integers(0, 256, (64, 64))))
    return str(tmp_path / "in")


def test_scan_and_review(spark, tmp_path, capsys):
    folder, report, bin_, log = _folder(tmp_path), str(tmp_path / "report"), str(tmp_path / "bin"), str(tmp_path / "log")
    (tmp_path / "options").write_text(f"# defaults\n--cache {tmp_path}/cache\n-o '{report}'\n")
    assert cli.main([folder, f"@{tmp_path}/options"]) == 0
    told = capsys.readouterr()
    assert "delete" in told.out and " KB" in told.out or " B" in told.out
    assert "2 items: 0 from the cache, 2 analysed, 0 errors" in told.err and "2/2" in told.err
    rows = {os.path.basename(r["path"]): r for r in read_report(spark, report).collect()}
    assert rows["flat.png"]["recommendation"] == "delete"
    assert cli.main(["review", report, "--move-log", log]) == 0
    line = [x for x in capsys.readouterr().out.splitlines() if "flat.png" in x]
    number = line[0].split()[0]
    assert cli.main(["review", report, "--move-log", log, "--quarantine", bin_, "--companions", "--move", f"{number},99"]) == 3
    assert capsys.readouterr().out.splitlines() == [f"{number} moved", "99 bad id"]
    assert sorted(os.listdir(bin_)) == ["flat.png", "flat.xmp"] and os.listdir(folder) == ["fine.png"]
    assert cli.main(["review", report, "--move-log", log, "--tiers", "delete"]) == 0 and "flat" not in capsys.readouterr().out
    assert cli.main(["review", report, "--move-log", log, "--restore"]) == 0 and sorted(os.listdir(folder)) == ["fine.png", "flat.png", "flat.xmp"]


def test_library_command(spark, tmp_path, capsys):
    folder = _folder(tmp_path)
    row = "asset_id string, filename string, location string, media_type string, favorite boolean, creation_date timestamp, modification_date timestamp, pixel_width int, pixel_height int, in_cloud boolean"
    from datetime import datetime

    rows = [(n, f"{n}.png", f"{folder}/{n}.png", "image", False, datetime(2024, 1, d), None, 64, 64, False) for n, d in (("flat", 5), ("fine", 6))] + [("cloud", None, None, "image", False, datetime(2024, 1, 7), None, 64, 64, True)]
    spark.createDataFrame(rows, row).write.parquet(str(tmp_path / "assets"))
    argv = ["library", str(tmp_path / "assets"), "-o", str(tmp_path / "report"), "--albums-output", str(tmp_path / "albums"), "--no-cache", "--no-download", "--since", "2024-01-05", "--album-date-format", "%Y"]
    assert cli.main(argv) == 0
    assert {r["path"]: r["recommendation"] for r in read_report(spark, str(tmp_path / "report")).collect()}["cloud"] == "error"
    assert {(r["asset_id"], r["album_key"]) for r in spark.read.parquet(str(tmp_path / "albums")).collect()} == {("flat", "delete"), ("fine", "review")}
    assert cli.main([*argv, "--until", "2024-01-01"]) == 1
    assert cli.main([*argv, "--album", "none"]) == 2 and cli.main([*argv, "--album-template", "x"]) == 2 and cli.main(["review", str(tmp_path / "none")]) == 1
    assert cli.main(["scan", folder, "--signals", "nonsense"]) == 2
    assert options_of_line(" # x") == [] and options_of_line("--a 'b c'") == ["--a", "b c"]
