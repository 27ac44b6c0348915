"""Command lines: ``python -m darkroom.cli scan PATH...``, ``library ASSETS`` and ``review REPORT``. Without a name, ``scan`` is meant."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from datetime import datetime

from darkroom.params import RunOptions, album_title, resolve_signals, session_label
from darkroom.signals import SIGNALS, Thresholds


# Fixed format: option names and defaults of all commands.
def _analysis_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("-o", "--output", default="report")
    p.add_argument("-j", "--workers", type=int, help="tasks at a time (the session's own by default)")
    p.add_argument("--no-models", action="store_true")
    p.add_argument("--no-faces", action="store_true")
    p.add_argument("--dedupe", action="store_true")
    p.add_argument("--dedupe-threshold", type=float, default=0.3)
    p.add_argument("--cache")
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--signals", help="use only these of: " + ", ".join(SIGNALS))
    p.add_argument("--exclude-signals")
    p.add_argument("--include-review", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    for name, value in vars(Thresholds()).items():
        p.add_argument("--" + name.replace("_", "-"), type=float, default=value)


def parser() -> argparse.ArgumentParser:
    """Options of a scan."""
    p = argparse.ArgumentParser(prog="darkroom scan", fromfile_prefix_chars="@")
    p.convert_arg_line_to_args = _arguments
    p.add_argument("paths", nargs="+", help="files and folders; @FILE reads options from a file")
    p.add_argument("-r", "--recursive", action="store_true")
    p.add_argument("--quarantine")
    p.add_argument("--move-log", help="folder of the log of moves")
    _analysis_options(p)
    return p


def library_parser() -> argparse.ArgumentParser:
    """Options of a library scan."""
    from darkroom.sources.library import SMART_ALBUMS

    p = argparse.ArgumentParser(prog="darkroom library", fromfile_prefix_chars="@")
    p.convert_arg_line_to_args = _arguments
    p.add_argument("assets", help="Parquet table of the library's assets")
    p.add_argument("--albums-table")
    p.add_argument("--membership-table")
    p.add_argument("--album")
    p.add_argument("--smart-album", choices=sorted(SMART_ALBUMS))
    p.add_argument("--since", metavar="YYYY-MM-DD")
    p.add_argument("--until", metavar="YYYY-MM-DD")
    p.add_argument("--include-favorites", action="store_true")
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--no-download", action="store_true")
    p.add_argument("--no-albums", action="store_true")
    p.add_argument("--albums-by", choices=("tier", "signal"), default="tier")
    p.add_argument("--albums-output", default="albums", help="Parquet table of album members")
    p.add_argument("--album-prefix", default="darkroom")
    p.add_argument("--album-template", default="{prefix} {date} {tier}")
    p.add_argument("--album-date-format", default="%Y-%m-%d-%H-%M")
    p.add_argument("--replace-albums", action="store_true")
    _analysis_options(p)
    return p


def review_parser() -> argparse.ArgumentParser:
    """Options of a review."""
    p = argparse.ArgumentParser(prog="darkroom review")
    p.add_argument("report", nargs="?", default="report")
    p.add_argument("--quarantine", metavar="DIR")
    p.add_argument("--move-log", metavar="DIR", default="move-log")
    p.add_argument("--tiers", default="delete,duplicate,review")
    p.add_argument("--signals", default="")
    p.add_argument("--name", default="")
    p.add_argument("--sort", default="tier")
    p.add_argument("--page", type=int, default=0)
    p.add_argument("--move", metavar="IDS", help="numbers of report rows, with commas: move them to the quarantine folder")
    p.add_argument("--companions", action="store_true", help="with --move: also files of the same folder and stem")
    p.add_argument("--restore", action="store_true", help="take the last move back")
    return p


def _arguments(line: str) -> list[str]:
    """Arguments of a line of an options file."""
    from darkroom.sources.report import options_of_line

    return options_of_line(line)


def _session(a: argparse.Namespace):
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    if getattr(a, "workers", None):
        spark.conf.set("spark.sql.shuffle.partitions", a.workers)
    return spark


def _options(a: argparse.Namespace) -> tuple[RunOptions, Thresholds]:
    signals = resolve_signals(a.signals, a.exclude_signals)
    return RunOptions(signals, not a.no_models, not a.no_faces, a.dedupe, a.dedupe_threshold, a.include_review), Thresholds(**{k: getattr(a, k) for k in vars(Thresholds())})


def _scanned(spark, source, a: argparse.Namespace, options: RunOptions, limits: Thresholds):
    """Judged photos; None if there are none. Writes the report and prints the summary and what was counted on the way."""
    from darkroom import pipeline
    from darkroom.progress import Progress

    counts = pipeline.Counts()
    photos = pipeline.run(spark, source, options, limits, None if a.no_cache else a.cache, counts, Progress)
    for m in source.missing:
        print(f"not found: {m}", file=sys.stderr)
    n = counts.get()
    if not n["items"]:
        return None
    print(f"{n['items']} items: {n['hits']} from the cache, {n['misses']} analysed, {n['errors']} errors", file=sys.stderr)
    pipeline.CsvReportSink(a.output).emit(photos)
    print("\n".join(pipeline.SummarySink().emit(photos)))
    return photos


def scan(argv: list[str]) -> int:
    """Scan files."""
    a = parser().parse_args(argv)
    options, limits = _options(a)
    from darkroom import pipeline

    spark = _session(a)
    photos = _scanned(spark, pipeline.FilesystemSource(a.paths, a.recursive, a.quarantine), a, options, limits)
    if photos is None:
        return 1
    if a.quarantine:
        pipeline.QuarantineSink(a.quarantine, options.sink_tiers, a.paths, a.dry_run, a.move_log).emit(photos)
    return 0


def library(argv: list[str]) -> int:
    """Scan a photo library's catalogue and write albums of what was found."""
    a = library_parser().parse_args(argv)
    options, limits = _options(a)
    title = album_title(a.album_template, a.album_prefix, session_label(datetime.now(), a.album_date_format), "x")
    from darkroom import pipeline
    from darkroom.sources.library import day

    spark = _session(a)
    table = lambda path: spark.read.parquet(path) if path else None
    assets = table(a.assets)
    fetch = {"album": a.album, "smart_album": a.smart_album, "since": day(a.since) if a.since else None, "until": day(a.until, True) if a.until else None,
             "include_favorites": a.include_favorites, "limit": a.limit}
    if a.album and not (a.albums_table and a.membership_table):
        raise ValueError("an album needs --albums-table and --membership-table")
    source = pipeline.LibrarySource(assets, table(a.albums_table), table(a.membership_table), not a.no_download, **fetch)
    photos = _scanned(spark, source, a, options, limits)
    if photos is None:
        return 1
    if not a.no_albums:
        session = session_label(datetime.now(), a.album_date_format)
        sink = pipeline.AlbumsSink(a.albums_output, assets, a.album_template, a.album_prefix, session, a.albums_by, options.enabled, a.replace_albums)
        print(f"albums such as {title!r} {'would go' if a.dry_run else 'go'} to {a.albums_output}", file=sys.stderr)
        if not a.dry_run:
            sink.emit(photos)
    return 0


def review(argv: list[str]) -> int:
    """Show a page of a report, or move or restore files of it."""
    a = review_parser().parse_args(argv)
    wanted = sorted({int(x) for x in a.move.split(",")}) if a.move else []
    if wanted and not a.quarantine:
        raise ValueError("--move needs --quarantine")
    from pyspark.sql import functions as F

    from darkroom.operators import gallery, moves
    from darkroom.operators.report import with_position
    from darkroom.sources import files
    from darkroom.sources.report import read_report

    spark = _session(a)
    if not files.exists(spark, a.report):
        print(f"no report: {a.report}", file=sys.stderr)
        return 1
    log = moves.MoveLog(spark, a.move_log)
    log.resume()
    gone = log.log().where("ok AND NOT undone").select(F.col("orig").alias("path"), F.lit(True).alias("gone")).distinct()
    rows = read_report(spark, a.report).withColumn("seq", F.monotonically_increasing_id())
    items = with_position(rows).drop("seq").withColumnRenamed("pos", "seq").join(gone, "path", "left").withColumn("removed", F.coalesce("gone", F.lit(False))).drop("gone")
    if items.isEmpty():
        print("no rows in the report", file=sys.stderr)
        return 1
    if a.restore:
        moves.restore(log, items)
        return 0
    if wanted:
        asked = spark.createDataFrame([(x,) for x in wanted], "seq bigint")
        chosen = items.join(F.broadcast(asked), "seq")  # as many rows as were asked for
        folders = [r[0] for r in chosen.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1)).distinct().collect()]
        listing = None
        for folder in folders if a.companions else []:
            here = files.scan_all(spark, folder, False)
            listing = here if listing is None else listing.unionAll(here)
        found = moves.existing_companions(moves.companions(chosen, listing), listing) if listing is not None else None
        existing = files.scan_all(spark, a.quarantine) if files.exists(spark, a.quarantine) else None
        done = moves.commit(log, asked, items, moves.absolute(a.quarantine), found, existing)
        for r in done.results.orderBy("seq").collect():
            print(f"{r['seq']} {'moved' if r['ok'] else r['error']}")
        return 0 if done.results.where("NOT ok").isEmpty() else 3
    view = gallery.visible(items, tuple(a.tiers.split(",")), tuple(x for x in a.signals.split(",") if x), a.name)
    for r in gallery.page(view, a.sort, a.page).collect():
        print(f"{r['seq']:>6} {r['recommendation']:<10} {r['sharpness']:>8} {r['path']} {';'.join(r['reasons'])}")
    return 0


COMMANDS: dict[str, Callable[[list[str]], int]] = {"scan": scan, "library": library, "review": review}


def main(argv: list[str] | None = None) -> int:
    """Run a command. 0: done; 1: nothing to work on; 2: bad options; 3: some files weren't moved."""
    argv = list(sys.argv[1:] if argv is None else argv)
    command = argv.pop(0) if argv and argv[0] in COMMANDS else "scan"
    try:
        return COMMANDS[command](argv)
    except (ValueError, LookupError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
