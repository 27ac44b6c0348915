"""Move plans: what goes where, without touching a file; and their inverse."""

from __future__ import annotations

import contextlib
import os
import shutil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from darkroom.functions.paths import basename, parent, stem, suffix
from darkroom.operators.report import numbered_rows
from darkroom.operators.skew import join_counted
from darkroom.runtime import materialise, scratch_path, shuffle_partitions, ship


def absolute(path: str) -> str:
    """A local path as listings have it: absolute, with symbolic links followed; a path with a scheme stays as it is."""
    return path.rstrip("/") if "://" in path else os.path.realpath(os.path.expanduser(path))


def relative_targets(items: DataFrame, roots: list[str], dest: str) -> DataFrame:
    """Items with ``target``: below ``dest`` as below the first root that holds them, or by bare name."""
    below = basename(F.col("path"))
    for root in reversed([r.rstrip("/") for r in roots]):
        below = F.when(F.col("path").startswith(root + "/"), F.substring(F.col("path"), len(root) + 2, 1_000_000)).otherwise(below)
    return items.withColumn("target", F.concat(F.lit(dest.rstrip("/") + "/"), below))


def _folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.concat(parent(path), F.lit("/"))).otherwise(F.lit(""))


def _numbered(path: Column, n: Column) -> Column:
    """A path with ``__n`` before its extension; 0 leaves it as it is."""
    return F.when(n == 0, path).otherwise(F.concat(_folder(path), stem(path), F.lit("__"), n.cast("string"), suffix(path)))


def _places(rows: DataFrame, name: str, order: list[Column], start: int = 0) -> DataFrame:
    """``rows`` with ``place``, their number among rows of one name in an order, without a window over a name's rows."""
    numbered = numbered_rows(rows, [F.col(name), *order], "_all")
    first = numbered.groupBy(name).agg(F.min("_all").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return join_counted(numbered, materialise(first, "name-starts"), [name], "_n").withColumn("place", F.col("_all") - F.col("_first") + start).drop("_all", "_first", "_n")


def resolve_collisions(plan: DataFrame, existing: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """Targets made unique: of rows with one target the first in order has it, if no such file exists; each other gets the next free ``__n`` before its extension.

    A numbered name is free if neither an existing file has it nor any row of the plan wants it as its own target. A generated name says which name it comes from, so names that are
    generated for different targets never meet, and one pass settles all: of one target, the k-th row in need gets the k-th gap between taken numbers. Both are laid out in one order, in which
    the place of a row is its number; that order is range-partitioned, so any number of rows may want one name. A null target stays null.
    """
    spark = plan.sparkSession
    rows = plan.select(F.struct("*").alias("row"), F.col(f"`{order}`").alias("ord"), F.col("target").alias("want"))
    ranked = materialise(_places(rows.where("want IS NOT NULL"), "want", [F.col("ord")]), "moves")
    wants = ranked.where("place = 0").select("want")  # each name once
    there = existing.select(F.col("path").alias("want")).distinct() if existing is not None else spark.createDataFrame([], "want string")
    first = ranked.where("place = 0").join(there, "want", "left_anti").select("row", "want", F.col("want").alias("target"))
    held = wants.join(there.withColumn("held", F.lit(1)), "want", "left").select("want", F.coalesce("held", F.lit(0)).alias("held"))
    counts = ranked.groupBy("want").agg(F.count(F.lit(1)).alias("n")).join(held, "want")
    # from 1, in need of a number
    needy = join_counted(ranked, materialise(counts, "name-counts"), ["want"]).select("row", "want", (F.col("place") + F.col("held")).alias("turn")).where("turn > 0")
    needy = materialise(needy, "moves-needy")
    known = wants.unionAll(there).select(F.col("want").alias("taken"))
    number = F.regexp_extract(stem(F.col("taken")), r"__([1-9][0-9]{0,17})$", 1)
    parsed = known.where(stem(F.col("taken")).rlike(r".__[1-9][0-9]{0,17}$")).select(
        "taken", number.cast("bigint").alias("number"), F.concat(_folder(F.col("taken")), F.regexp_replace(stem(F.col("taken")), r"__[1-9][0-9]{0,17}$", ""), suffix(F.col("taken"))).alias("want")
    )
    parsed = parsed.where(_numbered(F.col("want"), F.col("number")) == F.col("taken")).select("want", "number").distinct()
    parsed = parsed.join(needy.select("want").distinct(), "want", "left_semi")
    # so many free numbers lie below a taken one
    taken = _places(parsed, "want", [F.col("number")], 1).select("want", (F.col("number") - F.col("place")).alias("turn"), F.lit(None).cast(needy.schema["row"].dataType).alias("row"))
    both = needy.select("want", "turn", "row").unionByName(taken)
    settled = _places(both, "want", [F.col("turn"), F.col("row").isNull()], 1).where("row IS NOT NULL")
    settled = settled.select("row", "want", _numbered(F.col("want"), F.col("place")).alias("target"))
    done = first.unionByName(settled).unionByName(rows.where("want IS NULL").select("row", "want", F.col("want").alias("target")))
    return done.select(*[F.col("target") if c == "target" else F.col("row")[c].alias(c) for c in plan.columns])


def quarantine_plan(photos: DataFrame, tiers: tuple[str, ...], roots: list[str], dest: str, listing: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """(seq, path, target) of photos in ``tiers`` whose file is still listed."""
    chosen = photos.where(F.col("recommendation").isin(*tiers)).select("seq", "path")
    if listing is not None:
        chosen = chosen.join(listing.select("path").distinct(), "path", "left_semi")
    return resolve_collisions(relative_targets(chosen, roots, dest), existing).select("seq", "path", "target")


def companions(items: DataFrame, files: DataFrame) -> DataFrame:
    """For each item the other files of its folder with its stem (in any case), sorted: path, companions."""
    key = lambda d, p: d.select(F.col("path").alias(p), parent(F.col("path")).alias("dir"), F.lower(stem(F.col("path"))).alias("stem"))
    pairs = key(items.select("path").distinct(), "path").join(key(files.select("path").distinct(), "other"), ["dir", "stem"]).where("path <> other")
    found = pairs.groupBy("path").agg(F.array_sort(F.collect_set("other")).alias("companions"))
    return items.select("path").distinct().join(found, "path", "left").withColumn("companions", F.coalesce("companions", F.array().cast("array<string>")))


def expected_companions(requested: DataFrame, with_companions: DataFrame, items: DataFrame) -> DataFrame:
    """One row: how many files a request would move beside its own ones, each once, for a question before it is carried out."""
    own = items.join(requested.select("seq").distinct(), "seq", "left_semi").select("path")
    more = own.join(with_companions, "path").select(F.explode("companions").alias("path")).join(own, "path", "left_anti")
    return more.agg(F.countDistinct("path").alias("n_companions"))


def action_plan(requested: DataFrame, items: DataFrame, with_companions: DataFrame | None = None) -> DataFrame:
    """Files that a request moves: (owner, path, is_companion), each path once, for its first owner; unknown items drop.

    A companion that is gone since it was listed drops if ``with_companions`` was made from a fresh listing (see ``existing_companions``).
    """
    own = items.join(requested.select("seq").distinct(), "seq", "left_semi")
    rows = own.select(F.col("seq").alias("owner"), "path", F.lit(False).alias("is_companion"))
    if with_companions is not None:
        more = own.join(with_companions, "path").select(F.col("seq").alias("owner"), F.explode("companions").alias("path"), F.lit(True).alias("is_companion"))
        rows = rows.unionByName(more)
    first = F.row_number().over(Window.partitionBy("path").orderBy("is_companion", "owner"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def accounting(log: DataFrame, items: DataFrame) -> DataFrame:
    """Per action: owners, files, bytes freed (restores count against) and whether every file of every owner moved.

    Of items that repeat a path, the one with the largest size counts.
    """
    sizes = items.groupBy("path").agg(F.max("file_bytes").alias("report_bytes"))
    size = log.join(sizes, log["orig"] == sizes["path"], "left").drop("path")
    freed = F.coalesce("report_bytes", "stat_bytes", F.lit(0)) * F.when(F.col("undone"), -1).otherwise(1)
    return size.groupBy("action_id").agg(
        F.countDistinct("owner").alias("owners"), F.count(F.lit(1)).alias("files"), F.sum(F.when(F.col("ok"), freed).otherwise(0)).alias("freed"), F.bool_and("ok").alias("all_ok")
    )


def undo_plan(log: DataFrame) -> DataFrame:
    """Moves that take the last action back: (owner, path, target)."""
    last = log.where(~F.col("undone")).agg(F.max("action_id").alias("action_id"))
    return log.where("ok").join(F.broadcast(last), "action_id").select("owner", F.col("dest").alias("path"), F.col("orig").alias("target"))


def existing_companions(found: DataFrame, listing: DataFrame) -> DataFrame:
    """Companions that a fresh listing still has: path, companions."""
    there = listing.select(F.col("path").alias("one")).distinct()
    still = found.select("path", F.explode("companions").alias("one")).join(there, "one", "left_semi").groupBy("path").agg(F.array_sort(F.collect_set("one")).alias("companions"))
    return found.select("path").join(still, "path", "left").withColumn("companions", F.coalesce("companions", F.array().cast("array<string>")))


LOG = "action_id bigint, owner bigint, orig string, dest string, is_companion boolean, ok boolean, undone boolean, error string, stat_bytes bigint"
INTENT = "action_id bigint, of bigint, move_id bigint, owner bigint, orig string, dest string, is_companion boolean, size bigint, stamp bigint"
OUTCOME = "action_id bigint, move_id bigint, ok boolean, error string"


def _stat(path: str | None):
    try:
        return os.lstat(path) if path else None
    except OSError:
        return None


def _copied(source: str, target: str, move_id: int) -> None:
    """A move between file systems, or without hard links: copied under another name first."""
    part = f"{target}.part-{move_id}"
    shutil.copy2(source, part, follow_symlinks=False)
    if os.path.lexists(target):
        os.unlink(part)
        raise FileExistsError(f"there is a file already: {target}")
    os.rename(part, target)
    os.unlink(source)


def move_file(source: str, target: str, size: int | None, stamp: int | None, move_id: int = 0) -> str:
    """Move a file without ever replacing one; what went wrong, or an empty text.

    ``size`` and ``stamp`` (modification time in nanoseconds) are what the file had when the move was planned. A move that an earlier attempt has done, or half done, is
    recognised by them and finished, so any number of attempts has the effect of one.
    """
    try:
        for _ in range(2):  # once more if another attempt was faster
            have, there = _stat(source), _stat(target)
            if there is not None:
                if have is not None and source != target and (have.st_dev, have.st_ino) == (there.st_dev, there.st_ino):
                    os.unlink(source)  # linked, not yet unlinked
                    return ""
                if have is None and size is not None and (there.st_size, there.st_mtime_ns) == (size, stamp):
                    return ""
                return f"there is a file already: {target}"
            if have is None:
                return f"no such file: {source}"
            os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
            try:
                os.link(source, target, follow_symlinks=False)
            except FileExistsError:
                continue
            except FileNotFoundError:
                continue
            except OSError:
                _copied(source, target, move_id)
                return ""
            with contextlib.suppress(FileNotFoundError):
                os.unlink(source)
            return ""
        return f"there is a file already: {target}"
    except OSError as e:
        return str(e)


def _noted(batches):
    """Moves with size and stamp of their files, as they are now."""
    for batch in batches:
        stats = [_stat(p) for p in batch.column("orig").to_pylist()]
        own = [pa.array([s.st_size if s else None for s in stats], pa.int64()), pa.array([s.st_mtime_ns if s else None for s in stats], pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "size", "stamp"])


def _moved(batches):
    for batch in batches:
        rows = batch.select(["orig", "dest", "size", "stamp", "move_id"]).to_pylist()
        errors = [move_file(r["orig"], r["dest"], r["size"], r["stamp"], r["move_id"]) for r in rows]
        own = [pa.array([not e for e in errors], pa.bool_()), pa.array(errors, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("action_id"), batch.column("move_id"), *own], ["action_id", "move_id", "ok", "error"])


def _tried(batches):
    for batch in batches:
        rows = batch.select(["dest", "size"]).to_pylist()
        errors = [f"there is a file already: {r['dest']}" if _stat(r["dest"]) else "no such file" if r["size"] is None else "" for r in rows]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(errors, pa.string())], [*batch.schema.names, "error"])


class MoveLog:
    """Moves with a log that is written ahead: a folder of intents and outcomes, to which every action adds.

    An action's intents are all written before its first file moves; tasks on executors then move files and their outcomes are added. If a run dies, ``resume`` carries out what has
    an intent but no outcome, which loses nothing and moves nothing twice (see ``move_file``). Intents whose write didn't end don't count: none of their files
    has moved. Executors must see the files under the paths of the plan.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        ship(spark)

    def _table(self, name: str, schema: str) -> DataFrame:
        folder = f"{self.path}/{name}"
        kinds = schema.split(", ", 1)[1]
        if not self._ended(name):
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(f"{kinds}, action_id bigint").option("basePath", folder)
        return read.parquet(*[f"{folder}/action_id={a}" for a in self._ended(name)]).select(*[c.split()[0] for c in schema.split(", ")])

    def _ended(self, name: str) -> list[int]:
        """Actions whose table was written to its end: one number an action."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = [s.getPath() for s in fs.listStatus(folder)]
        return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("action_id=") and (name == "outcomes" or fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))))

    def begin(self, plan: DataFrame, action_id: int | None = None, of: int | None = None) -> int:
        """Write the intents of a plan (path, target, and owner or seq and is_companion, if it has them) and return the action's number, by default the next one."""
        numbers = self._ended("intents")
        action = (max(numbers, default=-1) + 1) if action_id is None else action_id
        if action in numbers:
            raise ValueError(f"there is an action {action} already")
        owner = F.col("owner") if "owner" in plan.columns else F.col("seq") if "seq" in plan.columns else F.lit(None)
        companion = F.col("is_companion") if "is_companion" in plan.columns else F.lit(False)
        rows = plan.select(F.lit(of).cast("bigint").alias("of"), owner.cast("bigint").alias("owner"), F.col("path").alias("orig"), F.col("target").alias("dest"), companion.alias("is_companion"))
        rows = rows.repartition(shuffle_partitions(self.spark)).mapInArrow(_noted, "of bigint, owner bigint, orig string, dest string, is_companion boolean, size bigint, stamp bigint")
        rows.withColumn("move_id", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{self.path}/intents/action_id={action}")
        return action

    def carry_out(self, action: int) -> None:
        """Move what an action has no outcome for yet."""
        done = self._table("outcomes", OUTCOME).where(F.col("action_id") == action)
        open_moves = self._table("intents", INTENT).where(F.col("action_id") == action).join(done.select("move_id"), "move_id", "left_anti")
        found = open_moves.select("action_id", "move_id", "orig", "dest", "size", "stamp").mapInArrow(_moved, OUTCOME)
        found.drop("action_id").write.mode("append").parquet(f"{self.path}/outcomes/action_id={action}")

    def resume(self) -> list[int]:
        """Carry out the rest of all actions that were cut short: their numbers."""
        intents, outcomes = self._table("intents", INTENT), self._table("outcomes", OUTCOME)
        open_actions = intents.join(outcomes, ["action_id", "move_id"], "left_anti").select("action_id").distinct().collect()  # one row an action
        for action in sorted(r["action_id"] for r in open_actions):
            self.carry_out(action)
        return sorted(r["action_id"] for r in open_actions)

    def log(self) -> DataFrame:
        """One row a move that has an outcome, without those that took others back (``LOG``)."""
        rows = self._table("intents", INTENT).join(self._table("outcomes", OUTCOME), ["action_id", "move_id"])
        back = rows.where("of IS NOT NULL AND ok").select(F.col("of").alias("action_id"), F.col("dest").alias("orig"), F.lit(True).alias("undone"))
        rows = rows.where("of IS NULL").join(back, ["action_id", "orig"], "left").withColumn("undone", F.coalesce("undone", F.lit(False))).withColumnRenamed("size", "stat_bytes")
        return rows.select(*[c.split()[0] for c in LOG.split(", ")])

    def undo(self) -> int | None:
        """Take the last action back: the number of the way back, or None if there is nothing to take back or it was taken back already.

        Files whose old place is taken meanwhile stay where they are.
        """
        own = self._table("intents", INTENT).where("of IS NULL").agg(F.max("action_id").alias("last")).first()["last"]
        if own is None:
            return None
        plan = self.log().where((F.col("action_id") == own) & F.col("ok") & ~F.col("undone")).select("owner", F.col("dest").alias("path"), F.col("orig").alias("target"), "is_companion")
        if plan.isEmpty():
            return None
        action = self.begin(plan, of=own)
        self.carry_out(action)
        return action


def execute(plan: DataFrame, dry_run: bool = True, action_id: int | None = None, log_path: str | None = None) -> DataFrame:
    """Carry out a plan on executors, and return its log (``LOG``), one row a file of the plan.

    ``plan`` has path and target, and may have owner (else seq) and is_companion. A move never replaces a file: if the target exists, or the source is
    gone, the row's ``ok`` is false, ``error`` says why, and the rest goes on. A dry run moves nothing and logs what would be done. ``log_path`` is the folder of a ``MoveLog``, a
    scratch folder by default.
    """
    spark = plan.sparkSession
    ship(spark)
    if not dry_run:
        log = MoveLog(spark, log_path or scratch_path(spark, "move-log"))
        action = log.begin(plan, action_id)
        log.carry_out(action)
        return log.log().where(F.col("action_id") == action)
    owner = F.col("owner") if "owner" in plan.columns else F.col("seq") if "seq" in plan.columns else F.lit(None)
    companion = F.col("is_companion") if "is_companion" in plan.columns else F.lit(False)
    rows = plan.select(owner.cast("bigint").alias("owner"), F.col("path").alias("orig"), F.col("target").alias("dest"), companion.alias("is_companion"))
    kinds = "owner bigint, orig string, dest string, is_companion boolean, size bigint, stamp bigint"
    tried = rows.mapInArrow(_noted, kinds).mapInArrow(_tried, kinds + ", error string")
    no = F.lit(False)
    return tried.select(F.lit(action_id or 0).cast("bigint").alias("action_id"), "owner", "orig", "dest", "is_companion", no.alias("ok"), no.alias("undone"), "error", F.col("size").alias("stat_bytes"))


def undo(log: DataFrame, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """Take the last action back: (log with the rows that went back marked as undone, log of the way back).

    A file whose old place is taken meanwhile stays where it is.
    """
    back = materialise(execute(undo_plan(log), dry_run, -1), "undo-log")
    returned = back.where("ok").select(F.col("dest").alias("orig"), F.col("orig").alias("dest"), F.lit(True).alias("back"))
    marked = log.join(returned, ["orig", "dest"], "left").withColumn("undone", F.col("undone") | F.coalesce("back", F.lit(False)))
    return marked.select(*log.columns), back


def trash_plan(items: DataFrame, trash: str, existing: DataFrame | None = None) -> DataFrame:
    """(owner, path, is_companion, target) of files that go to a trash folder by bare name, without replacing what is there."""
    rows = items.withColumn("target", F.concat(F.lit(trash.rstrip("/") + "/"), basename(F.col("path"))))
    return resolve_collisions(rows, existing, "path").select("owner", "path", "is_companion", "target")


class Committed:
    """What a request came to: ``action`` (None if nothing was moved), ``results`` (seq, ok, error), ``items`` with ``removed`` brought up to date, and ``totals`` (freed, companions_moved, owners)."""

    def __init__(self, action: int | None, results: DataFrame, items: DataFrame, totals: DataFrame):
        self.action, self.results, self.items, self.totals = action, results, items, totals


def commit(log: MoveLog, requested: DataFrame, items: DataFrame, dest: str, with_companions: DataFrame | None = None, existing: DataFrame | None = None) -> Committed:
    """Carry out a request in one call: move the requested items, and their companions if given, to ``dest`` by bare name, and keep account of it.

    Only items that there are (seq, path, file_bytes, removed) and that aren't removed are moved; others come out as errors. A companion that is an item itself counts as one and
    becomes removed too. An owner is ok if all its files moved.
    """
    items = materialise(items, "commit-items")
    asked = requested.select("seq").distinct().join(items.select("seq", "path", "removed"), "seq", "left")
    bad = asked.where("path IS NULL OR removed").select("seq", F.lit(False).alias("ok"), F.when(F.col("path").isNull(), "bad id").otherwise("not allowed").alias("error"))
    plan = action_plan(asked.where("NOT removed").select("seq"), items.where("NOT removed"), with_companions)
    plan = materialise(trash_plan(plan, dest, existing), "commit-plan")
    action = None if plan.isEmpty() else log.begin(plan)
    if action is not None:
        log.carry_out(action)
    done = materialise(log.log().where(F.col("action_id") == (-1 if action is None else action)), "commit-log")
    owners = done.groupBy(F.col("owner").alias("seq")).agg(F.bool_and("ok").alias("ok"), F.coalesce(F.min(F.when(~F.col("ok"), F.col("error"))), F.lit("")).alias("error"))
    moved = done.where("ok").select(F.col("orig").alias("path"), F.col("stat_bytes"), F.lit(True).alias("now"))
    after = items.join(moved.select("path", "now"), "path", "left").withColumn("removed", F.col("removed") | F.coalesce("now", F.lit(False))).select(*items.columns)
    tracked = moved.join(items.groupBy("path").agg(F.max("file_bytes").alias("file_bytes"), F.lit(True).alias("known")), "path", "left")
    totals = tracked.agg(
        F.coalesce(F.sum(F.when(F.col("known"), F.coalesce("file_bytes", F.lit(0))).otherwise(F.coalesce("stat_bytes", F.lit(0)))), F.lit(0)).alias("freed"), F.count_if(F.col("known").isNull()).alias("companions_moved"),
    )
    totals = totals.withColumn("owners", F.lit(done.where("ok").select("owner").distinct().count()))
    return Committed(action, bad.unionByName(owners), after, totals)


def restore(log: MoveLog, items: DataFrame) -> DataFrame:
    """Take the last request back: ``items`` with ``removed`` false again for files that are back. A second call in a row changes nothing."""
    action = log.undo()
    if action is None:
        return items
    back = log._table("intents", INTENT).join(log._table("outcomes", OUTCOME).where("ok"), ["action_id", "move_id"]).where(F.col("action_id") == action)
    back = materialise(back.select(F.col("dest").alias("path"), F.lit(True).alias("back")), "restored")
    return items.join(back, "path", "left").withColumn("removed", F.col("removed") & F.col("back").isNull()).select(*items.columns)
