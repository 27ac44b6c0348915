"""Exact similarity self-join of vectors: copies as classes, cells around pivots, bounds before comparisons.

1. Equal vectors are one class; only one vector of a class is compared.
2. Each vector lies in the cell of its nearest pivot. Two vectors of different cells that are closer than t both lie within t of the plane between the two pivots,
   and within t of the other cell's ball; a vector visits only the cells of smaller number for which both hold. Vectors closer to a pivot than t / 2 are
   all closer than t to each other: where links are enough, such a core is one star and its members aren't compared with each other.
3. Cells are put together, or cut, to about ``PARTS`` blocks, and pairs of blocks are compared in tasks, cell by cell. Blocks grow with the input while their number stays, so
   a vector is sent to so many blocks at most, however many there are. A bound in 32-bit numbers, on all coordinates or on the first ones along the main axes and the norm of the
   rest, decides which pairs are compared in full.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.operators.components import connected_components
from darkroom.operators.skew import join_counted
from darkroom.runtime import discard, materialise, ship

#: Rows of a block at least, pivots (a sample by hash) at most, and blocks that rows are dealt to (with remainders a few more).
BLOCK, PIVOTS, PARTS = 2048, 512, 24
#: Rows that are compared with others at once.
TILE = 1024
#: Rows of a core at least; fewer are compared like others.
CORE = 64
#: What a coordinate costs where single pairs are compared in full, measured in coordinates of a matrix product.
GATHER = 150
LINKS, PAIRS = "a bigint, b bigint", "a bigint, b bigint, distance2 double"
COUNTS = "met bigint, compared bigint, linked bigint"


def dominant_length(vectors: DataFrame, vector: str = "fprint") -> int | None:
    """The most frequent length of non-empty vectors; the smallest of equals."""
    row = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return None if row is None else row["d"]


def float_vectors(table: DataFrame, binary: str = "fprint") -> DataFrame:
    """``table`` with fingerprints given as bytes read as little-endian 32-bit floats; bytes beyond a multiple of 4 don't count, null stays null."""
    @F.pandas_udf("array<float>")
    def read(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else np.frombuffer(bytes(b)[: len(b) // 4 * 4], "<f4"))

    return table.withColumn(binary, read(F.col(binary)))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0)


class _Axes:
    """Main axes of a sample, and how many of them decide most pairs. Any orthogonal axes give right results."""

    def __init__(self, sample: np.ndarray, limit: float):
        self.middle = sample.mean(0)
        _, _, axes = np.linalg.svd(sample - self.middle, full_matrices=True)
        self.axes, self.first = axes.T, sample.shape[1]
        if len(sample) < 8:
            return
        y = self.turned(sample[:256])
        i, j = np.triu_indices(len(y), 1)
        least = np.inf
        shares = (0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1)
        for first in sorted({max(1, int(share * sample.shape[1])) for share in shares}):
            self.first = first
            short = self.shortened(y)
            cost = first + GATHER * sample.shape[1] * (((short[i] - short[j]) ** 2).sum(1) < limit).mean()
            if cost < least:
                least, best = cost, first
        self.first = best

    def turned(self, x: np.ndarray) -> np.ndarray:
        return (x - self.middle) @ self.axes

    def shortened(self, turned: np.ndarray) -> np.ndarray:
        """First coordinates and the norm of the rest: distances don't grow."""
        if self.first == turned.shape[1]:
            return turned
        return np.column_stack([turned[:, : self.first], np.sqrt((turned[:, self.first :] ** 2).sum(1))])


class _Rows:
    """Vectors of one side of a comparison, with what their bounds are computed from."""

    def __init__(self, x: np.ndarray, axes: _Axes):
        short = axes.shortened(axes.turned(x)).astype(np.float32)
        squares, one = (short * short).sum(1), np.ones((len(x), 1), np.float32)
        self.x, self.size, self.largest = x, short.shape[1], squares.max(initial=0)
        # their product is the squared distance
        self.left, self.right = np.hstack([-2 * short, one, squares[:, None]]), np.hstack([short, squares[:, None], one]).T


def _near(a: _Rows, b: _Rows, rows: np.ndarray, others: np.ndarray, limit: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Pairs of ``rows`` of a and ``others`` of b below the limit as (row, other, squared distance), and how many pairs were compared in full, tile by tile.

    With ``same``, both are the same rows, and each pair comes once.
    """
    # what 32-bit sums of so many products may be off by
    slack = (a.size + 8) * 2.0**-22 * (a.largest + b.largest) + 1e-12
    right = np.ascontiguousarray(b.right[:, others])
    step = max(1, 4_000_000 // max(1, a.x.shape[1]))
    for top in range(0, len(rows), TILE):
        left = a.left[rows[top : top + TILE]]
        for start in range(top if same else 0, len(others), TILE):
            bound = left @ right[:, start : start + TILE]
            i, j = np.divmod(np.flatnonzero(bound < limit + slack), bound.shape[1])
            i, j = i + top, j + start
            if same and start == top:
                i, j = i[i < j], j[i < j]
            i, j = rows[i], others[j]
            d = np.empty(len(i))
            for at in range(0, len(i), step):
                d[at : at + step] = ((a.x[i[at : at + step]] - b.x[j[at : at + step]]) ** 2).sum(1)
            good = d < limit
            yield i[good], j[good], d[good], len(i)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as links a, b: each node with the smallest of its component."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for side in (u, v, label[u], label[v]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


class _Cells:
    """Pivots, the radius of each cell, and the threshold: which vectors have something near them in a cell."""

    def __init__(self, pivots: np.ndarray, radius: np.ndarray, threshold: float):
        self.pivots, self.radius, self.threshold = pivots, radius, threshold
        self.between = np.sqrt(_squares(pivots, pivots))

    def near(self, own: np.ndarray, home: np.ndarray, away: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether a vector is near a cell, given squared distances ``away`` to the pivots of ``cells`` and ``own`` to its own one."""
        slack = 1e-9 * (1 + max(away.max(initial=0), own.max(initial=0)))
        plane = away - own[:, None] <= 2 * self.threshold * self.between[home][:, cells] + slack
        return plane & (np.sqrt(away) <= self.radius[cells] + self.threshold + np.sqrt(slack))


def _compare(axes: _Axes, cells: _Cells, result: str, apart: bool = False):
    """Compare a pair of blocks, cell by cell; with ``apart``, equal numbers aren't one block. Members of a core aren't compared with each other."""
    limit = cells.threshold * cells.threshold
    schema = pa.schema([(n, pa.float64() if k == "double" else pa.int64()) for n, k in (c.split() for c in result.split(", "))])
    out = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def meetings(v: np.ndarray, home: np.ndarray, core: np.ndarray, left: np.ndarray, same: bool):
        """Rows and others that are compared with each other, and whether they are the same rows."""
        unit = home * 2 + core
        residents = np.flatnonzero(left)
        residents = residents[np.argsort(unit[residents], kind="stable")]
        guests = residents if same else np.flatnonzero(~left)
        own = ((v[guests] - cells.pivots[home[guests]]) ** 2).sum(1)
        starts = np.flatnonzero(np.diff(unit[residents], prepend=-1))
        for at, end in zip(starts, [*starts[1:], len(residents)]):
            rows, this = residents[at:end], unit[residents[at]]
            if same and not core[rows[0]]:
                yield rows, rows, True
            later = slice(end if same else 0, None)
            some, cell = guests[later], np.array([this // 2])
            goes = cells.near(own[later], home[some], ((v[some] - cells.pivots[cell]) ** 2).sum(1)[:, None], cell)[:, 0]
            some = some[goes & ~(core[some] & (unit[some] == this))]
            if len(some):
                yield rows, some, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        left, core = (table.column(n).to_numpy(zero_copy_only=False).astype(bool) for n in ("is_left", "core"))
        same = not apart and table.column("a")[0].as_py() == table.column("b")[0].as_py()
        ids, nodes, home, v = table.column("id").to_numpy(), table.column("node").to_numpy(), table.column("home").to_numpy(), _matrix(table.column("vector"))
        del table
        known, met, compared, linked, links, held = _Rows(v, axes), 0, 0, 0, [], 0
        for rows, others, one in meetings(v, home, core, left, same):
            met += len(rows) * (len(rows) - 1) // 2 if one else len(rows) * len(others)
            for i, j, d, tried in _near(known, known, rows, others, limit, one):
                compared, linked = compared + tried, linked + len(i)
                if result == PAIRS and len(i):
                    p, q = ids[i], ids[j]
                    yield out(np.minimum(p, q), np.maximum(p, q), d)
                elif result == LINKS:
                    p, q = nodes[i], nodes[j]
                    links.append((p[p != q], q[p != q]))
                    held += len(links[-1][0])
                    if held > 4 * len(v) + 1_000_000:
                        links = [_stars(*map(np.concatenate, zip(*links)))]
                        held = len(links[0][0])
        if result == COUNTS:
            yield out([met], [compared], [linked])
        elif links:
            yield out(*_stars(*map(np.concatenate, zip(*links))))

    return run


def _homes(pivots: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                d = _squares(_matrix(batch.column("vector")), pivots)
                home = d.argmin(1)
                own = [pa.array(home.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(d)), home]))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "home", "away"])

    return run


def _visits(cells: _Cells, layout: list[tuple[int, bool, int, int]], every: bool = False):
    """Blocks with something near a vector: those of smaller number than its own ``block``, or with ``every`` all. A layout is that of ``_layout``."""
    own_cell, in_core = np.array([r[0] for r in layout]), np.array([r[1] for r in layout])
    has = np.zeros((len(layout), 1 + max(r[2] + r[3] - 1 for r in layout)), np.float32)
    for k, (_, _, first, parts) in enumerate(layout):
        has[k, first : first + parts] = 1

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _squares(_matrix(batch.column("vector")), cells.pivots)
            home = batch.column("home").to_numpy()
            goes = cells.near(d[np.arange(len(d)), home], home, d, np.arange(len(cells.pivots)))[:, own_cell]
            if not every:
                core = batch.column("core").to_numpy(zero_copy_only=False).astype(bool)
                goes &= ~(core[:, None] & in_core & (home[:, None] == own_cell))
            blocks = goes.astype(np.float32) @ has > 0
            if not every:
                blocks &= np.arange(blocks.shape[1]) < batch.column("block").to_numpy()[:, None]
            at = np.concatenate([[0], np.cumsum(blocks.sum(1))]).astype(np.int32)
            visits = pa.ListArray.from_arrays(pa.array(at), pa.array(np.nonzero(blocks)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, visits], [*batch.schema.names, "visits"])

    return run


def _layout(rows: dict[tuple[int, bool], int]) -> list[tuple[int, bool, int, int]]:
    """Cells and cores dealt to blocks: (cell, core, first block, number of blocks) for each (cell, core) with so many rows. Small ones share a block, large ones are cut into several."""
    size = max(BLOCK, -(-sum(rows.values()) // PARTS))
    out, last, filled = [], -1, size
    for (cell, core), n in sorted(rows.items()):
        if n > size:
            continue
        if filled + n > size:
            last, filled = last + 1, 0
        filled += n
        out.append((cell, core, last, 1))
    for (cell, core), n in sorted(rows.items()):
        if n > size:
            parts = -(-n // size)
            out.append((cell, core, last + 1, parts))
            last += parts
    return out


def _with_block(rows: DataFrame, layout: list[tuple[int, bool, int, int]]) -> DataFrame:
    """Rows (id, home, core) with their ``block``."""
    places = rows.sparkSession.createDataFrame(layout, "home int, core boolean, first int, parts int")
    placed = rows.join(F.broadcast(places), ["home", "core"])  # at most two rows a pivot
    return placed.withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")).drop("first", "parts")


def _fields(table: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)


def _classes(vectors: DataFrame, item: str, vector: str) -> tuple[DataFrame, DataFrame] | None:
    """(classes with id, n, vector; copies as id, rep). A class's id is its smallest; copies are its other members."""
    length = dominant_length(vectors, vector)
    if length is None:
        return None
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where((F.size(vector) == length) & ~odd).select(F.col(item).cast("bigint").alias("id"), F.col(vector).alias("vector")).where("id IS NOT NULL")
    classes = materialise(rows.groupBy("vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "sim-classes")
    copies = join_counted(rows, classes.where("n > 1").select("vector", "n", F.col("id").alias("rep")), ["vector"]).where("id <> rep").select("id", "rep").distinct()
    return classes.select("id", "n", "vector"), materialise(copies, "sim-copies")


def _joined(classes: DataFrame, threshold: float, result: str) -> DataFrame:
    """Pairs, links (with those of cores) or counts of comparisons of distinct vectors."""
    spark = classes.sparkSession
    cores = result != PAIRS
    n = classes.count()
    if not n:
        return spark.createDataFrame([], result)
    sample = classes.orderBy(F.xxhash64("vector"), "id").limit(PIVOTS).select("vector").collect()  # at most PIVOTS rows
    sample = np.array([r["vector"] for r in sample], np.float64)
    axes = _Axes(sample, threshold * threshold)
    pivots = sample[: max(1, min(PIVOTS, n // (BLOCK // 2)))]
    pivots = pivots[np.argsort(axes.turned(pivots)[:, 0])]  # neighbours in one block
    kind = classes.schema["vector"].dataType.simpleString()
    homes = classes.select("id", "vector").mapInArrow(_homes(pivots), f"id bigint, vector {kind}, home int, away double")
    homes = materialise(homes.withColumn("close", (F.col("away") < threshold / 2 * (1 - 1e-9)) if cores else F.lit(False)), "sim-homes")
    found = homes.groupBy("home", "close").agg(F.count(F.lit(1)).alias("rows"), F.max("away").alias("radius"), F.min("id").alias("hub")).collect()  # at most two rows a pivot
    crowded = {r["home"] for r in found if r["close"] and r["rows"] >= CORE}
    radius, rows, hubs = np.full(len(pivots), -np.inf), Counter(), {}
    for r in found:
        radius[r["home"]] = max(radius[r["home"]], r["radius"])
        rows[r["home"], r["close"] and r["home"] in crowded] += r["rows"]
        if r["close"]:
            hubs[r["home"]] = r["hub"]
    homes = homes.withColumn("core", F.col("close") & F.col("home").isin(crowded) if crowded else F.lit(False)).drop("close")
    layout, cells = _layout(rows), _Cells(pivots, radius, threshold)
    hub = F.broadcast(spark.createDataFrame([(c, k) for c, k in hubs.items() if c in crowded], "home int, hub bigint"))  # one row a pivot at most
    own = _with_block(homes, layout).join(hub, "home", "left").select("id", F.when(F.col("core"), F.col("hub")).otherwise(F.col("id")).alias("node"), "vector", "home", "core", "block")
    placed = materialise(own.mapInArrow(_visits(cells, layout), f"{_fields(own)}, visits array<int>"), "sim-placed")
    visits = placed.withColumn("a", F.explode("visits"))
    meetings = visits.select("a", F.col("block").alias("b")).unionAll(placed.select(F.col("block").alias("a"), F.col("block").alias("b"))).distinct()
    meetings = materialise(meetings, "sim-meetings")  # at most the square of the number of blocks
    columns = ["a", "b", "is_left", "id", "node", "home", "core", "vector"]
    residents = placed.join(F.broadcast(meetings), F.col("block") == F.col("a")).withColumn("is_left", F.lit(True)).select(columns)
    guests = visits.withColumns({"b": F.col("block"), "is_left": F.lit(False)}).select(columns)
    found = residents.unionAll(guests).groupBy("a", "b").applyInArrow(_compare(axes, cells, result), result)
    if result != LINKS:
        return found
    found = materialise(found.unionAll(homes.where("core").join(hub, "home").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))), "sim-links")
    discard(placed, meetings)
    return found


def _checked(threshold: float) -> None:
    if threshold < 0:
        raise ValueError("a distance threshold can't be negative")


def similarity_links(vectors: DataFrame, threshold: float, item: str = "id", vector: str = "fprint") -> DataFrame:
    """Links a, b with the same connected components as all pairs with a distance below ``threshold``.

    Copies and cores are stars and each pair of blocks gives a forest, so rows don't grow with the square of a group's size. Vectors that are null or empty, of a length other than
    the dominant one, or with null or non-finite components take no part, nor do rows without an id. A negative threshold raises ValueError; none is below 0.
    """
    _checked(threshold)
    spark = vectors.sparkSession
    ship(spark)
    found = _classes(vectors, item, vector) if threshold > 0 else None
    if found is None:
        return spark.createDataFrame([], LINKS)
    classes, copies = found
    return _joined(classes, threshold, LINKS).unionAll(copies.select(F.col("rep").alias("a"), F.col("id").alias("b")))


def similarity_pairs(vectors: DataFrame, threshold: float, item: str = "id", vector: str = "fprint") -> DataFrame:
    """All pairs a < b with squared distance below threshold squared: a, b, distance2 (in double precision).

    Who takes part is as in ``similarity_links``. All pairs of copies are among the rows; use the links where components are enough.
    """
    _checked(threshold)
    spark = vectors.sparkSession
    ship(spark)
    found = _classes(vectors, item, vector) if threshold > 0 else None
    if found is None:
        return spark.createDataFrame([], PAIRS)
    classes, copies = found
    pairs = _joined(classes, threshold, PAIRS)
    if copies.isEmpty():
        return pairs
    reps = classes.where("n > 1").select("id", F.col("id").alias("rep"))
    members = copies.unionByName(reps)
    side = lambda name: members.select(F.col("rep").alias(name), F.col("id").alias(f"own_{name}"))
    wide = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("own_a", "a").alias("p"), F.coalesce("own_b", "b").alias("q"), "distance2")
    inside = side("a").join(side("a").withColumnRenamed("own_a", "other"), "a").where("own_a < other").select(F.col("own_a").alias("p"), F.col("other").alias("q"), F.lit(0.0).alias("distance2"))
    return wide.unionAll(inside).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "distance2")


def similarity_work(vectors: DataFrame, threshold: float, item: str = "id", vector: str = "fprint") -> DataFrame:
    """One row: distinct vectors, and pairs of them that ``similarity_links`` brings together, compares in full and links."""
    _checked(threshold)
    ship(vectors.sparkSession)
    found = _classes(vectors, item, vector)
    classes = found[0] if found else vectors.sparkSession.createDataFrame([], "id bigint, n bigint, vector array<float>")
    work = _joined(classes, threshold, COUNTS)
    return work.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("met", "compared", "linked")]).withColumn("vectors", F.lit(classes.count()))


class Clusters:
    """Near-duplicate clusters that grow batch by batch: a folder with pivots, vectors by cell, and labels.

    A batch is compared with itself, and with the blocks of earlier vectors in the cells near each of its vectors; links then join labels. Every table of a batch is written
    under its number, so a batch that is delivered again is the same batch. Pivots come from the first batch that has vectors; any pivots give right results. All vectors must
    be of one length, that of the pivots; others take no part, nor do those with null or non-finite components.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: float):
        _checked(threshold)
        self.spark, self.path, self.threshold = spark, path.rstrip("/"), threshold
        ship(spark)

    def _numbers(self, name: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = [s.getPath() for s in fs.listStatus(folder)]
        return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _before(self, name: str, batch: int, schema: str) -> DataFrame:
        earlier = [f"{self.path}/{name}/batch={b}" for b in self._numbers(name) if b < batch]
        return self.spark.read.schema(schema).parquet(*earlier) if earlier else self.spark.createDataFrame([], schema)

    def _write(self, table: DataFrame, name: str, batch: int) -> None:
        table.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def labels(self, batch: int | None = None) -> DataFrame:
        """node, root (its cluster's smallest id) of all vectors in clusters, after a batch or after all."""
        done = [b for b in self._numbers("labels") if batch is None or b <= batch]
        return self.spark.read.schema("node bigint, root bigint").parquet(f"{self.path}/labels/batch={done[-1]}") if done else self.spark.createDataFrame([], "node bigint, root bigint")

    def _pivots(self, batch: int, rows: DataFrame) -> np.ndarray:
        kept = self._numbers("pivots")
        if not kept:
            n = rows.count()
            some = rows.orderBy(F.xxhash64("vector"), "id").limit(max(1, min(PIVOTS, n // (BLOCK // 8))))
            self._write(some.select("vector").distinct(), "pivots", batch)
            kept = self._numbers("pivots")
        found = self.spark.read.parquet(f"{self.path}/pivots/batch={kept[0]}").collect()  # at most PIVOTS rows
        return np.array(sorted(list(r["vector"]) for r in found), np.float64)

    def add(self, vectors: DataFrame, batch: int, item: str = "id", vector: str = "fprint") -> None:
        """Take a batch in: ids that are new, and their vectors."""
        odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        rows = vectors.where((F.size(vector) > 0) & ~odd).select(F.col(item).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("id IS NOT NULL")
        rows = materialise(rows, "batch")
        if rows.isEmpty():
            return
        pivots = self._pivots(batch, rows)
        rows = rows.where(F.size("vector") == pivots.shape[1])
        placed = "id bigint, vector array<double>, home int, away double"
        self._write(rows.mapInArrow(_homes(pivots), placed), "vectors", batch)
        new = self.spark.read.schema(placed).parquet(f"{self.path}/vectors/batch={batch}")
        old = self._before("vectors", batch, placed)
        cells = old.groupBy("home").agg(F.count(F.lit(1)).alias("rows"), F.max("away").alias("radius")).collect()  # one row a pivot
        links = similarity_links(new, self.threshold, "id", "vector") if self.threshold > 0 else self.spark.createDataFrame([], LINKS)
        if cells and self.threshold > 0:
            radius = np.full(len(pivots), -np.inf)
            for r in cells:
                radius[r["home"]] = r["radius"]
            near, no = _Cells(pivots, radius, self.threshold), F.lit(False)
            layout = _layout({(r["home"], False): r["rows"] for r in cells})
            n = new.count()
            mine = F.pmod(F.xxhash64("id"), F.lit(-(-n // max(BLOCK, -(-n // PARTS))))).cast("int").alias("b")
            right = new.mapInArrow(_visits(near, layout, True), placed + ", visits array<int>").select(F.explode("visits").alias("a"), mine, no.alias("is_left"), "id", F.col("id").alias("node"), "home", no.alias("core"), "vector")
            right = materialise(right, "batch-guests")
            held = _with_block(old.withColumn("core", no), layout).select(F.col("block").alias("a"), F.lit(True).alias("is_left"), "id", F.col("id").alias("node"), "home", "core", "vector")
            left = held.join(F.broadcast(right.select("a", "b").distinct()), "a")  # at most the square of the number of blocks
            both = left.unionByName(right).groupBy("a", "b").applyInArrow(_compare(_Axes(pivots, self.threshold * self.threshold), near, LINKS, True), LINKS)
            links = links.unionAll(both)
        links = materialise(links, "batch-links")
        before = self.labels(batch - 1)
        # links between labels: an id outside all clusters is its own
        root = lambda c: links.select(c).distinct().join(before, F.col(c) == F.col("node"), "left").select(F.col(c), F.coalesce("root", c).alias(f"root_{c}"))
        between = materialise(links.join(root("a"), "a").join(root("b"), "b").select("root_a", "root_b"), "batch-roots")
        merged = materialise(connected_components(between, "root_a", "root_b"), "batch-merged")
        moved = before.join(merged.withColumnRenamed("node", "was").withColumnRenamed("root", "now"), F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root"))
        fresh = merged.join(before.select("node"), "node", "left_anti").select("node", "root")
        self._write(moved.unionByName(fresh), "labels", batch)
