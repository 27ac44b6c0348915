"""Image files as DataFrames: listings without pixels, and decoded metrics."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from darkroom.functions import pixels
from darkroom.functions.paths import is_under, suffix
from darkroom.runtime import many_files, materialise, scratch_path, shuffle_partitions, ship
from darkroom.schema import IMAGE_EXTENSIONS, METRICS


def has_image_extension(path: Column) -> Column:
    """Whether a path has one of the scanned extensions, in any case."""
    return F.lower(suffix(path)).isin(*IMAGE_EXTENSIONS)


def first_of_each(rows: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def scan(spark: SparkSession, roots: list[str], recursive: bool = False, skip: str | None = None) -> tuple[DataFrame, list[str]]:
    """Files under the roots, and roots that don't exist.

    Folders give their images (all levels if ``recursive``) outside ``skip``; a file named as a root is taken whatever its
    name. Each path comes once, for its first root: root_ord, path, size, mtime. File contents aren't read.
    """
    found, missing = None, []
    for n, root in enumerate(roots):
        if not exists(spark, root):
            missing.append(root)
            continue
        folder = is_folder(spark, root)
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
        listed = listed.select(F.lit(n).alias("root_ord"), plain(F.col("path")).alias("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"))
        if folder:
            listed = listed.where(has_image_extension(F.col("path")))
            if skip:
                listed = listed.where(~is_under(F.col("path"), skip))
        found = listed if found is None else found.unionAll(listed)
    if found is None:
        found = spark.createDataFrame([], "root_ord int, path string, size bigint, mtime bigint")
    return first_of_each(found, "path", "root_ord"), missing


def in_order(listing: DataFrame) -> DataFrame:
    """Rows in the order of roots, then of path parts."""
    return listing.orderBy("root_ord", F.split("path", "/"))


def scan_all(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Paths of all files under a folder, whatever they are."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select(plain(F.col("path")).alias("path"))


#: Paths that one job names to Spark's reader.
SLICE_PATHS = 100_000
#: Bytes of thumbnails that go out at once.
OUT_BYTES = 4 << 20


def _images(paths: DataFrame) -> DataFrame:
    """Spark's image rows of named files (path). Names go from the query to the reader inside the JVM; from a Python list each would be a call."""
    spark = paths.sparkSession
    names = getattr(paths.select("path")._jdf, "as")(spark.sparkContext._jvm.org.apache.spark.sql.Encoders.STRING()).collect()
    return DataFrame(spark._jsparkSession.read().format("image").option("dropInvalid", "false").load(names), spark)


def _over_images(wanted: DataFrame, kernel, schema: str, slice_paths: int) -> DataFrame:
    """Rows that a kernel makes of the decoded files (path, height, width, nChannels, data, file_bytes) of ``wanted`` (path, size).

    Spark's image reader takes paths. They are named slice by slice, each a job of many images, whose rows are added to a written table: only wanted files are
    decoded, and the driver holds the paths of one slice.
    """
    spark = wanted.sparkSession
    rows = wanted.select("path", F.col("size").alias("file_bytes")).dropDuplicates(["path"])
    with many_files(spark, 0):  # a listing reads no contents
        listed = materialise(rows, "wanted")
    total = listed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("file_bytes"), F.lit(0)).alias("mean")).first()
    slices = -(-total["n"] // slice_paths)
    if slices > 1:
        cut = F.pmod(F.xxhash64("path"), F.lit(slices)).cast("int")
        parts = scratch_path(spark, "wanted-slices")
        listed.withColumn("slice", cut).repartition(shuffle_partitions(spark), "slice").write.partitionBy("slice").parquet(parts)
    out = scratch_path(spark, "images")
    for k in range(slices):
        here = listed
        if slices > 1:
            if not exists(spark, f"{parts}/slice={k}"):
                continue
            here = spark.read.schema(listed.schema).parquet(f"{parts}/slice={k}")
        with many_files(spark, total["mean"]):
            images = _images(here).select("image.*").withColumn("path", plain(F.col("origin")))  # one slice
            found = images.join(here, "path").select("path", "height", "width", "nChannels", "data", "file_bytes").mapInArrow(kernel, schema)
            found.write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out) if slices else spark.createDataFrame([], schema)


def analyse(wanted: DataFrame, outputs: frozenset[str] = frozenset(), scorer=None, slice_paths: int = SLICE_PATHS, counter=None) -> DataFrame:
    """Metrics of listed image files (path, size): path and the metric columns. An unreadable file gives a row with ``error``.

    Files are read and decoded once, by Spark's image reader, ``slice_paths`` a job. ``scorer`` maps a gray image to a dict of model outputs; only those in ``outputs`` are kept. Without one,
    ``fprint`` is the stand-in embedding. ``counter`` is an accumulator that counts images.
    """
    ship(wanted.sparkSession)
    return _over_images(wanted, _kernel(frozenset(outputs), scorer, counter), f"path string, {METRICS}", slice_paths)


def thumbnails(wanted: DataFrame, longest: int = 512, slice_paths: int = SLICE_PATHS) -> DataFrame:
    """Small copies of listed image files (path, size), as PNG: path, width, height, png (null if the file can't be decoded).

    The longer edge is ``longest`` pixels at most; images aren't enlarged, colours stay, transparency goes.
    """
    ship(wanted.sparkSession)
    return _over_images(wanted, _thumbnail_kernel(longest), "path string, width int, height int, png binary", slice_paths)


def _thumbnail_kernel(longest: int):
    import numpy as np
    import pyarrow as pa

    from darkroom.functions.png import png_bytes

    def one(path: str, height: int, width: int, channels: int, data: bytes) -> tuple:
        if height <= 0:
            return path, None, None, None
        a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
        planes = [a[:, :, 0]] if channels == 1 else [a[:, :, 2], a[:, :, 1], a[:, :, 0]]
        small = np.stack([np.rint(pixels.shrink(p.astype(np.float64), longest)) for p in planes], axis=-1).astype(np.uint8)
        return path, small.shape[1], small.shape[0], png_bytes(small[:, :, 0] if channels == 1 else small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.string(), pa.int32(), pa.int32(), pa.binary()
        batched = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["path", "width", "height", "png"])
        for batch in batches:
            made, held = [], 0
            for i in range(batch.num_rows):
                made.append(one(*(c[i].as_py() for c in batch.columns[:5])))
                held += len(made[-1][3] or b"")
                if held >= OUT_BYTES:
                    yield batched(made)
                    made, held = [], 0
            if made:
                yield batched(made)

    return run


def plain(path: Column) -> Column:
    """A local path without its scheme."""
    return F.regexp_replace(path, "^file:(//)?", "")


def _kernel(outputs: frozenset[str], scorer, counter=None):
    import pyarrow as pa

    def one(path: str, height: int, width: int, channels: int, data: bytes, size: int) -> dict:
        out = {"path": path, "width": 0, "height": 0, "megapixels": 0.0, "file_bytes": size or 0, "error": "", "sharpness": 0.0, "brightness": 0.0, "contrast": 0.0,
               "noise": 0.0, "black_frac": 0.0, "white_frac": 0.0, "aesthetic": None, "is_utility": None, "face_quality": None, "fprint": None}
        try:
            if height <= 0:
                raise ValueError("the image can't be decoded")
            g = pixels.gray(data, height, width, channels)
            out |= {"width": width, "height": height, "megapixels": round(width * height / 1e6, 2)} | pixels.classical(g)
            scored = scorer(g) if scorer else ({"fprint": pixels.stand_in_embedding(g).tolist()} if "fprint" in outputs else {})
            out |= {k: v for k, v in scored.items() if k in outputs}
        except Exception as e:  # the row survives
            out["error"] = str(e) or type(e).__name__
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<float>": pa.list_(pa.float32())}
        fields = [("path", pa.string())] + [(x.split()[0], kinds[x.split()[1]]) for x in METRICS.split(", ")]
        for batch in batches:
            rows = [one(*(c[i].as_py() for c in batch.columns)) for i in range(batch.num_rows)]
            if counter is not None:
                counter.add(len(rows))
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in fields], [n for n, _ in fields])

    return run
