"""The CSV report as sink and source."""

from __future__ import annotations

import shlex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.functions.paths import number_or_zero, whole_or_zero
from darkroom.operators.report import report_rows, worst_first
from darkroom.schema import REPORT_FIELDS


def write_report(photos: DataFrame, path: str, files: int | None = None) -> None:
    """Write judged photos worst first, as CSV with a header in each file; ``files`` = 1 gives one."""
    ordered = photos.orderBy(*worst_first())
    rows = report_rows(ordered.coalesce(files) if files else ordered)
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report with types: bad numbers are 0, blank scores null, reasons an array."""
    raw = spark.read.option("header", True).option("escape", '"').schema(", ".join(f"{c} string" for c in REPORT_FIELDS)).csv(path)
    text = lambda c: F.coalesce(c, F.lit(""))
    out = {}
    for c in REPORT_FIELDS:
        v = F.col(c)
        if c in ("width", "height", "cluster_size"):
            out[c] = whole_or_zero(v).cast("int")
        elif c == "cluster_id":
            out[c] = F.coalesce(v.try_cast("int"), F.lit(-1))
        elif c == "file_bytes":
            out[c] = whole_or_zero(v)
        elif c in ("aesthetic", "face_quality"):
            out[c] = v.try_cast("double")
        elif c in ("sharpness", "brightness", "contrast", "noise", "black_frac", "white_frac", "megapixels"):
            out[c] = number_or_zero(v)
        elif c in ("is_keeper", "is_utility"):
            out[c] = F.when(v == "True", True).when(v == "False", False)
        elif c == "reasons":
            out[c] = F.filter(F.split(text(v), ";"), lambda x: x != "")
        else:
            out[c] = text(v)
    return raw.select(*[x.alias(c) for c, x in out.items()])


def options_of_line(line: str) -> list[str]:
    """Arguments of a line of an options file, as a shell reads them; none in an empty line or a comment."""
    return [] if line.lstrip().startswith("#") else shlex.split(line)
