"""Path and text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    """The part after the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """The part before the last slash; empty if there is none."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """The last extension with its dot; a leading dot starts no extension."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    """The base name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def is_under(path: Column, folder: str) -> Column:
    """Whether a path is a folder or lies in it."""
    return (path == folder.rstrip("/")) | path.startswith(folder.rstrip("/") + "/")


def whole_or_zero(text: Column) -> Column:
    """A whole number from text; anything else is 0."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?\d+$"), F.expr("1") * t.try_cast("bigint")).otherwise(F.lit(0)).cast("bigint")


def number_or_zero(text: Column) -> Column:
    """A number from text; anything else is 0."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def human_bytes(n: Column) -> Column:
    """Bytes in steps of 1024 with one decimal, B to PB."""
    out = F.lit(None).cast("string")
    for i, unit in enumerate(("B", "KB", "MB", "GB", "TB", "PB")):
        value = n.cast("double") / float(1024**i)
        text = F.concat(F.format_string("%.1f", value), F.lit(" " + unit))
        out = F.coalesce(out, text) if unit == "PB" else F.coalesce(out, F.when(value < 1024, text))
    return out
