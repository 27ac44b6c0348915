"""Joins whose frequent keys don't meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.runtime import materialise

#: Keys that are joined by broadcast at most, and rows that such a key has at least.
MOST, LEAST = 4096, 1024


def join_counted(big: DataFrame, small: DataFrame, keys: list[str], count: str = "n", how: str = "inner", most: int = MOST, least: int = LEAST) -> DataFrame:
    """``big`` joined with ``small``, which has one row a key and says in ``count`` how many rows of ``big`` have it.

    The up to ``most`` most frequent keys of ``least`` rows or more are broadcast, so their rows stay where they are; all others are joined
    by whatever way Spark plans. A key beyond ``most`` holds less than 1 / ``most`` of all rows. ``how`` is inner or left; null keys match nothing.
    """
    hot = materialise(small.where(F.col(count) >= least).orderBy(F.desc(count), *keys).limit(most), "hot-keys")
    if hot.isEmpty():
        return big.join(small, keys, how)
    apart = big.join(F.broadcast(hot), keys)  # at most ``most`` rows
    rest = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(small, keys, how)
    return apart.unionByName(rest)
