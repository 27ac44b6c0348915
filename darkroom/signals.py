"""The registry of detection signals: one table that drives reasons, tiers, facets and albums."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """Fixed defaults of the limits."""

    blur: float = 100.0
    blur_hard: float = 35.0
    dark: float = 50.0
    dark_hard: float = 25.0
    contrast: float = 18.0
    noise: float = 7.0
    aesthetic: float = -0.10
    clip: float = 0.55
    face: float = 0.30


def _below(name: str, limit: float) -> Column:
    # null and NaN never flag
    return F.coalesce(F.col(name) < F.lit(limit), F.lit(False))


def _above(name: str, limit: float, equal: bool = False) -> Column:
    c = F.col(name)
    return F.coalesce(~F.isnan(c) & ((c >= F.lit(limit)) if equal else (c > F.lit(limit))), F.lit(False))


@dataclass(frozen=True)
class Signal:
    """A detection: its reasons, mildest first, and conditions under thresholds.

    ``soft`` gives the reason; ``hard`` turns it into the second reason and decides the tier by itself.
    """

    key: str
    label: str
    reasons: tuple[str, ...]
    needs_model: bool
    soft: Callable[[Thresholds], Column]
    hard: Callable[[Thresholds], Column] | None = None
    alone: bool = False


SIGNALS: dict[str, Signal] = {}


def register_signal(signal: Signal) -> None:
    """Add a detection; facets, albums and reasons follow."""
    SIGNALS[signal.key] = signal


# Keys, labels and reasons of the detections, in order.
for _s in (
    Signal("blur", "Blurry", ("blurry", "very_blurry"), False, lambda t: _below("sharpness", t.blur), lambda t: _below("sharpness", t.blur_hard)),
    Signal("dark", "Too dark", ("dark", "very_dark"), False, lambda t: _below("brightness", t.dark), lambda t: _below("brightness", t.dark_hard)),
    Signal("contrast", "Low contrast", ("low_contrast",), False, lambda t: _below("contrast", t.contrast)),
    Signal("noise", "Noisy", ("noisy",), False, lambda t: _above("noise", t.noise)),
    Signal("exposure", "Bad exposure", ("bad_exposure",), False, lambda t: _above("black_frac", t.clip, True) | _above("white_frac", t.clip, True)),
    Signal("aesthetic", "Low aesthetic", ("low_aesthetic",), True, lambda t: _below("aesthetic", t.aesthetic)),
    Signal("utility", "Utility/screenshot", ("utility",), True, lambda t: F.coalesce(F.col("is_utility"), F.lit(False))),
    Signal("face", "Poor face capture", ("low_face_quality",), True, lambda t: _below("face_quality", t.face), alone=True),
):
    register_signal(_s)

# Labels of tiers.
TIER_LABELS = {"delete": "Delete candidates", "duplicate": "Duplicates", "review": "Review"}


def reason_table(spark: SparkSession) -> DataFrame:
    """reason, signal, label, needs_model, ord: one row a reason (small by construction)."""
    rows = [(r, s.key, s.label, s.needs_model, i) for i, s in enumerate(SIGNALS.values()) for r in s.reasons]
    return spark.createDataFrame(rows, "reason string, signal string, label string, needs_model boolean, ord int").coalesce(1)


def flag(key: str, enabled: frozenset[str], t: Thresholds, hard: bool = False) -> Column:
    """Whether an enabled signal fires; a disabled one is a constant that the optimiser folds away."""
    s = SIGNALS.get(key)
    condition = s and (s.hard if hard else s.soft)
    return condition(t) if condition and key in enabled else F.lit(False)


def reasons(enabled: frozenset[str], t: Thresholds = Thresholds()) -> Column:
    """Reasons in registry order; a hard reason replaces the soft one."""
    parts = []
    for s in SIGNALS.values():
        if s.key in enabled:
            text = F.when(s.hard(t), F.lit(s.reasons[1])).otherwise(F.lit(s.reasons[0])) if s.hard else F.lit(s.reasons[0])
            parts.append(F.when(s.soft(t), text))
    return F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")


def tier(enabled: frozenset[str], t: Thresholds = Thresholds()) -> Column:
    """delete, review or keep. A hard limit decides alone, also where it lies above the soft one."""
    fires = lambda k, hard=False: flag(k, enabled, t, hard)
    strong = fires("blur", True) | fires("dark", True) | (fires("blur") & (fires("dark") | fires("exposure") | fires("contrast")))
    for s in SIGNALS.values():
        if s.alone:
            strong = strong | fires(s.key)
    return F.when(strong, "delete").when(F.size(reasons(enabled, t)) > 0, "review").otherwise("keep")


def with_verdict(metrics: DataFrame, enabled: frozenset[str] | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """Add reasons and recommendation. Rows with an error keep no reasons and are ``error``."""
    enabled = frozenset(SIGNALS) if enabled is None else enabled
    failed = F.coalesce(F.col("error"), F.lit("")) != "" if "error" in metrics.columns else F.lit(False)
    return metrics.withColumns(
        {
            "recommendation": F.when(failed, "error").otherwise(tier(enabled, t)),
            "reasons": F.when(failed, F.array().cast("array<string>")).otherwise(reasons(enabled, t)),
        }
    )
