"""Thresholds, options and the set of enabled signals: the parameters of a run."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from darkroom.signals import SIGNALS


def resolve_signals(include: str | None = None, exclude: str | None = None) -> frozenset[str]:
    """Enabled signals: the included ones (all by default) without the excluded ones.

    Unknown names raise ValueError before any job runs, and so does an empty result.
    """
    wanted, unwanted = ([x for x in map(str.strip, (text or "").split(",")) if x] for text in (include, exclude))
    unknown = sorted({*wanted, *unwanted} - SIGNALS.keys())
    if unknown:
        raise ValueError(f"no such signals: {', '.join(unknown)} (there are {', '.join(SIGNALS)})")
    enabled = frozenset(wanted or SIGNALS) - frozenset(unwanted)
    if not enabled:
        raise ValueError("no signal is enabled")
    return enabled


@dataclass(frozen=True)
class RunOptions:
    """What a run computes and returns."""

    enabled: frozenset[str] = field(default_factory=lambda: frozenset(SIGNALS))
    with_models: bool = True
    with_faces: bool = True
    dedupe: bool = False
    dedupe_threshold: float = 0.3
    include_review: bool = False

    def __post_init__(self):
        if self.dedupe_threshold < 0:
            raise ValueError("a distance threshold can't be negative")
        if self.dedupe and not self.with_models:
            raise ValueError("dedupe needs fingerprints, which need the models")

    @property
    def wanted_outputs(self) -> frozenset[str]:
        """Model outputs that this run uses; others aren't computed."""
        out = set()
        if self.with_models:
            out |= {"aesthetic"} & self.enabled | ({"is_utility"} if "utility" in self.enabled else set())
            if self.with_faces and "face" in self.enabled:
                out.add("face_quality")
        if self.dedupe:
            out.add("fprint")
        return frozenset(out)

    @property
    def sink_tiers(self) -> tuple[str, ...]:
        """Tiers that are moved or put in albums."""
        return ("delete", "duplicate") + (("review",) if self.include_review else ())


def session_label(now: datetime, pattern: str = "%Y-%m-%d-%H-%M") -> str:
    """A session's name; a pattern that can't be used gives way to the default."""
    try:
        return now.strftime(pattern)
    except ValueError:
        return now.strftime("%Y-%m-%d-%H-%M")


def album_title(template: str, prefix: str, date: str, tier: str) -> str:
    """An album's title. The template must hold {tier}; unknown fields raise ValueError."""
    if "{tier}" not in template:
        raise ValueError("the template must hold {tier}")
    try:
        return template.format(prefix=prefix, date=date, tier=tier)
    except (KeyError, IndexError) as e:
        raise ValueError(f"unknown field in the template: {e}") from e
