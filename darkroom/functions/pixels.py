"""Image metrics twice: as column expressions over a row-major pixel array, and as one NumPy kernel for decoded images."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BLACK, WHITE = 5, 250
LONGEST_EDGE, CROP = 1024, 768
NOISE_SCALE = math.sqrt(math.pi / 2) / 6


def _interior(px: str, w: str, h: str, mask: list[list[int]]) -> str:
    """Values of a 3x3 mask over all interior pixels."""
    terms = [f"{m} * {px}[p + {dy} * ({w}) + {dx}]" for dy, row in zip((-1, 0, 1), mask) for dx, m in zip((-1, 0, 1), row) if m]
    inner = f"(({w}) - 2) * (({h}) - 2)"
    return f"transform(sequence(0, {inner} - 1), k -> ((k div (({w}) - 2)) + 1) * ({w}) + (k % (({w}) - 2)) + 1)", " + ".join(terms)


def _apply(px: str, w: str, h: str, mask: list[list[int]]) -> str:
    at, term = _interior(px, w, h, mask)
    return f"transform({at}, p -> {term})"


LAPLACIAN = [[0, 1, 0], [1, -4, 1], [0, 1, 0]]
NOISE = [[1, -2, 1], [-2, 4, -2], [1, -2, 1]]


def _mean(a: str) -> str:
    return f"(aggregate({a}, 0D, (s, x) -> s + x) / size({a}))"


def sharpness(px: str = "px", w: str = "w", h: str = "h") -> Column:
    """Population variance of the Laplacian over the interior; NaN for sides under 3."""
    lap = _apply(px, w, h, LAPLACIAN)
    two = f"aggregate({lap}, struct(0D AS n, 0D AS m, 0D AS q), (s, x) -> struct(s.n + 1 AS n, s.m + (x - s.m) / (s.n + 1) AS m, s.q + (x - s.m) * (x - (s.m + (x - s.m) / (s.n + 1))) AS q), s -> s.q / s.n)"
    return F.expr(f"CASE WHEN ({w}) < 3 OR ({h}) < 3 THEN double('NaN') ELSE {two} END")


def noise(px: str = "px", w: str = "w", h: str = "h") -> Column:
    """Immerkaer's noise sigma over the interior; 0 for sides under 3."""
    return F.expr(f"CASE WHEN ({w}) < 3 OR ({h}) < 3 THEN 0D ELSE {NOISE_SCALE!r}D * {_mean(f'transform({_apply(px, w, h, NOISE)}, x -> abs(x))')} END")


def brightness(px: str = "px") -> Column:
    """Mean luminance."""
    return F.expr(_mean(px))


def contrast(px: str = "px") -> Column:
    """Population standard deviation of luminance."""
    return F.expr(
        f"sqrt(aggregate({px}, struct(0D AS n, 0D AS m, 0D AS q), (s, x) -> struct(s.n + 1 AS n, s.m + (x - s.m) / (s.n + 1) AS m, s.q + (x - s.m) * (x - (s.m + (x - s.m) / (s.n + 1))) AS q), s -> s.q / s.n))"
    )


def clipped(px: str = "px", white: bool = False) -> Column:
    """Share of pixels at or beyond the clipping limit."""
    test = f"x >= {WHITE}" if white else f"x <= {BLACK}"
    return F.expr(f"size(filter({px}, x -> {test})) / size({px})")


def gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Rec. 601 luminance of a decoded image (blue, green, red order), as 0 to 255 floats."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return a[:, :, 0] if channels == 1 else 0.114 * a[:, :, 0] + 0.587 * a[:, :, 1] + 0.299 * a[:, :, 2]


def shrink(g: np.ndarray, longest: int = LONGEST_EDGE) -> np.ndarray:
    """A box-filtered copy whose longer edge is ``longest``; never enlarged."""
    h, w = g.shape
    scale = longest / max(h, w)
    if scale >= 1:
        return g
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
    rows = np.add.reduceat(g, np.arange(nh) * h // nh, axis=0) / np.diff(np.append(np.arange(nh) * h // nh, h))[:, None]
    return np.add.reduceat(rows, np.arange(nw) * w // nw, axis=1) / np.diff(np.append(np.arange(nw) * w // nw, w))[None, :]


def centre_crop(g: np.ndarray, side: int = CROP) -> np.ndarray:
    """The native-resolution middle, at most ``side`` squared."""
    h, w = g.shape
    ch, cw = min(h, side), min(w, side)
    y, x = (h - ch) // 2, (w - cw) // 2
    return g[y : y + ch, x : x + cw]


def _stencil(g: np.ndarray, mask: list[list[int]]) -> np.ndarray:
    h, w = g.shape
    out = np.zeros((max(h - 2, 0), max(w - 2, 0)))
    for dy, row in enumerate(mask):
        for dx, m in enumerate(row):
            if m:
                out += m * g[dy : h - 2 + dy, dx : w - 2 + dx]
    return out


def classical(g: np.ndarray) -> dict[str, float]:
    """All pixel metrics of a gray image, rounded the way verdicts compare them (half to even on the exact value)."""
    small, native = shrink(g), centre_crop(g)
    tiny = min(small.shape) < 3
    sharp = float("nan") if tiny else float(_stencil(small, LAPLACIAN).var())
    sigma = 0.0 if min(native.shape) < 3 else float(NOISE_SCALE * np.abs(_stencil(native, NOISE)).mean())
    return {
        "sharpness": sharp if tiny else round(sharp, 1), "brightness": round(float(small.mean()), 1), "contrast": round(float(small.std()), 1),
        "black_frac": round(float((small <= BLACK).mean()), 3), "white_frac": round(float((small >= WHITE).mean()), 3), "noise": round(sigma, 2),
    }


def stand_in_embedding(g: np.ndarray, rows: int = 24, columns: int = 32) -> np.ndarray:
    """A deterministic 768-number fingerprint: mean-pooled luminance, unit length. Not comparable with any model's."""
    h, w = g.shape
    y, x = np.arange(rows + 1) * h // rows, np.arange(columns + 1) * w // columns
    y, tall, x, wide = y[:-1], np.maximum(np.diff(y), 1), x[:-1], np.maximum(np.diff(x), 1)
    # where a cell has no line or column of its own, this takes the one that it begins in
    sums = np.add.reduceat(np.add.reduceat(g, y, axis=0, dtype=np.float64), x, axis=1)
    v = (sums / (tall[:, None] * wide[None, :])).ravel().astype(np.float32)
    n = np.linalg.norm(v)
    return v / n if n else v
