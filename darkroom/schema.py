"""Column names and types of the pipeline's relations."""

from __future__ import annotations

#: Fixed format: extensions that are scanned, in lower case.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tif", ".tiff", ".webp", ".heic", ".heif", ".dng")
#: Fixed format: columns of the CSV report, in order.
REPORT_FIELDS = (
    "path", "recommendation", "reasons", "sharpness", "brightness", "contrast", "noise", "black_frac", "white_frac", "aesthetic", "is_utility",
    "face_quality", "cluster_id", "cluster_size", "is_keeper", "width", "height", "megapixels", "file_bytes", "asset_id", "error",
)
#: Tiers, worst first.
TIER_ORDER = {"delete": 0, "duplicate": 1, "review": 2, "keep": 3, "error": 4}
METRICS = (
    "width int, height int, megapixels double, file_bytes bigint, sharpness double, brightness double, contrast double, noise double, "
    "black_frac double, white_frac double, aesthetic double, is_utility boolean, face_quality double, fprint array<float>, error string"
)
METRIC_NAMES = tuple(x.split()[0] for x in METRICS.split(", "))
CACHE = f"cache_id string, size bigint, mtime bigint, ver int, computed_mask int, {METRICS}"
METRICS_VERSION = 1
