"""A photo library's catalogue as a source: fetch predicates, albums and display names."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Smart albums as predicates over the catalogue.
SMART_ALBUMS = {
    "recently-added": lambda: F.col("creation_date") >= F.current_timestamp() - F.expr("INTERVAL 30 DAYS"),
    "screenshots": lambda: F.col("is_screenshot"),
    "selfies": lambda: F.col("is_selfie"),
    "bursts": lambda: F.col("burst_id").isNotNull(),
    "favorites": lambda: F.col("favorite"),
    "panoramas": lambda: F.col("is_panorama"),
}


def day(text: str, inclusive: bool = False) -> datetime:
    """Midnight UTC of a day, or the last moment of it."""
    d = datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=timezone.utc)
    return d + timedelta(days=1, microseconds=-1) if inclusive else d


def fetch(assets: DataFrame, since: datetime | None = None, until: datetime | None = None, include_favorites: bool = False, limit: int = 0) -> DataFrame:
    """Images by date, newest first, without favourites unless asked for; 0 is no limit."""
    out = assets.where("media_type = 'image'")
    if not include_favorites:
        out = out.where(~F.coalesce("favorite", F.lit(False)))
    if since is not None:
        out = out.where(F.col("creation_date") >= F.lit(since))
    if until is not None:
        out = out.where(F.col("creation_date") <= F.lit(until))
    out = out.orderBy(F.desc("creation_date"), *(["n"] if "n" in assets.columns else ["asset_id"]))
    return out.limit(limit) if limit else out


def album_members(assets: DataFrame, albums: DataFrame, membership: DataFrame, title: str) -> DataFrame:
    """Assets of the first album with a title; none raises LookupError."""
    found = albums.where(F.col("title") == title).orderBy("album_id").limit(1)
    if not found.count():
        raise LookupError(f"no album {title!r}")
    return assets.join(membership.join(F.broadcast(found.select("album_id")), "album_id").select("asset_id"), "asset_id")  # one album row


def enumerate_assets(assets: DataFrame, albums: DataFrame | None = None, membership: DataFrame | None = None, album: str | None = None, smart_album: str | None = None, **options) -> DataFrame:
    """Assets of a user album, else of a smart album, else all, under fetch options."""
    if album:
        assets = album_members(assets, albums, membership, album)
    elif smart_album:
        if smart_album not in SMART_ALBUMS:
            raise LookupError(f"no smart album {smart_album!r}")
        assets = assets.where(SMART_ALBUMS[smart_album]())
    return fetch(assets, **options)


def cloud_error(allow_network: bool) -> Column:
    """Error text of assets whose pixels aren't here; empty otherwise."""
    return F.when(F.lit(not allow_network) & F.col("in_cloud"), "in cloud, download is off").otherwise("")


def display_name() -> Column:
    """The original file name, or the id without one."""
    return F.coalesce("filename", "asset_id")
