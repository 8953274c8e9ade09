"""Web addresses: canonical forms, hosts, slugs. The host is not checked before rewriting, unless ``strict``.

Null stays null; text that isn't an address is returned unchanged or classed ``unknown``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Host marks in order of test, and the class of each.
HOST_CLASSES = (
    ("facebook.com", "facebook"), ("instagram.com", "instagram"), ("tiktok.com", "instagram"), ("youtube.com", "youtube"), ("youtu.be", "youtube"),
    ("google.com", "google_drive"), ("googleusercontent.com", "google_drive"),
)


def authority(url: Column) -> Column:
    """Lower-cased network location with user and port; '' where there is none."""
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def _query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def host_class(url: Column) -> Column:
    where = authority(url)
    out = F.lit("unknown")
    for mark, name in reversed(HOST_CLASSES):
        out = F.when(where.contains(mark), name).otherwise(out)
    return F.when(url.isNotNull(), out)


def facebook_watch(url: Column, strict: bool = False) -> Column:
    """``…/watch/?v=ID`` where the query's first ``v`` or a ``/v/ID`` in the path names a video."""
    raw = F.nullif(F.regexp_extract(_query(url), r"(?:^|&)v=([^&]+)", 1), F.lit(""))
    decoded = F.coalesce(F.try_url_decode(raw), raw)
    video = F.coalesce(decoded, F.nullif(F.regexp_extract(_path(url), r"/v/([0-9A-Za-z]+)", 1), F.lit("")))
    fits = video.isNotNull() & (host_class(url) == "facebook") if strict else video.isNotNull()
    return F.when(fits, F.concat(F.lit("https://www.facebook.com/watch/?v="), video)).otherwise(url)


def instagram_post(url: Column, strict: bool = False) -> Column:
    """``https://www.instagram.com/KIND/ID/`` where the path holds ``/reel|p|tv/ID``."""
    kind = F.regexp_extract(_path(url), r"/(reel|p|tv)/([^/?]+)", 1)
    post = F.regexp_extract(_path(url), r"/(reel|p|tv)/([^/?]+)", 2)
    fits = (kind != "") & (host_class(url) == "instagram") if strict else kind != ""
    return F.when(fits, F.concat(F.lit("https://www.instagram.com/"), kind, F.lit("/"), post, F.lit("/"))).otherwise(url)


def drive_file_id(url: Column) -> Column:
    """Id of a shared file, of ten characters or more; null where there is none."""
    return F.nullif(F.regexp_extract(url, r"(?U)(?:/file/d/|id=)([\w-]{10,})", 1), F.lit(""))


def slug(url: Column) -> Column:
    """The host part after the last ``//`` without ``www.``, other signs than letters and digits as single dashes."""
    host = F.replace(F.split_part(F.element_at(F.split(url, "//"), -1), F.lit("/"), F.lit(1)), F.lit("www."), F.lit(""))
    return F.regexp_replace(F.regexp_replace(host, r"(?U)\W+", "-"), "^-+|-+$", "")
