"""Predicates and parts of post and image URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image endings, hosts that only serve images and hosts that images may be fetched from.
EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp")
IMAGE_HOSTS = ("i.redd.it", "i.imgur.com")
ALLOWED_HOSTS = ("i.redd.it", "preview.redd.it", "i.imgur.com", "i.imgflip.com")
#: Fixed value: image URLs in comment text, by host or by ending.
IMAGE_IN_TEXT = r"(?i)https?://(?:preview\.redd\.it|i\.redd\.it|i\.imgur\.com)/[^\s)\]]+|https?://[^\s)\]]+\.(?:jpe?g|png|gif|webp)(?:\?[^\s)\]]*)?"


def path_of(url: Column) -> Column:
    return F.substring_index(F.lower(url), "?", 1)


def is_image_url(url: Column) -> Column:
    lower = F.lower(url)
    ending = F.rlike(path_of(url), F.lit(r"\.(" + "|".join(EXTENSIONS) + r")$"))
    return F.coalesce(ending | F.contains(lower, F.lit(IMAGE_HOSTS[0])) | F.contains(lower, F.lit(IMAGE_HOSTS[1])), F.lit(False))


def image_extension(url: Column) -> Column:
    found = F.regexp_extract(F.substring_index(url, "?", 1), r"(?i)\.(png|gif|webp|jpeg)$", 1)
    return F.when(F.coalesce(found, F.lit("")) == "", "jpg").otherwise(F.lower(found))


def image_source_error(url: Column) -> Column:
    """Why an image may not be fetched; null if it may."""
    scheme, host = F.try_parse_url(url, F.lit("PROTOCOL")), F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    refused = F.concat(F.lit("image host not allowed: "), F.when(host == "", "(missing)").otherwise(host))
    return F.when(F.coalesce(F.lower(scheme), F.lit("")) != "https", "image URL must use https").when(~host.isin(*ALLOWED_HOSTS), refused)


def image_urls(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(IMAGE_IN_TEXT), F.lit(0))
