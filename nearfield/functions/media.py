"""Predicates and arithmetic on urls, types and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE_TYPES = ("png", "jpg", "gif", "webp", "bmp")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))


def url_allowed(url: Column, suffixes: list[str]) -> Column:
    """https only, host one of suffixes or below one, no literal private address."""
    h = host(url)
    known = F.lit(False)
    for s in suffixes:
        known = known | (h == s) | h.endswith("." + s)
    private = h.rlike(r"^(10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.)") | (h == "localhost")
    return F.coalesce(url.startswith("https://") & known & ~private, F.lit(False))


def extension(url: Column) -> Column:
    """Extension of the path in lower case, jpeg as jpg; empty where there is none."""
    e = F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"/[^/]*\.([A-Za-z0-9]{1,8})$", 1))
    return F.when(e == "jpeg", "jpg").otherwise(e)


def extension_allowed(ext: Column, allowed: list[str]) -> Column:
    return F.lit(True) if not allowed else ext.isin(allowed)


def safety_reason(size: Column, width: Column, height: Column, max_bytes: int, max_pixels: int) -> Column:
    return F.when(size > max_bytes, "metadata_file_too_large").when((width == 0) | (height == 0), "metadata_invalid_dimensions").when(width.cast("bigint") * height > max_pixels, "metadata_pixels_too_large")


def aspect_reason(width: Column, height: Column, most: float) -> Column:
    return F.when((F.least(width, height) > 0) & (F.greatest(width, height) / F.least(width, height) > most), "metadata_aspect_too_large")


def fit(width: Column, height: Column, max_width: int, max_height: int, max_area: int) -> tuple[Column, Column]:
    """Size that keeps the aspect within the limits, never enlarged."""
    r = F.least(F.lit(float(max_width)) / width, F.lit(float(max_height)) / height, F.sqrt(F.lit(float(max_area)) / (width.cast("double") * height)), F.lit(1.0))
    return F.greatest(F.round(width * r), F.lit(1.0)).cast("int"), F.greatest(F.round(height * r), F.lit(1.0)).cast("int")


def preview_size(width: Column, height: Column, max_pixels: int, max_aspect: float, least_percent: int = 35) -> Column:
    """(width, height) of a worthwhile preview, else null."""
    w, h = fit(width, height, 768, 2048, 786_432)
    area = width.cast("bigint") * height
    saved = 100 - F.floor(w.cast("bigint") * h * 100 / F.greatest(area, F.lit(1)))
    ok = (F.least(width, height) > 0) & (area <= max_pixels) & (F.greatest(width, height) / F.least(width, height) <= max_aspect) & ~((w >= width) & (h >= height)) & (saved >= least_percent)
    return F.when(ok, F.struct(w.alias("width"), h.alias("height")))


def retry_delay_ms(attempt: Column, base_ms: int, most_ms: int) -> Column:
    return F.least(F.lit(most_ms), F.lit(base_ms) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0)))).cast("bigint")
