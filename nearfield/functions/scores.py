"""Scores in single precision, as thresholds expect them (both operands are cast, or a bound is missed by rounding)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.functions import bits
from nearfield.plans.policy import Threshold


def f32(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, f32(lo)), f32(hi))


def ratio(value: Column, full: float) -> Column:
    return f32(0.0) if full <= 0 else (clamp((f32(value) / f32(full)).cast("float"), 0, 1) * f32(100.0)).cast("float")


def inverse(value: Column, most: float) -> Column:
    return f32(0.0) if most <= 0 else ((f32(1.0) - clamp((f32(value) / f32(most)).cast("float"), 0, 1)) * f32(100.0)).cast("float")


def perceptual(total: Column, t: Threshold) -> Column:
    close = (f32(1.0) - clamp((f32(total) / f32(max(t.total_max, 1))).cast("float"), 0, 1)).cast("float")
    return (f32(t.perceptual_floor) + (close * (f32(100.0) - f32(t.perceptual_floor))).cast("float")).cast("float")


def compatible(ph: Column, dh: Column, t: Threshold, slack: int = 0) -> Column:
    return (ph <= t.phash_max + slack) & (dh <= t.dhash_max + slack) & (ph + dh <= t.total_max + slack)


def local(hits: Column, regions: Column, spread: Column, mean: Column, residual: Column, t: Threshold) -> Column:
    parts = [(ratio(hits, t.full_hits), 0.50), (ratio(regions, t.full_regions), 0.18), (ratio(F.coalesce(spread, f32(0.0)), t.full_spread), 0.14), (inverse(F.coalesce(mean, f32(t.max_mean_distance)), max(t.max_mean_distance, 0.1)), 0.10), (inverse(F.coalesce(residual, f32(24.0)), 24.0), 0.08)]
    return clamp(sum(((a * f32(w)).cast("float") for a, w in parts), f32(0.0)), 0, 100)


def visual_signature(luma: Column, rgb: Column, grid: Column, text: Column, zero: tuple[int, int, int, int]) -> Column:
    """Similarity from differences, each worth nothing at its zero."""
    return inverse(luma, zero[0]) * 0.25 + inverse(rgb, zero[1]) * 0.20 + inverse(grid, zero[2]) * 0.25 + inverse(text, zero[3]) * 0.30


def with_visual(core: Column, visual: Column, weight: float) -> Column:
    w = min(max(weight, 0.0), 1.0)
    return clamp(core * ((1.0 - w) + w * visual / 100.0), 0, 100)


def hit_quality(distance: Column, deltas: list[Column], position: Column | None = None) -> Column:
    """Lower is better: four times the distance, the position's and an eighth of the features' difference (a byte)."""
    feature = F.floor(F.least(F.lit(255), sum(deltas[1:], deltas[0])) / 8)
    return (distance * 4 + feature + (position if position is not None else 0)).cast("int")


def geometry_compatible(sw: Column, sh: Column, cw: Column, ch: Column, t: Threshold) -> Column:
    """Limits on the candidate's size, and on how far it is from the specimen's. Not symmetric."""
    long_, short = F.greatest(cw, ch), F.least(cw, ch)
    aspect = lambda w, h: f32(F.greatest(w, h)) / f32(F.greatest(F.least(w, h), F.lit(1)))
    delta = lambda s, c, most: F.abs(f32(F.greatest(c, F.lit(1))) / f32(F.greatest(s, F.lit(1))) - f32(1.0)) <= f32(most)
    return (short >= t.min_short_edge) & (long_ * short >= t.min_area) & (aspect(cw, ch) <= f32(t.max_aspect)) & (F.abs(aspect(sw, sh) - aspect(cw, ch)) <= f32(t.aspect_delta)) & delta(sw, cw, t.width_delta) & delta(sh, ch, t.height_delta)


__all__ = ["bits"]
