"""Numbers: percentages, scores, sizes and places, as column expressions. Geometry rounds halves to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(F.lit(100.0) * part / whole, digits)


def guarded_percent(part: Column, whole: Column) -> Column:
    """0 where there is no whole."""
    return F.when(whole > 0, part / whole * 100.0).otherwise(0.0)


def success(damage_of_deleted: Column, line_of_all: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - (damage_of_deleted + line_of_all * 5.0)))


def priority(damage_of_deleted: Column, damage_of_all: Column, line_of_all: Column) -> Column:
    return damage_of_deleted + damage_of_all * 0.5 + line_of_all * 5.0


def scaled_height(width: Column, height: Column, target: Column) -> Column:
    return F.when(width == target, height).otherwise(F.greatest(F.lit(1), F.bround(height * (target / width), 0).cast("int")))


def positive_weight(delete_ratio: Column, most: float = 4.0) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(0.5), (1 - delete_ratio) / F.greatest(delete_ratio, F.lit(1e-6))))


def touches_border(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    return (x == 0) | (y == 0) | (x + w == width) | (y + h == height)


def window_top(y: Column, view: Column, height: Column) -> Column:
    return F.greatest(F.lit(0), F.least(y, height - view))


def auto_centers(height: Column, count: Column) -> Column:
    """Evenly spaced between margins of a twelfth."""
    low = F.floor(height / 12)
    high = F.greatest(low, height - low)
    step = (high - low) / (count - 1)
    return F.when(count <= 1, F.array(F.floor(height / 2).cast("int"))).otherwise(F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: F.bround(low + i * step, 0).cast("int")))


def hotspot_tops(height: Column, centers: Column, view: int, zoom: float) -> Column:
    source = round(view / zoom)
    return F.transform(centers, lambda c: F.greatest(F.lit(0), F.least((c - source / 2).cast("int"), F.greatest(F.lit(0), height - source))))


def renamed_keys(state: Column, strip: bool = True) -> Column:
    """Keys of a map of weights without, or with, the prefix that data-parallel training adds."""
    prefix = "module."
    return F.transform_keys(state, lambda k, _: F.regexp_replace(k, r"^module\.", "") if strip else F.when(k.startswith(prefix), k).otherwise(F.concat(F.lit(prefix), k)))
