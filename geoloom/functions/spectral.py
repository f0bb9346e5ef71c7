"""Per-pixel maths: calibration, spectral indices, masks and labels. Null stands for nodata throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (scale, offset) of known products; indices as (left band, right band); bands that all indices need.
PRESETS = {"s2-l2a": (1e-4, -0.1), "landsat-c2": (2.75e-5, -0.2)}
INDICES = {"ndvi": ("nir", "red"), "ndwi_mcfeeters": ("green", "nir"), "nbr": ("nir", "swir22")}
NEEDED = ("red", "nir")
#: The mean colours of the classes, in order of their labels.
CENTROIDS = [("bare", 180, 140, 90), ("built-up", 128, 128, 128), ("water", 30, 90, 180), ("vegetation", 40, 160, 60), ("cloud", 245, 245, 245)]


def calibrated(dn: Column, scale: float = 1.0, offset: float = 0.0, fill: float | None = None) -> Column:
    """Reflectance of a digital number; null where it is the fill value or not finite."""
    value = dn.cast("double")
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    if fill is not None:
        bad = bad | (value == float(fill))
    return F.when(~bad, value * scale + offset)


def boa_calibration(applied: Column, scale: Column, offset: Column) -> tuple[Column, Column]:
    """(scale, offset): the offset is 0 if the catalog says that it has been applied."""
    return F.coalesce(scale, F.lit(1e-4)), F.when(applied.eqNullSafe(F.lit(True)), F.lit(0.0)).otherwise(F.coalesce(offset, F.lit(0.0)))


def normalized_difference(left: Column, right: Column) -> Column:
    return F.try_divide(left - right, left + right)


def indices(columns: list[str]) -> dict[str, Column]:
    """The indices that the bands among columns allow."""
    if not set(NEEDED) <= set(columns):
        return {}
    return {name: normalized_difference(F.col(a), F.col(b)) for name, (a, b) in INDICES.items() if {a, b} <= set(columns)}


def _extremes(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    return F.least(r, g, b), F.greatest(r, g, b)


def is_cloud(r: Column, g: Column, b: Column) -> Column:
    low, high = _extremes(r, g, b)
    return (F.floor((r + g + b) / 3) >= 200) & (high - low <= 25)


def is_burn(r: Column, g: Column, b: Column) -> Column:
    luma = F.floor((299 * r + 587 * g + 114 * b) / 1000)
    return (luma >= 25) & (luma < 80) & (r > g) & (r > b) & (g < 90)


def is_water(r: Column, g: Column, b: Column) -> Column:
    return (b > r + 30) & (b > g + 20) & (b >= 80)


MASKS = {"cloud": is_cloud, "burn": is_burn, "water": is_water}


def nearest_class(r: Column, g: Column, b: Column, centroids=CENTROIDS) -> Column:
    """The label of the nearest centroid; the lowest of equals."""
    away = [
        F.struct(((r - x) * (r - x) + (g - y) * (g - y) + (b - z) * (b - z)).cast("double").alias("d"), F.lit(i).alias("i"))
        for i, (_, x, y, z) in enumerate(centroids)
    ]
    return F.least(*away)["i"]


def change_heat(before: tuple[Column, ...], after: tuple[Column, ...]) -> Column:
    """Mean absolute difference of the channels, 0 to 1."""
    total = sum((F.abs(x - y) for x, y in zip(before, after, strict=True)), F.lit(0))
    return total / F.lit(255.0 * len(before))


def stretched(value: Column, low: Column, high: Column) -> Column:
    """value between two bounds as 0 to 255, halves to even; 128 where the bounds leave no room, 0 for nodata."""
    span = high - low
    placed = F.least(F.greatest(F.try_divide(value - low, span), F.lit(0.0)), F.lit(1.0))
    return F.when(value.isNull(), 0).when(span <= 0, 128).otherwise(F.bround(placed * 255)).cast("int")
