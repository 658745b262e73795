"""Weather expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Compass points, Beaufort upper limits in knots, class limits.
COMPASS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]
BEAUFORT = [
    (1, "Calm"), (3, "Light air"), (6, "Light breeze"), (10, "Gentle breeze"), (16, "Moderate breeze"),
    (21, "Fresh breeze"), (27, "Strong breeze"), (33, "Near gale"), (40, "Gale"), (47, "Strong gale"),
    (55, "Storm"), (63, "Violent storm"), (999, "Hurricane"),
]
WIND_CLASSES = [(7, "Light (0-6kn)"), (14, "Moderate (7-13kn)"), (22, "Fresh (14-21kn)"), (28, "Strong (22-27kn)")]
WIND_TOP = "Gale+ (28kn+)"
SEA_CLASSES = [(2, "Calm (<2ft)"), (5, "Slight (2-4ft)"), (8, "Moderate (5-7ft)"), (13, "Rough (8-12ft)")]
SEA_TOP = "Very Rough (13ft+)"
SEA_SHORT = [(2, "Calm"), (5, "Slight"), (8, "Moderate"), (13, "Rough")]


def _ladder(x: Column, steps: list, top: str, missing: str) -> Column:
    chain = F.when(x.isNull() | F.isnan(x), missing)
    for limit, label in steps:
        chain = chain.when(x < limit, label)
    return chain.otherwise(top)


def wind_cardinal(deg: Column) -> Column:
    """16-point compass name; half-even index."""
    names = F.array(*[F.lit(n) for n in COMPASS])
    idx = F.pmod(F.bround(deg / 22.5, 0), F.lit(16)).cast("int")
    return F.when(deg.isNull() | F.isnan(deg), "").otherwise(F.get(names, idx))


def beaufort(kn: Column) -> Column:
    """struct(number, label); a missing speed is (0, Calm)."""
    num = F.when(kn.isNull() | F.isnan(kn), 0)
    lab = F.when(kn.isNull() | F.isnan(kn), "Calm")
    for i, (limit, label) in enumerate(BEAUFORT):
        num, lab = num.when(kn <= limit, i), lab.when(kn <= limit, label)
    return F.struct(num.otherwise(12).alias("number"), lab.otherwise("Hurricane").alias("label"))


def head_to_wind(heading: Column, wind: Column) -> Column:
    """Signed angle from heading to wind in (-180, 180]."""
    a = F.pmod(wind - heading, F.lit(360.0))
    return F.bround(F.when(a > 180, a - 360).otherwise(a), 1)


def wave_steepness(height_ft: Column, period_s: Column) -> Column:
    """Height over deep-water wavelength."""
    length = 9.81 * period_s * period_s / (2 * math.pi)
    return F.when(period_s > 0, F.bround(height_ft * 0.3048 / length, 4))


def wind_class(kn: Column) -> Column:
    """Five wind classes."""
    return _ladder(kn, WIND_CLASSES, WIND_TOP, "Unknown")


def sea_class(ft: Column) -> Column:
    """Five sea classes with limits in the label."""
    return _ladder(ft, SEA_CLASSES, SEA_TOP, "Unknown")


def sea_state(ft: Column) -> Column:
    """Sea state name; missing is a dash."""
    return _ladder(ft, SEA_SHORT, "Very Rough", "—")
