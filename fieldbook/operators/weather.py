"""Weather joined with lost time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions import weather as wx
from fieldbook.operators import hours, ordered, quantiles

# Weather wording in operation text.
WEATHER_MENTION = r"(?i)sea state|weather|wind|wave|swell|crane.*rest|unable.*vessel|vessel.*unable"


def derived(weather: DataFrame) -> DataFrame:
    """Derived indicators and day-on-day deltas (one row per day); the day before comes from the month's rows or
    the month before."""
    c = F.col
    cols = weather.columns
    weather = ordered.lag_across(weather.withColumn("__m", F.trunc("report_date", "MM")), [], "__m", ["report_date"], F.struct("wind_speed_kn", "wave_height_ft"), "__day")
    b = wx.beaufort(c("wind_speed_kn"))
    return weather.select(
        *cols,
        wx.wind_cardinal(c("wind_direction_deg")).alias("wind_cardinal"),
        b["number"].alias("beaufort_num"), b["label"].alias("beaufort_label"),
        wx.head_to_wind(c("vessel_heading_deg"), c("wind_direction_deg")).alias("head_to_wind_angle"),
        wx.wave_steepness(c("wave_height_ft"), c("wave_period_s")).alias("wave_steepness"),
        F.bround(c("swell_height_ft") / F.nullif(c("wave_height_ft"), F.lit(0.0)), 3).alias("swell_dominance"),
        F.bround(c("wind_speed_kn") - c("__day.wind_speed_kn"), 1).alias("wind_delta_kn"),
        F.bround(c("wave_height_ft") - c("__day.wave_height_ft"), 2).alias("wave_delta_ft"),
    )


def field_daily(ops: DataFrame) -> DataFrame:
    """Hours per date over the whole field with its most frequent phase."""
    h = hours.hours_by(ops, ["report_date"])
    n = ops.groupBy("report_date").agg(F.count_if("is_npt").alias("n_npt_ops"))
    return h.join(n, "report_date").join(hours.mode_by(ops, ["report_date"], "phase", "phase"), "report_date", "left").withColumn(
        "npt_pct", 100 * F.col("npt_h") / F.greatest("total_h", F.lit(1.0))
    )


def with_daily(weather: DataFrame, ops: DataFrame, how: str = "inner") -> DataFrame:
    """D1 (inner) / D3 (left): weather with the day's lost time and classes."""
    c = F.col
    return weather.join(field_daily(ops), "report_date", how).select(
        "*", wx.wind_class(c("wind_speed_kn")).alias("wind_class"), wx.sea_class(c("wave_height_ft")).alias("sea_class")
    )


def ops_with_weather(ops: DataFrame, weather: DataFrame) -> DataFrame:
    """Operation rows with the day's sea state."""
    w = weather.select("report_date", "wind_speed_kn", "wave_height_ft", wx.sea_state(F.col("wave_height_ft")).alias("sea_state"))
    return ops.join(w, "report_date", "left")


def by_class(merged: DataFrame, key: str) -> DataFrame:
    """Lost time per weather class."""
    return merged.groupBy(key).agg(
        F.count("npt_pct").alias("n_days"), F.avg("npt_pct").alias("avg_npt_pct"), F.avg("npt_h").alias("avg_npt_h")
    )


def correlation(merged: DataFrame) -> DataFrame:
    """Pearson correlation of wind and wave with the lost share; pairs with a
    null side are skipped by ``corr`` itself."""
    return merged.agg(F.corr("wind_speed_kn", "npt_pct").alias("wind_corr"), F.corr("wave_height_ft", "npt_pct").alias("wave_corr"))


def high_wind_split(merged: DataFrame) -> DataFrame:
    """Days at or above the 75th wind percentile against the rest."""
    q = quantiles.exact_quantiles(merged, [], "wind_speed_kn", {"p75": 0.75})
    return merged.join(q).withColumn("high_wind", F.col("wind_speed_kn") >= F.col("p75")).groupBy("high_wind").agg(
        F.count(F.lit(1)).alias("n_days"), F.avg("npt_pct").alias("avg_npt_pct"), F.avg("wind_speed_kn").alias("avg_wind_kn"),
        F.max("p75").alias("p75"),
    )


def phase_summary(merged: DataFrame) -> DataFrame:
    """Weather and lost time per phase."""
    return merged.filter(F.col("phase").isNotNull() & (F.col("phase") != "")).groupBy("phase").agg(
        F.count("report_date").alias("n_days"), F.bround(F.avg("wind_speed_kn"), 1).alias("avg_wind"),
        F.bround(F.max("wind_speed_kn"), 1).alias("max_wind"), F.bround(F.avg("wave_height_ft"), 1).alias("avg_wave"),
        F.bround(F.max("wave_height_ft"), 1).alias("max_wave"), F.bround(F.avg("npt_pct"), 1).alias("avg_npt"),
    )


def windiest(merged: DataFrame, n: int = 8) -> DataFrame:
    """Windiest days."""
    return merged.orderBy(F.desc("wind_speed_kn"), "report_date").limit(n).select(
        "report_date", "phase", "wind_speed_kn", "wave_height_ft", "swell_height_ft", "npt_pct"
    )


def mentions(ops: DataFrame) -> DataFrame:
    """Lost-time rows that mention weather: count and hours per phase."""
    return ops.filter(F.col("is_npt") & F.col("operation_text").rlike(WEATHER_MENTION)).groupBy("phase").agg(
        F.count(F.lit(1)).alias("n_ops"), F.sum("duration_hr").alias("hours")
    )
