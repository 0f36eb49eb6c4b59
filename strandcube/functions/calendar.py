"""Calendar parts, bands and cyclical encodings."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rush hours, hour bands, congestion edges and the bands of incidents (right-closed).
PEAK_HOURS = (7, 8, 9, 17, 18, 19)
TIME_BANDS = ((5, "Night"), (11, "Morning"), (16, "Afternoon"), (20, "Evening"), (23, "Late Evening"))
CONGESTION_BANDS = ((0.35, "Free flow"), (0.60, "Light"), (0.80, "Moderate"), (1.01, "Severe"))
CONGESTED_FROM = 0.60
DURATION_BANDS = ((20, "<=20min"), (45, "20-45min"), (90, "45-90min"), (10_000, ">90min"))
RESPONSE_BANDS = ((8, "<=8min"), (15, "8-15min"), (25, "15-25min"), (10_000, ">25min"))
LANE_BANDS = ((0, "0"), (1, "1"), (99, "2+"))
VEHICLE_BANDS = ((1, "1"), (3, "2-3"), (999, "4+"))
SEVERITY_LABELS = ((1, "Minor"), (2, "Moderate"), (3, "Serious"), (4, "Critical"))


def band(c: Column, bands, above: float) -> Column:
    """Label of the right-closed band of ``c``; NULL below ``above`` (excluded) or beyond the last band."""
    out = F.when(c.isNull() | F.isnan(c.cast("double")) | (c <= above), F.lit(None))
    for edge, label in bands:
        out = out.when(c <= edge, F.lit(label))
    return out


def congestion_level(c: Column) -> Column:
    """The lowest band includes 0."""
    return F.when(c == 0, F.lit(CONGESTION_BANDS[0][1])).otherwise(band(c, CONGESTION_BANDS, 0))


def is_congested(c: Column) -> Column:
    return (c >= CONGESTED_FROM).cast("int")


def time_key(ts: Column) -> Column:
    """yyyymmddhh as a number."""
    return F.date_format(ts, "yyyyMMddHH").cast("bigint")


def calendar_parts(ts: Column) -> dict[str, Column]:
    """All calendar columns of a timestamp; days of the week count from Monday 0."""
    hour, dow = F.hour(ts), F.weekday(ts)
    return {
        "date": F.to_date(ts), "year": F.year(ts), "quarter": F.quarter(ts), "month": F.month(ts), "month_name": F.date_format(ts, "MMMM"),
        "week_of_year": F.weekofyear(ts), "day_of_month": F.dayofmonth(ts), "day_of_week": dow, "day_name": F.date_format(ts, "EEEE"), "hour": hour,
        "is_weekend": (dow >= 5).cast("int"), "is_peak_hour": hour.isin(*PEAK_HOURS).cast("int"), "time_of_day": band(hour, TIME_BANDS, -1),
    }


def cyclical(part: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a periodic part."""
    angle = part * (2 * pi / period)
    return F.sin(angle), F.cos(angle)


def add_time_features(df: DataFrame, ts: str) -> DataFrame:
    """Calendar columns and hour and weekday cycles (columns of these names are replaced)."""
    df = df.withColumns(calendar_parts(F.col(ts)))
    hs, hc = cyclical(F.col("hour"), 24)
    ds, dc = cyclical(F.col("day_of_week"), 7)
    return df.withColumns({"hour_sin": hs, "hour_cos": hc, "dow_sin": ds, "dow_cos": dc})
