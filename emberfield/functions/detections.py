"""Column functions on single detections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = 0.05


def hhmm(time: Column) -> Column:
    """Four digits from texts such as '13.0' or '905'; null where it is no time of day."""
    digits = F.regexp_replace(F.trim(time.cast("string")), r"\.0+$", "")
    padded = F.lpad(digits, 4, "0")
    return F.when(digits.rlike("^[0-9]{1,4}$") & padded.rlike("^([01][0-9]|2[0-3])[0-5][0-9]$"), padded)


def observed_at(date: Column, time: Column) -> Column:
    """Timestamp (UTC) from a date and four digits; null if either is bad."""
    text = F.concat_ws(" ", date.cast("string"), F.concat_ws(":", F.substring(time, 1, 2), F.substring(time, 3, 2)))
    return F.when(date.isNotNull() & time.isNotNull(), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")))


def minute_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def _level(confidence: Column) -> Column:
    c = F.lower(F.trim(confidence))
    return F.when(c.isin("l", "low"), "low").when(c.isin("n", "nominal"), "nominal").when(c.isin("h", "high"), "high")


def confidence_code(confidence: Column, scheme: str) -> Column:
    """'training': 0/50/100 or null; 'serving': 30/60/90, numbers kept, else 0; 'label': the word or null."""
    level = _level(confidence)
    if scheme == "label":
        return level
    low, nominal, high = (0.0, 50.0, 100.0) if scheme == "training" else (30.0, 60.0, 90.0)
    code = F.when(level == "low", low).when(level == "nominal", nominal).when(level == "high", high)
    if scheme == "training":
        return code
    return F.coalesce(code, F.trim(confidence).try_cast("double"), F.lit(0.0))


def log_frp(frp: Column) -> Column:
    return F.when(frp.isNotNull(), F.log1p(F.greatest(frp, F.lit(0.0))))


def season(month: Column) -> Column:
    """Winter 12-2, summer 3-5, monsoon 6-9, else post-monsoon; 'unknown' without a month."""
    return (
        F.when(month.isNull(), "unknown").when(month.isin(12, 1, 2), "winter").when(month.between(3, 5), "summer")
        .when(month.between(6, 9), "monsoon").otherwise("post_monsoon")
    )


def weekend(date: Column) -> Column:
    return (F.weekday(date) >= 5).cast("int")


def night(daynight: Column) -> Column:
    return F.coalesce((F.upper(daynight) == "N").cast("int"), F.lit(0))


def product_by_cutoff(ts: Column, cutoff: str) -> Column:
    return F.when(ts < F.lit(cutoff).cast("timestamp"), "ARCHIVE").otherwise("NRT")


def four_decimals(x: Column) -> Column:
    """As ``%.4f``, by a decimal where that has the same digits: formatting a row costs ten times the rest of its id."""
    plain = (F.abs(x) >= 0.00005) & (F.abs(x) < 1e9)
    return F.when(plain, x.try_cast("decimal(20,4)").cast("string")).otherwise(F.format_string("%.4f", x))


def event_id(ts: Column, lat: Column, lon: Column) -> Column:
    return F.concat_ws("_", F.lit("FIRMS"), F.date_format(ts, "yyyyMMddHHmm"), four_decimals(lat), four_decimals(lon))


def nearest_int(x: Column) -> Column:
    """Rounds halves up, for either sign."""
    return F.floor(x + 0.5).cast("long")


def rounded(x: Column, digits: int) -> Column:
    """Rounds halves up with a small allowance, so that sums in another order round alike at halves."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5000001) / scale


def feed_id(date: Column, time: Column, lat: Column, lon: Column) -> Column:
    parts = (F.lit("F"), F.date_format(date, "yyyyMMdd"), time, nearest_int(lat * 100), nearest_int(lon * 100))
    return F.concat_ws("-", *parts)


def lat_cell(lat: Column) -> Column:
    return F.floor(lat / GRID).cast("long")


def grid_id(lat: Column, lon: Column) -> Column:
    return lat_cell(lat) * 10000 + lat_cell(lon)


def grid_text(lat: Column, lon: Column) -> Column:
    return F.concat_ws("_", lat_cell(lat), lat_cell(lon))


def hundredth_cell(lat: Column, lon: Column) -> Column:
    return F.concat_ws(":", nearest_int(lat * 100), nearest_int(lon * 100))


def local_text(ts: Column, zone: str = "Asia/Kolkata") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd HH:mm")


def density_weight(k: Column, frp: Column) -> Column:
    return F.least(F.lit(1.0), 0.18 + (k - 280) / 100 + F.coalesce(frp, F.lit(0.0)) / 500)


def thermal_band(k: Column) -> Column:
    return F.when(k < 320, "low").when(k < 335, "moderate").when(k < 350, "high").otherwise("extreme")


def tier(k: Column, frp: Column) -> Column:
    """Monitor tier from radiative power and brightness."""
    return F.when((frp >= 80) | (k >= 355), "CRITICAL").when((frp >= 35) | (k >= 340), "HIGH").otherwise("MODERATE")
