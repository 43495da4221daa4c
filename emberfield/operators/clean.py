"""Cleaning: standard columns, derived columns, region, duplicates and near-duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import detections as d
from ..schemas import align_schema, require_columns, standardize_columns

#: The region of interest.
REGION = (6.0, 38.0, 65.0, 100.0)


def standardized(raw: DataFrame) -> DataFrame:
    return align_schema(standardize_columns(raw))


def _keyed(df: DataFrame) -> DataFrame:
    """Adds what tells detections apart: time, timestamp, product and event id."""
    require_columns(df, ("latitude", "longitude", "brightness", "date", "time", "confidence", "daynight"))
    c = F.col
    df = df.withColumn("time", d.hhmm(c("time"))).withColumn("timestamp", d.observed_at(c("date"), c("time")))
    return df.select("*", c("product").alias("data_quality"), d.event_id(c("timestamp"), c("latitude"), c("longitude")).alias("event_id"))


def _described(df: DataFrame) -> DataFrame:
    c = F.col
    return df.select(
        "*",
        d.confidence_code(c("confidence"), "training").alias("confidence_score"),
        d.confidence_code(c("confidence"), "label").alias("confidence_label"),
        d.log_frp(c("frp")).alias("log_frp"), (c("brightness") - 300).alias("thermal_excess"),
        F.hour("timestamp").alias("hour"), F.month("date").alias("month"), F.dayofyear("date").alias("day_of_year"),
        F.year("date").alias("year"), d.season(F.month("date")).alias("season"), d.night(c("daynight")).alias("is_night"),
        d.grid_id(c("latitude"), c("longitude")).alias("grid_id"),
    )


def derived(df: DataFrame) -> DataFrame:
    """Adds time, confidence score, thermal and calendar columns, ids and the grid cell."""
    return _described(_keyed(df))


def _in_box(df: DataFrame, box: tuple = REGION) -> DataFrame:
    south, north, west, east = box
    return df.filter(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))


def in_region(df: DataFrame, box: tuple = REGION) -> DataFrame:
    return _in_box(df, box).filter(F.col("timestamp").isNotNull())


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a full order.

    Sorted by a hash of the key first: ids begin alike, so their own first bytes tell no two apart.
    """
    w = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def dedup_exact(df: DataFrame) -> DataFrame:
    return df.distinct()


def dedup_event_id(df: DataFrame) -> DataFrame:
    """One row per event id: archive first, then satellite, source and brightness."""
    return keep_first(df, ["event_id"], ["data_quality", "satellite", "source_id", "brightness"])


def clean(raw: DataFrame) -> DataFrame:
    """From raw detections to one row per event id within the region.

    Equal rows have equal ids, so one of them stays without a pass of its own; the rows are dealt out
    before the columns that follow from others are added.  Rows without a time go last, as their ids are
    none with a time: a filter on the time would repeat its parsing in the code of the first stage, which
    then is too long to be compiled.
    """
    rows = dedup_event_id(_keyed(_in_box(standardized(raw))))
    return _described(in_region(rows))


def dedup_near(df: DataFrame, minutes: int = 10, kelvin: float = 15.0, block: int = 256) -> DataFrame:
    """Sequential near-duplicate removal per cell, day and satellite.

    Each row is compared with the last kept one only; within the window and tolerance an archive row
    displaces a near-real-time one, else the later row is dropped.  A row that comes longer than the
    window after the one before it is far from whatever was kept, so each group is cut there; the fold
    runs over the sorted array of one such run, inside the JVM.
    """
    row = F.struct(
        F.unix_timestamp("timestamp").alias("at"), F.col("data_quality").alias("q"), F.col("source_id").alias("s"),
        F.col("brightness").alias("k"), F.col("event_id").alias("e"),
    )
    group = ["grid_id", "date", "satellite"]
    ordered = Window.partitionBy(*group).orderBy("row")
    rows = df.select(*group, row.alias("row"))
    rows = rows.withColumn("gap", F.col("row.at") - F.lag("row.at").over(ordered))
    rows = rows.withColumn("run", F.count(F.when(F.col("gap") > minutes * 60, 1)).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy(*group, "run").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        last = acc["last"]
        close = (x["at"] - last["at"] <= minutes * 60) & (F.abs(x["k"] - last["k"]) <= kelvin)
        close = last.isNotNull() & F.coalesce(close, F.lit(False))
        wins = close & (x["q"] == "ARCHIVE") & (last["q"] != "ARCHIVE")
        # The last kept row may still be displaced; it is put down when another row is kept after it.
        sure = F.when(last.isNull() | close, acc["sure"]).otherwise(F.concat(acc["sure"], F.array(last)))
        return F.struct(F.when(close & ~wins, last).otherwise(x).alias("last"), sure.alias("sure"))

    none = F.filter("rows", lambda x: F.lit(False))
    # Kept rows are gathered by block, so that a long run does not copy all of them for every row.
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / block)), lambda i: F.slice("rows", (i * block + 1).cast("int"), block))
    rows = rows.select(blocks.alias("blocks"), none.alias("none"))

    def over(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["last"].alias("last"), F.col("none").alias("sure")), step)
        # One-element array to name the result, lest it is made twice.
        put = lambda r: F.struct(r["last"].alias("last"), F.concat(acc["sure"], F.array(r["sure"])).alias("sure"))
        return F.get(F.transform(F.array(inner), put), 0)

    start = F.struct(F.get("none", 0).alias("last"), F.array(F.col("none")).alias("sure"))
    kept = F.aggregate("blocks", start, over, lambda acc: F.concat(F.flatten(acc["sure"]), F.array(acc["last"])))
    kept = rows.select(F.explode(kept).alias("x")).select(F.col("x.e").alias("event_id"), F.col("x.s").alias("source_id"))
    return df.join(kept.hint("merge"), ["event_id", "source_id"], "left_semi")
