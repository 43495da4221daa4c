"""Exact percentiles without gathering a column in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written


def exact_percentile(values: DataFrame, share: float, group: str = "feature", value: str = "value", accuracy: int = 10_000) -> DataFrame:
    """(group, n, percentile), linearly interpolated; groups are few, nulls don't count.

    A sketch names two values with the percentile between them (its ranks are off by n / accuracy at
    most, the bracket reaches three times as far); what lies below is counted, and only the distinct
    values inside the bracket are sorted.  A group with no more than ``accuracy`` values is a bracket
    as a whole.
    """
    held = values.select(group, F.col(value).cast("double").alias("v")).filter("v is not null")
    reach = 3 / accuracy
    ends = F.percentile_approx("v", [max(0.0, share - reach), min(1.0, share + reach)], accuracy)
    whole = F.array(F.lit(float("-inf")), F.lit(float("inf")))
    bracket = held.groupBy(group).agg(F.count("*").alias("n"), ends.alias("ends"))
    bracket = bracket.select(group, "n", F.when(F.col("n") <= accuracy, whole).otherwise(F.col("ends")).alias("ends"))
    # One row per group, and groups are few: the names of columns.
    met = held.join(F.broadcast(bracket), group)
    low, high = F.col("ends")[0], F.col("ends")[1]
    below = met.groupBy(group).agg(F.count(F.when(F.col("v") < low, 1)).alias("below"))
    inside = met.filter((F.col("v") >= low) & (F.col("v") <= high)).groupBy(group, "n", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(group).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = inside.withColumn("upto", upto).join(F.broadcast(below), group).withColumn("rank", F.col("below") + F.col("upto"))
    place = (F.col("n") - 1) * share
    first, second = (F.min(F.when(F.col("rank") >= at + 1, F.col("v"))) for at in (F.floor(place), F.ceil(place)))
    both = ranked.groupBy(group, "n").agg(first.alias("first"), second.alias("second"))
    return both.select(group, "n", (F.col("first") + (F.col("second") - F.col("first")) * (place - F.floor(place))).alias("percentile"))


def grouped_median(rows: DataFrame, group: str, value: str, small: int = 1024, slots: int = 1024) -> DataFrame:
    """(group, median) for many groups of any size, the mean of the two middle values; nulls don't count.

    Each group has a bracket, at first from its least to its largest value, that holds the middle.
    While a bracket has more than ``small`` values, they are counted in ``slots`` equal parts of it, before the
    shuffle, and the part with the middle is the next bracket; if the two middle values are in two
    parts, they are the end of one and the start of the other.  So no task ever holds a group: at most
    ``slots`` counts or ``small`` values of it.
    """
    held = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter("v is not null")
    whole = held.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # Places of the middle values from 0, and how many values lie below the bracket.
    first, second = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    state = whole.select("g", first.alias("k1"), second.alias("k2"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    state = written(state, "brackets")
    flat = (F.col("lo") == F.col("hi"))
    done = [state.filter(flat).select("g", F.col("lo").alias("median"))]
    last, state = state.filter(~flat & (F.col("inside") <= small)), state.filter(~flat & (F.col("inside") > small))
    waiting = [last]
    while state.limit(1).count():
        met = held.join(state.hint("merge"), "g").filter("v between lo and hi")
        # Monotone in the value, and the largest one is in the last part.
        slot = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * slots), F.lit(slots - 1))
        counts = met.groupBy("g", "k1", "k2", "below", slot.alias("slot")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy("g").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)) + F.col("below")
        counts = counts.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("c"))
        holds = lambda k: (F.col("from") <= F.col(k)) & (F.col(k) < F.col("upto"))
        parts = counts.filter(holds("k1") | holds("k2")).groupBy("g", "k1", "k2").agg(
            F.count("*").alias("parts"), F.max(F.when(holds("k1"), F.col("hi"))).alias("low"), F.min(F.when(holds("k2"), F.col("lo"))).alias("high"),
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("from").alias("below"), F.sum("c").alias("inside"),
        )
        parts = written(parts, "brackets")
        done.append(parts.filter("parts = 2").select("g", ((F.col("low") + F.col("high")) / 2).alias("median")))
        done.append(parts.filter((F.col("parts") == 1) & flat).select("g", F.col("lo").alias("median")))
        rest = parts.filter((F.col("parts") == 1) & ~flat).select("g", "k1", "k2", "lo", "hi", "below", "inside")
        waiting.append(rest.filter(F.col("inside") <= small))
        state = rest.filter(F.col("inside") > small)
    for bracket in waiting:
        met = held.join(bracket.hint("merge"), "g").filter("v between lo and hi")
        few = met.groupBy("g", "k1", "k2", "below").agg(F.sort_array(F.collect_list("v")).alias("v"))
        at = lambda k: F.get("v", (F.col(k) - F.col("below")).cast("int"))
        done.append(few.select("g", ((at("k1") + at("k2")) / 2).alias("median")))
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out.select(F.col("g").alias(group), "median")
