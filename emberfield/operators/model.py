"""Training data preparation, training, scoring and metrics with Spark ML."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosted
from .labels import hash_rank
from .quantiles import exact_percentile

#: Feature groups of the ablation.
GROUPS = {
    "thermal": ("brightness", "bright_t31", "frp", "log_frp", "thermal_excess", "confidence_score", "high_frp_flag"),
    "temporal": ("hour", "month", "day_of_year", "is_night", "night_fire_flag"),
    "persistence": (
        "hotspot_count_7d", "active_days_7d", "hotspot_count_30d", "active_days_30d", "persistence_score", "persistent_activity",
        "low_persistence_flag",
    ),
    "geo": ("distance_to_industrial_km", "distance_to_mining_km", "distance_to_gas_km"),
}


def _long(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))
    value = F.when(F.isnan("p.value") | (F.abs("p.value") == float("inf")), None).otherwise(F.col("p.value"))
    return df.select(F.explode(pairs).alias("p")).select("p.feature", value.alias("value"))


def medians(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """(feature, median, missing); infinite values count as missing."""
    values = _long(df, features)
    missing = values.groupBy("feature").agg(F.sum(F.col("value").isNull().cast("int")).alias("missing"))
    # One row per feature.
    middle = exact_percentile(values, 0.5).select("feature", F.col("percentile").alias("median"))
    return missing.join(F.broadcast(middle), "feature", "left").select("feature", "median", "missing")


def imputed(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Missing and infinite inputs replaced by the median of their column."""
    wide = medians(df, features).groupBy().agg(*(F.max(F.when(F.col("feature") == f, F.col("median"))).alias(f"_m_{f}") for f in features))
    df = df.crossJoin(F.broadcast(wide))
    bad = lambda f: F.col(f).isNull() | F.isnan(F.col(f).cast("double")) | (F.abs(F.col(f)) == float("inf"))
    kept = [c for c in df.columns if c not in features and not c.startswith("_m_")]
    return df.select(*kept, *(F.when(bad(f), F.col(f"_m_{f}")).otherwise(F.col(f).cast("double")).alias(f) for f in features))


def varying(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """(feature, constant): 1 where a column has at most one value."""
    ends = _long(df, features).groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return ends.select("feature", F.coalesce((F.col("lo") == F.col("hi")), F.lit(True)).cast("int").alias("constant"))


def split_stratified(df: DataFrame, share: float = 0.2, key: str = "event_id", label: str = "fire_type") -> DataFrame:
    """Adds ``part``: the first ``share`` of each class in a fixed random order is the test part."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_all"))
    # One row per class: by its class, most rows would be dealt to a few tasks.
    ranked = hash_rank(df, label, F.col(key)).join(F.broadcast(sizes), label)
    test = F.col("hash_rank") <= F.floor(F.col("_all") * share + 0.5)
    return ranked.withColumn("part", F.when(test, "test").otherwise("train")).drop("hash_rank", "_all")


def dealt(df: DataFrame, by: tuple[str, ...] = ("event_id",), most: int = 100_000) -> DataFrame:
    """The rows by a hash of columns that tell them apart, in partitions of about ``most``, but no fewer than there are cores.

    Fits keep their rows by partition, and a table that is read back has as many as its files have row groups.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // most))
    return df.repartition(n, *(by if set(by) <= set(df.columns) else ()))


def train(df: DataFrame, features: tuple[str, ...], trees: int = 20, depth: int = 6) -> PipelineModel:
    """Random forest on complete rows; class indexes in alphabetical order."""
    labels = StringIndexer(inputCol="fire_type", outputCol="label", stringOrderType="alphabetAsc").fit(df)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=42)
    inputs = VectorAssembler(inputCols=list(features), outputCol="x")
    kept = [c for c in ("event_id", "fire_type") if c in df.columns]
    fitted = forest.fit(inputs.transform(labels.transform(dealt(df.select(*kept, *features)))))
    return PipelineModel([labels, inputs, fitted, IndexToString(inputCol="prediction", outputCol="predicted", labels=labels.labels)])


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """event_id, class, confidence, and the probability of each class as a map."""
    names = model.stages[0].labels
    p = vector_to_array("probability")
    scored = PipelineModel(model.stages[1:]).transform(df)
    return scored.select(
        *[c for c in ("event_id", "fire_type") if c in df.columns], F.col("predicted").alias("predicted_fire_type"),
        F.array_max(p).alias("confidence"), F.map_from_arrays(F.array(*map(F.lit, names)), p).alias("probabilities"),
    )


def train_boosted(df: DataFrame, features: tuple[str, ...], rounds: int = 12, depth: int = 5, step: float = 0.4) -> boosted.Boosted:
    """Gradient-boosted trees that tell each class from all others, for all classes at once."""
    return boosted.train(df, features, rounds, depth, step)


def score_boosted(model: boosted.Boosted, df: DataFrame) -> DataFrame:
    """As ``score``: each class's probability against the others, divided by their sum; ties to the first class."""
    rows = boosted.probabilities(model, df, *(c for c in ("event_id", "fire_type") if c in df.columns))
    rows = rows.withColumn("_sum", F.aggregate("_p", F.lit(0.0), lambda a, x: a + x))
    p = F.transform("_p", lambda x: x / F.col("_sum"))
    names = F.array(*map(F.lit, model.names)).cast("array<string>")
    best = F.get(names, (F.array_position("_p", F.array_max("_p")) - 1).cast("int"))
    return rows.select(
        *[c for c in ("event_id", "fire_type") if c in df.columns], best.alias("predicted_fire_type"),
        F.array_max(p).alias("confidence"), F.map_from_arrays(names, p).alias("probabilities"),
    )


def importance(model: PipelineModel, features: tuple[str, ...]) -> DataFrame:
    from pyspark.sql import SparkSession

    values = [(f, float(v)) for f, v in zip(features, model.stages[2].featureImportances.toArray(), strict=True)]
    return SparkSession.getActiveSession().createDataFrame(values, "feature string, importance double")


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy(F.col("fire_type").alias("actual"), F.col("predicted_fire_type").alias("predicted")).agg(F.count("*").alias("n"))


def metrics(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, and accuracy, macro and weighted F1 as rows of their own."""
    cells = confusion(predictions)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    actual = cells.groupBy(F.col("actual").alias("name")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    said = cells.groupBy(F.col("predicted").alias("name")).agg(F.sum("n").alias("said"))
    per = actual.join(said.hint("merge"), "name", "left").fillna(0, ["said"])
    precision = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0)
    per = per.withColumns({"precision": precision, "recall": F.col("tp") / F.col("support")})
    total = F.col("precision") + F.col("recall")
    per = per.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))
    none = F.lit(None).cast("double")
    overall = per.agg(
        F.sum("support").alias("support"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted"),
    )
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).alias("f1")) for n, c in (("~accuracy", "accuracy"), ("~macro", "macro"), ("~weighted", "weighted"))))
    summary = overall.select("support", F.explode(rows).alias("r")).select("r.name", "support", none.alias("precision"), none.alias("recall"), "r.f1")
    out = per.select("name", "support", "precision", "recall", "f1").unionByName(summary)
    return out.select("name", "support", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def ablation(df: DataFrame, groups: dict[str, tuple[str, ...]] = GROUPS) -> DataFrame:
    """Accuracy on the test part with each group of features, with all, and with all but the distances."""
    sets = dict(groups) | {
        "all": tuple(f for g in groups.values() for f in g),
        "combined": tuple(f for n, g in groups.items() if n != "geo" for f in g),
    }
    parts = None
    for name, features in sets.items():
        model = train(df.filter("part = 'train'"), features, trees=8, depth=5)
        scored = score(model, df.filter("part = 'test'"))
        right = F.avg((F.col("fire_type") == F.col("predicted_fire_type")).cast("double"))
        row = scored.agg(right.alias("accuracy")).select(F.lit(name).alias("feature_group"), F.lit(len(features)).alias("features"), "accuracy")
        parts = row if parts is None else parts.unionByName(row)
    return parts
