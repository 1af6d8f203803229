"""Multi-class attack model on pyspark.ml: split, fit, predict, evaluate, tune."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial
from itertools import product
from multiprocessing.pool import ThreadPool
from statistics import fmean, pstdev

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassifier,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from connlens.functions.scalars import split_class
from connlens.operators import metrics
from connlens.operators.filters import browse, check_trainable, frequent_classes, page, trainable, with_class
from connlens.operators.ordered import ONE_TASK_ROWS, running_totals
from connlens.operators.spread import pin_small, side_by_side, sized_join, spread_evenly
from connlens.session import cut_lineage

FOREST = {"numTrees": 100, "maxDepth": 15, "minInstancesPerNode": 2}
BOOST = {"maxIter": 100, "stepSize": 0.1, "maxDepth": 10, "minInstancesPerNode": 2}

# Each row's node in each tree is kept from one pass to the next, four bytes each, in place of a walk from the root.
KEPT_PLACES = {"cacheNodeIds": True}

# Default grids; an unlimited depth is Spark's largest, 30. Spark trees have no minimum split size.
FOREST_GRID = {"numTrees": [50, 100, 200], "maxDepth": [10, 15, 20, 30], "minInstancesPerNode": [1, 2, 4]}
BOOST_GRID = {"maxIter": [50, 100, 200], "stepSize": [0.05, 0.1, 0.2], "maxDepth": [5, 10, 15]}


# Ranges of hashes in which the places of a class are counted before they are ranked.
RANGES = 4096


@dataclass(frozen=True)
class AttackModel:
    kind: str
    classes: tuple[str, ...]
    fitted: object
    threshold: float = 0.7
    facts: Mapping[str, object] = field(default_factory=dict, compare=False)

    @property
    def width(self) -> int:
        """Number of features."""
        return (self.fitted if self.kind == "random_forest" else self.fitted.models[0]).numFeatures

    def with_threshold(self, value: float) -> AttackModel:
        return AttackModel(self.kind, self.classes, self.fitted, check_threshold(value), self.facts)


def check_threshold(value: float) -> float:
    if not 0.0 <= value <= 1.0:
        raise ValueError(f"a threshold is a share from 0 to 1, not {value}")
    return value


def _place(key: str, seed: int) -> Column:
    """Position of a row in its class: a seeded hash of the key, then the key. Independent of the partitioning."""
    text = F.col(key).cast("string")
    return F.struct(F.xxhash64(text, F.lit(seed)).alias("h"), text.alias("k"))


def class_cuts(df: DataFrame, class_column: str, key: str, shares: Sequence[float], seed: int) -> DataFrame:
    """Per class, the places at rank round(share * class size), in order; shares that round to rank 0 are counted in ``_none``.

    The places of each of RANGES equal ranges of hashes are counted, and only those of a range that holds a wanted rank are
    ranked; the rows themselves, with their vectors, are later compared with these few places and never shuffled.
    """
    places = df.select(F.col(class_column).alias("_class"), _place(key, seed).alias("_p")).select("_class", F.floor(F.col("_p.h") / F.lit(2.0**64 / RANGES)).alias("_range"), "_p.h", "_p.k")
    along = W.partitionBy("_class").orderBy("_range")
    counts = places.groupBy("_class", "_range").agg(F.count("*").alias("_n")).withColumns({
        "_upto": F.sum("_n").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)), "_size": F.sum("_n").over(W.partitionBy("_class"))})
    ranks = F.array(*[F.round(F.lit(s) * F.col("_size")).cast("bigint") for s in shares])
    # Ranks of 0 are kept with the last range of their class.
    asked = counts.select("_class", "_range", "_n", (F.col("_upto") - F.col("_n")).alias("_before"), "_upto", "_size", F.explode(ranks).alias("_rank")).filter(
        F.col("_rank").between(F.col("_before") + 1, F.col("_upto")) | ((F.col("_rank") == 0) & (F.col("_upto") == F.col("_size"))))
    wanted = asked.select("_class", "_range", "_n", F.greatest(F.col("_rank") - F.col("_before"), F.lit(0)).alias("_rank"))
    few = pin_small(wanted)
    wanted = wanted if few is None else few
    held, within = wanted.filter("_rank > 0"), ["_class", "_range"]
    looked = held.select(*within).distinct()
    near = places.join(looked if few is None else F.broadcast(looked), within, "left_semi")
    if few is not None and (held.agg(F.max("_n")).first()[0] or 0) <= ONE_TASK_ROWS:
        ranked = near.withColumn("_rank", F.row_number().over(W.partitionBy(*within).orderBy("h", "k")))
    else:
        ranked = running_totals(near, ["h", "k"], {"_rank": F.lit(1)}, within)
    held = held if few is None else F.broadcast(held)
    found = held.select(*within, "_rank").join(ranked, [*within, "_rank"])
    cuts = found.groupBy("_class").agg(F.sort_array(F.collect_list(F.struct("h", "k"))).alias("_cuts"))
    none = wanted.groupBy("_class").agg(F.count_if(F.col("_rank") == 0).alias("_none"))
    return none.join(cuts, "_class", "left").withColumnRenamed("_class", class_column)


def passed_cuts(df: DataFrame, class_column: str, key: str, shares: Sequence[float], seed: int, name: str) -> DataFrame:
    """How many of its class's cuts lie before each row: 0 for the first share, 1 for the next, ..."""
    cut = sized_join(df, class_cuts(df, class_column, key, shares, seed), class_column, "inner")
    before = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<struct<h:bigint,k:string>>")), lambda c: c < F.col("_place")))
    placed = cut.withColumn("_place", _place(key, seed))
    return placed.withColumn(name, (before + F.col("_none")).cast("int")).drop("_cuts", "_none", "_place")


def stratified_split(df: DataFrame, class_column: str = "class_name", key: str = "uid", test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``side``: exactly round(share * class size) rows of each class are ``test``. Rows of one key stay together."""
    part = passed_cuts(df, class_column, key, [test_share], seed, "_part")
    return part.withColumn("side", F.when(F.col("_part") == 0, "test").otherwise("train")).drop("_part")


def class_sizes(df: DataFrame, class_column: str = "class_name") -> dict[str, int]:
    """Rows of each class: one number a class, as many as a prediction of the model holds for every row."""
    return {r[0]: r[1] for r in df.groupBy(class_column).count().collect()}


def prepare(df: DataFrame, classes: Sequence[str], vector: str = "features", class_column: str = "class_name", sizes: Mapping[str, int] | None = None) -> DataFrame:
    """Vector, class index in name order and balanced weight n / (classes * class size)."""
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(class_column)) - 1
    out = df.withColumns({"_vector": array_to_vector(F.col(vector)), "_label": index.cast("double")})
    if sizes is None:
        return out.withColumn("_weight", F.lit(1.0))
    n, k = sum(sizes.values()), len(sizes)
    weights = F.array(*[F.lit(n / (k * sizes[c])) for c in classes])
    return out.withColumn("_weight", F.element_at(weights, (index + 1).cast("int")))


def _estimator(kind: str, seed: int, options: Mapping[str, object]):
    names = {"featuresCol": "_vector", "labelCol": "_label", "predictionCol": "_prediction"}
    if kind == "random_forest":
        return RandomForestClassifier(
            **names, rawPredictionCol="_raw", probabilityCol="_probability", weightCol="_weight", seed=seed, **{**KEPT_PLACES, **FOREST, **options}
        )
    if kind == "gradient_boosting":
        binary = GBTClassifier(**names, seed=seed, **{**BOOST, **options}).setRawPredictionCol("_raw").setProbabilityCol("_probability")
        return OneVsRest(classifier=binary, **names, rawPredictionCol="_raw", parallelism=4)
    raise ValueError(f"classifier type {kind!r}: use 'random_forest' or 'gradient_boosting'")


def fit_attack_model(
    df: DataFrame, kind: str = "random_forest", vector: str = "features", class_column: str = "class_name",
    threshold: float = 0.7, seed: int = 42, **options,
) -> AttackModel:
    sizes = class_sizes(df, class_column)
    classes = sorted(sizes)
    ready = prepare(df, classes, vector, class_column, sizes if kind == "random_forest" else None)
    fitted = _estimator(kind, seed, options).fit(spread_evenly(ready.select("_vector", "_label", "_weight")))
    return AttackModel(kind, tuple(classes), fitted, check_threshold(threshold), {"training_rows": sum(sizes.values())})


def predict_classes(df: DataFrame, model: AttackModel, vector: str = "features", name: str = "classification") -> DataFrame:
    """Adds the struct ``name``: class parts, confidence, gate flags and the probability of each class.

    Below the threshold the class parts read ``unknown`` and the row asks for review.
    """
    ready = df.withColumn("_vector", array_to_vector(F.col(vector)))
    out = model.fitted.transform(ready)
    if model.kind == "random_forest":
        shares = vector_to_array(F.col("_probability"))
    else:
        # One binary model per class: logistic of twice the margin, scaled to sum 1.
        votes = F.transform(vector_to_array(F.col("_raw")), lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * m)))
        out = out.withColumn("_votes", votes)
        total = F.aggregate(F.col("_votes"), F.lit(0.0), lambda s, x: s + x)
        shares = F.transform(F.col("_votes"), lambda v: v / total)
    names = F.array(*[F.lit(c) for c in model.classes])
    out = out.withColumn("_shares", shares).withColumn("_top", F.array_max("_shares"))
    out = out.withColumn("_class", F.element_at(names, F.array_position("_shares", F.col("_top")).cast("int")))
    category, subcategory = split_class("_class")
    sure = F.col("_top") >= model.threshold
    answer = F.struct(
        F.when(sure, category).otherwise("unknown").alias("category"),
        F.when(sure, subcategory).otherwise("unknown").alias("subcategory"),
        F.col("_top").alias("confidence"), sure.alias("is_confident"), (~sure).alias("requires_review"),
        F.map_from_arrays(names, F.col("_shares")).alias("probabilities"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("note"),
    )
    return out.select(*df.columns, answer.alias(name), F.col("_class").alias("predicted_class"))


def evaluate(df: DataFrame, model: AttackModel, vector: str = "features", class_column: str = "class_name") -> dict[str, DataFrame]:
    """Summary, per-class report and confusion matrix of a labelled frame; the rows are predicted once."""
    predicted = cut_lineage(predict_classes(spread_evenly(df.select(class_column, vector)), model, vector).select(
        F.col(class_column).alias("true_label"), F.col("predicted_class").alias("prediction"), F.col("classification.confidence").alias("confidence")
    ))
    hit = F.when(F.col("true_label") == F.col("prediction"), 1.0).otherwise(0.0)
    summary = metrics.confident_accuracy(predicted, "true_label", "prediction", "confidence", model.threshold, F.avg(hit).alias("accuracy"))
    return {
        "summary": summary,
        "report": metrics.class_report(predicted),
        "confusion": metrics.confusion(predicted, classes=model.classes),
    }


def feature_importance(model: AttackModel, spark: SparkSession) -> DataFrame:
    """Importance per feature position; the mean over the class models for boosting."""
    if model.kind == "random_forest":
        values = list(model.fitted.featureImportances.toArray())
    else:
        each = [m.featureImportances.toArray() for m in model.fitted.models]
        values = list(sum(each) / len(each))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "feature int, importance double")


def train_from_store(
    store: DataFrame, minimum: str = "medium", least_per_class: int = 10, kind: str = "random_forest", vector: str = "feature_vector",
    threshold: float = 0.7, seed: int = 42, **options,
) -> tuple[AttackModel, dict[str, DataFrame]]:
    """Trainable rows of frequent classes, exact 80/20 split, fit, evaluation on the test side."""
    rows = cut_lineage(spread_evenly(with_class(trainable(store, minimum, vector)).select("uid", "class_name", vector)))
    before = rows.count()
    kept = frequent_classes(rows, "class_name", least_per_class)
    sizes = class_sizes(kept)
    check_trainable(before, len(sizes))
    split = cut_lineage(stratified_split(kept, seed=seed))
    model = fit_attack_model(split.filter("side = 'train'"), kind, vector, threshold=threshold, seed=seed, **options)
    facts = {"rows_before_class_filter": before, "training_samples": sum(sizes.values()), "classes_count": len(sizes)}
    model = AttackModel(model.kind, model.classes, model.fitted, model.threshold, facts)
    return model, evaluate(split.filter("side = 'test'"), model, vector)


def session_record(name: str, version: str, model: AttackModel, parts: dict[str, DataFrame], notes: str | None = None) -> DataFrame:
    """One row for the table of training sessions: sizes, accuracy, unweighted class means and the confusion matrix as JSON."""
    cell = F.struct("true_label", "predicted", "n")
    matrix = parts["confusion"].agg(F.to_json(F.sort_array(F.collect_list(cell))).alias("confusion_matrix"))
    means = parts["report"].agg(*[F.avg(c).alias(s) for c, s in (("precision", "precision_score"), ("recall", "recall_score"), ("f1_score", "f1_score"))])
    row = side_by_side([parts["summary"].select(F.col("accuracy").alias("accuracy_score")), means, matrix])
    return row.select(
        F.lit(name).alias("session_name"), F.lit(version).alias("model_version"),
        F.lit(model.facts.get("training_samples", model.facts.get("training_rows"))).cast("bigint").alias("training_data_count"),
        "accuracy_score", "precision_score", "recall_score", "f1_score", "confusion_matrix",
        F.current_timestamp().alias("completed_at"), F.lit(notes).cast("string").alias("notes"),
    )


def folds(df: DataFrame, class_column: str = "class_name", key: str = "uid", count: int = 5, seed: int = 42) -> DataFrame:
    """Stratified fold number per row."""
    return passed_cuts(df, class_column, key, [i / count for i in range(1, count)], seed, "fold")


def _in_folds(df: DataFrame, kind: str, vector: str, class_column: str, key: str, count: int, seed: int) -> DataFrame:
    split = folds(df, class_column, key, count, seed)
    sizes = class_sizes(split, class_column)
    ready = prepare(split, sorted(sizes), vector, class_column, sizes if kind == "random_forest" else None)
    # Written once: every fold reads these rows twice.
    return cut_lineage(spread_evenly(ready.select("_vector", "_label", "_weight", "fold")))


def _tuned(kind: str, seed: int):
    """Estimator, what its options belong to, and the evaluator."""
    estimator = _estimator(kind, seed, {})
    evaluator = MulticlassClassificationEvaluator(labelCol="_label", predictionCol="_prediction", metricName="accuracy")
    return estimator, estimator if kind == "random_forest" else estimator.getClassifier(), evaluator


def _search(df: DataFrame, grid: Mapping[str, Sequence], kind: str, vector: str, class_column: str, key: str, count: int, seed: int, parallelism: int):
    estimator, target, evaluator = _tuned(kind, seed)
    if grid:
        builder = ParamGridBuilder()
        for name, values in grid.items():
            builder = builder.addGrid(target.getParam(name), list(values))
        maps = builder.build()
    else:
        maps = [{}]
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, numFolds=count, foldCol="fold", seed=seed, parallelism=parallelism
    )
    return search.fit(_in_folds(df, kind, vector, class_column, key, count, seed))


def cross_validate(
    df: DataFrame, kind: str = "random_forest", vector: str = "features", class_column: str = "class_name", key: str = "uid",
    count: int = 5, seed: int = 42, parallelism: int = 2, **options,
) -> DataFrame:
    """Mean and population deviation of the accuracy over stratified folds: one fit a fold, and none of all rows, whose model nobody reads.

    A pass of a forest moves a histogram of every node from every partition, so
    ``parallelism`` forests grow side by side, each in its share of the slots.
    Boosting fits several classes at a time and has all slots.
    """
    spark, (estimator, target, evaluator) = df.sparkSession, _tuned(kind, seed)
    params = {target.getParam(name): value for name, value in options.items()}
    ready = _in_folds(df, kind, vector, class_column, key, count, seed)
    at_once = min(parallelism, count) if kind == "random_forest" else 1
    slots = max(1, spark.sparkContext.defaultParallelism // at_once)

    def accuracy(fold: int) -> float:
        train, test = ready.filter(F.col("fold") != fold), ready.filter(F.col("fold") == fold)
        for side, some in (("training", train), ("validation", test)):
            if some.isEmpty():
                raise ValueError(f"The {side} data at fold {fold} is empty.")
        return evaluator.evaluate(estimator.fit(train.repartition(slots), params).transform(test))

    with ThreadPool(at_once) as pool:
        found = pool.map(lambda fit: fit(), [inheritable_thread_target(spark)(partial(accuracy, i)) for i in range(count)], 1)
    return spark.createDataFrame([(count, fmean(found), pstdev(found))], "folds int, cv_mean double, cv_std double")


def grid_search(
    df: DataFrame, grid: Mapping[str, Sequence] | None = None, kind: str = "random_forest", vector: str = "features",
    class_column: str = "class_name", key: str = "uid", count: int = 3, seed: int = 42, parallelism: int = 2,
) -> DataFrame:
    """Mean accuracy of every combination, best first."""
    chosen = grid or (FOREST_GRID if kind == "random_forest" else BOOST_GRID)
    fitted = _search(df, chosen, kind, vector, class_column, key, count, seed, parallelism)
    rows = [({k: float(v) for k, v in zip(chosen, combo, strict=True)}, float(m)) for combo, m in zip(product(*chosen.values()), fitted.avgMetrics, strict=True)]
    out = df.sparkSession.createDataFrame(rows, "params map<string,double>, accuracy double")
    return out.orderBy(F.col("accuracy").desc(), F.to_json("params"))


def evaluate_verified(store: DataFrame, model: AttackModel, newest: int | None = None, least: int = 10, vector: str = "feature_vector") -> DataFrame:
    """Per-class report on all verified rows, or the newest of them, classes after the confidence gate."""
    rows = browse(store, review_status="verified")
    if newest is not None:
        rows = page(rows, limit=newest)
    usable = with_class(rows.filter(F.col(vector).isNotNull() & (F.length("label_category") > 0) & (F.length("label_subcategory") > 0)))
    found = usable.count()
    if found < least:
        raise ValueError(f"too few rows: {found} are verified, {least} are needed")
    predicted = predict_classes(spread_evenly(usable.select("class_name", vector)), model, vector)
    gated = F.concat_ws(".", "classification.category", "classification.subcategory")
    return metrics.class_report(predicted.select(F.col("class_name").alias("true_label"), gated.alias("prediction")))


# --- storage ---------------------------------------------------------------

def save_attack_model(model: AttackModel, path: str, spark: SparkSession) -> None:
    model.fitted.write().overwrite().save(f"{path}/fitted")
    row = (model.kind, list(model.classes), model.threshold)
    spark.createDataFrame([row], "kind string, classes array<string>, threshold double").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")


def load_attack_model(spark: SparkSession, path: str) -> AttackModel:
    facts = spark.read.parquet(f"{path}/facts").first()
    reader = RandomForestClassificationModel if facts["kind"] == "random_forest" else OneVsRestModel
    return AttackModel(facts["kind"], tuple(facts["classes"]), reader.load(f"{path}/fitted"), facts["threshold"])
