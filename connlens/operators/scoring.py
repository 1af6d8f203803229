"""The scan job: log rows to scored, labelled result rows; and model retraining."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from connlens.functions.scalars import fit_width, zero_if_missing, zoned_time
from connlens.operators import encoding, scaling
from connlens.operators.one_class import KernelModel, OneClassModel, fit_one_class, label, score_kernel, score_one_class
from connlens.operators.registry import latest_version
from connlens.operators.scaling import Scaler

Model = KernelModel | OneClassModel


@dataclass(frozen=True)
class Detector:
    """Encoder table, scaler and one-class model: all a scan needs."""

    encoder: DataFrame
    scaler: Scaler
    model: Model


def vectorise(log: DataFrame, encoder: DataFrame, scaler: Scaler, nan_policy: str = "pre", order: str = "line_no") -> DataFrame:
    """Scaled vector ``z`` next to the log columns; categories are kept as text."""
    encoded = encoding.apply_encoder(log, encoder, suffix="_id", order=order)
    named = {f"{c}_id" if c in encoding.CATEGORICAL else c: i for i, c in enumerate(scaler.features)}
    on_ids = Scaler(tuple(named), scaler.mean, scaler.std)
    return scaling.apply_scaler(encoded, on_ids, nan_policy).drop(*[f"{c}_id" for c in encoding.CATEGORICAL])


def score_vectors(df: DataFrame, model: Model, vector: str = "z", output: str = "score") -> DataFrame:
    scorer = score_kernel if isinstance(model, KernelModel) else score_one_class
    return scorer(df, model, vector, output)


def score_log(log: DataFrame, detector: Detector, nan_policy: str = "pre", cut: float = 0.0) -> DataFrame:
    """Log rows with ``z``, ``score`` and ``prediction``. One narrow plan: the parameters are literals or broadcast."""
    scored = score_vectors(vectorise(log, detector.encoder, detector.scaler, nan_policy), detector.model)
    return scored.withColumn("prediction", label("score", cut))


def result_rows(scored: DataFrame) -> DataFrame:
    """``[scan_id,] uid, timestamp, score, prediction``; a row without uid is named after its line."""
    uid = F.col("uid") if "uid" in scored.columns else F.lit(None).cast("string")
    line = F.col("line_no").cast("string") if "line_no" in scored.columns else F.lit("0")
    time = zoned_time("ts") if "ts" in scored.columns else zoned_time(F.current_timestamp())
    lead = ["scan_id"] if "scan_id" in scored.columns else []
    return scored.select(
        *lead, F.coalesce(uid, F.concat(F.lit("unknown-"), line)).alias("uid"), time.alias("timestamp"), "score", "prediction"
    )


def score_scan(log: DataFrame, detector: Detector, nan_policy: str = "pre", cut: float = 0.0) -> DataFrame:
    return result_rows(score_log(log, detector, nan_policy, cut))


def score_corpus(log: DataFrame, detector: Detector, nan_policy: str = "pre") -> tuple[DataFrame, DataFrame]:
    """All scans in one job. Rows without a scan or a time go to the second, rejected frame."""
    good = F.col("scan_id").isNotNull() & F.col("ts").isNotNull()
    rejected = log.filter(~good).select("scan_id", "uid", F.when(F.col("scan_id").isNull(), "no scan").otherwise("no time").alias("reason"))
    return score_scan(log.filter(good), detector, nan_policy), rejected


def fit_detector(log: DataFrame, order: str = "line_no", nan_policy: str = "pre", encoder: DataFrame | None = None, **options) -> Detector:
    """Encoder, scaler and model from the rows of normal traffic."""
    table = encoding.fit_encoder(log, order=order) if encoder is None else encoder
    encoded = encoding.apply_encoder(log, table, suffix="_id", order=order)
    features = scaling.feature_order(log)
    on_ids = [f"{c}_id" if c in encoding.CATEGORICAL else c for c in features]
    fitted = scaling.fit_scaler(encoded, on_ids, nan_policy)
    vectors = scaling.apply_scaler(encoded, fitted, nan_policy).select("z")
    model = fit_one_class(vectors, "z", **options)
    return Detector(table, Scaler(tuple(features), fitted.mean, fitted.std), model)


def training_report(scored: DataFrame, origin: str | None = None, categories: str | None = None) -> DataFrame:
    """Counters of a training run as ``(measure, name, value)`` rows."""
    overall = scored.agg(F.count("*").cast("double").alias("rows"), F.avg(-F.col("score")).alias("mean_anomaly_score"), F.stddev_pop("score").alias("std_anomaly_score"))
    out = overall.select(F.explode(F.array(*[
        F.struct(F.lit("total").alias("measure"), F.lit(c).alias("name"), F.col(c).alias("value")) for c in overall.columns
    ])).alias("r")).select("r.*")
    for measure, column in (("origin", origin), ("category", categories)):
        if column:
            counts = scored.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").cast("double").alias("value"))
            out = out.unionByName(counts.select(F.lit(measure).alias("measure"), F.col(column).alias("name"), "value"))
    return out


def retrain_labelled(labelled: DataFrame, scaler: Scaler, vector: str = "feature_vector", category: str | None = "attack_category", fit_to_width: bool = False, **options) -> tuple[OneClassModel, DataFrame]:
    """Fit on the labelled vectors alone, under the existing scaler. Returns the model and the report."""
    rows = labelled.filter(F.col(vector).isNotNull())
    width = len(scaler.mean)
    if fit_to_width:
        rows = scaling.align_width(rows, vector, width)
    else:
        other = rows.filter(F.size(vector) != width).limit(1).count()
        if other:
            raise ValueError(f"labelled vectors differ from the scaler's width {width}; pass fit_to_width=True to pad or cut them")
    z = scaling.scale_vector(rows, vector, scaler)
    model = fit_one_class(z, "z", **options)
    return model, training_report(score_one_class(z, model), categories=category)


def full_retrain(
    normal: DataFrame | None, labelled: DataFrame | None, encoder: DataFrame | None = None, unknown: DataFrame | None = None,
    vector: str = "features", order: str = "line_no", category: str = "attack_category", **options,
) -> tuple[Detector, DataFrame]:
    """Expand the encoder, stack normal and labelled vectors, refit scaler and model.

    ``normal`` is a log; ``labelled`` has ``vector`` and is padded or cut to
    the width of the normal vectors. Returns the detector and the report.
    """
    parts, features, table = [], None, encoder
    if normal is not None:
        if table is None:
            table = encoding.fit_encoder(normal, order=order)
        elif unknown is not None:
            table = encoding.expand_encoder(table, unknown)[0]
        features = scaling.feature_order(normal)
        encoded = encoding.apply_encoder(normal, table, suffix="_id", order=order)
        ids = [f"{c}_id" if c in encoding.CATEGORICAL else c for c in features]
        parts.append(scaling.assemble(encoded, ids, "v").select("v", F.lit("normal").alias("origin"), F.lit(None).cast("string").alias("category")))
    if labelled is not None:
        rows = labelled.filter(F.col(vector).isNotNull())
        if features is not None:
            rows = scaling.align_width(rows, vector, len(features))
        kind = F.col(category) if category in labelled.columns else F.lit(None).cast("string")
        parts.append(rows.select(F.col(vector).alias("v"), F.lit("labelled").alias("origin"), kind.alias("category")))
    if not parts:
        raise ValueError("no training data: both inputs are absent")
    stacked = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    filled = stacked.withColumn("v", F.transform("v", lambda x: zero_if_missing(x)))
    width = len(features) if features is not None else filled.agg(F.max(F.size("v")).alias("w")).first()["w"]
    filled = filled.withColumn("v", fit_width("v", width))
    fitted = scaling.fit_vector_scaler(filled, "v", width)
    z = scaling.scale_vector(filled, "v", fitted)
    model = fit_one_class(z, "z", **options)
    names = tuple(features) if features is not None else fitted.features
    report = training_report(score_one_class(z, model), "origin", "category")
    return Detector(table, Scaler(names, fitted.mean, fitted.std), model), report


# --- storage ---------------------------------------------------------------

def save_detector(detector: Detector, root: str, version: int, created: str | None = None) -> None:
    """Write the three parts, then one registry row per part: a version counts once all rows are there."""
    spark = detector.encoder.sparkSession
    base = f"{root}/parts/v{version}"
    tables = {"encoders": detector.encoder, "scaler": _scaler_table(spark, detector.scaler)}
    if isinstance(detector.model, OneClassModel):
        tables["model"] = detector.model.table(spark)
    else:
        m = detector.model
        rows = [(m.gamma, m.rho, [float(x) for x in v], float(a)) for v, a in zip(m.vectors, m.alphas, strict=True)]
        tables["model"] = spark.createDataFrame(rows, "gamma double, rho double, sv array<double>, alpha double")
    rows = []
    for part, table in tables.items():
        path = f"{base}/{part}"
        table.write.mode("error").parquet(path)
        rows.append(("detector", f"v{version}", part, path))
    stamp = F.lit(created).cast("timestamp") if created else F.current_timestamp()
    entry = spark.createDataFrame(rows, "model string, version string, part string, path string").withColumn("created_at", stamp)
    entry.coalesce(1).write.mode("append").parquet(f"{root}/registry")


def _scaler_table(spark: SparkSession, scaler: Scaler) -> DataFrame:
    rows = [(i, f, m, s) for i, (f, m, s) in enumerate(zip(scaler.features, scaler.mean, scaler.std, strict=True))]
    return spark.createDataFrame(rows, "position int, feature string, mean double, std double")


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/registry")


def load_detector(spark: SparkSession, root: str, version: int | None = None) -> Detector:
    """The given or the latest complete version."""
    registry = read_registry(spark, root)
    number = latest_version(registry).first()["version"] if version is None else version
    if number is None:
        raise ValueError(f"no complete model version under {root}")
    paths = {r["part"]: r["path"] for r in registry.filter(F.col("version") == f"v{number}").collect()}
    scaler = spark.read.parquet(paths["scaler"]).orderBy("position").collect()
    stored = spark.read.parquet(paths["model"])
    if "weights" in stored.columns:
        model: Model = OneClassModel.from_row(stored.first())
    else:
        rows = stored.collect()
        model = KernelModel(tuple(tuple(r["sv"]) for r in rows), tuple(r["alpha"] for r in rows), rows[0]["gamma"], rows[0]["rho"])
    fitted = Scaler(tuple(r["feature"] for r in scaler), tuple(r["mean"] for r in scaler), tuple(r["std"] for r in scaler))
    return Detector(spark.read.parquet(paths["encoders"]), fitted, model)
