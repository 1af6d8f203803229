"""Vector assembly, standard scaling and the three policies for missing numbers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from connlens.functions.scalars import fit_width, missing, zero_if_missing
from connlens.schemas import CATEGORICAL, FEATURES

NAN_POLICIES = ("pre", "post", "mean")


def feature_order(df: DataFrame, extra: Sequence[str] | None = None) -> list[str]:
    """Present categories first, then the numeric columns in model order (or ``extra`` as given)."""
    numbers = FEATURES[len(CATEGORICAL):] if extra is None else list(extra)
    return [c for c in CATEGORICAL if c in df.columns] + [c for c in numbers if c in df.columns]


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    """Doubles in the given order as one array; a text column that is no number raises."""
    return df.withColumn(output, F.array(*[F.col(c).cast("double") for c in columns]))


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per feature, fitted without missing values."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(
            list(zip(self.features, self.mean, self.std, strict=True)), "feature string, mean double, std double"
        )


def fit_scaler(df: DataFrame, columns: Sequence[str], nan_policy: str | None = None) -> Scaler:
    """One aggregation over all columns. ``nan_policy='pre'`` fits on zeros in place of missing numbers."""
    def value(c: str) -> Column:
        x = F.col(c).cast("double")
        return zero_if_missing(x) if nan_policy == "pre" else F.when(~missing(x), x)

    stats = []
    for i, c in enumerate(columns):
        stats += [F.avg(value(c)).alias(f"m{i}"), F.stddev_pop(value(c)).alias(f"s{i}")]
    row = df.agg(*stats).first()
    means = [row[f"m{i}"] if row[f"m{i}"] is not None else 0.0 for i in range(len(columns))]
    # A column without spread is only centred.
    stds = [row[f"s{i}"] or 1.0 for i in range(len(columns))]
    return Scaler(tuple(columns), tuple(means), tuple(stds))


def scaled(scaler: Scaler, nan_policy: str = "pre") -> list[Column]:
    """Scaled feature expressions.

    ``pre`` puts 0 for a missing number before scaling, ``post`` after it,
    ``mean`` puts the column mean (which scales to 0 as well).
    """
    if nan_policy not in NAN_POLICIES:
        raise ValueError(f"nan_policy must be one of {NAN_POLICIES}")
    out = []
    for c, m, s in zip(scaler.features, scaler.mean, scaler.std, strict=True):
        x = F.col(c).cast("double")
        if nan_policy == "pre":
            out.append((zero_if_missing(x) - F.lit(m)) / F.lit(s))
        elif nan_policy == "post":
            out.append(zero_if_missing((x - F.lit(m)) / F.lit(s)))
        else:
            filled = F.when(missing(x), F.lit(m)).otherwise(x)
            out.append((filled - F.lit(m)) / F.lit(s))
    return out


def apply_scaler(df: DataFrame, scaler: Scaler, nan_policy: str = "pre", output: str = "z") -> DataFrame:
    return df.withColumn(output, F.array(*scaled(scaler, nan_policy)))


def fit_vector_scaler(df: DataFrame, vector: str, width: int) -> Scaler:
    columns = [f"f{i}" for i in range(width)]
    wide = df.select(*[F.get(F.col(vector), F.lit(i)).alias(c) for i, c in enumerate(columns)])
    return fit_scaler(wide, columns)


def scale_vector(df: DataFrame, vector: str, scaler: Scaler, output: str = "z") -> DataFrame:
    """Scale an array column and put 0 for what is missing afterwards."""
    means = F.array(*[F.lit(m) for m in scaler.mean])
    stds = F.array(*[F.lit(s) for s in scaler.std])
    centred = F.zip_with(F.col(vector), means, lambda x, m: x - m)
    return df.withColumn(output, F.zip_with(centred, stds, lambda x, s: zero_if_missing(x / s)))


def align_width(df: DataFrame, vector: str, width: int) -> DataFrame:
    return df.withColumn(vector, fit_width(vector, width))


def missing_census(df: DataFrame, columns: Sequence[str], scaler: Scaler) -> DataFrame:
    """Missing cells before and after plain scaling, as one row."""
    def cells(expressions: Sequence[Column]) -> Column:
        total = F.lit(0)
        for e in expressions:
            total = total + F.when(missing(e), 1).otherwise(0)
        return F.coalesce(F.sum(total), F.lit(0))

    raw = [F.col(c).cast("double") for c in columns]
    after = [(F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(scaler.features, scaler.mean, scaler.std, strict=True)]
    return df.agg(F.count("*").alias("n"), cells(raw).alias("missing_before"), cells(after).alias("missing_after"))


def vector_missing_census(df: DataFrame, vector: str) -> DataFrame:
    holes = F.size(F.filter(F.col(vector), lambda x: x.isNull() | F.isnan(x)))
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(holes), F.lit(0)).alias("missing"))
