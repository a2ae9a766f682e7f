"""Standardization fitted on the training rows only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftgrid.spec import ExperimentSpec


@dataclass(frozen=True)
class Scaler:
    """Mean and scale per feature. The scale is the population deviation, 1 where that is 0."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace the features by their standardized values, in place and without a shuffle."""
        return df.withColumns(
            {
                c: (F.col(c) - F.lit(m)) / F.lit(s)
                for c, m, s in zip(self.features, self.mean, self.scale)
            }
        )

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(self.features, self.mean, self.scale))
        return spark.createDataFrame(rows, "feature string, mean double, scale double")

    @staticmethod
    def from_frame(df: DataFrame) -> Scaler:
        rows = df.select("feature", "mean", "scale").collect()
        return Scaler(*(tuple(r[i] for r in rows) for i in range(3)))


def fit_scaler(train: DataFrame, spec: ExperimentSpec) -> Scaler:
    """One aggregate over the training rows; two numbers per feature reach the driver."""
    stats = train.agg(
        *[F.avg(c).alias(f"{c}__mean") for c in spec.features],
        *[F.stddev_pop(c).alias(f"{c}__std") for c in spec.features],
    ).first()
    return Scaler(
        spec.features,
        tuple(stats[f"{c}__mean"] or 0.0 for c in spec.features),
        tuple(stats[f"{c}__std"] or 1.0 for c in spec.features),
    )


def scale_splits(df: DataFrame, spec: ExperimentSpec, split: str = "split") -> tuple[DataFrame, Scaler]:
    """Fit on the ``train`` split and standardize every split with it."""
    scaler = fit_scaler(df.where(F.col(split) == "train"), spec)
    return scaler.transform(df), scaler


def compact(df: DataFrame, spec: ExperimentSpec, extra: tuple[str, ...] = ("split",)) -> DataFrame:
    """Narrow storage types: float features, byte treatment and outcomes."""
    return df.select(
        spec.unit_id,
        *[F.col(c).cast("float").alias(c) for c in spec.features],
        *[F.col(c).cast("byte").alias(c) for c in (spec.treatment, *spec.outcomes)],
        *[c for c in extra if c in df.columns],
    )


def assemble(df: DataFrame, spec: ExperimentSpec, output: str = "features") -> DataFrame:
    """Add the feature vector the learners read; rows with a missing feature stay, as NaN."""
    as_double = df.withColumns({c: F.col(c).cast("double") for c in spec.features})
    return VectorAssembler(
        inputCols=list(spec.features), outputCol=output, handleInvalid="keep"
    ).transform(as_double)
