"""Covariate balance between the arms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftgrid.spec import ExperimentSpec

BALANCED_BELOW = 0.1


def balance_table(
    df: DataFrame,
    spec: ExperimentSpec,
    threshold: float = BALANCED_BELOW,
    groups: Sequence[str] = (),
) -> DataFrame:
    """Standardized mean difference of every feature, from one grouped scan.

    A pooled deviation of 0 gives an SMD of 0; ``degenerate`` then tells whether the arms are
    constant yet different. An absent arm gives nulls.
    """
    stats = [
        e
        for c in spec.features
        for e in (F.avg(c).alias(f"{c}__mean"), F.var_samp(c).alias(f"{c}__var"))
    ]
    t = F.col(spec.treatment)
    per_arm = df.where(t.isin(0, 1)).groupBy(*groups, t.alias("_arm")).agg(*stats)
    triples = ", ".join(f"'{c}', `{c}__mean`, `{c}__var`" for c in spec.features)
    long = per_arm.selectExpr(
        *[f"`{g}`" for g in groups],
        "_arm",
        f"stack({len(spec.features)}, {triples}) as (feature, _mean, _var)",
    )

    def arm(side: int, value: str) -> Column:
        return F.max(F.when(F.col("_arm") == side, F.col(value)))

    wide = long.groupBy(*groups, "feature").agg(
        arm(1, "_mean").alias("_m1"),
        arm(0, "_mean").alias("_m0"),
        arm(1, "_var").alias("_v1"),
        arm(0, "_var").alias("_v0"),
    )
    m1, m0 = F.col("_m1"), F.col("_m0")
    sd = F.sqrt((F.col("_v1") + F.col("_v0")) / 2)
    smd = F.when(sd > 0, (m1 - m0) / sd).when(sd == 0, F.lit(0.0))
    return wide.select(
        *groups,
        "feature",
        F.round(m1, 6).alias("mean_treatment"),
        F.round(m0, 6).alias("mean_control"),
        F.round("_v1", 6).alias("var_treatment"),
        F.round("_v0", 6).alias("var_control"),
        F.round(smd, 6).alias("smd"),
        (F.abs(smd) < threshold).alias("balanced"),
        ((sd == 0) & (m1 != m0)).alias("degenerate"),
    )


def balance_summary(table: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Feature count, number of unbalanced features and the largest absolute SMD."""
    return table.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_features"),
        F.count_if(~F.coalesce("balanced", F.lit(False))).alias("n_unbalanced"),
        F.max(F.abs("smd")).alias("max_abs_smd"),
    )
