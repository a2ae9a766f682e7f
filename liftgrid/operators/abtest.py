"""Arm counts, two-proportion tests, confidence intervals and detectable effects.

One scan reduces the units to a counts table with one row per outcome (and per group, if any);
all statistics are column arithmetic on that table, so they work for many experiments at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftgrid.functions.normal import detectable_shift, two_sided_p
from liftgrid.spec import ExperimentSpec

Z_95 = 1.959963985  # fixed value: the interval's critical value, as published


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def arm_counts(
    df: DataFrame,
    spec: ExperimentSpec,
    outcomes: Sequence[str] | None = None,
    groups: Sequence[str] = (),
) -> DataFrame:
    """``(*groups, outcome, n1, x1, n0, x0)`` for all outcomes from a single scan.

    An absent arm has counts of 0, which makes its rates null further on.
    """
    outcomes = list(outcomes or spec.outcomes)
    t = F.col(spec.treatment)
    sums = [F.count(F.lit(1)).alias("_n")] + [F.sum(o).cast("bigint").alias(o) for o in outcomes]
    per_arm = df.where(t.isin(0, 1)).groupBy(*groups, t.alias("_arm")).agg(*sums)
    pairs = ", ".join(f"'{o}', `{o}`" for o in outcomes)
    keys = [f"`{g}`" for g in groups]
    long = per_arm.selectExpr(
        *keys, "_arm", "_n", f"stack({len(outcomes)}, {pairs}) as (outcome, _x)"
    )

    def arm(side: int, value: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_arm") == side, F.col(value))), F.lit(0)).cast("bigint")

    return long.groupBy(*groups, "outcome").agg(
        arm(1, "_n").alias("n1"),
        arm(1, "_x").alias("x1"),
        arm(0, "_n").alias("n0"),
        arm(0, "_x").alias("x0"),
    )


def proportion_test(counts: DataFrame, alpha: float = 0.05, digits: bool = True) -> DataFrame:
    """Two-proportion z-test per counts row.

    The z statistic pools the variance; the interval on the absolute lift does not.
    """
    n1, x1, n0, x0 = (F.col(c).cast("double") for c in ("n1", "x1", "n0", "x0"))
    rates = counts.withColumns({"_p1": _ratio(x1, n1), "_p0": _ratio(x0, n0)})
    p1, p0 = F.col("_p1"), F.col("_p0")
    pooled = _ratio(x1 + x0, n1 + n0)
    rates = rates.withColumns(
        {
            "_lift": p1 - p0,
            "_se_pooled": F.sqrt(pooled * (1 - pooled) * (_ratio(F.lit(1.0), n1) + _ratio(F.lit(1.0), n0))),
            "_se": F.sqrt(_ratio(p1 * (1 - p1), n1) + _ratio(p0 * (1 - p0), n0)),
        }
    )
    rates = rates.withColumn("_z", _ratio(F.col("_lift"), F.col("_se_pooled")))
    rates = rates.withColumn("_p", two_sided_p(F.col("_z")))

    def shown(value: Column, places: int) -> Column:
        return F.round(value, places) if digits else value

    lift, se = F.col("_lift"), F.col("_se")
    return rates.select(
        *counts.columns,
        shown(p1, 6).alias("p_treatment"),
        shown(p0, 6).alias("p_control"),
        shown(lift, 6).alias("absolute_lift"),
        shown(_ratio(lift, p0) * 100, 3).alias("relative_lift_pct"),
        shown(F.col("_z"), 4).alias("z_statistic"),
        F.col("_p").alias("p_value"),
        (F.col("_p") < alpha).alias("significant"),
        shown(lift - Z_95 * se, 6).alias("ci_low"),
        shown(lift + Z_95 * se, 6).alias("ci_high"),
    )


def detectable_effect(
    counts: DataFrame, alpha: float = 0.05, power: float = 0.80, digits: bool = True
) -> DataFrame:
    """Smallest effect the observed sample sizes detect: Cohen's h and its rate equivalent."""
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    p0 = _ratio(F.col("x0").cast("double"), n0)
    h = detectable_shift(alpha, power) * F.sqrt(_ratio(F.lit(1.0), n0) + _ratio(F.lit(1.0), n1))
    p1 = F.pow(F.sin(F.asin(F.sqrt(p0)) + h / 2), F.lit(2.0))

    def shown(value: Column, places: int) -> Column:
        return F.round(value, places) if digits else value

    return counts.select(
        *counts.columns,
        shown(p0, 6).alias("baseline_control_rate"),
        shown(h, 6).alias("cohens_h_detectable"),
        shown(p1 - p0, 6).alias("mde_absolute"),
        shown(_ratio(p1 - p0, p0) * 100, 3).alias("mde_relative_pct"),
        F.lit(alpha).alias("alpha"),
        F.lit(power).alias("power"),
    )


def experiment_report(
    counts: DataFrame, alpha: float = 0.05, power: float = 0.80
) -> DataFrame:
    """Counts, test and detectable effect in one row per outcome."""
    return detectable_effect(proportion_test(counts, alpha), alpha, power)


def nested_report(report: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The report with one struct each for counts, test and power, as written to JSON."""
    return report.select(
        *groups,
        "outcome",
        F.struct(
            F.col("n1").alias("n_treatment"),
            F.col("x1").alias("x_treatment"),
            F.col("n0").alias("n_control"),
            F.col("x0").alias("x_control"),
        ).alias("raw_counts"),
        F.struct(
            "p_treatment",
            "p_control",
            "absolute_lift",
            "relative_lift_pct",
            "z_statistic",
            "p_value",
            "significant",
            F.array("ci_low", "ci_high").alias("ci_95_absolute_lift"),
        ).alias("ztest"),
        F.struct(
            "baseline_control_rate",
            "cohens_h_detectable",
            "mde_absolute",
            "mde_relative_pct",
            "alpha",
            "power",
        ).alias("retrospective_power"),
    )


def average_effect(
    df: DataFrame, spec: ExperimentSpec, outcome: str | None = None, groups: Sequence[str] = ()
) -> DataFrame:
    """``(*groups, ate)``: mean outcome of the treated minus that of the controls."""
    y, t = F.col(outcome or spec.primary_outcome), F.col(spec.treatment)
    ate = F.avg(F.when(t == 1, y)) - F.avg(F.when(t == 0, y))
    return df.groupBy(*groups).agg(ate.alias("ate"))

