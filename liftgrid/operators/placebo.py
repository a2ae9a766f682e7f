"""Falsification: a learner must find no effect of a treatment nobody received."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgrid.learners.boosting import PLACEBO_PARAMS, BoostParams
from liftgrid.learners.meta import fit_t_learner
from liftgrid.operators.bootstrap import bootstrap_means, percentile_interval
from liftgrid.operators.quality import arm_rows
from liftgrid.operators.sampling import pseudo_assignment, stratified_holdout
from liftgrid.session import cut_lineage
from liftgrid.spec import ExperimentSpec

PRACTICAL_SHARE = 0.10


def placebo_scores(
    df: DataFrame,
    spec: ExperimentSpec,
    outcome: str | None = None,
    params: BoostParams = PLACEBO_PARAMS,
    seed: int = 42,
) -> DataFrame:
    """``(unit_id, tau)`` of held-out controls under a random 50/50 assignment.

    Equal arms keep both outcome models equally calibrated, so a difference between them is
    noise. The hold-out is 30%, stratified on assignment and outcome.
    """
    y = outcome or spec.primary_outcome
    controls = pseudo_assignment(arm_rows(df, spec, 0), spec, 0.5, seed)
    fake = replace(spec, treatment="pseudo")
    marked = stratified_holdout(controls, fake, 0.30, seed, ["pseudo", y])
    model = fit_t_learner(marked.where(~F.col("holdout")), fake, None, y, params)
    scored = model.transform(marked.where("holdout"))
    return cut_lineage(scored.select(spec.unit_id, "tau"))


def placebo_verdict(
    scores: DataFrame,
    unit_id: str,
    real_ate: float,
    replicates: int = 1000,
    seed: int = 42,
    share: float = PRACTICAL_SHARE,
) -> DataFrame:
    """One row: mean effect, its bootstrap interval, and the two checks.

    The interval containing 0 is the statistical check. The practical one decides: the mean must
    be small next to the real effect of the experiment.
    """
    one = scores.withColumn("_everyone", F.lit(0))
    stats = one.groupBy("_everyone").agg(
        F.count(F.lit(1)).alias("n_scored"),
        F.avg("tau").alias("_mean"),
        F.stddev_pop("tau").alias("_std"),
    )
    means = bootstrap_means(one, unit_id, "tau", ["_everyone"], replicates, seed)
    joined = stats.join(percentile_interval(means, ["mean"], ["_everyone"]), "_everyone")
    real = abs(float(real_ate))
    ratio = F.abs("_mean") / F.lit(real) if real > 0 else F.lit(float("inf"))
    practical = ratio < share
    return joined.select(
        "n_scored",
        F.round("_mean", 6).alias("tau_mean"),
        F.round("_std", 6).alias("tau_std"),
        F.round("mean_low", 6).alias("ci_low"),
        F.round("mean_high", 6).alias("ci_high"),
        ((F.col("mean_low") <= 0) & (F.col("mean_high") >= 0)).alias("statistical_check_pass"),
        F.lit(round(real, 6)).alias("real_ate"),
        F.round(ratio * 100, 3).alias("practical_ratio_pct"),
        F.lit(share * 100).alias("practical_threshold_pct"),
        practical.alias("practical_check_pass"),
        F.when(practical, "PASS").otherwise("FAIL").alias("overall_verdict"),
    )


def control_pool(df: DataFrame, spec: ExperimentSpec, outcome: str | None = None) -> DataFrame:
    """``(n_control_pool, base_rate)`` of the units a placebo test uses."""
    y = outcome or spec.primary_outcome
    return arm_rows(df, spec, 0).agg(
        F.count(F.lit(1)).alias("n_control_pool"), F.avg(y).alias("base_rate")
    )


def placebo_report(pool: DataFrame, verdict: DataFrame, share: float = 0.5) -> DataFrame:
    """The verdict of :func:`placebo_verdict` with the pool of :func:`control_pool` and the assignment, in one row.

    ``base_rate`` is what both outcome models start from, as the arms are halves of one pool.
    """
    treated = round(100 * share)
    told = f"{treated}/{100 - treated}{' symmetric' if share == 0.5 else ''}"
    rows = pool.select("n_control_pool", F.lit(told).alias("pseudo_assignment"), F.round("base_rate", 9).alias("base_rate"))
    # Both sides are one row of an ungrouped aggregate.
    return rows.join(F.broadcast(verdict))
