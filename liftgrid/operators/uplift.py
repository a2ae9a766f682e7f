"""Ranking quality: uplift curve, AUUC, Qini, uplift at k, deciles, leaderboard.

Input is one row per unit and group (model, split, ...) with treatment, outcome and score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftgrid.functions.hashing import draw, draw_number
from liftgrid.operators.ranking import (
    BUCKET,
    ROWS_PER_BUCKET,
    SCORE,
    Buckets,
    bucketed,
    rows_at_ranks,
    running_totals,
    within_cuts,
)
from liftgrid.spec import ExperimentSpec

DECILES = 10


def binary(column: str | Column) -> Column:
    """The column as 0 or 1; any other value raises, since sums of it would be cut to integers."""
    col = F.col(column) if isinstance(column, str) else column
    other = F.raise_error(F.concat(F.lit("outcome or treatment outside 0 and 1: "), col.cast("string")))
    return F.when(col.isNull() | col.isin(0, 1), col.cast("bigint")).otherwise(other.cast("bigint"))


def arm_sums(spec: ExperimentSpec, outcome: str | None = None) -> dict[str, Column]:
    """The four sums every ranking metric is made of."""
    t, y = binary(spec.treatment), binary(outcome or spec.primary_outcome)
    return {"t": t, "c": 1 - t, "yt": y * t, "yc": y * (1 - t)}


def lift(t: Column, c: Column, yt: Column, yc: Column) -> Column:
    """Treated rate minus control rate; null while an arm is empty."""
    return F.when((t > 0) & (c > 0), yt / t - yc / c)


def uplift_curve(
    df: DataFrame,
    spec: ExperimentSpec,
    score: str = "tau",
    outcome: str | None = None,
    groups: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
    fitted: Buckets | None = None,
) -> DataFrame:
    """``(*groups, unit_id, score, rank, n, uplift, treatment, outcome)``, one row per unit.

    ``uplift`` is the rate difference among the units ranked so far, 0 while an arm is empty.
    """
    y = outcome or spec.primary_outcome
    slim = df.select(*groups, spec.unit_id, score, spec.treatment, y)
    placed = bucketed(slim, score, spec.unit_id, rows_per_bucket, fitted)
    ranked = running_totals(placed, spec.unit_id, groups, arm_sums(spec, y))
    value = F.coalesce(lift(*[F.col(f"cum_{k}") for k in ("t", "c", "yt", "yc")]), F.lit(0.0))
    return ranked.select(
        *groups, spec.unit_id, score, spec.treatment, y, "rank", "n", value.alias("uplift")
    )


def decile_of(rank: Column, n: Column, parts: int = DECILES) -> Column:
    """Bin of a 1-based rank when edge i lies at floor(i*n/parts)."""
    return F.floor((parts * rank + n - 1) / n).cast("int")


def ranking_metrics(
    df: DataFrame,
    spec: ExperimentSpec,
    score: str = "tau",
    outcome: str | None = None,
    groups: Sequence[str] = (),
    ks: Sequence[float] = (0.10, 0.20),
    rows_per_bucket: int = ROWS_PER_BUCKET,
    fitted: Buckets | None = None,
) -> DataFrame:
    """One row per group: n, ATE, AUUC, Qini (flat and triangle), uplift at k, score moments
    and the decile table, all from a single ranking of the units.

    ``qini`` subtracts the area of a flat line at the ATE, the expectation under a useless
    ranking. ``qini_triangle`` subtracts ATE/2 and is kept for comparison with older logs.
    """
    y = outcome or spec.primary_outcome
    curve = uplift_curve(df, spec, score, y, groups, rows_per_bucket, fitted)
    t, outcome_col, s = binary(spec.treatment), binary(y), F.col(score).cast("double")
    inside = {f"_k{i}": F.col("rank") <= F.floor(F.col("n") * F.lit(float(k))) for i, k in enumerate(ks)}
    cells = {
        "t": t,
        "c": 1 - t,
        "yt": outcome_col * t,
        "yc": outcome_col * (1 - t),
    }
    by_decile = curve.withColumn("_decile", decile_of(F.col("rank"), F.col("n"))).groupBy(
        *groups, "_decile"
    ).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum("uplift").alias("_area"),
        F.sum(s).alias("_s1"),
        F.avg(s).alias("_mean"),
        (F.var_pop(s) * F.count(s)).alias("_m2"),
        F.count(s).alias("_scored"),
        *[F.sum(c).alias(f"_{name}") for name, c in cells.items()],
        *[
            F.coalesce(F.sum(F.when(at, c)), F.lit(0)).alias(f"{k}_{name}")
            for k, at in inside.items()
            for name, c in cells.items()
        ],
    )
    entry = F.struct(
        F.col("_decile").alias("decile"),
        F.col("_rows").alias("n"),
        F.round("_mean", 6).alias("mean_predicted_tau"),
        F.round(lift(*[F.col(f"_{k}") for k in cells]), 6).alias("observed_lift"),
    )
    total = by_decile.groupBy(*groups).agg(
        F.sum("_rows").alias("n"),
        F.sum("_area").alias("_area"),
        F.sum("_s1").alias("_s1"),
        F.sum("_scored").alias("_scored"),
        F.collect_list(F.struct("_scored", "_mean", "_m2")).alias("_moments"),
        F.array_sort(F.collect_list(entry)).alias("decile_table"),
        *[F.sum(f"_{name}").alias(f"_{name}") for name in cells],
        *[F.sum(f"{k}_{name}").alias(f"{k}_{name}") for k in inside for name in cells],
    )
    n = F.col("n")
    mean = F.when(F.col("_scored") > 0, F.col("_s1") / F.col("_scored"))
    total = total.withColumns({"ate": lift(*[F.col(f"_{k}") for k in cells]), "tau_mean": mean})
    spread = F.aggregate(
        "_moments",
        F.lit(0.0),
        lambda acc, m: acc + m["_m2"] + m["_scored"] * F.pow(m["_mean"] - F.col("tau_mean"), F.lit(2.0)),
    )
    # The curve starts at 0 (one unit fills one arm) and ends at the ATE.
    auuc = (F.col("_area") - F.coalesce(F.col("ate"), F.lit(0.0)) / 2) / n
    at_k = [
        lift(*[F.col(f"{key}_{name}") for name in cells]).alias(uplift_name(k))
        for key, k in zip(inside, ks)
    ]
    return total.withColumn("auuc", auuc).select(
        *groups,
        "n",
        "ate",
        "auuc",
        (F.col("auuc") - F.col("ate") * (n - 1) / n).alias("qini"),
        (F.col("auuc") - F.col("ate") / 2).alias("qini_triangle"),
        *at_k,
        "tau_mean",
        F.when(F.col("_scored") > 0, F.sqrt(spread / F.col("_scored"))).alias("tau_std"),
        "decile_table",
    )


def uplift_name(k: float) -> str:
    return f"uplift_at_{k * 100:g}pct".replace(".", "_")


def uplift_at_k(
    df: DataFrame,
    spec: ExperimentSpec,
    ks: Sequence[float] = (0.10, 0.20),
    score: str = "tau",
    outcome: str | None = None,
    groups: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``(*groups, k, n_top, n_treatment, n_control, uplift)`` of the top ``floor(n*k)`` units.

    Only rows near a cut-off are sorted. ``uplift`` is null when an arm is empty.
    """
    y = outcome or spec.primary_outcome
    slim = df.select(*groups, spec.unit_id, score, spec.treatment, y)
    placed = bucketed(slim, score, spec.unit_id, rows_per_bucket)
    names = {f"k{i}": k for i, k in enumerate(ks)}
    cuts = rows_at_ranks(
        placed, spec.unit_id, groups, {c: F.floor(F.col("n") * F.lit(float(k))) for c, k in names.items()}
    )
    flagged = within_cuts(placed, spec.unit_id, groups, cuts, list(names))
    sums = arm_sums(spec, y)
    wide = flagged.groupBy(*groups).agg(
        *[
            F.coalesce(F.sum(F.when(F.col(c), v)), F.lit(0)).alias(f"{c}_{m}")
            for c in names
            for m, v in sums.items()
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(float(k)).alias("k"),
                (F.col(f"{c}_t") + F.col(f"{c}_c")).alias("n_top"),
                F.col(f"{c}_t").alias("n_treatment"),
                F.col(f"{c}_c").alias("n_control"),
                lift(*[F.col(f"{c}_{m}") for m in sums]).alias("uplift"),
            )
            for c, k in names.items()
        ]
    )
    return wide.select(*groups, F.inline(rows))


def with_decile(
    df: DataFrame,
    unit_id: str,
    score: str = "tau",
    groups: Sequence[str] = (),
    parts: int = DECILES,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``decile``, 1 for the highest scores. The rows themselves are not shuffled."""
    placed = bucketed(df, score, unit_id, rows_per_bucket)
    cut_names = [f"edge{i}" for i in range(1, parts)]
    ranks = {c: F.floor(F.col("n") * i / parts) for i, c in enumerate(cut_names, start=1)}
    cuts = rows_at_ranks(placed, unit_id, groups, ranks)
    flagged = within_cuts(placed, unit_id, groups, cuts, cut_names)
    passed = sum((F.when(F.col(c), 0).otherwise(1) for c in cut_names), F.lit(1))
    return flagged.withColumn("decile", passed.cast("int")).drop(*cut_names, SCORE, BUCKET)


def decile_table(
    df: DataFrame,
    spec: ExperimentSpec,
    score: str = "tau",
    outcome: str | None = None,
    groups: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``(*groups, decile, n, n_treatment, n_control, mean_predicted_tau, observed_lift)``."""
    y = outcome or spec.primary_outcome
    slim = df.select(*groups, spec.unit_id, score, spec.treatment, y)
    marked = with_decile(slim, spec.unit_id, score, groups, DECILES, rows_per_bucket)
    sums = arm_sums(spec, y)
    per = marked.groupBy(*groups, "decile").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("_mean"),
        *[F.sum(v).alias(f"_{m}") for m, v in sums.items()],
    )
    return per.select(
        *groups,
        "decile",
        "n",
        F.col("_t").alias("n_treatment"),
        F.col("_c").alias("n_control"),
        F.round("_mean", 6).alias("mean_predicted_tau"),
        F.round(lift(*[F.col(f"_{m}") for m in sums]), 6).alias("observed_lift"),
    )


def score_summary(df: DataFrame, score: str = "tau", groups: Sequence[str] = ()) -> DataFrame:
    """``(*groups, n, tau_mean, tau_std)`` with the population deviation."""
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("tau_mean"),
        F.stddev_pop(score).alias("tau_std"),
    )


def shuffled_score(unit_id: str, seed: int = 42) -> Column:
    """A score that ignores the data: ranks units by a digest of their key."""
    return draw_number(draw(unit_id, "perm", seed))


def permutation_check(
    df: DataFrame,
    spec: ExperimentSpec,
    outcome: str | None = None,
    groups: Sequence[str] = (),
    seed: int = 42,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Qini of a random ranking, which must be small next to the ATE."""
    y = outcome or spec.primary_outcome
    slim = df.select(*groups, spec.unit_id, spec.treatment, y).withColumn(
        "_shuffled", shuffled_score(spec.unit_id, seed)
    )
    metrics = ranking_metrics(slim, spec, "_shuffled", y, groups, (), rows_per_bucket)
    return metrics.select(*groups, *sanity_columns(F.col("qini"), F.col("ate")))


def sanity_columns(qini: Column, ate: Column) -> list[Column]:
    """The shuffled check's columns, from the Qini and the ATE of a random ranking."""
    limit = F.when(ate != 0, 0.1 * F.abs(ate)).otherwise(F.lit(1e-4))
    return [
        F.round(qini, 6).alias("shuffled_tau_qini"),
        F.round(ate, 6).alias("ate_for_reference"),
        (F.abs(qini) < limit).alias("sanity_pass"),
    ]
