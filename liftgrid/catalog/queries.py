"""One entry per operator, over the experiment derived from the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from typing import TypeVar

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftgrid.functions.hashing import fold
from liftgrid.learners.boosting import BoostParams
from liftgrid.learners.dualhead import fit_dual_head
from liftgrid.learners.forest import (
    ForestParams,
    cross_fit_residuals,
    fit_dml_forest,
    fit_honest_forest,
    leaf_moments,
)
from liftgrid.learners.meta import (
    TLearnerModel,
    XLearnerModel,
    blend,
    fit_t_learner,
    fit_x_learner,
    long_predictions,
    pseudo_outcome_summary,
    pseudo_outcomes,
    treatment_rate,
    with_features,
)
from liftgrid.operators import (
    abtest,
    agreement,
    balance,
    bootstrap,
    evaluation,
    placebo,
    quality,
    ranking,
    sampling,
    scaling,
    tails,
    uplift,
)
from liftgrid.plans.stages import combined_job
from liftgrid.session import checkpoint_dir
from liftgrid.sources import tables
from liftgrid.sources.testbed import SPEC, experiment

REPLICATES = 200
PLACEBO_DRAWS = 1000
Query = Callable[[SparkSession, str], DataFrame]
R = TypeVar("R")

_stored: dict[tuple[str, str, str], object] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/liftgrid-{uuid.uuid4().hex}"


def _once(spark: SparkSession, folder: str, name: str, build: Callable[[], R]) -> R:
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _stored:
        _stored[key] = build()
    return _stored[key]


def units(spark: SparkSession, folder: str) -> DataFrame:
    """The experiment as a stored table by arm, written once per session and folder.

    It keeps the leak column, which the contract query must drop.
    """

    def build() -> DataFrame:
        path = scratch(spark)
        wide = experiment(spark, folder)
        tables.write_by_arm(wide, path, SPEC)
        return tables.read_by_arm(spark, path, SPEC)

    return _once(spark, folder, "units", build)


def splits(spark: SparkSession, folder: str) -> DataFrame:
    """Scaled train, val and test rows, stored by split."""

    def build() -> DataFrame:
        path = scratch(spark)
        split = sampling.stratified_split(units(spark, folder), SPEC)
        scaled, _ = scaling.scale_splits(split, SPEC)
        tables.write_splits(scaling.compact(scaled, SPEC), path)
        return spark.read.parquet(path)

    return _once(spark, folder, "splits", build)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Three deterministic scores per unit: two that follow the effect, one that does not."""
    entry = F.inline(
        F.array(
            F.struct(F.lit("a").alias("model"), F.col("f0").alias("tau")),
            F.struct(F.lit("b").alias("model"), (F.col("f0") + F.col("f5") / 10).alias("tau")),
            F.struct(F.lit("c").alias("model"), (-F.col("f7")).alias("tau")),
        )
    )
    df = units(spark, folder)
    return df.select(SPEC.unit_id, SPEC.treatment, *SPEC.outcomes, entry)


def one_score(spark: SparkSession, folder: str) -> DataFrame:
    return units(spark, folder).withColumn("tau", F.col("f0") + F.col("f5") / 10)


# Experiment statistics


def ab_report(spark: SparkSession, folder: str) -> DataFrame:
    report = abtest.experiment_report(abtest.arm_counts(units(spark, folder), SPEC))
    return report.withColumn("p_value", F.round("p_value", 12))


def arm_counts(spark: SparkSession, folder: str) -> DataFrame:
    return abtest.arm_counts(units(spark, folder), SPEC)


def arm_counts_by_size(spark: SparkSession, folder: str) -> DataFrame:
    """Many experiments at once: the report per value of f5."""
    counts = abtest.arm_counts(units(spark, folder), SPEC, groups=["f5"])
    test = abtest.proportion_test(counts)
    return test.select("f5", "outcome", "n1", "x1", "n0", "x0", "absolute_lift", "z_statistic", "ci_low", "ci_high")


def average_effect(spark: SparkSession, folder: str) -> DataFrame:
    ate = abtest.average_effect(units(spark, folder), SPEC)
    return ate.select(F.round("ate", 9).alias("ate"))


def detectable_effect(spark: SparkSession, folder: str) -> DataFrame:
    return abtest.detectable_effect(abtest.arm_counts(units(spark, folder), SPEC))


def balance_table(spark: SparkSession, folder: str) -> DataFrame:
    table = balance.balance_table(units(spark, folder), SPEC)
    wide = ["mean_treatment", "mean_control", "var_treatment", "var_control"]
    return table.withColumns({c: F.round(c, 3) for c in wide})


def balance_summary(spark: SparkSession, folder: str) -> DataFrame:
    return balance.balance_summary(balance.balance_table(units(spark, folder), SPEC))


# Quality


def contract_rows(spark: SparkSession, folder: str) -> DataFrame:
    return quality.select_contract(units(spark, folder), SPEC)


def control_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.arm_rows(units(spark, folder), SPEC, 0)
    return rows.select("unit_id", "visit", "conversion", "f0")


def column_profile(spark: SparkSession, folder: str) -> DataFrame:
    profile = quality.column_profile(units(spark, folder), SPEC)
    return profile.withColumn("mean", F.round("mean", 6))


def rate_checks(spark: SparkSession, folder: str) -> DataFrame:
    return quality.rate_checks(quality.column_profile(units(spark, folder), SPEC))


def quality_verdict(spark: SparkSession, folder: str) -> DataFrame:
    report = quality.quality_report(quality.select_contract(units(spark, folder), SPEC), SPEC)
    return report.select(
        "row_count",
        "schema_matches",
        F.size("missing_columns").alias("n_missing"),
        F.size("unexpected_columns").alias("n_unexpected"),
        "any_nulls",
        F.size(F.filter("rates", lambda r: ~r["within_tolerance"])).alias("n_rates_off"),
        "all_passed",
    )


# Sampling, splitting, scaling


def sample_rows(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.stratified_sample(units(spark, folder), SPEC, 0.10).select("unit_id", "treatment")


def sample_builtin(spark: SparkSession, folder: str) -> DataFrame:
    sample = sampling.stratified_sample(units(spark, folder), SPEC, 0.10, method="builtin")
    return sample.select("unit_id", "treatment")


def sample_share(spark: SparkSession, folder: str) -> DataFrame:
    full = units(spark, folder)
    return quality.sample_share(full, sampling.stratified_sample(full, SPEC, 0.10))


def split_rows(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.stratified_split(units(spark, folder), SPEC).select("unit_id", "split")


def split_rows_by_order_value(spark: SparkSession, folder: str) -> DataFrame:
    """A split with about as many strata as there are orders."""
    priced = units(spark, folder).withColumn("price", F.floor("f4").cast("bigint"))
    return sampling.stratified_split(priced, SPEC, strata=["treatment", "price"]).select("unit_id", "split")


def split_summary(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.split_summary(sampling.stratified_split(units(spark, folder), SPEC), SPEC)


def scaled_features(spark: SparkSession, folder: str) -> DataFrame:
    scaled, _ = scaling.scale_splits(sampling.stratified_split(units(spark, folder), SPEC), SPEC)
    return scaled.select("unit_id", "split", *[F.round(c, 6).alias(c) for c in SPEC.features])


def scaler_state(spark: SparkSession, folder: str) -> DataFrame:
    split = sampling.stratified_split(units(spark, folder), SPEC)
    state = scaling.fit_scaler(split.where(F.col("split") == "train"), SPEC).to_frame(spark)
    return state.select("feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


def subsample_rows(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.stratified_subsample(units(spark, folder), SPEC, 5001).select("unit_id", "treatment", "conversion")


def holdout_rows(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.stratified_holdout(units(spark, folder), SPEC).select("unit_id", "holdout")


def pseudo_arms(spark: SparkSession, folder: str) -> DataFrame:
    controls = quality.arm_rows(units(spark, folder), SPEC, 0)
    return sampling.pseudo_assignment(controls, SPEC).select("unit_id", "pseudo")


def fold_sizes(spark: SparkSession, folder: str) -> DataFrame:
    folds = units(spark, folder).withColumn("fold", fold(SPEC.unit_id, 3, "fold", 42))
    return folds.groupBy("fold", "treatment").agg(F.count(F.lit(1)).alias("n"))


# Ranking


def uplift_curve(spark: SparkSession, folder: str) -> DataFrame:
    curve = uplift.uplift_curve(one_score(spark, folder), SPEC)
    return curve.select("unit_id", "rank", "n", F.round("uplift", 9).alias("uplift"))


def uplift_curve_tied(spark: SparkSession, folder: str) -> DataFrame:
    """Two thirds of the units share one score; their order is that of the unit key."""
    tied = units(spark, folder).withColumn("tau", F.greatest(F.col("f0"), F.lit(33.0)))
    curve = uplift.uplift_curve(tied, SPEC)
    return curve.select("unit_id", "rank", F.round("uplift", 9).alias("uplift"))


def ranking_metrics(spark: SparkSession, folder: str) -> DataFrame:
    m = uplift.ranking_metrics(scored(spark, folder), SPEC, groups=["model"])
    return m.select("model", "n", *[F.round(c, 9).alias(c) for c in m.columns if c not in ("model", "n", "decile_table")])


def ranking_metrics_visit(spark: SparkSession, folder: str) -> DataFrame:
    m = uplift.ranking_metrics(scored(spark, folder), SPEC, outcome="visit", groups=["model"], ks=())
    return m.select("model", *[F.round(c, 9).alias(c) for c in ("ate", "auuc", "qini", "qini_triangle")])


def uplift_at_k(spark: SparkSession, folder: str) -> DataFrame:
    top = uplift.uplift_at_k(scored(spark, folder), SPEC, (0.05, 0.10, 0.20, 0.50), groups=["model"])
    return top.withColumn("uplift", F.round("uplift", 9))


def decile_table(spark: SparkSession, folder: str) -> DataFrame:
    return uplift.decile_table(scored(spark, folder), SPEC, groups=["model"])


def score_summary(spark: SparkSession, folder: str) -> DataFrame:
    s = uplift.score_summary(scored(spark, folder), groups=["model"])
    return s.withColumns({c: F.round(c, 6) for c in ("tau_mean", "tau_std")})


def permutation_check(spark: SparkSession, folder: str) -> DataFrame:
    return uplift.permutation_check(units(spark, folder), SPEC)


def bootstrap_weights(spark: SparkSession, folder: str) -> DataFrame:
    w = bootstrap.weight_table(units(spark, folder).select("unit_id"), "unit_id", REPLICATES)
    return w.groupBy("replicate", "w").agg(F.count(F.lit(1)).alias("units"))


def bootstrap_metrics(spark: SparkSession, folder: str) -> DataFrame:
    m = bootstrap.bootstrap_metrics(one_score(spark, folder), SPEC, replicates=REPLICATES)
    names = [c for c in m.columns if c not in ("replicate", "n")]
    return m.select("replicate", "n", *[F.round(c, 9).alias(c) for c in names])


def bootstrap_interval(spark: SparkSession, folder: str) -> DataFrame:
    m = bootstrap.bootstrap_metrics(
        scored(spark, folder), SPEC, groups=["model"], replicates=REPLICATES, ks=()
    )
    ci = bootstrap.percentile_interval(m, ["qini", "auuc"], ["model"])
    return ci.select("model", *[F.round(c, 8).alias(c) for c in ci.columns[1:]])


def bootstrap_interval_full(spark: SparkSession, folder: str) -> DataFrame:
    """The usual 200 replicates."""
    m = bootstrap.bootstrap_metrics(one_score(spark, folder), SPEC, replicates=200, ks=())
    ci = bootstrap.percentile_interval(m, ["qini", "auuc"])
    return ci.select([F.round(c, 8).alias(c) for c in ci.columns])


def bootstrap_means(spark: SparkSession, folder: str) -> DataFrame:
    m = bootstrap.bootstrap_means(scored(spark, folder), "unit_id", "tau", ["model"], REPLICATES)
    return m.withColumn("mean", F.round("mean", 6))


def evaluation_report(spark: SparkSession, folder: str) -> DataFrame:
    r = evaluation.evaluation_report(scored(spark, folder), SPEC, replicates=REPLICATES)
    flat = r.select(
        "model",
        "n_test",
        "qini",
        F.get("qini_95ci", F.lit(0)).alias("qini_low"),
        F.get("qini_95ci", F.lit(1)).alias("qini_high"),
        "auuc",
        F.get("auuc_95ci", F.lit(0)).alias("auuc_low"),
        F.get("auuc_95ci", F.lit(1)).alias("auuc_high"),
        "uplift_at_10pct",
        "uplift_at_20pct",
        "tau_mean",
        "tau_std",
        F.col("random_baseline_sanity_check.shuffled_tau_qini").alias("shuffled_tau_qini"),
        F.col("random_baseline_sanity_check.sanity_pass").alias("sanity_pass"),
        F.get("decile_table", F.lit(0))["observed_lift"].alias("top_decile_lift"),
    )
    return flat


def evaluation_deciles(spark: SparkSession, folder: str) -> DataFrame:
    """All deciles of the evaluation report."""
    r = evaluation.evaluation_report(scored(spark, folder), SPEC, replicates=2)
    return r.select("model", F.inline("decile_table")).select("model", "decile", "n", "mean_predicted_tau", "observed_lift")


def leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.leaderboard(scored(spark, folder), SPEC)


def split_metrics(spark: SparkSession, folder: str) -> DataFrame:
    marked = sampling.stratified_split(units(spark, folder), SPEC).select("unit_id", "split")
    held = scored(spark, folder).join(marked.where(F.col("split") != "train"), "unit_id")
    return evaluation.split_metrics(held, SPEC)


# Agreement and sensitivity


def rank_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return agreement.rank_agreement(scored(spark, folder), "unit_id").withColumn(
        "p_value", F.round("p_value", 6)
    )


def rank_agreement_of_many_models(spark: SparkSession, folder: str) -> DataFrame:
    """Twelve models, some of which don't score all units."""
    k = F.col("k")
    scores = units(spark, folder).withColumn("k", F.explode(F.sequence(F.lit(10), F.lit(21)))).select(
        "unit_id",
        F.concat(F.lit("m"), k).alias("model"),
        (F.col("f0") * (k % 5) + F.col("f1") / 1000 + F.col("f5") * (k % 7)).alias("tau"),
        (F.substring("unit_id", 1, 1) != (k % 10).cast("string")).alias("there"),
    )
    pairs = agreement.rank_agreement(scores.where("there").drop("there"), "unit_id")
    return pairs.select("model_a", "model_b", "n", "spearman", F.round("p_value", 6).alias("p_value"))


def average_ranks(spark: SparkSession, folder: str) -> DataFrame:
    tied = units(spark, folder).select(F.lit("a").alias("model"), "unit_id", F.col("f0").alias("tau"))
    return agreement.average_ranks(tied, "unit_id")


def alignment_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored(spark, folder)
    partial = rows.where((F.col("model") != "c") | (F.col("treatment") == 1))
    return agreement.alignment_report(partial, "unit_id")


def percentiles(spark: SparkSession, folder: str) -> DataFrame:
    p = ranking.exact_percentiles(
        scored(spark, folder), "tau", "unit_id", (0.0, 0.01, 0.25, 0.5, 0.99, 1.0), ["model"]
    )
    return p.withColumn("value", F.round("value", 6))


def winsorized_rows(spark: SparkSession, folder: str) -> DataFrame:
    df = units(spark, folder).withColumn("tau", F.col("f1"))
    return tails.winsorize(df, "unit_id").select("unit_id", F.round("winsorized", 6).alias("winsorized"))


def by_region(spark: SparkSession, folder: str) -> DataFrame:
    """One score in groups, one of which has a null key."""
    group = F.when(F.col("f5") > 10, F.floor(F.col("f5") / 20).cast("int"))
    return one_score(spark, folder).withColumn("region", group)


def winsorized_rows_by_null_group(spark: SparkSession, folder: str) -> DataFrame:
    w = tails.winsorize(by_region(spark, folder), SPEC.unit_id, "f1", ["region"])
    return w.select("unit_id", "region", F.round("winsorized", 6).alias("winsorized"))


def percentiles_by_null_group(spark: SparkSession, folder: str) -> DataFrame:
    d = tails.diagnose_tail(by_region(spark, folder), SPEC, groups=["region"])
    points = [F.get("tau_percentiles", F.lit(i)).alias(c) for i, c in ((0, "tau_min"), (3, "tau_p50"), (6, "tau_max"))]
    return d.select("region", "decile", "n", *points)


def winsorize_report(spark: SparkSession, folder: str) -> DataFrame:
    r = tails.winsorize_report(scored(spark, folder), SPEC, groups=["model"])
    return r.select(
        "model",
        "clip_low",
        "clip_high",
        "n_clipped_low",
        "n_clipped_high",
        F.col("raw.qini").alias("raw_qini"),
        F.col("winsorized.qini").alias("winsorized_qini"),
        F.col("raw.auuc").alias("raw_auuc"),
        F.col("winsorized.auuc").alias("winsorized_auuc"),
        F.col("winsorized.uplift_at_10pct").alias("winsorized_at_10pct"),
        "qini_delta",
        "verdict",
    )


def last_deciles(spark: SparkSession, folder: str) -> DataFrame:
    report = tails.winsorize_report(scored(spark, folder), SPEC, groups=["model"])
    return tails.last_deciles(report, ["model"])


def tail_diagnosis(spark: SparkSession, folder: str) -> DataFrame:
    d = tails.diagnose_tail(scored(spark, folder), SPEC, groups=["model"])
    names = ("tau_min", "tau_p5", "tau_p25", "tau_p50", "tau_p75", "tau_p95", "tau_max")
    points = [F.get("tau_percentiles", F.lit(i)).alias(c) for i, c in enumerate(names)]
    kept = [
        "n", "n_treatment", "n_control", "mean_tau", "conversions_treatment",
        "conversions_control", "rate_treatment", "rate_control", "observed_lift",
    ]
    return d.select("model", "decile", *kept, *points)


def tail_interval(spark: SparkSession, folder: str) -> DataFrame:
    d = tails.diagnose_tail(scored(spark, folder), SPEC, groups=["model"])
    return d.select("model", "decile", "observed_lift", "lift_low", "lift_high", "contains_zero")


# Learners


def _outcome_models(spark: SparkSession, folder: str):
    """The two-model learner, fitted once; the imputed-outcome learner builds on it."""
    train, val = (splits(spark, folder).where(F.col("split") == s) for s in ("train", "val"))
    model = _once(spark, folder, "t_learner", lambda: fit_t_learner(train, SPEC, val, "visit"))
    return model, train, val


def _test(spark: SparkSession, folder: str) -> DataFrame:
    return splits(spark, folder).where(F.col("split") == "test")


def t_learner(spark: SparkSession, folder: str) -> DataFrame:
    model, _, _ = _outcome_models(spark, folder)
    return long_predictions(model.transform(_test(spark, folder)), SPEC, "t_learner")


def x_learner(spark: SparkSession, folder: str) -> DataFrame:
    base, train, val = _outcome_models(spark, folder)
    model = fit_x_learner(base, train, val, "visit")
    return long_predictions(model.transform(_test(spark, folder)), SPEC, "x_learner")


def residuals(spark: SparkSession, folder: str) -> DataFrame:
    train = splits(spark, folder).where(F.col("split") == "train")
    return cross_fit_residuals(train, SPEC, "visit").select("unit_id", "ry", "rt")


def causal_forest(spark: SparkSession, folder: str) -> DataFrame:
    train = splits(spark, folder).where(F.col("split") == "train")
    model = fit_dml_forest(train, SPEC, "visit")
    return long_predictions(model.transform(_test(spark, folder)), SPEC, "causal_forest")


def dual_head(spark: SparkSession, folder: str) -> DataFrame:
    train, val = (splits(spark, folder).where(F.col("split") == s) for s in ("train", "val"))
    model = fit_dual_head(train, val, SPEC, "visit")
    return long_predictions(model.transform(_test(spark, folder)), SPEC, "dual_head")


# Learners on one 0/1 feature, all rows and all features in every round: what they fit are group means, which SQL repeats.

GROUPED = replace(SPEC, features=("high",))
GROUP_MEANS = BoostParams(rounds=3, depth=1, step=0.5, row_fraction=1.0, feature_fraction=1.0, min_leaf=1, patience=None)


def grouped(spark: SparkSession, folder: str) -> DataFrame:
    return units(spark, folder).withColumn("high", (F.col("f0") > 40).cast("double"))


def t_learner_by_group(spark: SparkSession, folder: str) -> DataFrame:
    df = grouped(spark, folder)
    model = fit_t_learner(df, GROUPED, None, "visit", GROUP_MEANS)
    return model.transform(df).select("unit_id", *[F.round(c, 9).alias(c) for c in ("mu0", "mu1", "tau")])


def x_learner_by_group(spark: SparkSession, folder: str) -> DataFrame:
    df = grouped(spark, folder)
    base = fit_t_learner(df, GROUPED, None, "visit", GROUP_MEANS)
    model = fit_x_learner(base, df, None, "visit", GROUP_MEANS)
    return model.transform(df).select("unit_id", *[F.round(c, 9).alias(c) for c in ("tau0", "tau1", "tau")])


def x_learner_reloaded(spark: SparkSession, folder: str) -> DataFrame:
    """Both learners stored and read back, the second fitted on the first as read."""
    df, place = grouped(spark, folder), f"{checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"
    fit_t_learner(df, GROUPED, None, "visit", GROUP_MEANS).save(f"{place}/t_learner")
    base = TLearnerModel.load(f"{place}/t_learner", GROUPED, "visit")
    fit_x_learner(base, df, None, "visit", GROUP_MEANS).save(f"{place}/x_learner")
    model = XLearnerModel.load(f"{place}/x_learner", GROUPED, "visit")
    return model.transform(df).select("unit_id", *[F.round(c, 9).alias(c) for c in ("tau0", "tau1", "tau")])


def residuals_by_group(spark: SparkSession, folder: str) -> DataFrame:
    rows = cross_fit_residuals(grouped(spark, folder), GROUPED, "visit", 3, GROUP_MEANS, GROUP_MEANS)
    return rows.select("unit_id", *[F.round(c, 9).alias(c) for c in ("ry", "rt")])


def honest_tree_effects(spark: SparkSession, folder: str) -> DataFrame:
    """One tree of all units: grown on one half, its leaf effects measured on the other."""
    df = grouped(spark, folder)
    centred = df.withColumns({"ry": F.col("visit") - 0.07, "rt": F.col("treatment") - 0.85})
    params = ForestParams(trees=1, depth=1, row_fraction=1.0)
    model = fit_honest_forest(with_features(centred, GROUPED), GROUPED, params)
    return model.transform(df).select("unit_id", F.round("tau", 9).alias("tau"))


def placebo_scores_by_group(spark: SparkSession, folder: str) -> DataFrame:
    scores = placebo.placebo_scores(grouped(spark, folder), GROUPED, "visit", GROUP_MEANS)
    return scores.select("unit_id", F.round("tau", 9).alias("tau"))


def feature_vectors(spark: SparkSession, folder: str) -> DataFrame:
    values = vector_to_array(F.col("features"))
    rows = scaling.assemble(units(spark, folder), SPEC, "features")
    return rows.select("unit_id", *[values[i].alias(f"v{i}") for i in range(len(SPEC.features))])


def imputed_effects(spark: SparkSession, folder: str) -> DataFrame:
    df = units(spark, folder).withColumns({"mu0": F.col("f2") / 4, "mu1": F.col("f3") / 2})
    rows = pseudo_outcomes(df, SPEC)
    return rows.select("unit_id", F.round("effect", 9).alias("effect"))


def imputed_effect_summary(spark: SparkSession, folder: str) -> DataFrame:
    df = units(spark, folder).withColumns({"mu0": F.col("f2") / 4, "mu1": F.col("f3") / 2})
    s = pseudo_outcome_summary(pseudo_outcomes(df, SPEC), SPEC)
    return s.withColumns({c: F.round(c, 8) for c in ("mean", "std")})


def blended_effects(spark: SparkSession, folder: str) -> DataFrame:
    df = units(spark, folder)
    tau = blend(F.col("f2"), F.col("f3"), treatment_rate(df, SPEC))
    return df.select("unit_id", F.round(tau, 9).alias("tau"))


def honest_leaf_moments(spark: SparkSession, folder: str) -> DataFrame:
    df = units(spark, folder).select(
        (F.col("conversion") - F.lit(0.02)).alias("ry"),
        (F.col("treatment") - F.lit(0.85)).alias("rt"),
        F.array("f5", F.floor(F.col("f0") / 5).cast("double")).alias("leaves"),
    )
    m = leaf_moments(df)
    return m.select("tree", "leaf", "n", *[F.round(c, 8).alias(c) for c in ("t", "y", "ty", "tt")])


def placebo_test(spark: SparkSession, folder: str) -> DataFrame:
    train = splits(spark, folder).where(F.col("split") == "train")
    scores = placebo.placebo_scores(train, SPEC, "visit")
    real = abtest.average_effect(units(spark, folder), SPEC, "visit").first()[0]
    return placebo.placebo_verdict(scores, "unit_id", real, PLACEBO_DRAWS)


def placebo_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on a given score, which SQL can repeat."""
    controls = quality.arm_rows(units(spark, folder), SPEC, 0)
    scores = controls.select("unit_id", ((F.col("f5") - 25.5) / 1000).alias("tau"))
    real = abtest.average_effect(units(spark, folder), SPEC).first()[0]
    return placebo.placebo_verdict(scores, "unit_id", real, PLACEBO_DRAWS)


def control_pool(spark: SparkSession, folder: str) -> DataFrame:
    pool = placebo.control_pool(units(spark, folder), SPEC)
    return pool.withColumn("base_rate", F.round("base_rate", 9))


def placebo_report(spark: SparkSession, folder: str) -> DataFrame:
    pool = placebo.control_pool(units(spark, folder), SPEC)
    return placebo.placebo_report(pool, placebo_verdict(spark, folder))


# Sources and sinks


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    raw = units(spark, folder).select(*SPEC.raw_schema().fieldNames())
    raw.write.option("header", True).option("compression", "gzip").csv(path)
    back = tables.find_raw_csv(spark, path, SPEC)
    return quality.select_contract(back, SPEC).select("f0", "f1", "f7", "treatment", "visit", "conversion")


def arm_table_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    tables.write_by_arm(quality.select_contract(units(spark, folder), SPEC), path, SPEC, 4)
    return tables.read_by_arm(spark, path, SPEC).select("unit_id", "treatment", "visit", "conversion", "f4")


def split_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    test = _test(spark, folder)
    return test.select(
        "unit_id", "split", F.col("treatment").cast("int").alias("treatment"), F.col("conversion").cast("int").alias("conversion"),
        *[F.round(F.col(c).cast("double"), 5).alias(c) for c in SPEC.features],
    )


def prediction_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    tables.write_predictions(scored(spark, folder).select("unit_id", "model", "tau"), path)
    return tables.read_predictions(spark, path, SPEC, ["a", "c"])


def counts_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    tables.write_report(tables.nested_counts(arm_counts(spark, folder)), path)
    counts = tables.read_arm_counts(spark, path, SPEC).drop("source")
    return abtest.proportion_test(counts).select("outcome", "n1", "x1", "n0", "x0", "z_statistic", "ci_low", "ci_high")


def combined_report(spark: SparkSession, folder: str) -> DataFrame:
    result = combined_job(experiment(spark, folder), scratch(spark), SPEC)
    counts = result["counts"].selectExpr("outcome as item", "cast(x1 + x0 as double) as value")
    smd = result["balance"].selectExpr("feature as item", "smd as value")
    return counts.unionAll(smd)


ALL: dict[str, Query] = {
    f.__name__: f
    for f in (
        ab_report, arm_counts, arm_counts_by_size, average_effect, detectable_effect,
        balance_table, balance_summary,
        contract_rows, control_rows, column_profile, rate_checks, quality_verdict,
        sample_rows, sample_builtin, sample_share, split_rows, split_rows_by_order_value, split_summary, scaled_features,
        scaler_state, subsample_rows, holdout_rows, pseudo_arms, fold_sizes,
        uplift_curve, uplift_curve_tied, ranking_metrics, ranking_metrics_visit, uplift_at_k,
        decile_table, score_summary, permutation_check,
        bootstrap_weights, bootstrap_metrics, bootstrap_interval, bootstrap_interval_full,
        bootstrap_means, evaluation_report, evaluation_deciles, leaderboard, split_metrics,
        rank_agreement, rank_agreement_of_many_models, average_ranks, alignment_report, percentiles, winsorized_rows,
        winsorize_report, last_deciles, tail_diagnosis, tail_interval,
        imputed_effects, imputed_effect_summary, blended_effects, honest_leaf_moments,
        t_learner_by_group, x_learner_by_group, x_learner_reloaded, residuals_by_group, honest_tree_effects,
        placebo_scores_by_group, feature_vectors, winsorized_rows_by_null_group, percentiles_by_null_group,
        t_learner, x_learner, residuals, causal_forest, dual_head,
        placebo_test, placebo_verdict, placebo_report, control_pool,
        csv_round_trip, arm_table_round_trip, split_round_trip, prediction_round_trip,
        counts_round_trip, combined_report,
    )
}
