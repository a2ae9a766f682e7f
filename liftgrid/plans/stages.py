"""Whole stages over stored tables, composed from the operators.

A workspace folder holds the processed table, the sample, the splits, the predictions, the
fitted models and the reports; every stage reads what earlier ones stored there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftgrid.learners.boosting import EFFECT_PARAMS, OUTCOME_PARAMS, PLACEBO_PARAMS, BoostParams
from liftgrid.learners.dualhead import DualHeadModel, NetParams, fit_dual_head
from liftgrid.learners.forest import ForestParams, HonestForestModel, fit_dml_forest
from liftgrid.learners.meta import (
    TLearnerModel,
    XLearnerModel,
    fit_t_learner,
    fit_x_learner,
    long_predictions,
)
from liftgrid.operators import abtest, balance, quality, sampling, scaling
from liftgrid.operators.agreement import present_models, rank_agreement, require_aligned
from liftgrid.operators.evaluation import (
    attach_predictions,
    evaluation_report,
    leaderboard,
    split_metrics,
)
from liftgrid.operators.placebo import control_pool, placebo_report, placebo_scores, placebo_verdict
from liftgrid.operators.tails import diagnose_tail, winsorize_report
from liftgrid.session import keep
from liftgrid.sources import tables
from liftgrid.spec import ExperimentSpec

MODELS = ("t_learner", "x_learner", "causal_forest", "dual_head")
FOREST_UNITS = None  # all training units; a number draws a stratified subsample of that size


@dataclass(frozen=True)
class Workspace:
    """Paths of everything a run stores. ``which`` is ``full`` or ``sample``."""

    root: str
    which: str = "full"

    @property
    def processed(self) -> str:
        return f"{self.root}/processed/{self.which}"

    @property
    def splits(self) -> str:
        return f"{self.root}/splits/{self.which}"

    @property
    def predictions(self) -> str:
        return f"{self.root}/predictions/{self.which}"

    def model(self, name: str) -> str:
        return f"{self.root}/models/{self.which}/{name}"

    def report(self, name: str) -> str:
        return f"{self.root}/reports/{self.which}/{name}"

    def sibling(self, which: str) -> Workspace:
        return Workspace(self.root, which)


def ingest(
    raw: DataFrame,
    workspace: Workspace,
    spec: ExperimentSpec,
    fraction: float = 0.10,
    files: int | None = None,
    sample_files: int | None = None,
) -> DataFrame:
    """Store the full table and a stratified sample; return their sizes."""
    full = tables.ingest(raw, workspace.processed, spec, files)
    small = workspace.sibling("sample").processed
    tables.write_by_arm(sampling.stratified_sample(full, spec, fraction), small, spec, sample_files)
    return quality.sample_share(full, tables.read_by_arm(raw.sparkSession, small, spec))


def load(spark: SparkSession, workspace: Workspace, spec: ExperimentSpec) -> DataFrame:
    return tables.read_by_arm(spark, workspace.processed, spec)


def _reported(report: DataFrame, path: str) -> DataFrame:
    """Write a report and read it back, so it is computed once."""
    tables.write_report(report, path)
    return tables.read_report(report.sparkSession, path, report.schema)


def validate(spark: SparkSession, workspace: Workspace, spec: ExperimentSpec) -> bool:
    """Write the quality report; true when every check passed."""
    report = quality.quality_report(load(spark, workspace, spec), spec)
    return bool(_reported(report, workspace.report("ingestion_validation")).first()["all_passed"])


def balance_report(spark: SparkSession, workspace: Workspace, spec: ExperimentSpec) -> DataFrame:
    table = balance.balance_table(load(spark, workspace, spec), spec)
    return _reported(table, workspace.report("balance_table"))


def ab_test(spark: SparkSession, workspace: Workspace, spec: ExperimentSpec) -> DataFrame:
    report = abtest.experiment_report(abtest.arm_counts(load(spark, workspace, spec), spec))
    return _reported(abtest.nested_report(report), workspace.report("ab_test_results"))


def ab_test_from_counts(
    spark: SparkSession, counts_path: str, out_path: str, spec: ExperimentSpec
) -> DataFrame:
    """The same report from counts aggregated elsewhere."""
    report = abtest.experiment_report(tables.read_arm_counts(spark, counts_path, spec))
    return _reported(abtest.nested_report(report, ["source"]), out_path)


def combined_job(
    raw: DataFrame,
    out: str,
    spec: ExperimentSpec,
    fraction: float = 0.10,
    files: int | None = None,
) -> dict[str, DataFrame]:
    """Both stored tables, the balance table and the arm counts from one pass over the raw data.

    The raw table is parsed once; statistics and sample read the stored Parquet, so nothing has
    to be cached and a lost executor costs no second parse.
    """
    workspace = Workspace(out)
    full = tables.ingest(raw, workspace.processed, spec, files)
    tables.write_by_arm(
        sampling.stratified_sample(full, spec, fraction), workspace.sibling("sample").processed, spec
    )
    smd = _reported(balance.balance_table(full, spec), workspace.report("balance_table"))
    counts = abtest.arm_counts(full, spec)
    tables.write_report(tables.nested_counts(counts), workspace.report("ab_test_counts"))
    stored = tables.read_arm_counts(raw.sparkSession, workspace.report("ab_test_counts"), spec)
    return {"balance": smd, "counts": stored}


def split_and_scale(
    spark: SparkSession, workspace: Workspace, spec: ExperimentSpec, seed: int = 42
) -> DataFrame:
    """Store scaled splits and the scaler; return the split summary."""
    split = sampling.stratified_split(load(spark, workspace, spec), spec, seed=seed)
    scaled, scaler = scaling.scale_splits(split, spec)
    tables.write_splits(scaling.compact(scaled, spec), workspace.splits)
    scaler.to_frame(spark).write.mode("overwrite").parquet(workspace.model("feature_scaler"))
    summary = sampling.split_summary(spark.read.parquet(workspace.splits), spec)
    return _reported(summary, workspace.report("split_summary"))


def _store_scores(
    scored: DataFrame, workspace: Workspace, spec: ExperimentSpec, name: str, outcome: str
) -> None:
    rows = long_predictions(scored, spec, name, "split").withColumn("outcome", F.lit(outcome))
    tables.write_predictions(rows, workspace.predictions)


def train(
    spark: SparkSession,
    workspace: Workspace,
    spec: ExperimentSpec,
    model: str,
    outcome: str | None = None,
    params: BoostParams | ForestParams | NetParams | None = None,
    forest_units: int | None = FOREST_UNITS,
) -> DataFrame:
    """Fit one learner, save it, store its scores of val and test rows, return split metrics."""
    fit_rows, val, test = tables.read_splits(spark, workspace.splits, "train", "val", "test")
    outcome = outcome or spec.primary_outcome
    if model == "t_learner":
        fitted = fit_t_learner(fit_rows, spec, val, outcome, params or OUTCOME_PARAMS)
    elif model == "x_learner":
        base = TLearnerModel.load(workspace.model("t_learner"), spec, outcome)
        fitted = fit_x_learner(base, fit_rows, val, outcome, params or EFFECT_PARAMS)
    elif model == "causal_forest":
        if forest_units:
            fit_rows = sampling.stratified_subsample(fit_rows, spec, forest_units)
        fitted = fit_dml_forest(fit_rows, spec, outcome, params or ForestParams())
    elif model == "dual_head":
        fitted = fit_dual_head(fit_rows, val, spec, outcome, params or NetParams())
    else:
        raise ValueError(f"unknown model {model}; expected one of {MODELS}")
    fitted.save(workspace.model(model))
    _store_scores(fitted.transform(val.unionAll(test)), workspace, spec, model, outcome)
    return split_metrics(stored_scores(spark, workspace, spec, [model], outcome), spec, outcome)


def load_model(workspace: Workspace, spec: ExperimentSpec, name: str, outcome: str | None = None):
    """A saved learner, ready to score any scaled table; one fitted for another outcome raises."""
    kinds = {
        "t_learner": TLearnerModel,
        "x_learner": XLearnerModel,
        "causal_forest": HonestForestModel,
        "dual_head": DualHeadModel,
    }
    return kinds[name].load(workspace.model(name), spec, outcome)


def _scores_for(predictions: DataFrame, outcome: str) -> DataFrame:
    """The same rows; using a score of a model that was fitted for another outcome raises."""
    fitted = F.coalesce("outcome", F.lit("no outcome"))
    told = F.concat(F.lit("scores of "), "model", F.lit(" were fitted for "), fitted, F.lit(f", not {outcome}"))
    return predictions.withColumn("tau", F.when(F.col("outcome") == outcome, F.col("tau")).otherwise(F.raise_error(told)))


def stored_scores(
    spark: SparkSession,
    workspace: Workspace,
    spec: ExperimentSpec,
    models: list[str] | None = None,
    outcome: str | None = None,
    split: str | None = None,
) -> DataFrame:
    """Predictions joined to their units by key.

    Scores that a stage stored for another outcome raise; a table without that column is taken as it is.
    """
    units = spark.read.parquet(workspace.splits).where(F.col("split") != "train")
    predictions = tables.read_predictions(spark, workspace.predictions, spec, models).drop("split")
    if "outcome" in predictions.columns:
        predictions = _scores_for(predictions, outcome or spec.primary_outcome).drop("outcome")
    joined = attach_predictions(units, predictions, spec, outcome)
    return joined.where(F.col("split") == split) if split else joined


def evaluate(
    spark: SparkSession,
    workspace: Workspace,
    spec: ExperimentSpec,
    models: list[str] | None = None,
    outcome: str | None = None,
    replicates: int = 200,
) -> DataFrame:
    """Full evaluation of the stored test scores, one report row per model."""
    scored = keep(stored_scores(spark, workspace, spec, models, outcome, "test"))
    report = evaluation_report(scored, spec, outcome, ["model"], replicates)
    out = _reported(report, workspace.report("uplift_metrics"))
    scored.unpersist()
    return out


def compare(
    spark: SparkSession, workspace: Workspace, spec: ExperimentSpec, outcome: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Leaderboard and pairwise rank agreement over the models that have scores."""
    scored = keep(stored_scores(spark, workspace, spec, None, outcome, "test"))
    models = present_models(scored, MODELS)
    require_aligned(scored, spec.unit_id, models)
    board = _reported(leaderboard(scored, spec, outcome), workspace.report("leaderboard"))
    pairs = rank_agreement(scored, spec.unit_id, models)
    out = _reported(pairs, workspace.report("rank_correlation"))
    scored.unpersist()
    return board, out


def placebo_test(
    spark: SparkSession,
    workspace: Workspace,
    spec: ExperimentSpec,
    outcome: str | None = None,
    params: BoostParams = PLACEBO_PARAMS,
    replicates: int = 1000,
) -> DataFrame:
    """Placebo on the training controls, judged against the experiment's measured effect."""
    y = outcome or spec.primary_outcome
    real = abtest.average_effect(load(spark, workspace, spec), spec, y).first()["ate"]
    (fit_rows,) = tables.read_splits(spark, workspace.splits, "train")
    scores = placebo_scores(fit_rows, spec, y, params)
    verdict = placebo_verdict(scores, spec.unit_id, real or 0.0, replicates)
    report = placebo_report(control_pool(fit_rows, spec, y), verdict)
    return _reported(report, workspace.report("placebo_test"))


def tail_report(
    spark: SparkSession, workspace: Workspace, spec: ExperimentSpec, model: str, outcome: str | None = None
) -> DataFrame:
    scored = stored_scores(spark, workspace, spec, [model], outcome, "test")
    report = diagnose_tail(scored, spec, "tau", outcome, ["model"])
    return _reported(report, workspace.report(f"decile_tail_{model}"))


def winsorize_stage(
    spark: SparkSession,
    workspace: Workspace,
    spec: ExperimentSpec,
    model: str,
    outcome: str | None = None,
    lower: float = 0.01,
    upper: float = 0.99,
) -> DataFrame:
    scored = stored_scores(spark, workspace, spec, [model], outcome, "test")
    report = winsorize_report(scored, spec, "tau", outcome, ["model"], lower, upper)
    return _reported(report, workspace.report(f"winsorize_ablation_{model}"))
