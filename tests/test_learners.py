from __future__ import annotations

import hashlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from liftgrid.catalog.queries import splits
from liftgrid.learners import boosting, dualhead, forest, manifest, meta
from liftgrid.operators import placebo, sampling
from liftgrid.operators.quality import arm_rows
from liftgrid.plans import stages
from liftgrid.sources import tables
from liftgrid.spec import ExperimentSpec

TRIAL = boosting.BoostParams(rounds=8, depth=3, step=0.3, min_leaf=20, patience=4)


@pytest.fixture(scope="module")
def parts(spark):
    """Standardized splits of the middle-sized tables; the effect exists only for high f0."""
    rows = splits(spark, "/root/testdata/sf0.01")
    return [rows.where(F.col("split") == s).cache() for s in ("train", "val", "test")]


def separation(scored) -> tuple[float, float]:
    """Mean predicted effect below and above the planted threshold (f0 > 40, standardized)."""
    high = F.col("f0") > 1.01
    got = dict(scored.groupBy(high.alias("h")).agg(F.avg("tau")).collect())
    return got[False], got[True]


@pytest.fixture(scope="module")
def two_models(parts, spec):
    return meta.fit_t_learner(parts[0], spec, parts[1], "visit", TRIAL)


def test_t_learner_finds_the_planted_effect(parts, spec, two_models, tmp_path):
    low, high = separation(two_models.transform(parts[2]))
    assert low < 0.02 and high > 0.05
    two_models.save(str(tmp_path / "t"))
    again = meta.TLearnerModel.load(str(tmp_path / "t"), spec)
    assert separation(again.transform(parts[2])) == pytest.approx((low, high), abs=1e-12)
    with pytest.raises(FileNotFoundError):
        meta.TLearnerModel.load(str(tmp_path / "absent"), spec)


def test_x_learner_finds_the_planted_effect(parts, spec, two_models, tmp_path):
    model = meta.fit_x_learner(two_models, parts[0], parts[1], "visit", TRIAL)
    low, high = separation(model.transform(parts[2]))
    assert low < 0.02 and high > 0.05
    assert model.propensity == pytest.approx(0.85, abs=0.02)
    ends = model.transform(parts[2], 1.0).agg(F.max(F.abs(F.col("tau") - F.col("tau0")))).first()[0]
    assert ends == 0
    ends = model.transform(parts[2], F.lit(0.0)).agg(F.max(F.abs(F.col("tau") - F.col("tau1")))).first()[0]
    assert ends == 0
    model.save(str(tmp_path / "x"))
    again = meta.XLearnerModel.load(str(tmp_path / "x"), spec)
    assert separation(again.transform(parts[2])) == pytest.approx((low, high), abs=1e-12)


def test_outcome_models_are_calibrated(parts, two_models):
    r = two_models.outcomes(parts[2]).agg(F.avg("mu0"), F.avg("mu1")).first()
    assert r[0] == pytest.approx(0.06, abs=0.015) and r[1] == pytest.approx(0.078, abs=0.015)


def test_forest_finds_the_planted_effect(parts, spec, tmp_path):
    model = forest.fit_dml_forest(parts[0], spec, "visit", forest.small_forest(12, 5), TRIAL, TRIAL)
    scored = model.transform(parts[2]).cache()
    low, high = separation(scored)
    assert low < 0.03 and high > 0.04
    assert scored.agg(F.count("tau")).first()[0] == parts[2].count()
    model.save(str(tmp_path / "f"))
    again = forest.HonestForestModel.load(str(tmp_path / "f"), spec)
    assert separation(again.transform(parts[2])) == pytest.approx((low, high), abs=1e-9)


def residual_frame(spark, count=900, missing=True):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(count, 3)).round(1)
    if missing:
        x[::17, 1] = np.nan
    t = (rng.random(count) < 0.5) - 0.5
    y = t * (x[:, 0] > 0.3) + rng.normal(size=count) * 0.1
    rows = [(f"u{i}", x[i].tolist(), float(y[i]), float(t[i])) for i in range(count)]
    df = spark.createDataFrame(rows, "unit_id string, x array<double>, ry double, rt double")
    return df.withColumn("features", array_to_vector("x")), x, y, t


def test_forest_trees_are_honest_and_split_best(spark):
    """Samples, halves, splits and leaf moments of every tree against plain loops; scores against walks."""
    df, x, y, t = residual_frame(spark)
    spec = ExperimentSpec(features=("a", "b", "c"))
    params = forest.ForestParams(trees=5, depth=3, min_leaf=20, row_fraction=0.6)
    model = forest.fit_honest_forest(df.repartition(3), spec, params)
    again = forest.fit_honest_forest(df.repartition(7, "ry"), spec, params)
    trees = {r["tree"]: r for r in model.trees.collect()}
    assert trees == {r["tree"]: r for r in again.trees.collect()} and sorted(trees) == list(range(5))
    digests = [hashlib.md5(f"u{i}:honest:42".encode()).hexdigest() for i in range(len(x))]
    base, half = (np.array([int(d[k : k + 8], 16) for d in digests]) for k in (0, 8))
    grown_by, measured_by = np.zeros(len(x), int), np.zeros(len(x), int)
    walked = np.zeros((5, len(x)))
    for k, tree in trees.items():
        mine = forest._draws(base, k, 42) < int(0.6 * forest.PRIME)
        grows = mine & (forest._draws(half, k, 42) < forest.PRIME // 2)
        grown_by += grows
        measured_by += mine & ~grows

        def leaf(row, tree=tree):
            node = 0
            while tree["feature"][node] >= 0:
                f, cut = tree["feature"][node], tree["cut"][node]
                node = tree["child"][node] + (0 if row[f] <= cut else 1)
            return node

        at = np.array([leaf(row) for row in x])
        for node in range(len(tree["feature"])):
            held = (at == node) & mine & ~grows
            if tree["feature"][node] < 0:
                assert tree["n"][node] == held.sum() and ((at == node) & grows).sum() >= 20
                if held.any():
                    want = [v[held].mean() for v in (t, y, t * y, t * t)]
                    assert [tree[c][node] for c in ("t", "y", "ty", "tt")] == pytest.approx(want)
        best = max(
            (sum((t * y)[s].sum() ** 2 / (t * t)[s].sum() for s in (grows & left, grows & ~left)), -f, -cut)
            for f in range(3)
            for cut in np.unique(x[grows, f][~np.isnan(x[grows, f])])
            for left in [x[:, f] <= cut]
            if min((grows & left).sum(), (grows & ~left).sum()) >= 20
        )
        assert (tree["feature"][0], tree["cut"][0]) == (-best[1], -best[2])
        for i, node in enumerate(at):
            if tree["n"][node]:
                walked[:, i] += [1, *(tree[c][node] for c in ("t", "y", "ty", "tt"))]
    assert 0.2 < (grown_by > 0).mean() and ((grown_by > 0) & (measured_by > 0)).mean() > 0.4
    m = walked[1:] / walked[0]
    want = (m[2] - m[0] * m[1]) / (m[3] - m[0] ** 2)
    found = {r["unit_id"]: r["tau"] for r in model.transform(df.select("unit_id", "features")).collect()}
    assert [found[f"u{i}"] for i in range(len(x))] == pytest.approx(want.tolist())


def test_forest_of_few_units_and_bounded_trees(spark):
    df, *_ = residual_frame(spark, 40)
    spec = ExperimentSpec(features=("a", "b", "c"))
    model = forest.fit_honest_forest(df, spec, forest.ForestParams(trees=3, min_leaf=30))
    assert {len(r["feature"]) for r in model.trees.collect()} == {1}
    assert model.transform(df.select("unit_id", "features")).where("tau IS NULL OR isnan(tau)").count() == 0
    sparse = forest.fit_honest_forest(df, spec, forest.ForestParams(trees=4, tree_units=20, row_fraction=1.0))
    assert sum(sum(r["n"]) for r in sparse.trees.collect()) < 4 * 20
    with pytest.raises(ValueError, match="no units"):
        forest.fit_honest_forest(df.limit(0), spec)


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_trees_of_many_units_use_their_whole_sample(spark, monkeypatch, depth):
    """Trees that don't fit into a task are grown across tasks, from the same units and to the same splits and moments."""
    df, *_ = residual_frame(spark)
    spec, params = ExperimentSpec(features=("a", "b", "c")), forest.ForestParams(trees=3, depth=depth, min_leaf=5, row_fraction=0.9)
    ones = forest.fit_honest_forest(df.repartition(3), spec, params)
    monkeypatch.setattr(forest, "TASK_UNITS", 200)
    monkeypatch.setattr(forest, "_HISTOGRAM_BYTES", 2 * 5 * 3 * 256 * 24)  # two trees at a time
    many = forest.fit_honest_forest(df.repartition(4), spec, params)
    scores = [{r["unit_id"]: r["tau"] for r in m.transform(df.select("unit_id", "features")).collect()} for m in (ones, many)]
    assert scores[1] == pytest.approx(scores[0])
    for one, other in zip(*[m.trees.orderBy("tree").collect() for m in (ones, many)], strict=True):
        assert one["tree"] == other["tree"] and sorted(one["cut"]) == sorted(other["cut"])
        for c in ("n", "t", "y", "ty", "tt"):
            assert sorted(v for v, f in zip(other[c], other["feature"], strict=True) if f < 0) == pytest.approx(
                sorted(v for v, f in zip(one[c], one["feature"], strict=True) if f < 0)
            )


def test_no_query_bounds_the_units_of_a_tree(monkeypatch):
    from liftgrid.catalog import queries

    assert forest.ForestParams().tree_units is None
    seen = []
    monkeypatch.setattr(queries, "fit_honest_forest", lambda rows, spec, params: seen.append(params) or queries)
    monkeypatch.setattr(queries, "transform", lambda df: df.withColumn("tau", F.lit(0.0)), raising=False)
    monkeypatch.setattr(queries, "with_features", lambda df, spec: df)
    monkeypatch.setattr(queries, "units", lambda spark, folder: spark)
    frame = SparkSession.active().createDataFrame([("u", 50.0, 1, 1)], "unit_id string, f0 double, visit int, treatment int")
    queries.honest_tree_effects(frame, "")
    assert seen[0].tree_units is None and seen[0].row_fraction == 1.0


def test_growing_horizon_equals_the_whole_run_cut_at_its_best_round(parts, spec):
    """Early stopping by steps gives the trees that fitting all rounds and refitting to the best one gives."""
    rows, held = (meta.with_features(arm_rows(p, spec, 0), spec) for p in parts[:2])
    params = boosting.BoostParams(rounds=14, depth=2, step=0.3, min_leaf=50, patience=2)
    model = boosting.fit_boosted(rows, "visit", params, held)
    columns = ["features", F.col("visit").cast("double").alias("visit")]
    plain = boosting.sized(rows.select(*columns))
    whole = boosting._regressor("visit", params).fit(plain)
    best = boosting.best_round(whole.evaluateEachIteration(held.select(*columns), "squared"), 2)
    refit = boosting._regressor("visit", params).setMaxIter(best).fit(plain)
    assert model.getNumTrees == best
    both = boosting.predict(model, boosting.predict(refit, held, "a").drop("_prediction"), "b")
    assert both.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] == 0


def labelled(spark, count, parts):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(count, 3)).round(1)
    y = (rng.random(count) < 0.2 + 0.3 * (x[:, 0] > 0.4)).astype(float)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double")
    return df.select(array_to_vector("x").alias("features"), "y").coalesce(1).repartition(parts).cache()


def test_rounds_grow_the_trees_of_mllib(spark, monkeypatch):
    """The same trees node by node, in one task and with a job per level; without a job per round where rows fit into a task."""
    rows, params = labelled(spark, 800, 1), boosting.BoostParams(rounds=12, depth=4, step=0.2, min_leaf=3, feature_fraction=0.5)
    text = [line for line in boosting._regressor("y", params).fit(rows).toDebugString.split("\n") if "uid" not in line]
    one = boosting.fit_boosted(rows, "y", params)
    assert [line for line in one.toDebugString.split("\n") if "uid" not in line] == text
    monkeypatch.setattr(boosting, "ONE_TASK_ROWS", 100)
    many = boosting.fit_boosted(rows, "y", params)
    assert [line for line in many.toDebugString.split("\n") if "uid" not in line] == text


def test_fits_of_few_rows_take_few_jobs(spark):
    rows, params = labelled(spark, 200, 1), boosting.BoostParams(rounds=30, depth=3, min_leaf=3)
    spark.sparkContext.setJobGroup("boosting", "boosting")
    try:
        boosting.fit_boosted(rows, "y", params)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosting")) < 30
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rounds_across_tasks_stop_at_the_held_error(spark, monkeypatch):
    rows, held = labelled(spark, 900, 3), labelled(spark, 300, 2)
    params = boosting.BoostParams(rounds=40, depth=3, step=0.4, min_leaf=3, patience=4)
    monkeypatch.setattr(boosting, "TASK_ROWS", 300)
    one = boosting.fit_boosted(rows, "y", params, held)
    monkeypatch.setattr(boosting, "ONE_TASK_ROWS", 100)
    many = boosting.fit_boosted(rows, "y", params, held)
    assert one.getNumTrees == many.getNumTrees < 40
    both = boosting.predict(many, boosting.predict(one, held, "a"), "b")
    assert both.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-9


def test_boosting_cuts_its_lineage_often(spark):
    """Every task reads the lineage of the predictions, which has a tree for each round since they were last stored."""
    assert boosting._regressor("visit", boosting.NUISANCE_Y_PARAMS).getCheckpointInterval() <= 10


def test_dual_head_finds_the_planted_effect(parts, spec, tmp_path):
    params = dualhead.NetParams(batch=256, rate=3e-3, epochs=6, shared=48, head=20)
    model = dualhead.fit_dual_head(parts[0], parts[1], spec, "visit", params)
    low, high = separation(model.transform(parts[2]))
    assert high - low > 0.02
    model.save(str(tmp_path / "n"))
    again = dualhead.DualHeadModel.load(str(tmp_path / "n"), spec)
    assert again.params == params and again.outcome == "visit" and again.history == model.history
    assert separation(again.transform(parts[2])) == pytest.approx((low, high), abs=1e-12)


def test_network_follows_from_the_rows_alone(spark, parts, spec):
    """Neither the layout of the table nor the size of an Arrow batch matters; many learners are added in their order."""
    params = dualhead.NetParams(batch=128, epochs=2, shared=6, head=4, learner_rows=500)
    one = dualhead.fit_dual_head(parts[0].repartition(2), parts[1].repartition(3), spec, "visit", params)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "77")
    try:
        other = dualhead.fit_dual_head(parts[0].repartition(7), parts[1].coalesce(1), spec, "visit", params)
    finally:
        spark.conf.set(name, before)
    assert np.array_equal(one.weights, other.weights) and one.history == other.history


def test_one_learner_is_a_plain_loop(parts, spec):
    params = dualhead.NetParams(batch=200, epochs=2, shared=6, head=4, rate=3e-3, learners=1, patience=9)
    model = dualhead.fit_dual_head(parts[0], parts[1], spec, "visit", params)
    order = F.md5(F.concat(spec.unit_id, F.lit(":learner:42")))
    columns = [F.col(c).cast("float").alias(c) for c in spec.features]
    rows = parts[0].orderBy(order).select(*columns, spec.treatment, "visit").toPandas()
    x = rows[list(spec.features)].to_numpy(dtype=np.float64)
    t, y = rows[spec.treatment].to_numpy(), rows["visit"].to_numpy(dtype=np.float64)
    dims = dualhead.layout(x.shape[1], params)
    flat = dualhead.initial_weights(x.shape[1], params, y.mean())
    m, v, step, epochs = np.zeros_like(flat), np.zeros_like(flat), 0, []
    for epoch in (1, 2):
        for start in range(0, len(y), 800):
            rng = np.random.default_rng([42, epoch, 0, start])
            block = start + rng.permutation(min(800, len(y) - start))
            for at in range(0, len(block), 200):
                pick = block[at : at + 200]
                _, grad = dualhead.loss_gradient(flat, dims, x[pick], t[pick], y[pick], params.dropout, rng)
                step += 1
                dualhead.adam_step(flat, m, v, step, grad, params.rate, params)
        epochs.append(flat.copy())
    best = min((h[2], h[0]) for h in model.history)[1]
    assert model.weights == pytest.approx(epochs[best - 1], abs=1e-9)


def test_models_are_not_taken_for_others(parts, spec, two_models, tmp_path):
    path = str(tmp_path / "t")
    two_models.save(path)
    assert meta.TLearnerModel.load(path, spec, "visit").outcome == "visit"
    with pytest.raises(ValueError, match="outcome 'visit', not 'conversion'"):
        meta.TLearnerModel.load(path, spec, "conversion")
    with pytest.raises(ValueError, match="features"):
        meta.TLearnerModel.load(path, replace(spec, features=spec.features[:3]))
    with pytest.raises(ValueError, match="kind 't_learner'"):
        meta.XLearnerModel.load(path, spec)
    with pytest.raises(ValueError, match="fitted for 'visit'"):
        meta.fit_x_learner(two_models, parts[0], parts[1], "conversion", TRIAL)
    with pytest.raises(RuntimeError), manifest.storing(path, "t_learner", spec, "visit"):
        raise RuntimeError("lost half way")
    with pytest.raises(FileNotFoundError):
        meta.TLearnerModel.load(path, spec)


def test_stages_know_the_outcome_of_stored_scores(spark, units, spec, tmp_path):
    workspace = stages.Workspace(str(tmp_path))
    tables.write_splits(sampling.stratified_split(units, spec).repartition(2), workspace.splits)
    stages.train(spark, workspace, spec, "t_learner", "visit", TRIAL)
    assert stages.load_model(workspace, spec, "t_learner", "visit").outcome == "visit"
    with pytest.raises(ValueError, match="not 'conversion'"):
        stages.train(spark, workspace, spec, "x_learner", None, TRIAL)
    scores = stages.stored_scores(spark, workspace, spec, None, "visit", "test")
    assert scores.agg(F.count("tau")).first()[0] == 900 and "outcome" not in scores.columns
    with pytest.raises(Exception, match="scores of t_learner were fitted for visit, not conversion"):
        stages.evaluate(spark, workspace, spec, replicates=2)


def test_gradient_matches_differences():
    p = dualhead.NetParams(shared=5, head=4, dropout=0.0)
    rng = np.random.default_rng(0)
    x, t = rng.normal(size=(40, 3)), (rng.random(40) < 0.7).astype(int)
    y = (rng.random(40) < 0.3).astype(float)
    dims, flat = dualhead.layout(3, p), dualhead.initial_weights(3, p, 0.3)
    loss, grad = dualhead.loss_gradient(flat, dims, x, t, y)
    assert loss == pytest.approx(dualhead.balanced(dualhead.arm_losses(dualhead.unpack(flat, dims), x, t, y)))
    for i in range(0, len(flat), 3):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (dualhead.loss_gradient(flat + s, dims, x, t, y)[0] for s in (step, -step))
        assert grad[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_network_works_in_arrays_it_has():
    """Batches of any size, in arrays that were used before, give the bits of plain formulas, and no large array is made anew."""
    import tracemalloc

    p = dualhead.NetParams(shared=64, head=32)
    rng = np.random.default_rng(3)
    dims, flat = dualhead.layout(5, p), dualhead.initial_weights(5, p, 0.2)
    w, work = dualhead.unpack(flat, dims), dualhead.Work()

    def elu(a):
        return np.where(a > 0, a, np.expm1(np.minimum(a, 0)))

    for rows in (700, 300, 4000):
        x, t, y = rng.normal(size=(rows, 5)), (rng.random(rows) < 0.8).astype(int), (rng.random(rows) < 0.3).astype(float)
        phi = elu(elu(x @ w["w1"] + w["b1"]) @ w["w2"] + w["b2"])
        plain = [elu(phi @ w[f"u{h}"] + w[f"c{h}"]) @ w[f"v{h}"] + w[f"d{h}"] for h in "01"]
        assert all(np.array_equal(a, b) for a, b in zip(dualhead.forward(w, x, work), plain))
        fresh = dualhead.loss_gradient(flat, dims, x, t, y, 0.1, np.random.default_rng(1))
        again = dualhead.loss_gradient(flat, dims, x, t, y, 0.1, np.random.default_rng(1), work)
        assert fresh[0] == again[0] and np.array_equal(fresh[1], again[1])
    dualhead.loss_gradient(flat, dims, x, t, y, 0.1, rng, work)
    tracemalloc.start()
    dualhead.loss_gradient(flat, dims, x, t, y, 0.1, rng, work)
    dualhead.forward(w, x, work)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < rows * p.shared * 8


def test_balanced_loss_ignores_arm_size():
    assert dualhead.balanced(np.array([10.0, 10.0, 3000.0, 1000.0])) == pytest.approx(0.5 * 1 + 0.5 * 3)
    assert dualhead.balanced(np.array([0.0, 0.0, 30.0, 10.0])) == pytest.approx(1.5)


def test_output_bias_starts_at_the_base_rate():
    p = dualhead.NetParams()
    dims = dualhead.layout(12, p)
    flat = dualhead.initial_weights(12, p, 0.0029)
    w = dualhead.unpack(flat, dims)
    assert w["d0"] == pytest.approx(np.log(0.0029 / 0.9971)) and w["d1"] == w["d0"]
    assert len(flat) == 12 * 64 + 64 + 64 * 64 + 64 + 2 * (64 * 32 + 32 + 32 + 1)


def test_best_round_waits_for_progress():
    assert boosting.best_round([5, 4, 4.5, 3, 3.5, 3.6, 2], 2) == 4
    assert boosting.best_round([5, 4, 4.5, 3, 3.5, 3.6, 2], 5) == 7


def test_placebo_finds_little(spark, parts, spec):
    scores = placebo.placebo_scores(parts[0], spec, "visit", boosting.BoostParams(rounds=3, depth=2, step=0.3, min_leaf=50))
    r = placebo.placebo_verdict(scores, spec.unit_id, 0.5, 100).first()
    assert r["practical_check_pass"] is True and r["overall_verdict"] == "PASS"
    assert abs(r["tau_mean"]) < 0.03
    worse = placebo.placebo_verdict(scores.withColumn("tau", F.lit(0.4)), spec.unit_id, 0.5, 100).first()
    assert worse["statistical_check_pass"] is False and worse["overall_verdict"] == "FAIL"


@pytest.mark.parametrize("name", ["t_learner", "x_learner", "causal_forest"])
def test_registered_learners_fit_with_full_settings(name, spark, folder):
    from liftgrid.catalog import queries

    rows = queries.ALL[name](spark, folder).agg(F.count("tau"), F.countDistinct("unit_id"), F.stddev("tau")).first()
    assert rows[0] == rows[1] == queries._test(spark, folder).count()


@pytest.mark.parametrize(
    ("name", "fit"),
    [
        ("t_learner", "fit_t_learner"),
        ("x_learner", "fit_x_learner"),
        ("residuals", "cross_fit_residuals"),
        ("causal_forest", "fit_dml_forest"),
        ("dual_head", "fit_dual_head"),
        ("placebo_test", "placebo.placebo_scores"),
    ],
)
def test_registered_learners_run_with_full_settings(name, fit, spark, folder, monkeypatch):
    from inspect import Parameter, signature

    from liftgrid.catalog import queries

    *inside, last = fit.split(".")
    where = getattr(queries, inside[0]) if inside else queries
    wanted = signature(getattr(where, last))

    def instead(*args, **named):
        given = wanted.bind(*args, **named).arguments
        whole = {k: p.default for k, p in wanted.parameters.items() if p.default is not Parameter.empty and k not in ("val", "outcome")}
        assert {k: v for k, v in given.items() if k in whole and v != whole[k]} == {}
        raise InterruptedError

    if name == "x_learner":
        monkeypatch.setattr(queries, "_outcome_models", lambda *_: (None, None, None))
    monkeypatch.setattr(queries, "_once", lambda spark, folder, what, make: make())
    monkeypatch.setattr(where, last, instead)
    with pytest.raises(InterruptedError):
        getattr(queries, name)(spark, folder)
