from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from liftgrid.learners.boosting import BoostParams
from liftgrid.learners.dualhead import NetParams
from liftgrid.plans import stages
from liftgrid.sources import tables
from liftgrid.spec import ExperimentSpec

SMALL = ExperimentSpec(features=("f0", "f1"))
HEADER = "f0,f1,treatment,conversion,visit,exposure\n"
BODY = "1.5,2.0,1,0,1,1\n2.5,3.0,0,0,0,0\n"


def test_gzip_csv_with_explicit_schema(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    with gzip.open(tmp_path / "deep" / "er" / "raw.csv.gz", "wt") as f:
        f.write(HEADER + BODY)
    (tmp_path / "deep" / "more.csv").write_text(HEADER + BODY)
    (tmp_path / "deep" / "notes.txt").write_text("not data")
    df = tables.find_raw_csv(spark, str(tmp_path), SMALL, partitions=4)
    assert df.count() == 4 and df.schema == SMALL.raw_schema()
    assert df.agg(F.sum("visit"), F.sum("f0")).first() == (2, 8.0)


def test_no_csv_is_an_error(spark, tmp_path):
    (tmp_path / "readme.txt").write_text("nothing")
    with pytest.raises(FileNotFoundError):
        tables.find_raw_csv(spark, str(tmp_path), SMALL)


def test_malformed_and_truncated_input_fail(spark, tmp_path):
    (tmp_path / "bad.csv").write_text(HEADER + "x,2.0,1,0,1,1\n")
    with pytest.raises(Exception):
        tables.read_raw_csv(spark, str(tmp_path / "bad.csv"), SMALL).collect()
    whole = gzip.compress((HEADER + BODY * 5000).encode())
    (tmp_path / "cut.csv.gz").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception):
        tables.read_raw_csv(spark, str(tmp_path / "cut.csv.gz"), SMALL).collect()


def test_unit_keys_are_assigned_once(spark, tmp_path):
    raw = spark.createDataFrame([(1.0, 1.0, 1, 0, 0, 0)] * 50, SMALL.raw_schema()).repartition(5)
    stored = tables.ingest(raw, str(tmp_path / "t"), SMALL, files=2)
    first = {r["unit_id"] for r in stored.collect()}
    assert len(first) == 50 and first == {r["unit_id"] for r in stored.repartition(7).collect()}
    assert "exposure" not in stored.columns and dict(stored.dtypes)["treatment"] == "int"


def test_counts_file_flat_or_nested(spark, tmp_path):
    cell = {"n_treatment": 200, "x_treatment": 20, "n_control": 200, "x_control": 10}
    (tmp_path / "flat.json").write_text(json.dumps({"visit": cell, "other": cell}))
    (tmp_path / "nested.json").write_text(json.dumps({"total_rows": 400, "counts": {"visit": cell, "conversion": cell}}, indent=2))
    got = tables.read_arm_counts(spark, str(tmp_path))
    assert sorted(r["outcome"] for r in got.collect()) == ["conversion", "visit", "visit"]
    report = stages.ab_test_from_counts(spark, str(tmp_path / "nested.json"), str(tmp_path / "out"), SMALL)
    assert report.count() == 2 and report.first()["ztest"]["z_statistic"] == pytest.approx(1.8983, abs=1e-4)


def test_predictions_of_other_models_stay(spark, tmp_path):
    path = str(tmp_path / "p")
    frame = lambda m, v: spark.createDataFrame([("u1", m, v), ("u2", m, v)], "unit_id string, model string, tau double")
    tables.write_predictions(frame("a", 1.0), path)
    tables.write_predictions(frame("b", 2.0), path)
    tables.write_predictions(frame("a", 3.0), path)
    got = tables.read_predictions(spark, path, SMALL).groupBy("model").agg(F.sum("tau")).collect()
    assert dict(got) == {"a": 6.0, "b": 4.0}


def test_all_stages_in_one_workspace(spark, units, spec, tmp_path):
    """From raw rows to leaderboard, every stage reading what the earlier ones stored."""
    raw = units.select("unit_id", *spec.raw_schema().fieldNames())
    ws = stages.Workspace(str(tmp_path / "ws"))
    sizes = stages.ingest(raw, ws, spec, 0.2, files=2).first()
    assert sizes["full_rows"] == 6000 and 15 < sizes["sample_pct"] < 25
    assert stages.validate(spark, ws, spec) is False
    assert stages.balance_report(spark, ws, spec).count() == 8
    report = stages.ab_test(spark, ws, spec)
    assert {r["outcome"] for r in report.collect()} == {"visit", "conversion"}
    assert stages.split_and_scale(spark, ws, spec).count() == 3
    light = BoostParams(rounds=2, depth=2, step=0.3, min_leaf=20, patience=None)
    with pytest.raises(FileNotFoundError):
        stages.train(spark, ws, spec, "x_learner", "visit", light)
    metrics = stages.train(spark, ws, spec, "t_learner", "visit", light)
    assert {r["split"] for r in metrics.collect()} == {"val", "test"}
    stages.train(spark, ws, spec, "x_learner", "visit", light)
    stages.train(spark, ws, spec, "dual_head", "visit", NetParams(epochs=1))
    with pytest.raises(ValueError):
        stages.train(spark, ws, spec, "unknown")
    out = stages.evaluate(spark, ws, spec, outcome="visit", replicates=10)
    assert {r["model"] for r in out.collect()} == {"t_learner", "x_learner", "dual_head"}
    board, pairs = stages.compare(spark, ws, spec, "visit")
    assert board.count() == 3 and pairs.count() == 3
    assert stages.placebo_test(spark, ws, spec, "visit", light, 20).count() == 1
    assert stages.tail_report(spark, ws, spec, "t_learner", "visit").count() == 3
    assert stages.winsorize_stage(spark, ws, spec, "t_learner", "visit").count() == 1
    loaded = stages.load_model(ws, spec, "t_learner")
    assert "tau" in loaded.transform(spark.read.parquet(ws.splits)).columns


def test_combined_job(spark, units, spec, tmp_path):
    out = stages.combined_job(units, str(tmp_path / "job"), spec, files=2)
    assert out["balance"].count() == 8
    counts = {r["outcome"]: r for r in out["counts"].collect()}
    assert counts["visit"]["n1"] + counts["visit"]["n0"] == 6000


def test_tasks_that_write_arms_grow_with_the_rows(spark, small_spec, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    rows = spark.range(1000).selectExpr("id as unit_id", "cast(id % 2 as int) as treatment", "cast(id as double) as f0")
    tables.write_by_arm(rows, f"{tmp_path}/t", small_spec, 4)
    files = spark.read.parquet(f"{tmp_path}/t").inputFiles()
    assert len({f.split("/part-")[1][:5] for f in files}) == 10


def test_many_orders_meet_their_customers_first(spark, tmp_path, monkeypatch):
    """Line items then shuffle for orders and parts only; the rows are those of the written order, repeated and null keys included."""
    from liftgrid.sources import testbed

    lines = [(k % 7 or None, k % 5, k % 3, k % 4, float(k), k + 0.25, 0.1, 0.2) for k in range(60)]
    made = {
        "lineitem": spark.createDataFrame(
            lines,
            "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
            "l_extendedprice double, l_discount double, l_tax double",
        ),
        "orders": spark.createDataFrame(
            [(1, 1, 10.0), (1, 2, 11.0), (2, None, 12.0), (3, 3, 13.0), (4, 9, 14.0), (None, 1, 15.0), (5, 1, None)],
            "o_orderkey bigint, o_custkey bigint, o_totalprice double",
        ),
        "part": spark.createDataFrame([(k % 4, k, float(k)) for k in range(6)], "p_partkey bigint, p_size int, p_retailprice double"),
        "customer": spark.createDataFrame([(1, 1.5), (1, 1.5), (2, None), (3, 3.5), (None, 4.5)], "c_custkey bigint, c_acctbal double"),
    }
    for name, df in made.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    written = testbed.experiment(spark, str(tmp_path))
    monkeypatch.setattr(testbed, "FEW_ORDERS", 3)
    first = testbed.experiment(spark, str(tmp_path))
    assert first.schema == written.schema and first.count() > 60
    assert sorted(map(str, first.collect())) == sorted(map(str, written.collect()))
    joins = [[line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in line] for df in (written, first)]
    assert "o_custkey" in joins[0][0] and "o_custkey" in joins[1][-1] and len(joins[1]) == 3
