from __future__ import annotations

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from liftgrid.functions.normal import detectable_shift, erfc, two_sided_p, two_sided_t
from liftgrid.operators import abtest, balance, quality
from liftgrid.spec import ExperimentSpec

# Published counts and results of a large experiment and its 10% sample.
KNOWN = {
    ("full", "visit"): ((11882655, 576824, 2096937, 80105), (0.048543, 0.038201, 0.010342, 27.074, 65.2474, 0.010056, 0.010629, 0.002098, 0.000403, 1.056)),
    ("full", "conversion"): ((11882655, 36711, 2096937, 4063), (0.003089, 0.001938, 0.001152, 59.449, 28.5165, 0.001085, 0.001219, 0.002098, 0.000093, 4.819)),
    ("sample", "visit"): ((1189865, 57979, 210134, 8002), (0.048727, 0.03808, 0.010647, 27.959, 21.2322, 0.009742, 0.011552, 0.006629, 0.001279, 3.358)),
    ("sample", "conversion"): ((1189865, 3768, 210134, 440), (0.003167, 0.002094, 0.001073, 51.237, 8.2823, 0.000853, 0.001293, 0.006629, 0.000314, 14.995)),
}
PUBLISHED_P = {("full", "conversion"): 7.30826328583868e-179, ("sample", "conversion"): 1.2085058387885523e-16}


def test_known_answers(spark):
    rows = [(*key, *counts) for key, (counts, _) in KNOWN.items()]
    counts = spark.createDataFrame(
        rows, "dataset string, outcome string, n1 long, x1 long, n0 long, x0 long"
    )
    for r in abtest.experiment_report(counts).collect():
        key = (r["dataset"], r["outcome"])
        got = [
            r[c]
            for c in (
                "p_treatment", "p_control", "absolute_lift", "relative_lift_pct", "z_statistic",
                "ci_low", "ci_high", "cohens_h_detectable", "mde_absolute",
            )
        ]
        assert got == list(KNOWN[key][1][:-1])
        assert r["mde_relative_pct"] == pytest.approx(KNOWN[key][1][-1], abs=2e-3)
        assert r["significant"]
        if key in PUBLISHED_P:
            assert r["p_value"] == pytest.approx(PUBLISHED_P[key], rel=1e-11)


def test_erfc_matches_the_library(spark):
    xs = spark.range(0, 1000).select((F.col("id") / 40.0).alias("x"))
    for r in xs.select("x", erfc(F.col("x")).alias("y")).collect():
        assert r["y"] == pytest.approx(math.erfc(r["x"]), rel=1e-11, abs=1e-300)
    p = spark.range(1).select(two_sided_p(F.lit(-1.959963984540054)).alias("p")).first()["p"]
    assert p == pytest.approx(0.05, rel=1e-10)


def student_tail(t: float, df: int) -> float:
    """The finite series for whole degrees of freedom."""
    c2 = df / (df + t * t)
    terms, now = [], 1.0
    for j in range(df // 2):
        now *= 1.0 if j == 0 else c2 * ((2 * j - 1) / (2 * j) if df % 2 == 0 else 2 * j / (2 * j + 1))
        terms.append(now)
    inside = t / math.sqrt(df + t * t) * math.fsum(terms)
    return 1 - (inside if df % 2 == 0 else 2 / math.pi * (math.atan(t / math.sqrt(df)) + math.sqrt(c2) * inside))


def test_student_tail_equals_its_series(spark):
    cases = [(t, n) for n in (1, 2, 3, 4, 5, 10, 31, 999, 1000, 1001, 1002, 20_001) for t in (0.0, 0.01, 0.7, 1.9, 3.2, 6.0)]
    rows = spark.createDataFrame(cases, "t double, df long").select("t", "df", two_sided_t(-F.col("t"), F.col("df")).alias("p"))
    for r in rows.collect():
        assert r["p"] == pytest.approx(student_tail(r["t"], r["df"]), abs=1e-10)
    far = spark.range(1).select(two_sided_t(F.lit(1e6), F.lit(2)).alias("p")).first()["p"]
    assert far == pytest.approx(1e-12, rel=1e-9)


def test_detectable_shift_counts_both_tails():
    delta, phi = detectable_shift(0.05, 0.8), NormalDist().cdf
    crit = NormalDist().inv_cdf(0.975)
    assert phi(delta - crit) + phi(-delta - crit) == pytest.approx(0.8, abs=1e-12)


def test_balance_flags_only_the_shifted_feature(two_arm_frame, small_spec):
    got = {r["feature"]: r for r in balance.balance_table(two_arm_frame, small_spec).collect()}
    assert abs(got["f0"]["smd"]) < 0.1 and got["f0"]["balanced"] is True
    assert abs(got["f1"]["smd"]) > 0.1 and got["f1"]["balanced"] is False
    summary = balance.balance_summary(balance.balance_table(two_arm_frame, small_spec)).first()
    assert (summary["n_features"], summary["n_unbalanced"]) == (2, 1)


def test_constant_feature_has_no_smd_but_is_marked(two_arm_frame, small_spec):
    df = two_arm_frame.withColumns({"f0": F.lit(1.0), "f1": F.col("treatment").cast("double")})
    got = {r["feature"]: r for r in balance.balance_table(df, small_spec).collect()}
    assert got["f0"]["smd"] == 0 and got["f0"]["degenerate"] is False
    assert got["f1"]["smd"] == 0 and got["f1"]["degenerate"] is True


def test_counts_and_direction(two_arm_frame, small_spec):
    counts = abtest.arm_counts(two_arm_frame, small_spec)
    got = {r["outcome"]: r for r in abtest.experiment_report(counts).collect()}
    visit = got["visit"]
    assert (visit["n1"], visit["x1"], visit["n0"], visit["x0"]) == (210, 30, 210, 15)
    assert visit["p_treatment"] > visit["p_control"] and visit["absolute_lift"] > 0
    assert 0 <= visit["p_value"] <= 1
    assert got["conversion"]["mde_absolute"] > 0 and got["conversion"]["baseline_control_rate"] >= 0


def test_single_arm_gives_nulls(two_arm_frame, small_spec):
    one = two_arm_frame.where("treatment = 1")
    r = abtest.experiment_report(abtest.arm_counts(one, small_spec)).first()
    assert r["n0"] == 0 and r["p_control"] is None and r["z_statistic"] is None and r["p_value"] is None
    assert {x["smd"] for x in balance.balance_table(one, small_spec).collect()} == {None}


def test_zero_base_rate(two_arm_frame, small_spec):
    df = two_arm_frame.withColumn("visit", F.when(F.col("treatment") == 0, 0).otherwise(F.col("visit")))
    r = abtest.experiment_report(abtest.arm_counts(df, small_spec, ["visit"])).first()
    assert r["relative_lift_pct"] is None and r["mde_relative_pct"] is None and r["mde_absolute"] > 0


def test_quality_report(two_arm_frame, small_spec):
    expected = {"treatment": 0.5, "visit": 0.107, "conversion": 0.019}
    clean = quality.select_contract(two_arm_frame, small_spec)
    assert quality.quality_report(clean, small_spec, expected).first()["all_passed"] is True
    holes = clean.withColumn("f0", F.when(F.rand(1) < 0.5, F.col("f0")))
    report = quality.quality_report(holes, small_spec, expected).first()
    assert report["any_nulls"] is True and report["all_passed"] is False
    narrow = quality.quality_report(clean.drop("f1").withColumn("z", F.lit(1)), small_spec, expected).first()
    assert narrow["missing_columns"] == ["f1"] and narrow["unexpected_columns"] == ["z"]
    assert narrow["schema_matches"] is False and narrow["all_passed"] is False
    off = quality.quality_report(clean, small_spec, {"visit": 0.5}).first()
    assert off["rates"][0]["within_tolerance"] is False


def test_relative_tolerance_catches_what_the_absolute_one_misses(two_arm_frame, small_spec):
    profile = quality.column_profile(two_arm_frame, small_spec)
    wanted = {"conversion": 0.002}
    assert quality.rate_checks(profile, wanted).first()["within_tolerance"] is True
    assert quality.rate_checks(profile, wanted, 0.1, relative=True).first()["within_tolerance"] is False


def test_leak_cannot_be_a_feature():
    with pytest.raises(ValueError):
        ExperimentSpec(features=("f0", "exposure"))
