"""Cut-offs of very many groups take the joined path and give the same answer."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from liftgrid.operators import agreement, ranking, uplift


@pytest.mark.parametrize("limit", [3, 1_000_000])
def test_large_side_tables_are_joined(units, spec, monkeypatch, limit):
    monkeypatch.setattr(ranking, "_BOUNDED_ROWS", limit)
    df = units.withColumns({"tau": F.col("f1"), "g": (F.col("f5") % 5).cast("int")})
    got = uplift.decile_table(df, spec, groups=["g"], rows_per_bucket=100)
    want = uplift.ranking_metrics(df, spec, groups=["g"]).select("g", F.inline("decile_table"))
    a = {(r["g"], r["decile"]): (r["n"], r["mean_predicted_tau"], r["observed_lift"]) for r in got.collect()}
    b = {(r["g"], r["decile"]): (r["n"], r["mean_predicted_tau"], r["observed_lift"]) for r in want.collect()}
    assert a == b and len(a) == 50


def test_average_ranks_with_a_joined_table(units, monkeypatch):
    monkeypatch.setattr(ranking, "_BOUNDED_ROWS", 2)
    df = units.select("unit_id", F.col("f0").alias("tau"), (F.col("f5") % 3).alias("model"))
    got = agreement.average_ranks(df, "unit_id", rows_per_bucket=200)
    assert got.agg(F.sum("avg_rank")).first()[0] == sum(
        n * (n + 1) / 2 for (_, n) in df.groupBy("model").count().collect()
    )


def test_bounded_refuses(spark):
    with pytest.raises(ValueError):
        ranking.bounded(spark.range(10), 5)
