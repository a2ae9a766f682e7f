from __future__ import annotations

import json

import pytest

from liftgrid.__main__ import parser, run

COLUMNS = ["--features", "f0,f1"]


def call(spark, *args: str) -> int:
    return run(parser().parse_args([*COLUMNS, *args]), spark)


def test_first_stages(spark, tmp_path, capsys):
    raw = tmp_path / "raw"
    raw.mkdir()
    rows = [f"{i % 7}.5,{i % 5}.0,{int(i % 6 != 0)},{int(i % 31 == 0)},{int(i % 11 == 0)},0" for i in range(3000)]
    (raw / "units.csv").write_text("f0,f1,treatment,conversion,visit,exposure\n" + "\n".join(rows) + "\n")
    ws = ["--workspace", str(tmp_path / "ws")]
    assert call(spark, "ingest", *ws, "--input", str(raw), "--partitions", "3") == 0
    assert call(spark, "validate", *ws) == 1
    assert call(spark, "balance", *ws) == 0
    assert call(spark, "abtest", *ws) == 0
    assert call(spark, "abtest", *ws, "--which", "sample") == 0
    assert call(spark, "split", *ws) == 0
    assert call(spark, "combined", "--input", str(raw), "--output", str(tmp_path / "job")) == 0
    out = capsys.readouterr().out
    assert "smd" in out and "some checks failed" in out


def test_counts_file(spark, tmp_path):
    cell = {"n_treatment": 11882655, "x_treatment": 36711, "n_control": 2096937, "x_control": 4063}
    (tmp_path / "c.json").write_text(json.dumps({"counts": {"conversion": cell}}))
    out = tmp_path / "out"
    assert call(spark, "abtest-from-counts", "--counts-file", str(tmp_path / "c.json"), "--output", str(out)) == 0
    got = spark.read.json(str(out)).first()
    assert got["ztest"]["z_statistic"] == 28.5165


def test_unknown_stage():
    with pytest.raises(SystemExit):
        parser().parse_args(["nothing"])
