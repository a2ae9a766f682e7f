"""Contract checks of an ingested experiment table, fused into one scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftgrid.spec import ExperimentSpec

# Documented rates of the public uplift data set, and their absolute tolerance.
EXPECTED_RATES = {"treatment": 0.846, "visit": 0.04699, "conversion": 0.00292}
RATE_TOLERANCE = 0.02


def select_contract(df: DataFrame, spec: ExperimentSpec, keep_unit: bool = True) -> DataFrame:
    """Drop leak columns and project to the contract columns, in order."""
    key = [spec.unit_id] if keep_unit and spec.unit_id in df.columns else []
    return df.drop(*spec.leak).select(*key, *spec.contract)


def arm_rows(df: DataFrame, spec: ExperimentSpec, arm: int) -> DataFrame:
    """Units of one arm; prunes directories when the table is stored by arm."""
    return df.where(F.col(spec.treatment) == arm)


def schema_report(df: DataFrame, spec: ExperimentSpec) -> dict[str, object]:
    """Missing, unexpected and mistyped columns, sorted by name; reads no data."""
    expected = spec.processed_types()
    actual = {f.name: f.dataType for f in df.schema.fields if f.name != spec.unit_id}
    missing = sorted(set(expected) - set(actual))
    unexpected = sorted(set(actual) - set(expected))
    mistyped = sorted(c for c in expected if c in actual and actual[c] != expected[c])
    return {
        "schema_matches": not missing and not unexpected,
        "missing_columns": missing,
        "unexpected_columns": unexpected,
        "mistyped_columns": mistyped,
    }


def column_profile(
    df: DataFrame, spec: ExperimentSpec, columns: Sequence[str] | None = None
) -> DataFrame:
    """``(column, row_count, null_count, mean, min, max)`` of the numeric columns, one scan."""
    columns = list(columns or [c for c in spec.contract if c in df.columns])
    aggregates = [F.count(F.lit(1)).alias("row_count")]
    for c in columns:
        value = F.col(c).cast("double")
        aggregates += [
            F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"),
            F.avg(value).alias(f"{c}__mean"),
            F.min(value).alias(f"{c}__min"),
            F.max(value).alias(f"{c}__max"),
        ]
    cells = ", ".join(f"'{c}', `{c}__nulls`, `{c}__mean`, `{c}__min`, `{c}__max`" for c in columns)
    return df.agg(*aggregates).selectExpr(
        f"stack({len(columns)}, {cells}) as (column, null_count, mean, min, max)", "row_count"
    )


def _with_rates(
    profile: DataFrame, expected: Mapping[str, float], tolerance: float, relative: bool
) -> DataFrame:
    table = F.create_map(*[F.lit(v) for pair in expected.items() for v in pair])
    want = F.try_element_at(table, F.col("column"))
    slack = want * tolerance if relative else F.lit(tolerance)
    within = F.coalesce(F.abs(F.col("mean") - want) <= slack, F.lit(False))
    return profile.withColumns(
        {"expected": want, "actual": F.round("mean", 5), "within_tolerance": within}
    )


def rate_checks(
    profile: DataFrame,
    expected: Mapping[str, float] = EXPECTED_RATES,
    tolerance: float = RATE_TOLERANCE,
    relative: bool = False,
) -> DataFrame:
    """Compare observed means with documented rates.

    The absolute tolerance hardly constrains a rare outcome; ``relative=True`` scales it by the
    expected rate.
    """
    checked = _with_rates(profile, expected, tolerance, relative)
    return checked.where(F.col("expected").isNotNull()).select(
        "column", "expected", "actual", "within_tolerance"
    )


def quality_report(
    df: DataFrame,
    spec: ExperimentSpec,
    expected: Mapping[str, float] = EXPECTED_RATES,
    tolerance: float = RATE_TOLERANCE,
    relative: bool = False,
) -> DataFrame:
    """One nested row: row count, schema, nulls, rates, feature ranges and the verdict."""
    schema = schema_report(df, spec)
    present = [c for c in spec.contract if c in df.columns]
    marked = _with_rates(column_profile(df, spec, present), expected, tolerance, relative)
    is_feature = F.col("column").isin(*spec.features)
    extent = F.struct("column", "min", "max")
    rate = F.struct("column", "expected", "actual", "within_tolerance")
    report = marked.agg(
        F.max("row_count").alias("row_count"),
        F.array_sort(F.collect_list(F.struct("column", "null_count"))).alias("null_counts"),
        F.max(F.col("null_count") > 0).alias("any_nulls"),
        F.array_sort(F.collect_list(F.when(F.col("expected").isNotNull(), rate))).alias("rates"),
        F.array_sort(F.collect_list(F.when(is_feature, extent))).alias("feature_ranges"),
    )
    rates_ok = (F.size("rates") == len(expected)) & F.forall("rates", lambda r: r["within_tolerance"])

    def names(key: str) -> Column:
        return F.array(*map(F.lit, schema[key])).cast("array<string>").alias(key)

    return report.select(
        "row_count",
        F.lit(schema["schema_matches"]).alias("schema_matches"),
        names("missing_columns"),
        names("unexpected_columns"),
        names("mistyped_columns"),
        "null_counts",
        "any_nulls",
        "rates",
        "feature_ranges",
        (F.lit(schema["schema_matches"]) & ~F.col("any_nulls") & rates_ok).alias("all_passed"),
    )


def sample_share(full: DataFrame, sample: DataFrame) -> DataFrame:
    """``(full_rows, sample_rows, sample_pct)``; each side is only counted."""
    counts = full.select(F.lit("f").alias("_side")).unionAll(sample.select(F.lit("s").alias("_side")))
    sides = counts.groupBy().agg(
        F.count_if(F.col("_side") == "f").alias("full_rows"),
        F.count_if(F.col("_side") == "s").alias("sample_rows"),
    )
    pct = F.when(F.col("full_rows") > 0, 100 * F.col("sample_rows") / F.col("full_rows"))
    return sides.select("full_rows", "sample_rows", F.round(pct, 2).alias("sample_pct"))
