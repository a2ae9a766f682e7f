"""Readers and writers of every table in an experiment's life."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftgrid.operators.quality import select_contract
from liftgrid.spec import ExperimentSpec

COUNT_FIELDS = ("n_treatment", "x_treatment", "n_control", "x_control")


def read_raw_csv(
    spark: SparkSession, path: str, spec: ExperimentSpec, partitions: int | None = None
) -> DataFrame:
    """Read CSV (plain or gzip) with the explicit raw schema; malformed rows fail the read.

    A gzip file is one task, so ``partitions`` spreads its rows right after parsing.
    """
    raw = (
        spark.read.schema(spec.raw_schema())
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return raw.repartition(partitions) if partitions else raw


def find_raw_csv(
    spark: SparkSession, folder: str, spec: ExperimentSpec, partitions: int | None = None
) -> DataFrame:
    """Read all ``.csv`` and ``.csv.gz`` files anywhere below a folder; none is an error."""
    raw = (
        spark.read.schema(spec.raw_schema())
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{csv,csv.gz}")
        .csv(folder)
    )
    if not raw.inputFiles():
        raise FileNotFoundError(f"no CSV file below {folder}")
    return raw.repartition(partitions) if partitions else raw


def with_unit_id(df: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Give each row a key if the source has none; write the result before using it.

    The key depends on the input's layout, so it is assigned once, straight after reading.
    """
    if spec.unit_id in df.columns:
        return df
    return df.withColumn(spec.unit_id, F.monotonically_increasing_id())


#: Rows that a task sorts by arm and writes, where the number of tasks is asked for.
TASK_ROWS = 500_000


def write_by_arm(df: DataFrame, path: str, spec: ExperimentSpec, files: int | None = None) -> None:
    """Overwrite a Parquet table partitioned by arm, with ``files`` tasks writing, or as many more as ``TASK_ROWS`` asks for.

    A task sorts its rows by arm, so its memory would grow with the table; counting the rows reads ``df`` once more.
    """
    spread = df.repartition(max(files, -(-df.count() // TASK_ROWS))) if files else df
    spread.write.mode("overwrite").partitionBy(spec.treatment).parquet(path)


def read_by_arm(spark: SparkSession, path: str, spec: ExperimentSpec) -> DataFrame:
    """Read such a table; arm and outcomes come back as integers, columns in contract order."""
    df = spark.read.parquet(path)
    ints = {c: F.col(c).cast("int") for c in (spec.treatment, *spec.outcomes) if c in df.columns}
    typed = df.withColumns(ints)
    first = [c for c in (spec.unit_id, *spec.contract) if c in typed.columns]
    return typed.select(*first, *[c for c in typed.columns if c not in first])


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_splits(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    """The named splits, each pruned to its own directory."""
    df = spark.read.parquet(path)
    return [df.where(F.col("split") == n) for n in names]


def write_predictions(df: DataFrame, path: str) -> None:
    """Write ``(unit_id, model, tau)`` by model; models already there and not in ``df`` stay."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model")
        .parquet(path)
    )


def read_predictions(
    spark: SparkSession, path: str, spec: ExperimentSpec, models: Sequence[str] | None = None
) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.withColumn("model", F.col("model").cast("string"))
    if models:
        df = df.where(F.col("model").isin(*models))
    return df.select(spec.unit_id, "model", "tau", *[c for c in df.columns if c not in (spec.unit_id, "model", "tau")])


def write_report(report: DataFrame, path: str) -> None:
    """Write a small nested report as one JSON file; nulls are kept as explicit fields."""
    (
        report.coalesce(1)
        .write.mode("overwrite")
        .option("ignoreNullFields", False)
        .json(path)
    )


def read_report(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_arm_counts(
    spark: SparkSession, path: str, spec: ExperimentSpec | None = None
) -> DataFrame:
    """``(source, outcome, n1, x1, n0, x0)`` from JSON files of pre-aggregated counts.

    Each file maps outcomes to counts, directly or under ``counts``; other entries are ignored.
    """
    outcomes = (spec or ExperimentSpec()).outcomes
    cells = T.StructType([T.StructField(c, T.LongType()) for c in COUNT_FIELDS])
    flat = [T.StructField(o, cells) for o in outcomes]
    schema = T.StructType([*flat, T.StructField("counts", T.StructType(flat))])
    files = spark.read.schema(schema).option("multiLine", True).json(path)
    source = F.col("_metadata.file_path")
    per = F.array(
        *[
            F.struct(F.lit(o).alias("outcome"), F.coalesce(F.col(f"counts.{o}"), F.col(o)).alias("c"))
            for o in outcomes
        ]
    )
    long = files.select(source.alias("source"), F.inline(per)).where(F.col("c").isNotNull())
    return long.select(
        "source",
        "outcome",
        F.col("c.n_treatment").alias("n1"),
        F.col("c.x_treatment").alias("x1"),
        F.col("c.n_control").alias("n0"),
        F.col("c.x_control").alias("x0"),
    )


def nested_counts(counts: DataFrame, total_rows: bool = True) -> DataFrame:
    """Counts of one experiment as a single row in the shape :func:`read_arm_counts` reads."""
    cells = F.struct(
        F.col("n1").alias("n_treatment"),
        F.col("x1").alias("x_treatment"),
        F.col("n0").alias("n_control"),
        F.col("x0").alias("x_control"),
    )
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", cells.alias("c")))))
    extra = [F.max(F.col("n1") + F.col("n0")).alias("total_rows")] if total_rows else []
    return counts.agg(*extra, pairs.alias("counts"))


def ingest(
    raw: DataFrame,
    path: str,
    spec: ExperimentSpec,
    files: int | None = None,
) -> DataFrame:
    """Key, project and store a raw table, and return the stored one.

    Later steps read the stored table, so the raw file is parsed once.
    """
    write_by_arm(select_contract(with_unit_id(raw, spec), spec), path, spec, files)
    return read_by_arm(raw.sparkSession, path, spec)
