"""Helpers shared by the operators: hot-key-safe group minima, components, storage, batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftgrid.session import checkpoint_dir, cut_lineage

#: Ways a group is split by before rows meet; a hot group becomes this many groups.
SALTS = 256


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below the checkpoint folder that driver and executors share."""
    return f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def store(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the copy, which outlives executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folders of a frame that :func:`store` wrote and nothing reads any more."""
    spark = df.sparkSession
    root = checkpoint_dir(spark).split(":", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root not in folder:
            raise ValueError(f"{folder} is no stored intermediate")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pyarrow_uri(path: str) -> str:
    """A Hadoop path as pyarrow's file systems spell it (``file:/x`` has one slash in Hadoop)."""
    path = re.sub(r"^file:/+", "file:///", path)
    return path if re.match(r"^[a-z0-9+.-]+://", path) else f"file://{path}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def map_batches(
    df: DataFrame, work: Callable[[pa.RecordBatch], dict[str, object] | None], schema: str
) -> DataFrame:
    """Apply ``work`` to each Arrow batch; it returns the columns of the output batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def uniform(seed: int, *columns: str | Column) -> Column:
    """A number in [0, 1) that is a hash of the columns; a share of rows is those below it."""
    return F.xxhash64(F.lit(seed), *columns) / F.lit(2.0**64) + 0.5


def with_group_min(df: DataFrame, key: str, value: str, out: str, spread: list[str]) -> DataFrame:
    """Add the smallest ``value`` of each row's ``key`` as ``out``.

    Groups are pre-aggregated and joined back in ``SALTS`` pieces, dealt by the ``spread``
    columns, so a group with a third of all rows never meets in one task. Rows with a null key
    are dropped.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("short"))
    pieces = salted.groupBy(key, "_salt").agg(F.min(value).alias("_low"))
    low = pieces.select(
        key, "_salt", F.min("_low").over(Window.partitionBy(key)).alias(out)
    )
    return salted.join(low, [key, "_salt"]).drop("_salt")


def with_lookup(df: DataFrame, key: str, small: DataFrame, spread: list[str]) -> DataFrame:
    """Inner join with one row per ``key``, where a ``key`` of ``df`` may have any share of its rows.

    The row of a key is first copied to the pieces that its group is dealt to, ``SALTS`` at most.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("short"))
    pieces = salted.select(key, "_salt").distinct().join(small, key)
    return salted.join(pieces, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, root)`` for every node of an edge, root being the smallest reachable node.

    Alternating large-star and small-star rounds over long ids; each round is a fixed number of
    shuffles and is written to the shared folder. Edges with a null end or a loop are ignored.
    """
    spark = edges.sparkSession
    now = cut_lineage(
        edges.where(F.col(left) != F.col(right))
        .select(
            F.greatest(left, right).alias("u"),
            F.least(left, right).alias("v"),
        )
        .distinct()
    )
    before = None
    while True:
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if row[0] == 0 or tuple(row) == before:
            break
        before = tuple(row)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            with_group_min(both, "u", "v", "low", ["v"])
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
            .distinct()
        )
        low = with_group_min(large, "u", "v", "low", ["v"])
        links = low.where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        stars = low.select("u", F.col("low").alias("v"))
        now = cut_lineage(links.union(stars).distinct())
    if before is None:
        return spark.createDataFrame([], "node long, root long")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
