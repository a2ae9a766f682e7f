"""Proportional stratified interleaving: every shard has the mixture of the whole.

Rows of a source are shuffled by a seeded hash and get the rank ``r`` of ``n``. Their fractional
rank ``(r + phase) / n``, with one seeded phase in [0, 1) per source, spreads each source evenly
over (0, 1). Sorted by it, any contiguous run of rows has each source within one row or so of its
share, so cutting the order into equal runs gives shards that match the mixture.

Neither order is made by one global window. A seeded hash is uniform, hence its leading bits are
even buckets of a source, and fractional ranks are uniform by construction, hence equal ranges of
them are even buckets of the whole. Rows are numbered inside a bucket, and the counts of earlier
buckets are added. A source with a third of all rows is so split like the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_count(rows: int) -> int:
    """About as many buckets as rows in a bucket: neither the list of buckets nor a bucket grows large."""
    return max(1, rows // max(256, math.isqrt(rows)))


def _offsets(counts: DataFrame, group: list[str], bucket: str, out: str) -> DataFrame:
    """Rows before each bucket, by running sums over one row per bucket."""
    order = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*group, bucket, F.coalesce(F.sum("_n").over(order), F.lit(0)).alias(out))


def interleave(
    df: DataFrame,
    source: Column,
    order: list[Column],
    shards: int = 16,
    seed: int = 42,
) -> DataFrame:
    """All columns of ``df`` plus ``shard`` (int, 0 to ``shards - 1``) and ``slot`` (long).

    Shard sizes differ by one row at most; slots of a shard are gapless from 0. ``order`` names
    the columns that tell rows apart: the shuffle is a hash of them, and ties in it are settled
    by their values. Rows alike in all of them are interchangeable. A null source is a source of
    its own, an empty table gives an empty result, and no column of
    ``df`` can clash; its own ``shard`` and ``slot`` are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")]).alias("_row"),
        F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n")).alias("_source"),
        F.struct(*order).alias("_order"),
        F.xxhash64(F.lit(seed), *order).alias("_hash"),
    )
    total = df.count()
    buckets = bucket_count(total)
    fine = rows.withColumn("_fine", F.floor((F.col("_hash") / F.lit(2.0**64) + 0.5) * buckets))

    counts = fine.groupBy("_source", "_fine").agg(F.count("*").alias("_n"))
    sizes = counts.withColumn("_total", F.sum("_n").over(Window.partitionBy("_source")))
    before = _offsets(counts, ["_source"], "_fine", "_before")
    ranks = before.join(sizes.select("_source", "_fine", "_total"), ["_source", "_fine"])
    inside = Window.partitionBy("_source", "_fine").orderBy("_hash", "_order")
    phase = F.xxhash64(F.lit(~seed), "_source") / F.lit(2.0**64) + 0.5
    ranked = (
        fine.withColumn("_in", F.row_number().over(inside) - 1)
        .join(ranks, ["_source", "_fine"])
        .withColumn("_share", (F.col("_before") + F.col("_in") + phase) / F.col("_total"))
        .select("_row", "_source", "_order", "_hash", "_share")
        .withColumn("_cell", F.floor(F.col("_share") * buckets))
    )

    cells = ranked.groupBy("_cell").agg(F.count("*").alias("_n"))
    inside = Window.partitionBy("_cell").orderBy("_share", "_source", "_hash", "_order")
    place = (
        ranked.withColumn("_in", F.row_number().over(inside) - 1)
        .join(_offsets(cells, [], "_cell", "_before"), "_cell")
        .withColumn("_place", F.col("_before") + F.col("_in"))
    )
    shard = F.expr(f"(_place * {shards}L) div {max(1, total)}L")
    start = F.expr(f"(_shard * {max(1, total)}L + {shards - 1}L) div {shards}L")
    return (
        place.withColumn("_shard", shard)
        .withColumn("_slot", F.col("_place") - start)
        .select("_row.*", F.col("_shard").cast("int").alias("shard"), F.col("_slot").alias("slot"))
    )


def write_shards(df: DataFrame, path: str) -> None:
    """Write the result of :func:`interleave` as one folder per shard, each file in slot order."""
    df.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
