"""Samples, exact stratified splits, hold-outs and pseudo-assignments.

Units are ordered by a digest of their key. A split takes the first units of each stratum, so it
is exact, reproducible and independent of partitioning. Since only the cut-off units have to be
found, the table itself is never shuffled, however skewed the strata are.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftgrid.functions.hashing import below, draw
from liftgrid.operators.ranking import (
    BUCKET,
    bucket_totals,
    bucketed,
    match,
    rows_at_ranks,
    running_totals,
    settled,
    small,
    within_cuts,
)
from liftgrid.spec import ExperimentSpec

DRAW = "_draw"
MIN_CONVERSIONS = 50
_UNITS_PER_BUCKET = 20_000
SIZE, KEY = "_size", "_stratum"
#: Strata whose sizes and quotas are a local table. The driver works through such tables row by row, so more are kept distributed.
FEW_STRATA = 10_000


def stratified_sample(
    df: DataFrame,
    spec: ExperimentSpec,
    fraction: float | Mapping[int, float],
    seed: int = 42,
    method: str = "hash",
) -> DataFrame:
    """Bernoulli sample by arm.

    ``hash`` keeps a unit when its digest falls below the fraction. ``builtin`` uses Spark's
    sampler, whose draws follow the partition layout.
    """
    fractions = dict(fraction) if isinstance(fraction, Mapping) else {0: fraction, 1: fraction}
    if method == "builtin":
        return df.sampleBy(spec.treatment, fractions=fractions, seed=seed)
    if method != "hash":
        raise ValueError(f"unknown sampling method: {method}")
    drawn = draw(spec.unit_id, "sample", seed)
    keep = F.lit(False)
    for arm, share in fractions.items():
        keep = keep | ((F.col(spec.treatment) == arm) & below(drawn, share))
    return df.where(keep)


def pseudo_assignment(
    df: DataFrame, spec: ExperimentSpec, share: float = 0.5, seed: int = 42, name: str = "pseudo"
) -> DataFrame:
    """Add a random 0/1 column that ignores the data."""
    return df.withColumn(name, below(draw(spec.unit_id, "pseudo", seed), share).cast("int"))


def allocate(sizes: DataFrame, draws: int, size: str, out: str, strata: Sequence[str]) -> DataFrame:
    """Add ``out``: ``draws`` divided over the rows in proportion to ``size``, by largest remainder.

    Equal remainders go to the stratum that sorts first, null before any value. The remainders are ranked like any other
    scores, so the strata may be as many as the units.
    """
    total = sizes.agg(F.sum(size)).first()[0] or 0
    if not 0 <= draws <= total:
        raise ValueError(f"cannot draw {draws} of {total} units")
    if total == 0:
        return sizes.withColumn(out, F.lit(0).cast("bigint"))
    product = F.col(size).cast("decimal(19,0)") * F.lit(draws).cast("decimal(19,0)")
    parts = sizes.withColumn("_product", product).select(
        F.struct(*sizes.columns).alias("_row"),
        F.struct(*strata).alias(KEY),
        F.expr(f"_product DIV CAST({total} AS DECIMAL(19,0))").alias("_whole"),
        F.expr(f"CAST(_product % CAST({total} AS DECIMAL(19,0)) AS BIGINT)").alias("_rest"),
    )
    left = draws - parts.agg(F.sum("_whole")).first()[0]
    ranked = running_totals(bucketed(parts, "_rest", KEY), KEY, [], {})
    return ranked.select("_row.*", (F.col("_whole") + (F.col("rank") <= left).cast("bigint")).alias(out))


def default_strata(spec: ExperimentSpec) -> list[str]:
    return [spec.treatment, spec.primary_outcome]


def stratum_sizes(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Rows per stratum, as a column ``_size``."""
    return settled(df.groupBy(*strata).agg(F.count(F.lit(1)).alias(SIZE)), FEW_STRATA)


def _first_units(
    df: DataFrame,
    spec: ExperimentSpec,
    strata: Sequence[str],
    quotas: DataFrame,
    names: Sequence[str],
    salt: str,
    seed: int,
) -> DataFrame:
    """Add a boolean column per name: is the unit among the first so many of its stratum?

    ``quotas`` has a row per stratum, with its size and a column for each name. A stratum's buckets are the first hex digits
    of the draws, as many as its size asks for. With more than ``FEW_STRATA`` strata there is a cut-off in about every bucket, so rows
    are ranked instead of compared with cut-off rows.
    """
    drawn = df.withColumn(DRAW, draw(spec.unit_id, salt, seed))
    per_bucket = F.greatest(F.lit(float(_UNITS_PER_BUCKET)), F.sqrt(SIZE))
    digits = F.greatest(F.ceil(F.log(16.0, F.col(SIZE) / per_bucket)), F.lit(0)).cast("int")
    quotas = settled(quotas.withColumn("_digits", digits), FEW_STRATA)
    prefix = F.substring(F.col(DRAW), F.lit(1), F.col("_digits"))
    bucket = F.coalesce(F.conv(prefix, 16, 10).cast("bigint"), F.lit(0).cast("bigint"))
    if not quotas.isLocal():
        placed = match(drawn, quotas.select(*strata, "_digits", *names), strata).withColumn(BUCKET, bucket)
        return _ranked_first(placed, spec, strata, quotas, names).select(*df.columns, *names)
    sized = match(drawn.select(*strata, spec.unit_id, DRAW), small(quotas, quotas), strata)
    cuts = rows_at_ranks(
        sized.select(*strata, spec.unit_id, DRAW, bucket.alias(BUCKET)),
        spec.unit_id,
        strata,
        {name: F.col(name) for name in names},
        order=[F.col(DRAW).asc(), F.col(spec.unit_id).asc()],
        carry=[DRAW],
        known=quotas.select(*strata, *names),
    )
    return within_cuts(drawn, spec.unit_id, strata, cuts, names, score=DRAW).drop(DRAW)


def _ranked_first(placed: DataFrame, spec: ExperimentSpec, strata: Sequence[str], quotas: DataFrame, names: Sequence[str]) -> DataFrame:
    """Turn each quota column into whether the row's rank in its stratum is within it.

    Units with equal draw and key share the least rank, so they fall on one side of a cut-off together. A row without a key
    takes a place and is never within.
    """
    here = Window.partitionBy(*strata, BUCKET).orderBy(F.col(DRAW).asc(), F.col(spec.unit_id).asc())
    ranked = placed.withColumn("_rank", F.rank().over(here).cast("bigint"))
    if quotas.agg(F.max("_digits")).first()[0]:
        # Only strata of several buckets have ranks that start in another bucket.
        earlier = settled(bucket_totals(placed.where("_digits > 0"), strata, {"_rows": F.lit(1)}).select(*strata, BUCKET, "_before__rows"))
        ranked = match(ranked, small(earlier, earlier), strata, [BUCKET], "left")
        ranked = ranked.withColumn("_rank", F.col("_rank") + F.coalesce("_before__rows", F.lit(0)))
    there = F.col(DRAW).isNotNull() & F.col(spec.unit_id).isNotNull()
    return ranked.withColumns({n: there & (F.col("_rank") <= F.col(n)) for n in names})


def stratified_split(
    df: DataFrame,
    spec: ExperimentSpec,
    train: float = 0.70,
    val: float = 0.15,
    test: float = 0.15,
    seed: int = 42,
    strata: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``split``: train, val or test, with exact sizes overall and per stratum.

    Train takes ``floor(train * n)`` units; val takes its share of what is left, also rounded
    down; test takes the rest.
    """
    if abs(train + val + test - 1.0) > 1e-9:
        raise ValueError("fractions must sum to 1")
    strata = list(strata or default_strata(spec))
    sizes = stratum_sizes(df, strata)
    total = sizes.agg(F.sum(SIZE)).first()[0] or 0
    in_train = math.floor(train * total)
    first = settled(allocate(sizes, in_train, SIZE, "_in_train", strata).withColumn("_rest_size", F.col(SIZE) - F.col("_in_train")), FEW_STRATA)
    in_val = math.floor(val / (val + test) * (total - in_train)) if val + test else 0
    second = allocate(first, in_val, "_rest_size", "_in_val", strata)
    quotas = second.withColumn("_in_val", F.col("_in_train") + F.col("_in_val"))
    names = ["_in_train", "_in_val"]
    marked = _first_units(df, spec, strata, quotas, names, "split", seed)
    split = F.when(F.col("_in_train"), "train").when(F.col("_in_val"), "val").otherwise("test")
    return marked.withColumn("split", split).drop(*names)


def stratified_subsample(
    df: DataFrame,
    spec: ExperimentSpec,
    n: int,
    seed: int = 42,
    strata: Sequence[str] | None = None,
) -> DataFrame:
    """Exactly ``n`` units in proportion to the strata, or all of them if there are no more."""
    strata = list(strata or default_strata(spec))
    sizes = stratum_sizes(df, strata)
    if n >= (sizes.agg(F.sum(SIZE)).first()[0] or 0):
        return df
    quotas = allocate(sizes, n, SIZE, "_kept", strata)
    marked = _first_units(df, spec, strata, quotas, ["_kept"], "subsample", seed)
    return marked.where("_kept").drop("_kept")


def stratified_holdout(
    df: DataFrame,
    spec: ExperimentSpec,
    test_fraction: float = 0.30,
    seed: int = 42,
    strata: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``holdout``: true for ``ceil(test_fraction * n)`` units, stratified."""
    strata = list(strata or default_strata(spec))
    sizes = stratum_sizes(df, strata)
    total = sizes.agg(F.sum(SIZE)).first()[0] or 0
    quotas = allocate(sizes, total - math.ceil(test_fraction * total), SIZE, "_kept", strata)
    marked = _first_units(df, spec, strata, quotas, ["_kept"], "holdout", seed)
    return marked.withColumn("holdout", ~F.col("_kept")).drop("_kept")


def split_summary(df: DataFrame, spec: ExperimentSpec, split: str = "split") -> DataFrame:
    """Per split: size, treatment share, outcome rates, conversions, and a small-count flag."""
    y = spec.primary_outcome
    rates = [F.round(F.avg(o), 6).alias(f"{o}_rate") for o in spec.outcomes]
    return (
        df.groupBy(split)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg(spec.treatment), 6).alias("treat_ratio"),
            *rates,
            F.sum(y).cast("bigint").alias(f"{y}_count"),
        )
        .withColumn("unstable", F.col(f"{y}_count") < MIN_CONVERSIONS)
    )
