"""Exact global ranking, running totals and order statistics without a single-task window.

The order is always ``(score desc, unit_id asc)``. A row's *bucket* is a pure function of its
score (and, inside a heavily tied score, of its unit key) through cut values fitted once by an
approximate quantile sketch. Buckets follow the global order, so

* a window over ``(groups, bucket)`` plus the totals of all earlier buckets gives global ranks
  and running sums with one shuffle of the rows, spread evenly, and
* a rank cut-off is found by looking only inside the buckets it falls into; the rest of the
  table is classified by comparing with the cut-off row and is never shuffled.

Approximate cut values only affect how even the buckets are, never a result. Being literals in
the plan, they also make every retry place a row in the same bucket.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from liftgrid.session import cut_lineage

BUCKET = "_bucket"
SCORE = "_score"

ROWS_PER_BUCKET = 10_000
MIN_LIMIT, MAX_LIMIT = 2048, 1 << 16  # bounds of the most score buckets; the sketch holds about as many scores
_SUB_SPAN = 2**21
_SAMPLED = 64  # rows of a tied score that are looked at for each bucket
_BOUNDED_ROWS = 1_000_000


def ordered_score(score: str | Column) -> Column:
    """A double that sorts like the score; null and NaN go last, zero has one sign."""
    col = (F.col(score) if isinstance(score, str) else score).cast("double")
    return F.coalesce(F.nanvl(col, F.lit(None).cast("double")), F.lit(float("-inf"))) + F.lit(0.0)


def match(left: DataFrame, right: DataFrame, groups: Sequence[str], on: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Join on group keys, where null is a group like any other, and on plain columns.

    The result has each key once.
    """
    names = {k: f"_right_{k}" for k in (*groups, *on)}
    same = [F.col(k).eqNullSafe(F.col(names[k])) for k in groups] + [F.col(k) == F.col(names[k]) for k in on]
    return left.join(right.withColumnsRenamed(names), same, how).drop(*names.values())


def rank_order(unit_id: str) -> list[Column]:
    return [F.col(SCORE).desc(), F.col(unit_id).asc()]


@dataclass(frozen=True)
class Buckets:
    """Fitted cut values: ascending score splits, and unit keys that split tied scores.

    ``key_cuts`` holds the cut keys as JSON, ascending inside each score of ``tied_scores``; ``tie_ends`` are the positions in it
    after the keys of each of these scores. A tied score has a score bucket of its own.
    """

    rows: int
    score_splits: list[float] = field(default_factory=list)
    key_cuts: list[str] = field(default_factory=list)
    tied_scores: list[float] = field(default_factory=list)
    tie_ends: list[int] = field(default_factory=list)

    def place(self, scored: DataFrame, unit_id: str) -> DataFrame:
        """Add the bucket, ascending in rank order, to a frame with a score column."""
        if not self.score_splits:
            return scored.withColumn(BUCKET, F.lit(0).cast("bigint"))
        out = Bucketizer(
            splits=self.score_splits, inputCol=SCORE, outputCol="_at", handleInvalid="error"
        ).transform(scored)
        # Never null, to Spark's knowledge too: a join on the bucket would else filter rows by it first, working it out twice.
        out = out.withColumn("_at", F.coalesce(F.col("_at").cast("int"), F.lit(0)))
        bucket = (F.lit(len(self.score_splits)) - F.col("_at")).cast("bigint") * _SUB_SPAN
        if self.key_cuts:
            out = self._inner(out, unit_id)
            bucket += F.col("_low")
        return out.withColumn(BUCKET, bucket).select(*scored.columns, BUCKET)

    def _inner(self, placed: DataFrame, unit_id: str) -> DataFrame:
        """Add ``_low``: the position after the last cut key of the row's score that is not above its key, by bisection.

        Each halving is a projection of its own, which Spark compiles; a higher-order function would be interpreted.
        """
        kind = T.ArrayType(placed.schema[unit_id].dataType)
        starts, ends = [0] * len(self.score_splits), [0] * len(self.score_splits)
        begins = [0, *self.tie_ends]
        for value, low, high in zip(self.tied_scores, begins, self.tie_ends):
            at = bisect.bisect_right(self.score_splits, value) - 1
            starts[at], ends[at] = low, high
        at = F.col("_at")
        out = placed.withColumns(
            {
                "_cuts": F.from_json(F.lit(f"[{','.join(self.key_cuts)}]"), kind),
                "_low": _number_at(starts, at),
                "_high": _number_at(ends, at),
            }
        )
        most = max(high - low for low, high in zip(begins, self.tie_ends))
        for bit in reversed(range(most.bit_length())):
            upto = F.col("_low") + (1 << bit)
            passed = (upto <= F.col("_high")) & (F.get("_cuts", upto - 1) <= F.col(unit_id))
            out = out.withColumn("_low", F.when(passed, upto).otherwise(F.col("_low")))
        return out


def _number_at(numbers: Sequence[int], position: Column) -> Column:
    """The entry of a list of integers, one literal in the plan."""
    listed = F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")
    return F.coalesce(F.get(listed, position), F.lit(0))


def _sketch(scored: DataFrame, size: int = MAX_LIMIT - 1) -> tuple[int, bytes | None]:
    """Number of rows, and a mergeable quantile sketch of the scores.

    Task ``i`` sends its sketch to merger ``floor(sqrt(i))``, so that no task, the last one included, merges
    more than about twice the root of the number of tasks.
    """
    merger = F.floor(F.sqrt(F.spark_partition_id()))
    parts = scored.select(SCORE, merger.alias("_merger")).groupBy("_merger").agg(
        F.count(F.lit(1)).alias("_n"), F.kll_sketch_agg_double(SCORE, size).alias("_sketch")
    )
    found = parts.agg(F.sum("_n").alias("n"), F.kll_merge_agg_double("_sketch", size).alias("sketch")).first()
    return found.n or 0, found.sketch and bytes(found.sketch)


def _even_cuts(spark: SparkSession, sketch: bytes, parts: int) -> list[float]:
    """Approximate values at 1/parts, 2/parts, ... of the scores in the sketch; the list is one literal to keep plans small."""
    listed = ",".join(repr(i / parts) for i in range(1, parts))
    ranks = F.split(F.lit(listed), ",").cast("array<double>")
    one = spark.createDataFrame([(bytearray(sketch),)], "sketch binary")
    return one.select(F.kll_sketch_get_quantile_double("sketch", ranks)).first()[0]


def fit_buckets(
    scored: DataFrame,
    unit_id: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    split_ties: bool = True,
) -> Buckets:
    """Fit cut values so that no bucket holds much more than 1/n-th of the rows.

    One pass with a mergeable sketch, and a second over tied scores only when a score repeats
    often enough to fill several buckets. There are as many buckets as the rows fill; beyond ``MIN_LIMIT`` their number and
    their size both grow as the root of the rows, so at most ``MAX_LIMIT`` scores and as many keys reach the driver.
    Scores of all groups are pooled: a bucket of one group never exceeds the pooled bucket.
    """
    rows, sketch = _sketch(scored)
    wanted = min(math.ceil(rows / rows_per_bucket), max(MIN_LIMIT, math.isqrt(rows)), MAX_LIMIT)
    if wanted < 2:
        return Buckets(rows=rows)
    cuts = _even_cuts(scored.sparkSession, sketch, wanted)
    repeats = Counter(cuts)
    edges = {-math.inf, math.inf}
    for value, count in repeats.items():
        edges.add(value)
        if count > 1 or value == -math.inf:
            edges.add(math.nextafter(value, math.inf))
    splits = sorted(edges)
    if len(splits) < 3:
        return Buckets(rows=rows)
    tied = sorted(v for v, c in repeats.items() if c > 2 and split_ties)
    keys = _tied_keys(scored, unit_id, tied, rows / wanted) if tied else {}
    flat = [k for found in keys.values() for k in found]
    return Buckets(rows, splits, flat, list(keys), list(accumulate(map(len, keys.values()))))


def _tied_keys(scored: DataFrame, unit_id: str, tied: Sequence[float], per_bucket: float) -> dict[float, list[str]]:
    """Every so many-th unit key of each tied score, from a sample of real keys with small hashes.

    The sample is of units, so it doesn't depend on partitioning. It holds ``_SAMPLED`` rows for each bucket, whatever share
    of the rows a score has, and one key in ``_SAMPLED`` reaches the driver: one for each bucket. Null keys, which sort before
    any cut, make none.
    """
    share = min(1.0, _SAMPLED / per_bucket)
    low = F.xxhash64(F.lit(17), F.to_json(F.struct(unit_id))) / F.lit(2.0**64) + 0.5 < share
    drawn = scored.where(F.col(SCORE).isin(list(tied)) & low).select(SCORE, unit_id)
    order = F.row_number().over(Window.partitionBy(SCORE).orderBy(F.col(unit_id).asc()))
    gap = max(1, round(share * per_bucket))
    cuts = drawn.withColumn("_i", order).where((F.col("_i") % gap == 0) & F.col(unit_id).isNotNull())
    found: dict[float, list[str]] = {}
    for row in cuts.orderBy(SCORE, unit_id).select(SCORE, F.to_json(F.array(unit_id)).alias("cut")).collect():
        found.setdefault(row[SCORE], []).append(row["cut"][1:-1])
    return {score: list(dict.fromkeys(keys)) for score, keys in found.items()}


def bucketed(
    df: DataFrame,
    score: str | Column,
    unit_id: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    fitted: Buckets | None = None,
) -> DataFrame:
    """Add the ordering score and the bucket to ``df``; cut values that were fitted before are used as they are."""
    scored = df.withColumn(SCORE, ordered_score(score))
    return (fitted or fit_buckets(scored, unit_id, rows_per_bucket)).place(scored, unit_id)


def bucket_totals(
    placed: DataFrame,
    groups: Sequence[str],
    sums: Mapping[str, Column],
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Per (groups, bucket): sums, the sums of all earlier buckets and of the whole group.

    Rows combine map-side; what is left is one row per bucket.
    """
    per = placed.groupBy(*groups, BUCKET).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()], *extra
    )
    everything = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    earlier = everything.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumns(
        {f"_before_{n}": F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in sums}
        | {f"_all_{n}": F.sum(n).over(everything) for n in sums}
    )


def running_totals(
    placed: DataFrame, unit_id: str, groups: Sequence[str], sums: Mapping[str, Column]
) -> DataFrame:
    """Add ``rank``, ``n`` and, per entry of ``sums``, ``cum_*`` and ``all_*`` columns.

    Rows shuffle once, by bucket and groups. The totals are a settled table of a row per bucket and group: a join that is not
    a broadcast compares groups null-safely, by other keys than the window's, and would shuffle and sort all rows once more.
    The bucket leads the sort, as only the first key is compared without unpacking rows.
    """
    sums = {"_rows": F.lit(1), **sums}
    totals = settled(bucket_totals(placed, groups, sums).drop(*sums))
    here = Window.partitionBy(BUCKET, *groups).orderBy(*rank_order(unit_id))
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {"_local__rows": F.row_number().over(here).cast("bigint")} | {
        f"_local_{n}": F.sum(c).over(upto) for n, c in sums.items() if n != "_rows"
    }
    joined = match(placed.withColumns(local), small(totals, totals), groups, [BUCKET])
    out = joined.withColumns(
        {
            "rank": F.col("_before__rows") + F.col("_local__rows"),
            "n": F.col("_all__rows"),
            **{f"cum_{n}": F.col(f"_before_{n}") + F.col(f"_local_{n}") for n in sums if n != "_rows"},
            **{f"all_{n}": F.col(f"_all_{n}") for n in sums if n != "_rows"},
        }
    )
    return out.drop(*local, *[f"_before_{n}" for n in sums], *[f"_all_{n}" for n in sums])


def rows_at_ranks(
    placed: DataFrame,
    unit_id: str,
    groups: Sequence[str],
    ranks: Mapping[str, Column],
    order: Sequence[Column] | None = None,
    carry: Sequence[str] = (SCORE,),
    known: DataFrame | None = None,
) -> DataFrame:
    """The rows sitting at given global ranks: ``(*groups, cut, n, at, unit_id, *carry)``.

    ``ranks`` maps a cut name to a rank as an expression of the group size ``n`` and of the columns
    of ``known``, one row per group; ranks outside 1..n find no row. Only the buckets that contain a wanted rank are shuffled and sorted. The
    result is a local table with one row per group and cut.
    """
    totals = bucket_totals(placed, groups, {"_rows": F.lit(1)}).withColumn("n", F.col("_all__rows"))
    if known is not None:
        totals = match(totals, small(known, known), groups)
    wanted = F.inline(
        F.array(
            *[F.struct(F.lit(k).alias("cut"), r.cast("bigint").alias("at")) for k, r in ranks.items()]
        )
    )
    before = F.col("_before__rows")
    hits = (
        totals.select(*groups, BUCKET, "n", before, "_rows", wanted)
        .where((F.col("at") > before) & (F.col("at") <= before + F.col("_rows")))
        .select(*groups, BUCKET, "cut", "n", "at", (F.col("at") - before).alias("_local"))
    )
    hits = settled(hits)
    pick = hits.select(*groups, BUCKET).distinct()
    here = Window.partitionBy(*groups, BUCKET).orderBy(*(order or rank_order(unit_id)))
    inside = (
        match(
            placed.select(*dict.fromkeys([*groups, BUCKET, unit_id, *carry])),
            small(pick, hits),
            groups,
            [BUCKET],
            "left_semi",
        )
        .withColumn("_local", F.row_number().over(here).cast("bigint"))
    )
    found = match(inside, small(hits, hits), groups, [BUCKET, "_local"])
    return settled(found.select(*groups, "cut", "n", "at", unit_id, *carry))


def bounded(df: DataFrame, limit: int = _BOUNDED_ROWS) -> DataFrame:
    """Turn a small result into a local table, refusing one that is not small.

    Spark then knows the table's size, so broadcasting it is safe, and reads it again for free.
    """
    table = df.limit(limit + 1).toArrow()
    if table.num_rows > limit:
        raise ValueError(f"more than {limit} rows in a table meant to be small")
    return df.sparkSession.createDataFrame(table, df.schema)


def settled(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Compute a side table once: as a local table when small, else in the checkpoint folder."""
    limit = _BOUNDED_ROWS if limit is None else limit
    table = df.limit(limit + 1).toArrow()
    if table.num_rows > limit:
        return cut_lineage(df)
    return df.sparkSession.createDataFrame(table, df.schema)


def small(df: DataFrame, source: DataFrame) -> DataFrame:
    """Mark ``df`` for broadcasting if it derives from a local table, whose size is known."""
    return F.broadcast(df) if source.isLocal() else df


def within_cuts(
    df: DataFrame,
    unit_id: str,
    groups: Sequence[str],
    cut_rows: DataFrame,
    names: Sequence[str],
    score: str = SCORE,
) -> DataFrame:
    """Add a boolean column per cut: is the row ranked at or above the cut's row?

    ``cut_rows`` comes from :func:`rows_at_ranks`. While that is a local table, rows are compared
    with its broadcast and nothing is shuffled; a larger one is joined by group.
    """

    def above(score_at: Column, unit_at: Column) -> Column:
        ahead = F.col(score) > score_at if score == SCORE else F.col(score) < score_at
        hit = ahead | ((F.col(score) == score_at) & (F.col(unit_id) <= unit_at))
        return F.coalesce(hit, F.lit(False))

    if not groups:
        found = {r["cut"]: r for r in cut_rows.collect()}
        score_type, unit_type = (cut_rows.schema[c].dataType for c in (score, unit_id))

        def at(name: str, column: str, kind: T.DataType) -> Column:
            return F.lit(found[name][column] if name in found else None).cast(kind)

        return df.withColumns(
            {c: above(at(c, score, score_type), at(c, unit_id, unit_type)) for c in names}
        )
    wide = _cuts_by_group(cut_rows, groups, names, score, unit_id)
    joined = match(df, small(wide, wide), groups, how="left")
    flags = {c: above(F.col(f"_cut_score_{c}"), F.col(f"_cut_unit_{c}")) for c in names}
    return joined.withColumns(flags).drop(*[c for c in wide.columns if c not in groups])


def _cuts_by_group(
    cut_rows: DataFrame, groups: Sequence[str], names: Sequence[str], score: str, unit_id: str
) -> DataFrame:
    """One row per group with the score and unit of each cut; local if ``cut_rows`` is."""
    kinds = {"score": score, "unit": unit_id}
    columns = {f"_cut_{k}_{n}": (c, n) for n in names for k, c in kinds.items()}
    if not cut_rows.isLocal():
        picks = [F.max(F.when(F.col("cut") == n, F.col(c))).alias(k) for k, (c, n) in columns.items()]
        return cut_rows.groupBy(*groups).agg(*picks)
    fields = [cut_rows.schema[g] for g in groups]
    fields += [T.StructField(k, cut_rows.schema[c].dataType) for k, (c, _) in columns.items()]
    schema = T.StructType(fields)
    found: dict[tuple, dict[str, object]] = {}
    for r in cut_rows.collect():
        row = found.setdefault(tuple(r[g] for g in groups), {g: r[g] for g in groups})
        row |= {k: r[c] for k, (c, n) in columns.items() if n == r["cut"]}
    table = pa.Table.from_pylist(
        [{f.name: row.get(f.name) for f in fields} for row in found.values()],
        schema=to_arrow_schema(schema),
    )
    return cut_rows.sparkSession.createDataFrame(table, schema)


def percentile_rank_bounds(prob: float, n: Column) -> tuple[Column, Column, Column]:
    """Descending ranks of the two order statistics around a percentile, and the weight."""
    position = F.lit(float(prob)) * (n - 1)
    low = F.floor(position)
    return n - low, n - F.least(low + 1, n - 1), position - low


def exact_percentiles(
    df: DataFrame,
    value: str | Column,
    unit_id: str,
    probs: Sequence[float],
    groups: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``(*groups, n, prob, value)``: exact percentiles, linear between order statistics.

    Unlike the built-in exact aggregate it holds no value table in memory. Null and NaN values are
    left out, as is a group that has no others; ``n`` counts the values that are there.
    """
    column = (F.col(value) if isinstance(value, str) else value).cast("double")
    present = df.where(column.isNotNull() & ~F.isnan(column))
    placed = bucketed(present, value, unit_id, rows_per_bucket)
    n = F.col("n")
    ranks = {}
    for i, p in enumerate(probs):
        low, high, _ = percentile_rank_bounds(p, n)
        ranks |= {f"{i}:low": low, f"{i}:high": high}
    rows = rows_at_ranks(placed, unit_id, groups, ranks)
    parts = F.split("cut", ":")
    table = F.array(*[F.lit(float(p)) for p in probs])
    rows = rows.withColumns({"_i": parts[0].cast("int"), "_side": parts[1]})
    prob = F.get(table, F.col("_i"))
    position = prob * (F.col("n") - 1)
    pair = rows.groupBy(*groups, "n", "_i").agg(
        F.max(F.when(F.col("_side") == "low", F.col(SCORE))).alias("_low"),
        F.max(F.when(F.col("_side") == "high", F.col(SCORE))).alias("_high"),
    )
    weight = position - F.floor(position)
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * weight
    # Infinite neighbours have no difference to share out.
    value_at = F.when((weight == 0) | (F.col("_low") == F.col("_high")), F.col("_low")).otherwise(between)
    return pair.select(*groups, "n", prob.alias("prob"), value_at.alias("value"))
