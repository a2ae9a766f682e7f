"""Embedding near-duplicates through an inverted multi-index.

Vectors are cut in halves with an independent codebook each; the product of the codebooks is a grid
of cells, and a vector's home is the cell of its nearest codewords. A query visits cells in the order
of the summed distances of its halves to their codewords (the multi-sequence order). How many it visits
is calibrated: sampled queries are compared with all rows by brute force, and neighbours at exactly the
threshold are planted around them, in random directions and towards other rows. The number is the
smallest at which the target share is met of each: of their links, on average over queries and over
links, and of both kinds of planted neighbours. It so holds where links are too rare for a sample to have any.
What is met is verified by the cosine in double precision.

Codebooks and queries are fitted on samples of bounded size (``SAMPLE``, ``QUERIES``); every row is
indexed. Vectors of different lengths have no cosine: each length has a grid of its own. Equal vectors of a
label are one member with a count. A cell with many members is cut into
a grid of chunks of members and visitors, so no task takes a hot cell alone. A chunk reports link counts
and a spanning forest, not pairs.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgrid.llm.common import components, store, uniform, with_group_min, with_lookup
from liftgrid.llm.simhash import _merge

SAMPLE, QUERIES = 20_000, 400
#: Neighbours of each kind that are planted, over all queries.
PLANTED = 1_600
#: Share of the links that visits should meet.
TARGET = 0.98
#: Members of a cell that are compared at once.
CHUNK = 4_096
#: Visits are calibrated at these numbers; the last are more than there are cells.
VISITS = np.unique(np.round(1.3 ** np.arange(64)).astype(np.int64))

LOG = logging.getLogger(__name__)


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _codebook(rows: np.ndarray, size: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    words = rows[rng.permutation(len(rows))[:size]].copy()
    for _ in range(rounds):
        near = _distances(rows, words).argmin(axis=1)
        count = np.bincount(near, minlength=len(words))
        for d in range(rows.shape[1]):
            total = np.bincount(near, rows[:, d], len(words))
            words[:, d] = np.where(count > 0, total / np.maximum(count, 1), words[:, d])
    return words


def _distances(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared, up to the rows' own squares."""
    return (words * words).sum(axis=1) - 2 * rows @ words.T


class Grid:
    """The two codebooks; a cell is ``i * size + j``."""

    def __init__(self, rows: np.ndarray, size: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.half = rows.shape[1] // 2
        self.left = _codebook(rows[:, : self.half], size, rng)
        self.right = _codebook(rows[:, self.half :], size, rng)

    def parts(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(rows[:, : self.half], self.left), _distances(rows[:, self.half :], self.right)

    def home(self, rows: np.ndarray) -> np.ndarray:
        a, b = self.parts(rows)
        return a.argmin(axis=1) * len(self.right) + b.argmin(axis=1)

    def visits(self, rows: np.ndarray, count: int) -> np.ndarray:
        """The first ``count`` cells of each row in multi-sequence order, its home first.

        The cell at places ``(a, b)`` of the two sorted lists comes after ``(a + 1)(b + 1) - 1``
        others, so only places with a product of at most ``count`` can be among the first.
        """
        a, b = self.parts(rows)
        count = min(count, a.shape[1] * b.shape[1])
        by_a, by_b = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        p, q = np.nonzero(np.outer(np.arange(1, a.shape[1] + 1), np.arange(1, b.shape[1] + 1)) <= count)
        sums = np.take_along_axis(a, by_a, 1)[:, p] + np.take_along_axis(b, by_b, 1)[:, q]
        first = np.argsort(sums, axis=1, kind="stable")[:, :count]
        return np.take_along_axis(by_a, p[first], 1) * b.shape[1] + np.take_along_axis(by_b, q[first], 1)


def _vectors(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def planted_recall(rows: np.ndarray, grid: Grid, least: float) -> np.ndarray:
    """Shares met after each of ``VISITS`` of neighbours at cosine ``least``, for two kinds of directions.

    A pair is met if either end visits the other's home.
    """
    rng = np.random.default_rng(11)
    x = rows[np.arange(PLANTED) % len(rows)]
    kinds = [rng.standard_normal(x.shape), rows[rng.integers(0, len(rows), len(x))] + 1e-9 * rng.standard_normal(x.shape)]

    def rank(of: np.ndarray, other: np.ndarray) -> np.ndarray:
        (a, b), home = grid.parts(of), grid.home(other)
        i, j = np.divmod(home, b.shape[1])
        at = a[np.arange(len(of)), i] + b[np.arange(len(of)), j]
        return ((a[:, :, None] + b[:, None, :]).reshape(len(of), -1) < at[:, None]).sum(axis=1) + 1

    out = []
    for kind in kinds:
        side = kind - (kind * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(side, axis=1, keepdims=True)
        y = unit(least * x + np.sqrt(max(0.0, 1 - least * least)) * side / np.maximum(size, 1e-300))
        met = [np.minimum(rank(x[k : k + 64], y[k : k + 64]), rank(y[k : k + 64], x[k : k + 64])) for k in range(0, len(x), 64)]
        out.append((np.concatenate(met)[:, None] <= VISITS).mean(axis=0))
    return np.stack(out)


def calibrate(members: DataFrame, grid: Grid, dimension: int, least: float, share: float) -> tuple[int, float]:
    """Cells to visit, and the smallest share then met: of links, by brute force of sampled queries on
    all rows, and of planted neighbours."""
    queries = members.where(uniform(5, "rid") < share).select("rid", "label", "v").toPandas()
    if not len(queries):
        queries = members.select("rid", "label", "v").orderBy("rid").limit(QUERIES).toPandas()
    rid, label = queries["rid"].to_numpy(), queries["label"].to_numpy()
    rows = unit(np.stack(queries["v"].to_numpy()))
    a, b = grid.parts(rows)
    sums = np.sort((a[:, :, None] + b[:, None, :]).reshape(len(rows), -1), axis=1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(rows), VISITS.size + 1), np.int64)
        for batch in batches:
            other = unit(_vectors(batch.column(2), dimension))
            home = grid.home(other)
            near = (rows @ other.T >= least) & (label[:, None] == batch.column(1).to_numpy()) & (rid[:, None] != batch.column(0).to_numpy())
            for q, o in zip(*np.nonzero(near), strict=True):
                i, j = divmod(int(home[o]), b.shape[1])
                rank = np.searchsorted(sums[q], a[q, i] + b[q, j], "left") + 1
                found[q, np.searchsorted(VISITS, rank)] += 1
        q, v = np.nonzero(found)
        yield pa.RecordBatch.from_pydict({"q": q, "v": v, "n": found[q, v]})

    rows_of = members.select("rid", "label", "v").mapInArrow(count, "q long, v long, n long")
    total = np.zeros((len(rows), VISITS.size + 1))
    for r in rows_of.groupBy("q", "v").agg(F.sum("n").alias("n")).collect():
        total[r["q"], r["v"]] = r["n"]
    recall = planted_recall(rows, grid, least).min(axis=0)
    total = total[total.sum(axis=1) > 0]
    if len(total):
        met = np.cumsum(total, axis=1)[:, : VISITS.size]
        every = total.sum(axis=1, keepdims=True)
        recall = np.minimum(recall, np.minimum((met / every).mean(axis=0), met.sum(axis=0) / every.sum()))
    at = min(int(np.searchsorted(recall, TARGET)), VISITS.size - 1)
    return int(VISITS[at]), float(recall[at])


def _members(df: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """All rows with ``rid`` (null: links with nothing), and the distinct members."""
    sound = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = df.schema[label].dataType.typeName() in ("byte", "short", "integer", "long")
    same = F.col(label).cast("long") if whole else F.when(F.col(label).isNotNull(), F.xxhash64(label))
    rows = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), same.alias("label"))
    rows = rows.withColumn("ok", F.coalesce(F.col("k").isNotNull() & F.col("label").isNotNull() & sound, F.lit(False)))
    # Divided by the largest component, so that no square is too large or too small; the cosine stays.
    largest = F.array_max(F.transform("v", F.abs))
    rows = rows.withColumn("ok", F.col("ok") & F.coalesce(largest > 0, F.lit(False)))
    rows = rows.withColumn("v", F.when(F.col("ok"), F.transform("v", lambda x: x / largest)))
    rows = rows.withColumn("rid", F.when(F.col("ok"), F.xxhash64("label", "v")))
    rows = store(rows.select("k", "label", "v", "rid"), "vectors")
    members = rows.where("rid IS NOT NULL").groupBy("rid", "label", "v").agg(F.min("k").alias("low"), F.count("*").alias("weight"))
    return rows, store(members, "members")


def _visitors(members: DataFrame, grid: Grid, dimension: int, visits: int) -> DataFrame:
    """A row per member and visited cell; ``home`` marks the member's own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = grid.visits(unit(_vectors(batch.column(2), dimension)), visits)
            for low in range(0, batch.num_rows, 1024):
                part = cells[low : low + 1024]
                at = pa.array(np.repeat(np.arange(low, low + len(part)), part.shape[1]))
                out = pa.RecordBatch.from_arrays([c.take(at) for c in batch.columns], schema=batch.schema)
                out = out.append_column("cell", pa.array(part.ravel().astype(np.int64)))
                yield out.append_column("home", pa.array(np.tile(np.arange(part.shape[1]) == 0, len(part))))

    rows = members.select("rid", "label", "v", "weight")
    return rows.mapInArrow(work, "rid long, label long, v array<double>, weight long, cell long, home boolean")


def _links(dealt: DataFrame, grid: Grid, dimension: int, visits: int, least: float) -> DataFrame:
    """``(rid, links, to)``: counts of links per chunk, and forest edges where ``to`` is not null."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None

        def settled(part: tuple) -> tuple:
            rows, rid, weight = (np.concatenate([h[k] for h in part]) for k in range(3))
            order = np.argsort(rid)
            rows = unit(rows[order])
            return rows, rid[order], weight[order], grid.home(rows), np.sort(grid.visits(rows, visits), axis=1)

        for batch in batches:
            group = np.stack([batch.column(k).to_numpy() for k in range(4)], axis=1)
            member = batch.column(4).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1) | (member[1:] != member[:-1]), True])
            rows, rid, weight = _vectors(batch.column(6), dimension), batch.column(5).to_numpy(), batch.column(7).to_numpy()
            for low, high in zip(cut[:-1], cut[1:], strict=True):
                if now != (key := tuple(group[low])):
                    now, held, ready = key, [], None
                part = rows[low:high], rid[low:high], weight[low:high]
                if member[low]:
                    held.append(part)
                    continue
                if not held:
                    continue
                ready = ready or settled(held)
                mine, mine_id, mine_weight, mine_home, mine_visits = ready
                for a in range(0, high - low, 1024):
                    x, x_id, x_weight = unit(part[0][a : a + 1024]), part[1][a : a + 1024], part[2][a : a + 1024]
                    p, m = np.nonzero((x @ mine.T >= least) & (x_id[:, None] != mine_id))
                    if not p.size:
                        continue
                    back = (mine_visits[m] == grid.home(x)[p][:, None]).any(axis=1)  # met from the other side too
                    once = ~back | (x_id[p] < mine_id[m])
                    p, m = p[once], m[once]
                    if not p.size:
                        continue
                    ids = np.r_[x_id, mine_id]
                    links = np.r_[np.bincount(p, mine_weight[m], x_id.size), np.bincount(m, x_weight[p], mine_id.size)].astype(np.int64)
                    label = np.arange(ids.size)
                    _merge(label, p, m + x_id.size)
                    used = np.flatnonzero(links)
                    to = np.where(label == np.arange(ids.size), ids, ids[label])[used]
                    yield pa.RecordBatch.from_pydict({"rid": ids[used], "links": links[used], "to": to})

    keys = ["label", "cell", "m_chunk", "v_chunk"]
    # Members come before the visitors of their chunk.
    ranged = dealt.repartition(*keys).sortWithinPartitions(*keys, F.desc("member"))
    return ranged.select(*keys, "member", "rid", "v", "weight").mapInArrow(compare, "rid long, links long, to long")


def near_vectors(df: DataFrame, key: str, vector: str, label: str, least: float = 0.93) -> DataFrame:
    """``key``, ``n_links``, ``component`` and ``kept`` of every row.

    A row links with nothing if its key, label or vector is null, its vector is zero, or holds a null
    or non-finite component; it is then a component of its own (null for a null key, and kept). Vectors of
    different lengths don't link. Rows with equal keys are rows of their own. Labels may be of any type. Other columns are
    ignored, so their names can't clash. An empty table gives an empty table.
    """
    rows, members = _members(df, key, vector, label)
    linked = rows.where("rid IS NULL").select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component"))
    length = F.size("v")
    for dimension, count in sorted(members.groupBy(length).count().collect()):
        mine = members.where(length == dimension)
        sample = mine.where(uniform(3, "rid") < SAMPLE / count).select("v").toPandas()["v"]
        size = int(np.clip(np.sqrt(count / 64), 4, 256))
        grid = Grid(unit(np.stack(sample.to_numpy())) if len(sample) else np.ones((1, dimension)), size)
        visits, recall = calibrate(mine, grid, dimension, least, QUERIES / count)
        LOG.info("%d vectors of length %d: %d of %d cells visited, recall %.4f", count, dimension, visits, len(grid.left) * len(grid.right), recall)
        linked = linked.unionByName(_linked(rows.where(F.col("rid").isNotNull() & (length == dimension)), mine, grid, dimension, visits, least))
    kept = F.coalesce(F.col("k") == F.col("component"), F.lit(True))
    return linked.select(F.col("k").alias(key), "n_links", "component", kept.alias("kept"))


def _linked(rows: DataFrame, members: DataFrame, grid: Grid, dimension: int, visits: int, least: float) -> DataFrame:
    cells = store(_visitors(members, grid, dimension, visits), "cells")
    place = F.struct("label", "cell")
    sizes = cells.where("home").groupBy(place.alias("place")).agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    placed = with_lookup(cells.withColumn("place", place), "place", sizes, ["rid"])
    own, every = F.pmod(F.xxhash64("rid"), "chunks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    columns = ["label", "cell", "rid", "v", "weight"]
    members_of = placed.where("home").select(*columns, F.lit(True).alias("member"), own.alias("m_chunk"), every.alias("v_chunk"))
    visitors = placed.select(*columns, F.lit(False).alias("member"), every.alias("m_chunk"), own.alias("v_chunk"))
    found = store(_links(members_of.unionByName(visitors), grid, dimension, visits, least), "links")
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    roots = components(found, "rid", "to").withColumnRenamed("node", "rid")
    whole = (
        members.select("rid", "low", "weight")
        .join(counts, "rid", "left")
        .join(roots, "rid", "left")
        .select("rid", "low", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rid").alias("root"))
    )
    named = with_group_min(whole, "root", "low", "component", ["rid"]).select("rid", "n_links", "component")
    return with_lookup(rows.select("k", "rid"), "rid", named, ["k"]).select("k", "n_links", "component")
