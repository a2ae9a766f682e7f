"""Vector code compression: product codes by active-entry Lloyd rounds, in exact integers.

Components become ``floor(256 x)``; vectors are cut into equal parts, each with a codebook of its own.
A round assigns every part to its nearest entry and moves every used entry to the floored mean of its
parts. Rows carry the assigned entry of each part and its exact distance from round to round. Where that
entry has not moved since, the distance still holds, and all entries that have not moved keep their order:
only the moved ones are compared with the stored distance. Parts whose entry moved rescan the whole codebook.
Ties go to the lower index in both cases, so the result is that of plain Lloyd rounds.

Only a codebook (``entries`` numbers per component) and one sum per entry and component of it reach the
driver. Each round reads the stored rows once for the assignment and once for the sums, without a shuffle
of rows; the rows of the round before are then deleted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgrid.llm.common import discard, store, with_lookup

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Integers up to this size have squared distances that doubles hold exactly (parts of up to 1,024 components).
EXACT = 1 << 20
#: Large integers are summed in limbs of so many bits.
LIMB = 32
#: Rows of a batch that are compared at once.
ROWS = 4_096


def quantize(rows: np.ndarray) -> np.ndarray:
    """``floor(256 x)``: as int64 where every value is at most ``EXACT``, else as Python integers."""
    if not rows.size or np.abs(rows).max() <= EXACT / 256 - 1:
        return np.floor(rows * 256.0).astype(np.int64)
    whole = [math.floor(x * 256.0) if abs(x) < 2.0**52 else int(x) * 256 for x in rows.ravel().tolist()]
    out = np.empty(len(whole), object)
    out[:] = whole
    return out.reshape(rows.shape)


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows by entries."""
    if rows.dtype == object or entries.dtype == object:
        apart = rows.astype(object)[:, None, :] - entries.astype(object)[None]
        return (apart * apart).sum(axis=2) if rows.shape[1] else np.zeros(apart.shape[:2], object)
    x, c = rows.astype(np.float64), entries.astype(np.float64)
    return ((x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry, position]`` and which of them have moved since the rows were assigned."""

    entries: np.ndarray
    moved: np.ndarray

    def narrow(self) -> Codebooks:
        """With int64 entries if all are small."""
        if self.entries.dtype == object and not any(abs(x) > EXACT for x in self.entries.ravel()):
            return Codebooks(self.entries.astype(np.int64), self.moved)
        return self

    def assign(self, rows: np.ndarray, code: np.ndarray | None, held: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and its distance for each row and part.

        ``code`` and ``held`` are those of the codebooks before the entries moved; None: not known.
        """
        parts, entries, width = self.entries.shape
        new = np.zeros((len(rows), parts), np.int64)
        far = np.zeros((len(rows), parts), np.int64 if rows.dtype != object and self.entries.dtype != object else object)
        for p in range(parts):
            mine = rows[:, p * width : (p + 1) * width]
            scan = np.ones(len(rows), bool) if code is None else self.moved[p][code[:, p]]
            if scan.any():
                d = distances(mine[scan], self.entries[p])
                new[scan, p] = at = d.argmin(axis=1)
                far[scan, p] = d[np.arange(len(d)), at]
            still = np.flatnonzero(~scan)
            if still.size:
                new[still, p], far[still, p] = code[still, p], held[still, p]
                active = np.flatnonzero(self.moved[p])
                if active.size:
                    d = distances(mine[still], self.entries[p][active])
                    at = d.argmin(axis=1)
                    d, at = d[np.arange(len(d)), at], active[at]
                    old = held[still, p]
                    better = (d < old) | ((d == old) & (at < code[still, p]))
                    new[still[better], p], far[still[better], p] = at[better], d[better]
        return new, far

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for x in self.entries.ravel().tolist()).encode()).hexdigest()


def _vectors(column: pa.Array, length: int, parts: int) -> np.ndarray:
    """Rows of the list column, with zeros up to a multiple of ``parts``."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), length)
    return np.pad(rows, ((0, 0), (0, -length % parts)))


def _sizes(rows: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of the small rows, then of those with large components, in blocks."""
    small = np.abs(rows).max(axis=1, initial=0.0) <= EXACT / 256 - 1
    for kind in (np.flatnonzero(small), np.flatnonzero(~small)):
        for low in range(0, kind.size, ROWS):
            yield kind[low : low + ROWS]


def _assigned(rows: DataFrame, books: Codebooks, length: int, fresh: bool) -> DataFrame:
    """Rows with ``code`` (a byte per part) and ``held`` (a 64-bit distance per part; null: too large for one)."""
    parts = books.entries.shape[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _vectors(batch.column("v"), length, parts)
            code: list[bytes] = [b""] * batch.num_rows
            held: list[bytes | None] = [None] * batch.num_rows
            error: list[int | None] = [None] * batch.num_rows
            old = None if fresh else batch.column("code").to_pylist()
            was = None if fresh else batch.column("held").to_pylist()
            for block in _sizes(vectors):
                known = [] if fresh else [i for i in block.tolist() if was[i] is not None]
                unknown = block.tolist() if fresh else [i for i in block.tolist() if was[i] is None]
                for some, seen in ((known, True), (unknown, False)):
                    if not some:
                        continue
                    before = (None, None)
                    if seen:
                        before = (
                            np.frombuffer(b"".join(old[i] for i in some), np.uint8).reshape(-1, parts).astype(np.int64),
                            np.frombuffer(b"".join(was[i] for i in some), "<i8").reshape(-1, parts),
                        )
                    new, far = books.assign(quantize(vectors[some]), *before)
                    total = far.astype(object).sum(axis=1) if far.dtype == object else far.sum(axis=1)
                    for row, i in enumerate(some):
                        code[i] = new[row].astype(np.uint8).tobytes()
                        if total[row] < 1 << 63:
                            held[i], error[i] = np.array(far[row], "<i8").tobytes(), int(total[row])
            columns = {n: batch.column(n) for n in ("k", "label", "v")}
            yield pa.RecordBatch.from_pydict(
                columns | {"code": pa.array(code, pa.binary()), "held": pa.array(held, pa.binary()), "error": pa.array(error, pa.int64())}
            )

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in ("k", "label", "v"))
    return rows.mapInArrow(work, f"{kinds}, code binary, held binary, error long")


def _limbs(value: int) -> list[int]:
    """``value`` as signed limbs, the lowest first."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def _moved(rows: DataFrame, books: Codebooks, length: int) -> Codebooks:
    """Every used entry at the floored mean of its parts."""
    parts, entries, width = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, width), np.int64)
        large: dict[tuple[int, int, int, int], int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _vectors(batch.column("v"), length, parts)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
            for block in _sizes(vectors):
                whole = quantize(vectors[block])
                for p in range(parts):
                    mine, at = whole[:, p * width : (p + 1) * width], code[block, p]
                    count[p] += np.bincount(at, minlength=entries)
                    if whole.dtype != object:
                        np.add.at(total[p], at, mine)
                        continue
                    for entry, row in zip(at.tolist(), mine, strict=True):
                        for pos, value in enumerate(row):
                            for limb, part in enumerate(_limbs(value)):
                                key = (p, entry, pos, limb)
                                large[key] = large.get(key, 0) + part
        p, e = np.nonzero(count)
        a, b, c = np.nonzero(total)
        more = np.array([*large], np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_pydict(
            {
                "part": np.concatenate([p, a, more[:, 0]]),
                "entry": np.concatenate([e, b, more[:, 1]]),
                "pos": np.concatenate([np.full(p.size, -1), c, more[:, 2]]),
                "limb": np.concatenate([np.zeros(p.size + a.size, np.int64), more[:, 3]]),
                "total": np.concatenate([count[p, e], total[a, b, c], np.array([*large.values()], np.int64)]),
            }
        )

    partial = rows.select("v", "code").mapInArrow(sums, "part long, entry long, pos long, limb long, total long")
    found = partial.groupBy("part", "entry", "pos", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    count, total = {}, {}
    for r in found.collect():  # at most entries times components times limbs
        if r["pos"] < 0:
            count[r["part"], r["entry"]] = int(r["total"])
        else:
            key = (r["part"], r["entry"], r["pos"])
            total[key] = total.get(key, 0) + (int(r["total"]) << LIMB * r["limb"])
    new = books.entries.astype(object)
    for (p, e), n in count.items():
        for pos in range(width):
            new[p, e, pos] = total.get((p, e, pos), 0) // n
    return Codebooks(new, (new != books.entries).any(axis=2)).narrow()


def encode(df: DataFrame, key: str, vector: str, label: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, dict[int, Codebooks]]:
    """``key``, ``label``, ``code`` (a byte per part), ``error``, ``length`` of every kept row, and the codebooks by vector length.

    Rows whose vector is null or holds a null or non-finite component are dropped; keys and labels may be null.
    Codebooks start as the parts of the ``entries`` rows with the smallest key (nulls last, equal keys by
    vector); fewer rows give fewer entries. Vectors of different lengths have codebooks of their own;
    lengths that ``parts`` doesn't divide are filled with zeros. An error too large for 64 bits is null. Other columns
    are ignored, so their names can't clash. An empty table gives no rows and no codebooks.
    """
    if entries > 256:
        raise ValueError("a code is a byte per part")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = df.where(F.col(vector).isNotNull() & sound).select(F.col(key).alias("k"), F.col(label).alias("label"), F.col(vector).alias("v"))
    books, done = {}, []
    lengths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())
    for length in lengths:
        mine = rows.where(F.size("v") == length)
        first = mine.orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).select("v").collect()
        start = np.pad(np.array([r[0] for r in first], np.float64).reshape(len(first), length), ((0, 0), (0, -length % parts)))
        whole = quantize(start).reshape(len(first), parts, -1).transpose(1, 0, 2) if start.size else np.zeros((parts, len(first), 0), np.int64)
        now = Codebooks(whole, np.ones((parts, len(first)), bool)).narrow()
        state = None
        for _ in range(rounds):
            new = store(_assigned(mine if state is None else state, now, length, state is None), "codes")
            now = _moved(new, now, length)
            if state is not None:
                discard(state)
            state = new
        final = _assigned(mine if state is None else state, now, length, state is None)
        done.append(store(final.select("k", "label", "code", "error", F.lit(length).alias("length")), "coded"))
        if state is not None:
            discard(state)
        books[length] = now
    if not done:
        return rows.select("k", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).alias("length")).limit(0), books
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, books


def decode(code: bytes, books: Codebooks, length: int) -> np.ndarray:
    """The integers that a code stands for."""
    return np.concatenate([books.entries[p, e] for p, e in enumerate(code)])[:length]


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add ``label_error``: the errors of all rows with an equal label, nulls together.

    Null if one of them is null or the sum doesn't fit 64 bits.
    """
    keyed = coded.withColumn("_label", F.to_json(F.struct("label")))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = keyed.groupBy("_label").agg(F.when(F.count("error") == F.count("*"), total).alias("_sum"))
    sums = sums.select("_label", F.expr("try_cast(_sum as bigint)").alias("label_error"))
    return with_lookup(keyed, "_label", sums, ["k", "code"]).drop("_label")
