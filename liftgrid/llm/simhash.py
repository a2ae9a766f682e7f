"""SimHash near-duplicates with pivot distance tables.

A fingerprint has 64 bits by majority over the hashes of a text's word shingles. Two are linked at
``max_bits`` or fewer differing bits; a component of links is a group of near-duplicates.

*Candidates.* The bits are cut into ``max_bits + c`` blocks. Linked fingerprints agree in ``c`` of
them, so each is put in one bucket for each choice of ``c`` blocks, and no link is lost. ``c``
follows the number of distinct fingerprints, so that chance meetings in a bucket stay few.

*Pivot tables.* In a bucket the Hamming distances to the reference fingerprints are tabled.
By the triangle inequality a pair is out if any coordinate differs by more than ``max_bits``: rows
are sorted by the first coordinate and only the band within it is compared, the other coordinates
discard most of the rest, and only survivors have their bits counted. A bucket too large for that
(near copies of one text) is split again by blocks of the bits that its members may differ in.

A bucket reports a spanning forest of its links, not its pairs, so a group of any size makes at
most one row per member and bucket. Exact copies share a fingerprint and are one member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgrid.llm.common import components, map_batches, store, with_group_min, with_lookup

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
PIVOTS = np.random.default_rng(10).integers(0, 2**64, 24, dtype=np.uint64)
#: Largest bucket that is compared by bands; larger ones are split by further bits.
BAND_ROWS = 2048
#: Chance meetings in a bucket that are accepted, as a power of two.
CHANCE_BITS = 4


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of the text, repeats included; of all words if they are fewer."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    joined = memoryview(b" ".join(found))
    ends = (np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], seed) for a, b in zip(starts, ends[min(words, len(found)) - 1 :], strict=False)],
        dtype=np.uint64,
    )


def fingerprint(hashes: np.ndarray) -> int:
    """Bit ``i`` is 1 if it is set in over half of the hashes; no hashes give zero."""
    if not hashes.size:
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, hashes.size, 65_536):
        part = hashes[k : k + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > hashes.size, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``k`` and ``fp`` (the 64 bits as a signed long) of every row of ``df``."""

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        bits = [fingerprint(shingle_hashes(t.as_py(), words)) for t in batch.column(1)]
        return {"k": batch.column(0), "fp": pa.array(np.array(bits, np.uint64).view(np.int64))}

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return map_batches(rows, work, f"k {kind}, fp long")


def block_choice(distinct: int, max_bits: int) -> tuple[list[int], int]:
    """Masks of the blocks, and how many of them a bucket fixes."""
    wanted = max(1.0, math.log2(max(2, distinct)) - CHANCE_BITS)
    fixed = 1
    while 64 * fixed / (max_bits + fixed) < wanted and max_bits + fixed < 32:
        fixed += 1
    cuts = np.linspace(0, 64, max_bits + fixed + 1).round().astype(int)
    return [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], fixed


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the pairs; ``label`` keeps the smallest member of each set."""
    while a.size:
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if a.size:
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, again := label[label]):
            label[:] = again


def _bands(fp: np.ndarray, group: np.ndarray, at: np.ndarray, max_bits: int, label: np.ndarray) -> None:
    """Link rows of equal ``group``; ``at`` are their places in ``label``."""
    table = np.bitwise_count(fp[:, None] ^ PIVOTS).astype(np.int8)
    order = np.lexsort((table[:, 0], group))
    table, fp, group, at = table[order], fp[order], group[order], at[order]
    live = np.arange(fp.size - 1)
    for step in range(1, fp.size):
        live = live[live + step < fp.size]
        near = (group[live] == group[live + step]) & (table[live + step, 0] - table[live, 0] <= max_bits)
        live = live[near]
        if not live.size:
            break
        left = live[label[at[live]] != label[at[live + step]]]
        for c in range(1, PIVOTS.size):
            left = left[np.abs(table[left, c] - table[left + step, c]) <= max_bits]
        left = left[np.bitwise_count(fp[left] ^ fp[left + step]) <= max_bits]
        _merge(label, at[left], at[left + step])


def _split(fp: np.ndarray, at: np.ndarray, free: int, max_bits: int, label: np.ndarray) -> None:
    """Link the members of one large bucket, which may differ in the ``free`` bits only."""
    if fp.size <= BAND_ROWS:
        _bands(fp, np.zeros(fp.size, np.int8), at, max_bits, label)
        return
    bits = [k for k in range(64) if free >> k & 1]
    if len(bits) <= max_bits:
        _merge(label, at[:-1], at[1:])
        return
    for part in np.array_split(np.array(bits), max_bits + 1):
        mask = sum(1 << int(k) for k in part)
        value = fp & np.uint64(mask)
        order = np.argsort(value, kind="stable")
        edges = np.flatnonzero(np.diff(value[order])) + 1
        small = []
        for rows in np.split(order, edges):
            if rows.size > BAND_ROWS:
                _split(fp[rows], at[rows], free & ~mask, max_bits, label)
            elif rows.size > 1:
                small.append(rows)
        if small:
            rows = np.concatenate(small)
            _bands(fp[rows], np.repeat(np.arange(len(small)), [r.size for r in small]), at[rows], max_bits, label)


def links(prints: DataFrame, max_bits: int) -> DataFrame:
    """Edges ``(fp, to)`` whose components are those of all links among the distinct ``fp``."""
    masks, fixed = block_choice(prints.count(), max_bits)
    choices = [sum(masks[k] for k in c) for c in combinations(range(len(masks)), fixed)]
    signed = [m - (1 << 64) if m >> 63 else m for m in choices]

    def keys(batch: pa.RecordBatch) -> dict[str, object]:
        fp = batch.column(0).to_numpy()
        return {
            "choice": np.repeat(np.arange(len(signed), dtype=np.int32), fp.size),
            "key": np.concatenate([fp & np.int64(m) for m in signed]),
            "fp": np.tile(fp, len(signed)),
        }

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def done(part: pa.Table) -> pa.RecordBatch | None:
            choice, key = part["choice"].to_numpy(), part["key"].to_numpy()
            fp = part["fp"].to_numpy().view(np.uint64)
            new = np.r_[True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])]
            group = np.cumsum(new) - 1
            size = np.bincount(group)
            label = np.arange(fp.size)
            rows = np.flatnonzero((size[group] > 1) & (size[group] <= BAND_ROWS))
            if rows.size:
                _bands(fp[rows], group[rows], rows, max_bits, label)
            for g in np.flatnonzero(size > BAND_ROWS):
                rows = np.flatnonzero(group == g)
                _split(fp[rows], rows, ~choices[choice[rows[0]]] & (1 << 64) - 1, max_bits, label)
            linked = np.flatnonzero(label != np.arange(fp.size))
            if not linked.size:
                return None
            fp = fp.view(np.int64)
            return pa.RecordBatch.from_pydict({"fp": fp[linked], "to": fp[label[linked]]})

        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            choice, key = rest["choice"].to_numpy(), rest["key"].to_numpy()
            last = np.flatnonzero((choice != choice[-1]) | (key != key[-1]))
            cut = int(last[-1]) + 1 if last.size else 0  # the last bucket may go on
            if cut:
                if (out := done(rest.slice(0, cut))) is not None:
                    yield out
                rest = rest.slice(cut).combine_chunks()
        if rest is not None and rest.num_rows and (out := done(rest)) is not None:
            yield out

    dealt = map_batches(prints.select("fp"), keys, "choice int, key long, fp long")
    return dealt.repartition("choice", "key").sortWithinPartitions("choice", "key").mapInArrow(find, "fp long, to long")


def near_duplicates(df: DataFrame, key: str, text: str, words: int = 3, max_bits: int = 2) -> DataFrame:
    """``key``, ``fp`` (long) and ``component`` (smallest key reachable by links) of every row.

    Texts are lower-cased in A-Z and cut at ASCII white space; a null, empty or blank text has
    fingerprint zero and links like any other. Rows with equal keys are rows of their own; a null
    key never names a component unless all keys of it are null. An empty table gives none.
    """
    prints = store(fingerprints(df, key, text, words), "fingerprints")
    distinct = store(prints.groupBy("fp").agg(F.min("k").alias("low")), "distinct")
    roots = components(links(distinct, max_bits), "fp", "to").withColumnRenamed("node", "fp")
    member = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = with_group_min(member, "root", "low", "component", ["fp"]).select("fp", "component")
    return with_lookup(prints, "fp", named, ["k"]).select(F.col("k").alias(key), "fp", "component")
