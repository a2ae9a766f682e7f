"""Removal of repeated byte strings over a sparse, distributed suffix array.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts earlier. Sorting every suffix
would move many times the text, so only suffixes at *anchors* are sorted. The anchor of a window is the
leftmost of its ``GRAM``-byte tokens with the smallest hash; equal windows have it at the same
place, so windows that repeat meet at equal anchors, and neighbouring windows mostly share one.

1. Each task finds the anchors of whole texts. The windows of one anchor form one stretch of text.
   An anchor's suffix begins with its token (hashed), then its stretch (hashed). Of equal
   stretches in a task only the earliest goes on; the others are repeats and become removals.
2. Splitters, sampled from a bounded number of documents, range-partition the suffixes by token and
   stretch; a frequent token so spreads over several partitions. Each bucket is sorted by the keys in turn
   (token, stretch, document, place): all but the first of equal stretches are removals. First
   ones whose token has other stretches too share part of their windows at most.
3. Only for those the stretch itself is fetched, dealt by the same splitters, and compared window by
   window. Tokens that a splitter cuts apart are compared across the boundary by their windows' hashes.
4. Removals are gathered per document and applied to its bytes.

Positions are 32-bit, so a text may have 2 GB. Hashes are 64 bits within equal tokens of 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgrid.llm.common import map_batches, store, with_group_min

WINDOW, GRAM = 100, 32
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 2_000_000
#: Suffixes held before a task looks for equal stretches among them.
HELD = 200_000
#: Documents sampled for the splitters, and the suffixes a bucket should have.
SAMPLE_DOCS, BUCKET = 2_000, 200_000

_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SPAN, _NEED, _SUFFIX, _CROSS = range(4)
_ROWS = "kind byte, g long, s long, doc long, row int, a int, b int, c short"


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(1 << bits, _BASE), np.full(1 << bits, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


class Hashes:
    """Hashes of any ranges of a buffer."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers(max(21, int(data.size).bit_length()))
        self.total = np.zeros(data.size + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: data.size], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.total[end] - self.total[start]) * self.down[start])

    def every(self, size: int) -> np.ndarray:
        raw = self.total[size:] - self.total[:-size]
        raw *= self.down[: raw.size]
        return _mixed(raw)


def _smallest(keys: np.ndarray, size: int) -> np.ndarray:
    """Minimum over each run of ``size`` entries, from minima of blocks from either side."""
    count = keys.size - size + 1
    full = np.full(-(-keys.size // size) * size, np.iinfo(np.uint64).max, np.uint64)
    full[: keys.size] = keys
    blocks = full.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[size - 1 : size - 1 + count])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(text, anchor, first window, last window, token, stretch)`` of texts laid end to end."""
    if data.size < WINDOW:
        return tuple(np.empty(0, t) for t in (np.int64,) * 4 + (np.uint64,) * 2)
    hashes = Hashes(data)
    grams = hashes.every(GRAM)
    places = np.arange(grams.size, dtype=np.uint64)
    found = _smallest((grams & np.uint64(0xFFFFFFFF00000000)) | places, WINDOW - GRAM + 1)
    anchor = (found & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(ends.size), np.diff(np.r_[0, ends]))[: anchor.size]
    window = np.flatnonzero(np.arange(anchor.size) + WINDOW <= ends[text])
    anchor = anchor[window]
    new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if anchor.size else np.empty(0, np.int64)
    first, last = window[new], window[np.r_[new[1:], window.size] - 1] if new.size else window[new]
    at = anchor[new]
    return text[first], at, first, last, grams[at], hashes(first, last + WINDOW)


def _laid(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of texts laid end to end: bytes, ends, document and row of each."""
    docs, rows, parts, size = [], [], [], 0

    def laid() -> tuple[np.ndarray, ...]:
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), ends, np.array(docs, np.int64), np.array(rows, np.int32)

    for batch in batches:
        for doc, row, text in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            docs.append(doc)
            rows.append(row)
            parts.append(text)
            size += len(text)
            if size >= CHUNK:
                yield laid()
                docs, rows, parts, size = [], [], [], 0
    if parts:
        yield laid()


def _order(t: dict[str, np.ndarray]) -> np.ndarray:
    return np.lexsort((t["a"], t["row"], t["doc"], t["s"], t["g"]))


def _same(t: dict[str, np.ndarray], *names: str) -> np.ndarray:
    """For sorted rows: equal to the row before in ``names``."""
    out = np.ones(t["g"].size, bool)
    out[:1] = False
    for n in names:
        out[1:] &= t[n][1:] == t[n][:-1]
    return out


def _split_repeats(same: np.ndarray, *place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: the first of each run of ``same``, and those at another place than the first.

    Rows alike in place come from rows alike in key and text and are neither.
    """
    first = np.maximum.accumulate(np.where(same, 0, np.arange(same.size)))
    moved = np.zeros(same.size, bool)
    for p in place:
        moved |= p != p[first]
    return ~same, same & moved


def _joined(doc: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping or touching ranges of a text as one."""
    order = np.lexsort((end, start, row, doc))
    doc, row, start, end = doc[order], row[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not doc.size:
        return doc, row, start, end
    new = np.r_[True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])]
    lift = np.cumsum(new) * (1 << 33)  # texts apart, so that one running maximum serves all
    reach = np.maximum.accumulate(end + lift)
    new[1:] |= (start + lift)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], row[at], start[at], np.maximum.reduceat(end, at)


def _batch(kind: int, doc, row, a, b, g=None, s=None, c=None, pid=None) -> pa.RecordBatch:  # noqa: ANN001
    n = len(doc)
    zero = np.zeros(n, np.int64)
    columns = {
        "kind": np.full(n, kind, np.int8),
        "g": zero if g is None else g.view(np.int64),
        "s": zero if s is None else s.view(np.int64),
        "doc": doc,
        "row": row.astype(np.int32),
        "a": a.astype(np.int32),
        "b": b.astype(np.int32),
        "c": (zero if c is None else c).astype(np.int16),
    }
    return pa.RecordBatch.from_pydict(columns | ({} if pid is None else {"pid": pid.astype(np.int32)}))


class Splitters:
    """Sampled ``(token, stretch)`` pairs that cut the suffixes into buckets."""

    def __init__(self, g: np.ndarray, s: np.ndarray, buckets: int):
        order = np.lexsort((s, g))
        pick = order[np.linspace(0, order.size, buckets + 1).astype(int)[1:-1]] if order.size else order
        self.g, self.s, self.buckets = g[pick], s[pick], buckets

    def bucket(self, g: np.ndarray, s: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.g, g, "left"), np.searchsorted(self.g, g, "right")
        for k in np.flatnonzero(low < high):
            low[k] += np.searchsorted(self.s[low[k] : high[k]], s[k], "right")
        return low

    def cut(self, g: np.ndarray) -> np.ndarray:
        """The token may lie in more buckets than one."""
        return np.isin(g, self.g)


def _suffixes(batches: Iterator[pa.RecordBatch], splitters: Splitters | None) -> Iterator[pa.RecordBatch]:
    names, held, count = ("g", "s", "doc", "row", "a", "b", "c"), [], 0

    def settle() -> Iterator[pa.RecordBatch]:
        t = {n: np.concatenate([h[n] for h in held]) for n in names}
        order = _order(t)
        t = {n: x[order] for n, x in t.items()}
        new, again = _split_repeats(_same(t, "g", "s"), t["doc"], t["row"], t["a"])
        d = {n: x[again] for n, x in t.items()}
        doc, row, start, end = _joined(d["doc"], d["row"], d["a"] - d["c"], d["b"] + WINDOW)
        yield _batch(_SPAN, doc, row, start, end, pid=doc % splitters.buckets)
        t = {n: x[new] for n, x in t.items()}
        yield _batch(_SUFFIX, t["doc"], t["row"], t["a"], t["b"], t["g"], t["s"], t["c"], splitters.bucket(t["g"], t["s"]))

    for data, ends, docs, rows in _laid(batches):
        text, at, first, last, g, s = anchors(data, ends)
        if not at.size:
            continue
        begin = np.r_[0, ends[:-1]][text]
        part = {"g": g, "s": s, "doc": docs[text], "row": rows[text], "a": at - begin, "b": last - begin, "c": at - first}
        if splitters is None:
            yield pa.RecordBatch.from_pydict({"g": g.view(np.int64), "s": s.view(np.int64)})
            continue
        held.append(part)
        count += at.size
        if count >= HELD:
            yield from settle()
            held, count = [], 0
    if held:
        yield from settle()


def _columns(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(list(batches))
    out = {n: table[n].to_numpy() for n in table.column_names if n != "bytes"}
    out["g"], out["s"] = out["g"].view(np.uint64), out["s"].view(np.uint64)
    return out | ({"bytes": table["bytes"]} if "bytes" in table.column_names else {})


def _sorted_buckets(splitters: Splitters):  # noqa: ANN202
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = _columns(batches)
        spans = t["kind"] == _SPAN
        if spans.any():
            yield _batch(_SPAN, *(t[n][spans] for n in ("doc", "row", "a", "b")))
        t = {n: x[~spans] for n, x in t.items()}
        order = _order(t)
        t = {n: x[order] for n, x in t.items()}
        new, again = _split_repeats(_same(t, "g", "s"), t["doc"], t["row"], t["a"])
        yield _batch(_SPAN, t["doc"][again], t["row"][again], t["a"][again] - t["c"][again], t["b"][again] + WINDOW)
        t = {n: x[new] for n, x in t.items()}
        alike = _same(t, "g")
        shared = alike | np.r_[alike[1:], np.zeros(min(1, alike.size), bool)] | splitters.cut(t["g"])
        yield _batch(_NEED, *(t[n][shared] for n in ("doc", "row", "a", "b", "g", "s", "c")))

    return work


def _fetched(splitters: Splitters):  # noqa: ANN202
    """The bytes of the wanted stretches of each text, with the bucket they belong to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in ("g", "s", "doc", "row", "a", "b", "c", "bytes")}
            for doc, row, text, _, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for w in wanted:
                    for n in ("g", "s", "a", "b", "c"):
                        out[n].append(w[n])
                    out["doc"].append(doc)
                    out["row"].append(row)
                    out["bytes"].append(text[w["a"] - w["c"] : w["b"] + WINDOW])
            if out["doc"]:
                g, s = np.array(out["g"], np.int64), np.array(out["s"], np.int64)
                rest = _batch(_NEED, *(np.array(out[n], np.int64) for n in ("doc", "row", "a", "b")), g, s, np.array(out["c"]), splitters.bucket(g.view(np.uint64), s.view(np.uint64)))
                yield rest.append_column("bytes", pa.array(out["bytes"], pa.binary()))

    return work


def _compared(splitters: Splitters):  # noqa: ANN202
    """Window by window: removals, and the first windows of tokens that a splitter cuts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = _columns(batches)
        size = (t["b"] - t["a"] + t["c"] + 1).astype(np.int64)  # windows of each stretch
        order = np.argsort(t["g"], kind="stable")
        ends = np.cumsum(size[order])
        group = np.cumsum(np.r_[True, t["g"][order][1:] != t["g"][order][:-1]])
        low = 0
        while low < order.size:  # whole tokens, some two million windows at once
            high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + 2_000_000, "right"))
            high = max(high, int(np.searchsorted(group, group[low], "right")))
            if high < order.size:
                high = max(int(np.searchsorted(group, group[high], "left")), int(np.searchsorted(group, group[low], "right")))
            at, low = order[low:high], high
            data = np.frombuffer(b"".join(t["bytes"].take(pa.array(at)).to_pylist()), np.uint8)
            long, count = size[at] + WINDOW - 1, size[at]
            owner = np.repeat(np.arange(at.size), count)
            step = np.arange(owner.size) - np.repeat(np.cumsum(count) - count, count)
            begin = np.repeat(np.cumsum(long) - long, count) + step
            own = at[owner]
            start = t["a"][own].astype(np.int64) - t["c"][own] + step
            back = (t["a"][own] - start).astype(np.uint64)  # the anchor's place in the window
            h = _mixed(Hashes(data)(begin, begin + WINDOW) ^ t["g"][own] * _MIX1 ^ back * _MIX2)
            doc, row = t["doc"][own], t["row"][own]
            by = np.lexsort((start, row, doc, h))
            same = np.r_[np.zeros(min(1, by.size), bool), h[by][1:] == h[by][:-1]]
            new, again = (np.zeros(by.size, bool) for _ in range(2))
            new[by], again[by] = _split_repeats(same, doc[by], row[by], start[by])
            spans = _joined(doc[again], row[again], start[again], start[again] + WINDOW)
            yield _batch(_SPAN, *spans)
            cross = new & splitters.cut(t["g"][own])
            if cross.any():
                yield _batch(_CROSS, doc[cross], row[cross], start[cross], start[cross] + WINDOW, h[cross])

    return work


def _applied(batch: pa.RecordBatch) -> dict[str, object]:
    total, removed, runs, digest = [], [], [], []
    for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
        total.append(len(text))
        gone, at, kept, count = 0, 0, hashlib.sha256(), 0
        if spans:
            start, end = np.array([x["a"] for x in spans]), np.array([x["b"] for x in spans])
            zero = np.zeros(start.size, np.int64)
            for a, b in zip(*(x.tolist() for x in _joined(zero, zero, start, end)[2:]), strict=True):
                kept.update(text[at:a])
                gone, at, count = gone + b - a, b, count + 1
        kept.update(text[at:])
        removed.append(gone)
        runs.append(count)
        digest.append(kept.hexdigest())
    return {"k": batch.column(0), "n_bytes": total, "n_removed": removed, "n_spans": runs, "kept_sha256": digest, "removed": batch.column(2)}


def repeated_spans(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``(doc, row, text, k)`` of every row, and its removals ``(doc, row, a, b)``, overlaps included.

    A null text counts as empty, a null key as the smallest. Rows with equal keys are told apart
    by ``row``, a checksum of their text, and ordered by it; rows alike in key and text are one
    document, whose result each of them gets.
    """
    rows = df.select(
        F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("doc"),
        F.hash(text).alias("row"),
        F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"),
        F.col(key).alias("k"),
    )
    texts = rows.select("doc", "row", "text")
    spark, count = df.sparkSession, df.count()
    every = max(1, count // SAMPLE_DOCS)
    sample = texts.where(F.pmod(F.xxhash64("doc", "row"), F.lit(every)) == 0)
    pairs = sample.mapInArrow(lambda b: _suffixes(b, None), "g long, s long").toPandas()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(pairs) * every // BUCKET)
    splitters = Splitters(pairs["g"].to_numpy().view(np.uint64), pairs["s"].to_numpy().view(np.uint64), buckets)

    suffixes = texts.mapInArrow(lambda b: _suffixes(b, splitters), f"{_ROWS}, pid int")
    dealt = suffixes.repartitionById(buckets, "pid").select("kind", "g", "s", "doc", "row", "a", "b", "c")
    settled = store(dealt.mapInArrow(_sorted_buckets(splitters), _ROWS), "suffixes")

    wanted = settled.where(F.col("kind") == _NEED).groupBy("doc", "row").agg(
        F.collect_set(F.struct("g", "s", "a", "b", "c")).alias("wanted")
    )
    # All of the row, so that this join and the one that applies the removals share one shuffle of the texts.
    near = rows.join(wanted, ["doc", "row"]).select(*rows.columns, "wanted")
    fetched = near.mapInArrow(_fetched(splitters), f"{_ROWS}, pid int, bytes binary")
    again = fetched.repartitionById(buckets, "pid").mapInArrow(_compared(splitters), _ROWS)
    across = with_group_min(
        again.where(F.col("kind") == _CROSS).withColumn("at", F.struct("doc", "row", "a")), "g", "at", "first", ["doc", "a"]
    ).where("at > first")
    columns = ["doc", "row", "a", "b"]
    spans = settled.where(F.col("kind") == _SPAN).select(columns)
    spans = spans.union(again.where(F.col("kind") == _SPAN).select(columns)).union(across.select(columns))
    return rows, spans


def remove_repeats(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``removed`` of every row.

    ``removed`` lists byte ranges, overlapping ones included, and is null where nothing goes. An
    empty table gives none; see :func:`repeated_spans` for nulls and repeated rows.
    """
    rows, spans = repeated_spans(df, key, text)
    lists = spans.groupBy("doc", "row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    whole = rows.join(lists, ["doc", "row"], "left").select("k", "text", "spans")
    kind = f"k {rows.schema['k'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<a: int, b: int>>"
    return map_batches(whole, _applied, kind).withColumnRenamed("k", key)
