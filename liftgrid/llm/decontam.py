"""Benchmark decontamination by latent semantic retrieval.

Terms are the benchmark's words; other words of a document only take up room between them. All
documents are cut into passages, whose document frequencies weigh the terms. A randomised
decomposition of the passages' TF-IDF matrix A gives the latent space: each task multiplies its rows
of A by a random matrix and back (its part of A'A Omega, terms x ``RANK``), Spark adds the parts, and the
driver finishes on that bounded matrix. Its eigenvectors fold items and passages into one space.

Search. Windows of an item's size slide over whole documents. A window whose terms weigh too little to
hold the wanted share of any item is left out, which loses nothing; the others are compared with all items by
latent cosine. What surrounds a copy in its window can outweigh it in the latent space, so windows whose words can make a
copy are candidates whatever their cosine. Candidates are then verified on the words: the longest common subsequence, weighted by
term, and the same for the item's *answer*, its last sentence. Copies pass by the first alone,
paraphrases need both.

Items are taken in blocks with a pass each, so what is sent to tasks is bounded: of ``BLOCK_ITEMS`` items and ``TERMS``
words at most (an item of more words is a block). Every word of a block has a number of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgrid.llm.common import map_batches, store

BLOCK_ITEMS = 20_000
#: Largest number of terms of a block, number 0 (no term) included.
TERMS = 1 << 15
#: Words of a passage, and between windows.
PASSAGE, STRIDE = 32, 8
#: Words that are searched at once.
SEARCH_WORDS = 400_000
#: Latent dimensions, and random ones that make them accurate.
LATENT, RANK = 24, 32
#: Latent cosine of a candidate; share of an item that makes a copy; share of item and answer of a paraphrase.
COSINE, COPY, PARAPHRASE, ANSWER = 0.4, 0.8, 0.6, 0.6
#: Share of an item, in its heaviest terms, that is counted in all windows to find those that can hold a copy.
HEAVY = 0.5

_SPLIT = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()), b" " * 66)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words: runs of ASCII letters and digits and of any other characters."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split()


def answer_words(text: str) -> int:
    """Words of the last sentence; a quarter of the text, three at least, where that is shorter."""
    total = len(words_of(text))
    last = [s for s in re.split(r"[.!?\n]+", text) if words_of(s)]
    return min(total, max(len(words_of(last[-1])) if last else 0, 3, total // 4))


def common_weight(item: np.ndarray, region: np.ndarray, weight: np.ndarray) -> float:
    """Largest weight of a common subsequence; ``weight`` is that of the item's words."""
    row = np.zeros(region.size + 1)
    for term, w in zip(item, weight, strict=True):
        if w > 0:
            take = np.where(region == term, row[:-1] + w, 0)
            np.maximum(row[1:], take, out=row[1:])
            np.maximum.accumulate(row, out=row)
    return float(row[-1])


def by_vocabulary(rows: Iterable[tuple[int | None, str | None]]) -> Iterator[list[tuple[int | None, str | None]]]:
    """Consecutive items whose words, together, have numbers below ``TERMS``; at least one list, each of an item or more."""
    part: list[tuple[int | None, str | None]] = []
    seen: set[bytes] = set()
    for row in rows:
        words = set(words_of(row[1]))
        if part and len(seen | words) >= TERMS:
            yield part
            part, seen = [], set()
        part.append(row)
        seen |= words
    yield part


class Items:
    """The items of a block: term numbers, and after :meth:`weigh` what the search compares."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        kept = [(k, t) for k, t in rows if words_of(t)]
        self.keys = [k for k, _ in kept]
        words = [words_of(t) for _, t in kept]
        terms = sorted({w for found in words for w in found})
        self.terms = {w: k + 1 for k, w in enumerate(terms)}
        self.size = len(terms) + 1
        self.items = [np.array([self.terms[w] for w in found], np.int32) for found in words]
        self.answers = [answer_words(t) for _, t in kept]

    def weigh(self, idf: np.ndarray, basis: np.ndarray) -> None:
        self.fold = (idf[:, None] * basis).astype(np.float32)
        self.weight = idf**2  # a term weighs as in the product of two TF-IDF rows
        self.mass = np.array([self.weight[i].sum() for i in self.items])
        query = np.stack([self.fold[i].sum(axis=0) for i in self.items]) if self.items else np.zeros((0, basis.shape[1]))
        self.query = query / np.maximum(np.linalg.norm(query, axis=1, keepdims=True), 1e-12)
        blocks = np.array([-(-i.size // STRIDE) for i in self.items], int)
        self.classes = [self._class(int(n), np.flatnonzero((blocks == n) & (self.mass > 0))) for n in np.unique(blocks)]

    def _class(self, size: int, members: np.ndarray) -> tuple:
        """Items of one size: their terms, padded with the term that weighs nothing, weights, and :meth:`_heavy`."""
        terms = np.zeros((members.size, size * STRIDE), np.int32)
        for row, m in enumerate(members):
            terms[row, : self.items[m].size] = self.items[m]
        return size, members, terms, self.weight[terms].astype(np.float32), self._heavy(members)

    def _heavy(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Members by heavy term (first place of each term, members, weights), and the weight that a window with a
        copy has of each member's: at most ``1 - COPY`` of an item is missing, wherever that is."""
        found = []
        for row, m in enumerate(members):
            term, count = np.unique(self.items[m], return_counts=True)
            order = np.argsort(-self.weight[term], kind="stable")
            weight = (self.weight[term] * count)[order]
            taken = min(order.size, int(np.searchsorted(np.cumsum(weight), HEAVY * self.mass[m])) + 1)
            found.append((term[order[:taken]], np.full(taken, row), weight[:taken]))
        if not found:
            return np.zeros(self.weight.size + 1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        need = np.array([f[2].sum() for f in found]) - (1 - COPY) * self.mass[members]
        term, row, weight = map(np.concatenate, zip(*found, strict=True))
        order = np.argsort(term, kind="stable")
        return np.searchsorted(term[order], np.arange(self.weight.size + 1)), row[order], weight[order], need

    def _copies(self, ids: np.ndarray, start: np.ndarray, stop: np.ndarray, a: np.ndarray, b: np.ndarray, heavy: tuple) -> np.ndarray:
        """Whether each window of blocks ``a`` to ``b`` has enough heavy terms for a copy of each member; repeats
        in a window count again, so none is missed."""
        place, row, weight, need = heavy
        edges = np.zeros(b.max() - a[0] + 1, np.int64)
        np.add.at(edges, a - a[0], 1)
        np.add.at(edges, b - a[0], -1)
        used = np.cumsum(edges[:-1]) > 0
        number = np.r_[0, np.cumsum(used)]
        blocks = a[0] + np.flatnonzero(used)
        words = stop[blocks] - start[blocks]
        inside = np.arange(words.sum()) - np.repeat(np.cumsum(words) - words, words)
        term = ids[np.repeat(start[blocks], words) + inside]
        times = place[term + 1] - place[term]
        at = np.repeat(place[term] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        cell = np.repeat(np.repeat(np.arange(1, blocks.size + 1), words), times) * need.size + row[at]
        total = np.bincount(cell, weight[at], (blocks.size + 1) * need.size).reshape(-1, need.size)
        np.cumsum(total, axis=0, out=total)
        return total[number[b - a[0]]] - total[number[a - a[0]]] >= need * (1 - 1e-5)

    def search(self, ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, float, float, float, int]]:
        """``(document, item, cosine, share, answer share, first word)`` of each item found in
        documents laid end to end."""
        size_of = np.diff(np.r_[0, ends])
        count = -(-size_of // STRIDE)
        doc = np.repeat(np.arange(ends.size), count)
        if not doc.size:
            return []
        last = np.cumsum(count)[doc]  # blocks of STRIDE words, numbered over all documents
        number = np.arange(doc.size) - (last - count[doc])
        start = (ends - size_of)[doc] + number * STRIDE
        stop = np.minimum(start + STRIDE, ends[doc])
        total = np.r_[0.0, np.cumsum(np.add.reduceat(self.weight[ids], start))]
        plans, edges = [], np.zeros(doc.size + 1, np.int64)
        for size, members, terms, weights, heavy in self.classes:
            if not members.size:
                continue
            least = PARAPHRASE * self.mass[members]
            low = np.flatnonzero(number < np.maximum(1, count[doc] - size))
            high = np.minimum(low + size + 1, last[low])  # one block more, as items start anywhere
            mass = total[high] - total[low]
            dense = mass >= least.min()
            if dense.any():
                plans.append((members, terms, weights, heavy, least, low[dense], high[dense], mass[dense]))
                np.add.at(edges, low[dense], 1)
                np.add.at(edges, high[dense], -1)
        if not plans:
            return []
        # Only blocks of windows that are still in are folded; the others count as zero.
        folded = np.zeros((doc.size + 1, self.fold.shape[1]))
        needed = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
        words = stop[needed] - start[needed]
        first = np.cumsum(words) - words
        inside = np.arange(words.sum()) - np.repeat(first, words)
        folded[needed + 1] = np.add.reduceat(self.fold[ids[np.repeat(start[needed], words) + inside]], first, axis=0)
        np.cumsum(folded, axis=0, out=folded)
        near: dict[tuple[int, int], list] = {}
        for members, terms, weights, heavy, least, low, high, mass in plans:
            step = max(16, (1 << 23) // self.weight.size)
            for k in range(0, low.size, step):
                a, b = low[k : k + step], high[k : k + step]
                latent = folded[b] - folded[a]
                latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
                cosine = latent @ self.query[members].T
                copies = self._copies(ids, start, stop, a, b, heavy)
                w, m = np.nonzero(((cosine >= COSINE) | copies) & (mass[k : k + step, None] >= least))
                if not w.size:
                    continue
                # The words must be there, in whatever order, for a subsequence of them to be.
                some, w_at = np.unique(w, return_inverse=True)
                first = start[a[some]]
                words = stop[b[some] - 1] - first
                inside = np.arange(words.sum()) - np.repeat(np.cumsum(words) - words, words)
                present = np.zeros((some.size, self.weight.size), bool)
                present[np.repeat(np.arange(some.size), words), ids[np.repeat(first, words) + inside]] = True
                for j in range(0, w.size, 1 << 15):
                    v, n = w_at[j : j + (1 << 15)], m[j : j + (1 << 15)]
                    wanted = np.where(cosine[w[j : j + (1 << 15)], n] >= COSINE, 1, COPY / PARAPHRASE) * least[n]
                    there = np.einsum("ij,ij->i", present[v[:, None], terms[n]], weights[n]) >= wanted * (1 - 1e-5)
                    for at, n_ in zip((w[j : j + (1 << 15)])[there], n[there], strict=True):
                        place = (int(start[a[at]]), int(stop[b[at] - 1]), float(cosine[at, n_]))
                        near.setdefault((int(doc[a[at]]), int(members[n_])), []).append(place)
        found = []
        for (where, item), windows in sorted(near.items()):
            best = None
            region: list = []
            for a, b, c in windows:  # windows that touch are verified as one
                if region and a <= region[1]:
                    region[1:] = [b, max(region[2], c)]
                    continue
                best = self._better(best, item, ids, region)
                region = [a, b, c]
            best = self._better(best, item, ids, region)
            if best is not None:
                found.append((where, *best[:4], best[4] - int(ends[where] - size_of[where])))
        return found

    def _better(self, best: tuple | None, item: int, ids: np.ndarray, region: list) -> tuple | None:
        if not region:
            return best
        terms, here = self.items[item], ids[region[0] : region[1]]
        weight = self.weight[terms]
        share = common_weight(terms, here, weight) / self.mass[item]
        if share < PARAPHRASE or (best is not None and best[2] >= share):
            return best
        last = self.answers[item]
        whole = weight[-last:].sum()
        answer = common_weight(terms[-last:], here, weight[-last:]) / whole if whole > 0 else share
        if share >= COPY or answer >= ANSWER:
            return item, region[2], share, answer, region[0]
        return best


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers of all documents of a batch, and the passage of each."""
    lists = batch.column(0)
    size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    ids = lists.flatten().to_numpy()
    inside = np.arange(ids.size) - np.repeat(np.cumsum(size) - size, size)
    counts = -(-size // PASSAGE)
    return ids, inside // PASSAGE + np.repeat(np.cumsum(counts) - counts, size)


def numbered(docs: DataFrame, key: str, text: str, items: Items) -> DataFrame:
    """``k`` and the term number of each word (0: no term) of every document."""
    terms = items.terms

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        parts = []
        for t in batch.column(1):  # words of one document at a time are held
            found = words_of(t.as_py())
            parts.append(np.fromiter(map(terms.get, found, repeat(0)), np.int32, len(found)))
        size = np.cumsum([0, *(p.size for p in parts)])
        flat = np.concatenate(parts)
        return {"k": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(flat))}

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return map_batches(rows, work, f"k {rows.schema['k'].dataType.simpleString()}, ids array<int>")


def inverse_frequency(ids: DataFrame, size: int) -> np.ndarray:
    """log((passages + 1) / (passages with the term + 1)) of each term, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            terms, passage = _flat(batch)
            if terms.size:
                seen[0] += passage[-1] + 1
                used = terms > 0
                once = np.sort(passage[used] * size + terms[used])
                once = once[np.r_[True, once[1:] != once[:-1]][: once.size]]
                seen += np.bincount(once % size, minlength=size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"term": at.astype(np.int32), "n": seen[at]})

    total = np.zeros(size)
    for row in ids.select("ids").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        total[row["term"]] = row["n"]
    idf = np.log((total[0] + 1) / (total + 1))
    idf[0] = 0
    return np.maximum(idf, 0)


def latent_basis(ids: DataFrame, idf: np.ndarray) -> np.ndarray:
    """The leading right singular vectors of all passages' TF-IDF rows, by one randomised pass."""
    omega = np.random.default_rng(7).standard_normal((idf.size, RANK))
    spread = (idf[:, None] * omega).astype(np.float32)
    columns = [f"z{k}" for k in range(RANK)]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((idf.size, RANK))
        for batch in batches:
            terms, passage = _flat(batch)
            used = terms > 0
            terms, passage = terms[used], passage[used]
            for a in range(0, terms.size, 1 << 18):
                b = min(terms.size, a + (1 << 18))  # a passage cut here counts as two
                t, p = terms[a:b], passage[a:b]
                at = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                rows = np.add.reduceat(spread[t], at, axis=0)
                order = np.argsort(t.astype(np.uint16) if idf.size <= 1 << 16 else t, kind="stable")  # 16 bits are sorted by digits
                place = (np.cumsum(np.r_[True, p[1:] != p[:-1]]) - 1)[order]
                first = np.flatnonzero(np.r_[True, np.diff(t[order]) != 0])
                out[t[order][first]] += np.add.reduceat(rows[place], first, axis=0)
        at = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_pydict({"term": at.astype(np.int32)} | {c: np.round(out[at, k], 3) for k, c in enumerate(columns)})

    parts = ids.select("ids").mapInArrow(multiply, "term int, " + ", ".join(f"{c} double" for c in columns))
    z = np.zeros((idf.size, RANK))
    for row in parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in columns]).collect():
        z[row["term"]] = row[1:]
    z *= idf[:, None]
    core = omega.T @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > values.max(initial=0) * 1e-9
    if not keep.any():
        return np.zeros((idf.size, LATENT))
    left, _, _ = np.linalg.svd(z @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    return left[:, :LATENT]


def find_leaks(docs: DataFrame, key: str, text: str, benchmark: DataFrame, item: str, item_text: str) -> DataFrame:
    """``key``, ``item``, ``cosine``, ``share``, ``answer`` and ``word`` (where) of each item in each document.

    Null and empty texts and items without words give nothing, nor does an empty table. Repeated rows
    and null keys stay rows of their own; an item that stands in a document repeatedly is given
    once, where its share is largest.
    """
    blocks = max(1, -(-benchmark.count() // BLOCK_ITEMS))
    out = None
    doc_kind = docs.schema[key].dataType.simpleString()
    item_kind = benchmark.schema[item].dataType.simpleString()
    schema = f"k {doc_kind}, i {item_kind}, cosine double, share double, answer double, word long"
    of_block = F.pmod(F.xxhash64(item, item_text), F.lit(blocks))
    hashed = (benchmark.where(of_block == b).select(item, item_text).orderBy(item, item_text) for b in range(blocks))
    for rows in (part for block in hashed for part in by_vocabulary(tuple(r) for r in block.collect())):
        items = Items(rows)
        ids = store(numbered(docs, key, text, items), "terms")
        idf = inverse_frequency(ids, items.size)
        items.weigh(idf, latent_basis(ids, idf))

        def work(batch: pa.RecordBatch, items: Items = items) -> dict[str, object] | None:
            lists, found = batch.column(1), []
            offsets, flat, low = lists.offsets.to_numpy(), lists.values.to_numpy(), 0
            while low < batch.num_rows:  # some documents at once, a longer one alone
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SEARCH_WORDS, "right")) - 1)
                ends = (offsets[low + 1 : high + 1] - offsets[low]).astype(np.int64)
                found += [(low + f[0], *f[1:]) for f in items.search(flat[offsets[low] : offsets[high]], ends)]
                low = high
            if not found:
                return None
            who, at, cosine, share, answer, word = zip(*found, strict=True)
            keys = pa.array([items.keys[k] for k in at])
            return {"k": batch.column(0).take(pa.array(who)), "i": keys, "cosine": cosine, "share": share, "answer": answer, "word": word}

        part = map_batches(ids, work, schema)
        out = part if out is None else out.union(part)
    return out.withColumnsRenamed({"k": key, "i": item})
