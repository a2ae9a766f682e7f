"""Co-trained quality and toxicity classifiers over two views of a document.

The *text* view is the set of a whole text's words and runs of signs, hashed; the *page* view is
its metadata (language, source, size) and layout (lines, digits, signs, capitals, repeats). Per target each
view has a logistic regression. In each round the views are calibrated on labelled rows
held out from training, score an unlabelled pool, and hand their confident labels to each other. A
view may hand on a class only if its held-out labels at that confidence are right often enough, so a
view that cannot see a target (layout says little about toxicity) teaches nothing wrong. At the end
a regression over both calibrated margins combines the views.

Only fitting uses samples, whose expected sizes are bounded (``LABELLED`` and ``POOL`` rows by a hash of
the key); it is a few vector operations on the driver. All documents are scored, in Spark tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgrid.llm.common import map_batches, uniform
from liftgrid.llm.decontam import words_of

LABELLED, POOL = 12_000, 6_000
ROUNDS = 2
#: Hashed words, and hashed values of each metadata column.
WORDS, VALUES = 1 << 18, 64
#: Training rows that must hold a word for it to count.
LEAST_ROWS = 4
#: Standard errors between its shares of the two labels' rows.
APART = 4.0
#: Probability from which a view hands on a label, and the share that must be right on held-out rows.
CONFIDENT, RIGHT = 0.95, 0.97
#: Held-out labels needed to trust that share.
LEAST_HELD = 30
TARGETS = ("quality", "toxic")

_SIGNS = re.compile(r"[^\w\s]+")
_DIGITS, _CAPITALS = b"0123456789", bytes(range(65, 91))
LAYOUT = 8


@dataclass
class Rows:
    """Views of some documents: hashed words laid end to end, and one row of page features each."""

    words: np.ndarray
    ends: np.ndarray
    page: np.ndarray

    def __len__(self) -> int:
        return self.ends.size

    def take(self, at: np.ndarray) -> Rows:
        size = np.diff(self.ends, prepend=0)[at]
        ends, begin = np.cumsum(size), self.ends[at] - size
        words = np.empty(size.sum(), self.words.dtype)
        for low, high, count in zip(begin.tolist(), ends.tolist(), size.tolist(), strict=True):
            words[high - count : high] = self.words[low : low + count]
        return Rows(words, ends, self.page[at])

    def blocks(self, rows: int = 1_000) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Some rows at a time, so that what is worked out per word stays small: which, their words, where each row's end."""
        for low in range(0, len(self), rows):
            begin = self.ends[low - 1] if low else 0
            ends = self.ends[low : low + rows]
            yield slice(low, low + ends.size), self.words[begin : ends[-1]], ends - begin

    def with_rows(self, other: Rows) -> Rows:
        if not len(other):
            return self
        last = self.ends[-1] if self.ends.size else 0
        return Rows(np.r_[self.words, other.words], np.r_[self.ends, other.ends + last], np.concatenate([self.page, other.page]))


def views(texts: list[str | None], metadata: list[list]) -> Rows:
    """Both views; ``metadata`` has a list of values per column. Null counts as empty."""
    words, ends, page = [], [], np.zeros((len(texts), LAYOUT + VALUES * len(metadata)))
    for k, text in enumerate(texts):
        text = text or ""
        found, signs = words_of(text), _SIGNS.findall(text)
        different = {*found, *(s.encode("utf-8", "surrogatepass") for s in signs)}
        words.append(np.fromiter(map(zlib.crc32, different), np.int64, len(different)) % WORDS)
        ends.append(len(different))
        data = text.encode("utf-8", "surrogatepass")
        size = max(1, len(data))
        page[k, :LAYOUT] = (
            1,
            np.log1p(len(data)) / 10,
            np.log1p(data.count(b"\n")) / 5,
            10 * (len(data) - len(data.translate(None, _DIGITS))) / size,
            4 * sum(map(len, signs)) / size,
            8 * data.count(b"|") / size,
            4 * (len(data) - len(data.translate(None, _CAPITALS))) / size,
            len(different) / max(1, len(found) + len(signs)),
        )
    for c, values in enumerate(metadata):
        at = [zlib.crc32(str(v).encode("utf-8", "surrogatepass")) % VALUES for v in values]
        page[np.arange(len(texts)), LAYOUT + c * VALUES + np.array(at, int)] = 1
    return Rows(np.concatenate(words or [np.zeros(0, np.int64)]), np.cumsum(ends, dtype=np.int64), page)


def _adam(w: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:  # noqa: ANN001
    first, second = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        g = gradient(w)
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        w -= rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return w


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


@dataclass
class View:
    """Weights of one view; the last of the text view is its intercept. A line calibrates the margin."""

    text: bool
    weights: np.ndarray
    line: np.ndarray

    def margin(self, rows: Rows) -> np.ndarray:
        if not self.text:
            return rows.page @ self.weights
        out, before = np.zeros(len(rows)), 0.0
        for some, words, ends in rows.blocks():
            total = np.cumsum(np.r_[before, self.weights[words]])
            out[some], before = total[ends] - total[np.r_[0, ends[:-1]]] + self.weights[-1], total[-1]
        return out

    def logit(self, rows: Rows) -> np.ndarray:
        return self.margin(rows) * self.line[0] + self.line[1]


def _fit_text(rows: Rows, label: np.ndarray, decay: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Logistic regression on the presence of the words that tell the labels apart at all.

    Of many rare words some always seem to; only those count whose shares of the two labels' rows
    differ by ``APART`` standard errors.
    """
    count, good = np.zeros(WORDS, np.int64), np.zeros(WORDS)
    for some, words, ends in rows.blocks():
        count += np.bincount(words, minlength=WORDS)
        good += np.bincount(words, np.repeat(label[some], np.diff(ends, prepend=0)), WORDS)
    sides = np.array([label.sum(), (1 - label).sum()])
    mean = count / len(rows)
    error = np.sqrt(np.maximum(mean * (1 - mean), 1e-12) * (1 / sides).sum())
    apart = np.abs(good / sides[0] - (count - good) / sides[1]) / error
    own = np.full(WORDS, -1)
    used = np.flatnonzero((count >= LEAST_ROWS) & (apart >= APART))
    own[used] = np.arange(used.size)
    parts = [(np.zeros(0, np.int64),) * 2]
    for some, words, ends in rows.blocks():
        row, word = np.repeat(np.arange(some.start, some.stop), np.diff(ends, prepend=0)), own[words]
        parts.append((row[word >= 0], word[word >= 0]))
    row, word = map(np.concatenate, zip(*parts, strict=True))

    def gradient(w: np.ndarray) -> np.ndarray:
        gap = (_chance(np.bincount(row, w[word], len(rows)) + w[-1]) - label) / len(rows)
        return np.r_[np.bincount(word, gap[row], used.size) + decay * w[:-1], gap.sum()]

    fitted = _adam(np.zeros(used.size + 1), gradient, steps, 0.1)
    weights = np.zeros(WORDS + 1)
    weights[used], weights[-1] = fitted[:-1], fitted[-1]
    return weights


def _fit_page(rows: Rows, label: np.ndarray, decay: float = 1e-4, steps: int = 300) -> np.ndarray:
    page = rows.page.astype(np.float64)

    def gradient(w: np.ndarray) -> np.ndarray:
        return page.T @ ((_chance(page @ w) - label) / len(rows)) + decay * w

    return _adam(np.zeros(page.shape[1]), gradient, steps, 0.2)


def _line(margins: np.ndarray, label: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and intercept of a regression of labels on one or two margins, by Newton steps."""
    x = np.column_stack([margins, np.ones(len(label))])
    w, hold = np.zeros(x.shape[1]), np.diag([*[ridge] * (x.shape[1] - 1), 1e-6])
    for _ in range(50):
        p = _chance(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + hold, x.T @ (label - p) - hold @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass
class Target:
    views: tuple[View, View]
    line: np.ndarray

    def chance(self, rows: Rows) -> np.ndarray:
        first, second = (v.logit(rows) for v in self.views)
        return _chance(first * self.line[0] + second * self.line[1] + self.line[2])


def _handed(view: View, held: Rows, label: np.ndarray, pool: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Places in the pool and labels: the confident ones of classes that the view gets right."""
    sure, at, said = np.log(CONFIDENT / (1 - CONFIDENT)), [], []
    tested, scored = view.logit(held), view.logit(pool)
    for value, sign in ((1.0, 1), (0.0, -1)):
        seen = sign * tested >= sure
        if seen.sum() >= LEAST_HELD and (label[seen] == value).mean() >= RIGHT:
            at.append(np.flatnonzero(sign * scored >= sure))
            said.append(np.full(at[-1].size, value))
    return (np.concatenate(at), np.concatenate(said)) if at else (np.zeros(0, int), np.zeros(0))


def fit(rows: Rows, label: np.ndarray, held: np.ndarray, pool: Rows) -> Target | None:
    """Co-train one target; None where the labels of a side are all alike."""
    own, own_label = rows.take(np.flatnonzero(~held)), label[~held]
    test, test_label = rows.take(np.flatnonzero(held)), label[held]
    if any(np.unique(x).size < 2 for x in (own_label, test_label)):
        return None
    extra = [(np.zeros(0, int), np.zeros(0))] * 2
    for last in range(ROUNDS + 1):
        made = []
        for text, (at, said) in zip((True, False), extra, strict=True):
            train_rows, train_label = own.with_rows(pool.take(at)), np.r_[own_label, said]
            view = View(text, (_fit_text if text else _fit_page)(train_rows, train_label), np.array([1.0, 0.0]))
            view.line = _line(view.margin(test)[:, None], test_label)
            made.append(view)
        if last < ROUNDS:
            extra = [_handed(made[1], test, test_label, pool), _handed(made[0], test, test_label, pool)]
    both = np.column_stack([v.logit(test) for v in made])
    return Target((made[0], made[1]), _line(both, test_label))


def _sampled(docs: DataFrame, text: str, metadata: list[str], labels: list[str]) -> tuple[Rows, np.ndarray]:
    """Views of a bounded table, made in tasks and collected, and its label columns."""

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        rows = views(batch.column(0).to_pylist(), [batch.column(1 + k).to_pylist() for k in range(len(metadata))])
        words = pa.ListArray.from_arrays(pa.array(np.r_[0, rows.ends], pa.int32()), pa.array(rows.words.astype(np.int32)))
        page = pa.array(list(rows.page.astype(np.float32)), pa.list_(pa.float32()))
        return {"words": words, "page": page} | {c: batch.column(1 + len(metadata) + k) for k, c in enumerate(labels)}

    named = [F.col(text), *[F.col(m).cast("string") for m in metadata], *[F.col(c).cast("double") for c in labels]]
    wide = docs.select(*[c.alias(f"c{k}") for k, c in enumerate(named)])
    schema = "words array<int>, page array<float>" + "".join(f", {c} double" for c in labels)
    got = map_batches(wide, work, schema).toArrow()
    words = np.concatenate([np.zeros(0, np.int32), *(c.flatten().to_numpy() for c in got["words"].chunks)])
    ends = np.cumsum(pc.list_value_length(got["words"]).to_numpy(), dtype=np.int64)
    page = np.concatenate([np.zeros(0, np.float32), *(c.flatten().to_numpy() for c in got["page"].chunks)])
    rows = Rows(words, ends, page.reshape(got.num_rows, LAYOUT + VALUES * len(metadata)))
    return rows, np.column_stack([got[c].to_numpy() for c in labels]) if labels else np.zeros((got.num_rows, 0))


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, metadata: list[str]) -> dict[str, Target | None]:
    """A model per target from the labelled rows, or a sample of about ``LABELLED`` of them.

    Rows without a key, and keys labelled more than once, are not learned from. Nor is a null label.
    """
    docs = docs.select(key, text, *metadata)
    once = labels.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("_times"), *[F.first(t).alias(t) for t in TARGETS]
    ).where("_times = 1").drop("_times")
    share = LABELLED / max(1, once.count())
    picked = once.where(uniform(9, key) < share).select(F.col(key).alias("_key"), *[F.col(t).alias(f"_{t}") for t in TARGETS])
    chosen = docs.join(F.broadcast(picked), docs[key] == F.col("_key")).withColumn("_fold", F.pmod(F.xxhash64(F.lit(10), key), F.lit(4)))
    rows, values = _sampled(chosen, text, metadata, [*(f"_{t}" for t in TARGETS), "_fold"])
    share = POOL / max(1, docs.count())
    known = once.select(F.col(key).alias("_key")).where(uniform(11, "_key") < share)
    rest = docs.where(uniform(11, key) < share).join(known, docs[key] == F.col("_key"), "left_anti")
    pool, _ = _sampled(rest, text, metadata, [])
    pa.default_memory_pool().release_unused()
    out = {}
    for k, target in enumerate(TARGETS):
        seen = np.flatnonzero(~np.isnan(values[:, k]))
        out[target] = fit(rows.take(seen), values[seen, k], values[seen, -1] == 0, pool)
    return out


def judge(docs: DataFrame, models: dict[str, Target | None], text: str, metadata: list[str]) -> DataFrame:
    """``docs`` plus ``p_quality``, ``p_toxic`` and ``keep``, which replace columns of these names.

    A target without a model counts as fine. An empty or null text is judged like any other, by
    its metadata; nulls in metadata are a value of their own.
    """
    kept = docs.drop("p_quality", "p_toxic", "keep")
    at, extra = kept.columns.index(text), [kept.columns.index(m) for m in metadata]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [batch.column(k).cast(pa.string()).to_pylist() for k in extra]
            rows = views(batch.column(at).to_pylist(), values)
            good, toxic = (models[t].chance(rows) if models[t] else np.full(len(rows), float(t == "quality")) for t in TARGETS)
            out = batch
            for name, column in (("p_quality", good), ("p_toxic", toxic), ("keep", (good >= 0.5) & (toxic < 0.5))):
                out = out.append_column(name, pa.array(column))
            yield out

    schema = kept.withColumns({"p_quality": F.lit(0.5), "p_toxic": F.lit(0.5), "keep": F.lit(True)}).schema
    return kept.mapInArrow(work, schema)
