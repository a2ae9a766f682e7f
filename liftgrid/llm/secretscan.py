"""Secret scanning: fixed patterns, and a linear-chain conditional random field for the rest.

The field tags the tokens of a line as begin (B), inside (I) or outside (O) of a secret. Its features
are the token's shape (length, character classes, their changes, hexadecimal), the token's word
and the neighbouring words, hashed, and features of the file. It is trained on the driver on a
bounded sample: windows around what the patterns find in ``train_docs`` documents, and windows of
as many other documents. In training the words are hidden at random, so that a secret
is also known by its shape where no keyword stands before it, which the patterns cannot do.

Whole texts are scanned. Tokens, features and scores are vectors over a chunk of many lines. A line
whose scores cannot pay for leaving O anywhere needs no decoding, the others are decoded by Viterbi
side by side.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftgrid.llm.common import map_batches, uniform

# The base patterns, the lengths they need, and the order of kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "crf")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32

#: Code points in a chunk; a longer line is a chunk of its own.
CHUNK = 1_000_000
#: Natural-log score by which a tagged span must beat the same tokens tagged O.
MARGIN = 3.0
WORDS = 4096
O, B, I = 0, 1, 2

_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_CHARS)  # a run is matched whole, so short ones can be skipped
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xFF51AFD7ED558CCD)

_SPACE, _LINE, _DIGIT, _LOWER, _UPPER, _SIGN, _PUNCT, _OTHER = range(8)
_CLASS = np.full(129, _PUNCT, np.uint8)
_CLASS[[*range(9, 14), *range(28, 33)]] = _SPACE
_CLASS[10] = _LINE
_CLASS[48:58], _CLASS[97:123], _CLASS[65:91], _CLASS[128] = _DIGIT, _LOWER, _UPPER, _OTHER
_CLASS[[ord(c) for c in "+/_-."]] = _SIGN

SIZES = (12, 32, 36, 144, 24, WORDS, WORDS, WORDS, WORDS, 6, 5, 32)
#: The features that training hides at random: the words.
HIDDEN = (5, 6, 7, 8)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the patterns' matches, by start, then kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, _BASE)
    down = np.full(size, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _bucket(value: np.ndarray, most: int) -> np.ndarray:
    return np.minimum(value, most - 1).astype(np.int64)


@dataclass
class Tokens:
    """Tokens of a chunk: their code point range, their line, and a feature number of each family."""

    start: np.ndarray
    end: np.ndarray
    line: np.ndarray
    features: np.ndarray


def file_features(text: str) -> tuple[int, int]:
    """Buckets of a document's size and of how many of its characters are ``= : { }``."""
    marks = sum(text.count(c) for c in "=:{}")
    return min(5, len(text).bit_length() // 4), min(4, (1000 * marks // max(1, len(text))).bit_length())


def tokenize(codes: np.ndarray, file: np.ndarray) -> Tokens:
    """``file`` holds the document's two buckets for each code point's line, by code point run."""
    kind = _CLASS[np.minimum(codes, 128)]
    word = (kind == _DIGIT) | (kind == _LOWER) | (kind == _UPPER) | (kind == _SIGN) | (kind == _OTHER)
    punct = kind == _PUNCT
    before = np.r_[False, word[:-1]]
    after = np.r_[word[1:], False]
    start = np.flatnonzero((word & ~before) | punct)
    end = np.flatnonzero((word & ~after) | punct) + 1
    line = np.cumsum(kind == _LINE)[start] if start.size else start

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(mask, dtype=np.int32)]
        return total[end] - total[start]

    size = (end - start).astype(np.int64)
    digits, lower, upper, sign = (count(kind == k) for k in (_DIGIT, _LOWER, _UPPER, _SIGN))
    turns = count(np.r_[False, kind[1:] != kind[:-1]] & word & before)
    hexes = count((kind == _DIGIT) | ((codes >= 97) & (codes < 103)))
    small = np.where(kind == _UPPER, codes + 32, codes).astype(np.uint64)
    full = 1 << max(20, int(codes.size - 1).bit_length())
    up, down = (p[: codes.size] for p in _powers(full))
    total = np.r_[np.uint64(0), np.cumsum(small * up, dtype=np.uint64)]
    mixed = (total[end] - total[start]) * down[start] * _MIX
    own = (mixed >> np.uint64(40)).astype(np.int64) % (WORDS - 1) + 1

    def near(step: int) -> np.ndarray:
        """The word ``step`` tokens on in the same line, else 0."""
        out = np.zeros(own.size, np.int64)
        if own.size > abs(step):
            a, b = (slice(None, -step), slice(step, None)) if step > 0 else (slice(-step, None), slice(None, step))
            out[a] = np.where(line[a] == line[b], own[b], 0)
        return out

    length = _bucket(np.log2(size + 1) * 2, 12)
    mask = (digits > 0) + 2 * (lower > 0) + 4 * (upper > 0) + 8 * (sign > 0) + 16 * (size > digits + lower + upper + sign)
    share = _bucket(digits * 6 // np.maximum(size, 1), 6) * 6 + _bucket(upper * 6 // np.maximum(size, 1), 6)
    change = _bucket(turns * 12 // np.maximum(size, 1), 12) * 12 + length
    pure = np.where(hexes == size, length, 12 + length)
    coarse = _bucket(size // 10, 4) * 8 + 4 * (digits > 1) + 2 * (turns > 3) + (lower * upper > 0)
    features = np.stack([length, mask, share, change, pure, own, near(-1), near(-2), near(1), file[0][start], file[1][start], coarse])
    return Tokens(start, end, line, features.astype(np.int32))


@dataclass
class Model:
    """Weights per family, feature and tag, and per transition; O to I is forbidden."""

    weights: list[np.ndarray]
    moves: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((features.shape[1], 3), np.float32)
        for table, index in zip(self.weights, features, strict=True):
            out += table[index]
        return out


def _padded(rows: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = np.minimum(begin[:, None] + np.arange(size.max()), begin[:, None] + size[:, None] - 1)
    return rows[at]


def train(windows: list[tuple[np.ndarray, np.ndarray]], rounds: int = 120, rate: float = 0.15, hide: float = 0.5, decay: float = 1e-3, seed: int = 8) -> Model:
    """Maximise the conditional likelihood of ``(features, tags)`` windows by Adam."""
    model = Model([np.zeros((n, 3)) for n in SIZES], np.array([[0.0, -1.0, -1e9], [0.0, -1.0, 0.0], [0.0, -1.0, 0.0]]))
    if not windows:
        return Model([w.astype(np.float32) for w in model.weights], model.moves)
    rng = np.random.default_rng(seed)
    windows = sorted(windows, key=lambda w: w[1].size)
    groups = []
    for k in range(0, len(windows), 256):
        part = windows[k : k + 256]
        size = np.array([t.size for _, t in part])
        long = size.max()
        features = np.stack([np.pad(f, ((0, 0), (0, long - f.shape[1]))) for f, _ in part])
        tags = np.stack([np.pad(t, (0, long - t.size)) for _, t in part])
        groups.append((features, tags, np.arange(long) < size[:, None]))
    params = [*model.weights, model.moves]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    allowed = model.moves > -1e8
    count = len(windows)
    for step in range(1, rounds + 1):
        grads = [np.zeros_like(p) for p in params]
        for features, tags, live in groups:
            features = features.copy()
            for f in HIDDEN:
                features[:, f][rng.random(tags.shape) < hide] = 0
            emit = sum(model.weights[f][features[:, f]] for f in range(len(SIZES)))
            gap, moves = _gradient(emit, tags, live, model.moves)
            for f in range(len(SIZES)):
                for t in range(3):
                    grads[f][:, t] += np.bincount(features[:, f].ravel(), (gap[..., t] * live).ravel(), SIZES[f])
            grads[-1] += moves
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            g = g / count - decay * np.where(np.abs(p) < 1e8, p, 0)
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            change = rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
            p += np.where(allowed, change, 0) if p is model.moves else change
    return Model([w.astype(np.float32) for w in model.weights], model.moves)


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _gradient(emit: np.ndarray, tags: np.ndarray, live: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Observed minus expected counts of tags and transitions, by forward and backward sums."""
    n, long, _ = emit.shape
    ahead = np.empty_like(emit)
    ahead[:, 0] = emit[:, 0] + moves[O]
    for k in range(1, long):
        ahead[:, k] = np.where(live[:, k, None], emit[:, k] + _sum(ahead[:, k - 1, :, None] + moves, 1), ahead[:, k - 1])
    whole = _sum(ahead[:, -1], 1)
    behind = np.zeros_like(emit)
    for k in range(long - 2, -1, -1):
        behind[:, k] = np.where(live[:, k + 1, None], _sum(moves + (emit[:, k + 1] + behind[:, k + 1])[:, None, :], 2), 0)
    gap = np.eye(3)[tags] - np.exp(ahead + behind - whole[:, None, None])
    both = live[:, 1:]
    pair = ahead[:, :-1, :, None] + moves + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None]
    expected = (np.exp(np.minimum(pair, 0)) * both[..., None, None]).sum((0, 1))
    seen = np.zeros((3, 3))
    np.add.at(seen, (tags[:, :-1][both], tags[:, 1:][both]), 1)
    np.add.at(seen, (O, tags[:, 0]), 1)
    expected[O] += np.exp(ahead[:, 0] + behind[:, 0] - whole[:, None]).sum(0)
    return gap, seen - expected


def decode(scores: np.ndarray, line: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of each line by Viterbi; lines that cannot leave O are not walked."""
    tags = np.zeros(line.size, np.int8)
    if not line.size:
        return tags
    begin = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    size = np.diff(np.r_[begin, line.size])
    exit_ = max(0.0, max(moves[B, O], moves[I, O]) - moves[O, O])
    enter = scores[:, B] - scores[:, O] + moves[:, B].max() - moves[O, O] + exit_
    stay = np.maximum(scores[:, I] - scores[:, O] + max(moves[B, I], moves[I, I]) - moves[O, O], enter)
    hope = np.maximum.reduceat(enter, begin) + np.add.reduceat(np.maximum(stay, 0), begin)
    rows = np.flatnonzero(hope > 0)
    rows = rows[np.argsort(-size[rows], kind="stable")]
    for part in np.array_split(rows, max(1, rows.size // 4096)):
        if not part.size:
            continue
        long, at, first = size[part], begin[part], 0
        best = scores[at] + moves[O]
        back = np.zeros((int(long[0]), part.size, 3), np.int8)
        for k in range(1, int(long[0])):
            live = int(np.searchsorted(-long, -k, side="left"))
            step = best[:live, :, None] + moves
            back[k, :live] = step.argmax(1)
            best[:live] = step.max(1) + scores[at[:live] + k]
        tag = best.argmax(1)
        for k in range(int(long[0]) - 1, first - 1, -1):
            live = int(np.searchsorted(-long, -k, side="left"))
            tags[at[:live] + k] = tag[:live]
            tag[:live] = back[k, np.arange(live), tag[:live]]
    return tags


def _chunks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of whole lines of many texts, their file buckets, and per run: text and shift."""
    parts, who, shift, total = [], [], [], 0

    def chunk() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = [len(p) for p in parts]
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
        file = np.repeat(np.array([buckets[w] for w in who]), sizes, axis=0).T
        run = np.repeat(np.arange(len(who)), sizes)
        return codes, file, np.array(who)[run], (np.array(shift) - (np.cumsum(sizes) - sizes))[run]

    buckets = [file_features(t) for t in texts]
    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            to = len(text)
            if total + to - at > CHUNK:
                cut = text.rfind("\n", at, at + max(0, CHUNK - total)) + 1
                if not cut and parts:
                    yield chunk()
                    parts, who, shift, total = [], [], [], 0
                    continue
                to = cut or (text.find("\n", at) + 1 or len(text))
            parts.append(text[at:to] + ("" if text[to - 1] == "\n" else "\n"))
            who.append(k)
            shift.append(at)
            total += len(parts[-1])
            at = to
            if total >= CHUNK:
                yield chunk()
                parts, who, shift, total = [], [], [], 0
    if parts:
        yield chunk()


def field_spans(texts: list[str], model: Model) -> list[list[tuple[int, int]]]:
    """The spans that the field tags in each text, by start."""
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    for codes, file, who, shift in _chunks(texts):
        tokens = tokenize(codes, file)
        scores = model.scores(tokens.features)
        tags = decode(scores, tokens.line, model.moves)
        gain = scores[np.arange(tags.size), tags] - scores[:, O]
        opens = np.flatnonzero(tags == B)
        if not opens.size:
            continue
        inside = np.r_[tags[1:] == I, False]
        closes = np.flatnonzero((tags != O) & ~inside)
        total = np.r_[0.0, np.cumsum(gain, dtype=np.float64)]
        for a, b in zip(opens, closes, strict=True):
            if total[b + 1] - total[a] >= MARGIN:
                start, end = int(tokens.start[a]), int(tokens.end[b])
                found[who[start]].append((start + int(shift[start]), end + int(shift[start])))
    return found


def all_spans(texts: list[str], model: Model) -> list[list[tuple[int, int, str]]]:
    """Base spans, and those of the field that touch none of them."""
    out = []
    for text, extra in zip(texts, field_spans(texts, model), strict=True):
        base = base_spans(text)
        covered = sorted(base)
        reach = np.maximum.accumulate([e for _, e, _ in covered]).tolist() if covered else []
        for a, b in extra:
            k = bisect.bisect_left(covered, (b,))
            if k == 0 or reach[k - 1] <= a:
                base.append((a, b, "crf"))
        out.append(sorted(base, key=lambda s: (s[0], KINDS.index(s[2]))))
    return out


def training_windows(texts: list[str], around: int = 24) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tagged windows: around the patterns' secrets, and, where a text has none, from its middle."""
    out = []
    for text in texts:
        spans = [(m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
        spans += [(a, b) for a, b, k in base_spans(text) if k != "assign"]
        for codes, file, _, shift in _chunks([text]):
            tokens = tokenize(codes, file)
            if not tokens.start.size:
                continue
            tags = np.zeros(tokens.start.size, np.int64)
            start, end = tokens.start + shift[tokens.start], tokens.end + shift[tokens.start]
            places = []
            for a, b in sorted(spans):
                inside = np.flatnonzero((start < b) & (end > a))
                if inside.size and not tags[inside].any():
                    tags[inside], tags[inside[0]] = I, B
                    places.append((int(inside[0]), int(inside[-1]) + 1))
            places = places or [(tags.size // 2, tags.size // 2 + 2 * around)]
            for a, b in places[:20]:
                low, high = max(0, a - around), min(tags.size, b + around)
                for line in np.unique(tokens.line[low:high]):
                    pick = low + np.flatnonzero(tokens.line[low:high] == line)
                    out.append((tokens.features[:, pick], tags[pick]))
    return out


def fit(df: DataFrame, key: str, text: str, train_docs: int = 400) -> Model:
    """Train on about ``train_docs`` documents, drawn by hash, that hold a base span, and on as many
    of the others. Without any span the model tags nothing. Windows are trained on, not
    whole texts, and the sample's texts of over 100,000 characters are passed over.
    """
    hit = F.col(text).rlike(f"(?i:{ASSIGN})|{ACCESS}|[0-9a-f]{{{HEX_CHARS},}}")
    draw = uniform(8, key, text)
    sizes = {r["hit"]: r["count"] for r in df.groupBy(hit.alias("hit")).count().collect()}

    def sample(which: Column, count: int) -> list[str]:
        share = train_docs / max(1, count)
        picked = df.where(draw < share).where(which).where(F.length(text) <= 100_000)
        return [r[0] for r in picked.select(text).limit(2 * train_docs).collect()]

    texts = sorted(sample(hit, sizes.get(True, 0)))
    plain = sorted(sample(~hit, sizes.get(False, 0)))
    windows = training_windows(texts)
    if not any(t.any() for _, t in windows):
        return train([])
    return train(windows + training_windows(plain))


def scan(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """``key`` and ``spans`` (kind, start, end in code points, end exclusive) of every row of ``df``.

    Null and empty texts have no spans. Rows with equal or null keys stay rows of their own.
    """

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        spans = [[{"kind": k, "start": a, "end": b} for a, b, k in s] for s in all_spans(texts, model)]
        return {"k": batch.column(0), "spans": pa.array(spans, kind)}

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    named = f"k {rows.schema['k'].dataType.simpleString()}, spans array<struct<kind: string, start: bigint, end: bigint>>"
    return map_batches(rows, work, named).withColumnRenamed("k", key)


def redact(df: DataFrame, text: str, model: Model, mask: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of ``text``, overlapping ones as one, replaced by ``mask``."""

    def clean(texts: list[str | None]) -> list[str | None]:
        out = []
        for t, spans in zip(texts, all_spans([t or "" for t in texts], model), strict=True):
            parts, at = [], 0
            for a, b, _ in spans:
                if b > at:
                    parts += [t[at:a], mask] if a >= at else []
                    at = b
            out.append(t if not parts else "".join([*parts, t[at:]]))
        return out

    place = df.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            field = batch.schema.field(place)
            yield batch.set_column(place, field, pa.array(clean(batch.column(place).to_pylist()), field.type))

    return df.mapInArrow(work, df.schema)
