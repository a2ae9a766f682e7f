"""BPE ids of whole texts through a minimal acyclic transducer of frequent words, and back.

Words are counted over all texts. The frequent ones are compiled with their ids into an acyclic transducer
whose equal suffixes share states and whose arcs give out ids as early as they are certain. It is one file of
flat arrays in the shared folder; Spark hands it to each executor, and tasks map it into memory.

A batch of texts is cut at spaces and line feeds, which no word contains; what stands between (a chunk) is
normalized and split into words by the tokenizer's own normalizer and pattern, once per distinct chunk of the batch. All
distinct words then walk the transducer together, a byte per step. Words it doesn't hold are merged by
the tokenizer's merge list, again all together: each step applies the lowest-ranked pair of every word at all its
places. That equals merging one place after another because a pair always ranks after the merges that made its
parts, which is checked on loading. Long words use a heap instead, so their time doesn't grow with the square of their length.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftgrid.llm.common import discard, scratch, store

#: Frequent chunks whose words are compiled; all other words are merged.
FREQUENT = 32_768
#: Bytes of text that are worked on at once; a longer text is worked on alone.
BLOCK = 2_000_000
#: Words of more bytes are merged with a heap.
LONG = 64
#: Distinct chunks that a counting task holds.
HELD = 300_000


# A normalizer that leaves these characters to lower case alone: Latin letters are composed already, and
# their classes and cases are the same in all versions of Unicode. (Control characters and the dotted I aren't in it.)
_STEPS = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_LATIN = re.compile("[!-~\xa1-\u012f\u0131-\u024f]*").fullmatch


class Lists:
    """Many lists of ids, one after another: list ``i`` is ``ids[at[i]:at[i + 1]]``."""

    def __init__(self, at: np.ndarray, ids: np.ndarray):
        self.at, self.ids = at, ids

    @staticmethod
    def of(lists: Sequence[Sequence[int]]) -> Lists:
        at = np.zeros(len(lists) + 1, np.int64)
        np.cumsum([len(x) for x in lists], out=at[1:])
        return Lists(at, np.fromiter((i for x in lists for i in x), np.int64, int(at[-1])))

    def take(self, which: np.ndarray) -> Lists:
        """The lists ``which``, in that order."""
        size = np.diff(self.at)[which]
        at = np.zeros(which.size + 1, np.int64)
        np.cumsum(size, out=at[1:])
        inside = np.arange(at[-1]) - np.repeat(at[:-1], size)
        return Lists(at, self.ids[np.repeat(self.at[which], size) + inside])

    def plus(self, other: Lists) -> Lists:
        """Those of ``other`` behind these."""
        return Lists(np.r_[self.at, self.at[-1] + other.at[1:]], np.r_[self.ids, other.ids])

    def joined(self, groups: np.ndarray) -> Lists:
        """Lists joined in runs; run ``g`` ends before list ``groups[g + 1]``."""
        return Lists(self.at[groups], self.ids)


class Tokenizer:
    """What a tokenizer file of this kind says: normalizer, pattern, merges, added tokens."""

    def __init__(self, path: str):
        from tokenizers import Regex, pre_tokenizers
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, steps = spec["model"], spec["pre_tokenizer"].get("pretokenizers", [])
        if [s["type"] for s in steps] != ["Split", "ByteLevel"] or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError(f"{path}: another kind of tokenizer")
        library = Library.from_file(path)
        self.normalizer = library.normalizer
        pattern = steps[0]["pattern"]["Regex"]
        self.quick = regex.compile(pattern) if spec["normalizer"] == _STEPS and steps[0]["invert"] else None
        self.split = pre_tokenizers.Split(Regex(pattern), steps[0]["behavior"].lower(), steps[0]["invert"])
        self.suffix, vocab = model.get("end_of_word_suffix") or "", model["vocab"]
        shown = self.byte_characters()
        self.inner = np.array([vocab[c] for c in shown], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in shown], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        table = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        rank = np.arange(len(table))
        made = np.full(max(vocab.values(), default=0) + 1, -1)
        made[table[:, 2]] = rank
        #: Equal pairs of a word may be merged at once: each result has one pair, which comes after those of its parts.
        self.together = bool((made[table[:, 2]] == rank).all() and (made[table[:, :2]] < rank[:, None]).all())
        keys = (table[:, 0] << 32) | table[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks, self.results = keys[order], rank[order], table[order, 2]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = all(t["special"] and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"])
        if not plain or any(c in t for t in self.added for c in " \n"):
            raise ValueError(f"{path}: another kind of added tokens")
        longest = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    @cached_property
    def pairs(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Rank and result of each pair."""
        left, right = (self.keys >> 32).tolist(), (self.keys & 0xFFFFFFFF).tolist()
        return dict(zip(zip(left, right, strict=True), zip(self.ranks.tolist(), self.results.tolist(), strict=True), strict=True))

    @staticmethod
    def byte_characters() -> list[str]:
        """The visible character that stands for each byte: itself, or the next free one from U+0100."""
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        free = iter(range(256, 512))
        return [chr(b) if b in own else chr(next(free)) for b in range(256)]

    def words(self, chunk: str) -> list[bytes]:
        """The words of a chunk in UTF-8; an added token is itself behind a space, which no word holds."""
        if self.marks is None or not self.marks.search(chunk):
            if self.quick is not None and _LATIN(chunk):
                return [w.encode() for w in self.quick.findall(chunk.lower())]
            return [w.encode() for w, _ in self.split.pre_tokenize_str(self.normalizer.normalize_str(chunk))]
        out = []
        for part in self.marks.split(chunk):
            if part in self.added:
                out.append(b" " + part.encode())
            elif part:
                out += [w.encode() for w, _ in self.split.pre_tokenize_str(self.normalizer.normalize_str(part))]
        return out

    def merge(self, words: Sequence[bytes]) -> Lists:
        """Ids of words by the merge list."""
        if not words:
            return Lists(np.zeros(1, np.int64), np.zeros(0, np.int64))
        alone = [i for i, w in enumerate(words) if len(w) > LONG or w[:1] == b" " or not self.together]
        if not alone:
            return self._merge_all(words)
        own = Lists.of([[self.added[words[i][1:].decode()]] if words[i][:1] == b" " else self._merge_long(words[i]) for i in alone])
        skip = set(alone)
        rest = [i for i in range(len(words)) if i not in skip]
        if not rest:
            return own
        where = np.empty(len(words), np.int64)
        where[rest], where[alone] = np.arange(len(rest)), len(rest) + np.arange(len(alone))
        return self._merge_all([words[i] for i in rest]).plus(own).take(where)

    def _symbols(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = self.inner[data]
        out[ends] = self.last[data[ends]]
        return out

    def _merge_all(self, words: Sequence[bytes]) -> Lists:
        size = np.array([len(w) for w in words])
        symbol = self._symbols(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - 1)
        word = np.repeat(np.arange(len(words)), size)
        done_symbol, done_word = [], []
        while symbol.size:
            inside = np.r_[word[1:] == word[:-1], False]
            key = (symbol << 32) | np.r_[symbol[1:], 0]
            place = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
            hit = inside & (self.keys[place] == key)
            rank = np.where(hit, self.ranks[place], np.iinfo(np.int64).max)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, word.size])
            best = np.repeat(least, lengths)
            going = best != np.iinfo(np.int64).max
            chosen = hit & (rank == best)
            # Of overlapping places (the pair is twice the same symbol) those at even distance from the run's start.
            run = np.flatnonzero(chosen & ~np.r_[False, chosen[:-1]])
            if run.size:
                index = np.arange(chosen.size)
                first = run[np.searchsorted(run, index, "right") - 1]
                chosen &= (index - first) % 2 == 0
            done_symbol.append(symbol[~going])
            done_word.append(word[~going])
            symbol = np.where(chosen, self.results[place], symbol)
            left = going & ~np.r_[False, chosen[:-1]]
            symbol, word = symbol[left], word[left]
        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        at = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bincount(word, minlength=len(words)), out=at[1:])
        return Lists(at, symbol[order])

    def _merge_long(self, word: bytes) -> list[int]:
        data = np.frombuffer(word, np.uint8)
        symbol = self._symbols(data, np.array([data.size - 1])).tolist()
        after, before = [*range(1, len(symbol)), -1], [*range(-1, len(symbol) - 1)]
        heap = [(self.pairs[p][0], i) for i in range(len(symbol) - 1) if (p := (symbol[i], symbol[i + 1])) in self.pairs]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if symbol[i] >= 0 else -1
            if j < 0 or (found := self.pairs.get((symbol[i], symbol[j]))) is None or found[0] != rank:
                continue
            symbol[i], symbol[j], after[i] = found[1], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (p := (symbol[x], symbol[after[x]])) in self.pairs:
                    heapq.heappush(heap, (self.pairs[p][0], x))
        return [s for s in symbol if s >= 0]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


@lru_cache(maxsize=2)
def token_table(path: str) -> tuple[np.ndarray, pa.Array]:
    """Which ids there are (the last: none), and their tokens."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    size = max(tokens, default=-1) + 1
    known = np.zeros(size + 1, bool)
    known[list(tokens)] = True
    return known, pa.array([tokens.get(i, "") for i in range(size + 1)])


class _State:
    __slots__ = ("arcs", "final", "end")

    def __init__(self):
        self.arcs: dict[int, list] = {}  # label: [target, ids]
        self.final, self.end = False, ()


def _common(a: tuple, b: tuple) -> tuple:
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return a[:n]


#: The arrays of a transducer's file in order: arcs sorted by ``state << 8 | byte``, where they lead, what
#: they give out; per state what ends a word there (-1: none does); the lists given out.
ARRAYS = ("keys", "targets", "gives", "ends", "at", "ids")


class Transducer:
    """A minimal acyclic transducer from words to lists of ids, as flat arrays."""

    def __init__(self, arrays: dict[str, np.ndarray], root: int):
        self.__dict__.update(arrays)
        self.root = root

    @staticmethod
    def compile(words: Iterable[tuple[bytes, Sequence[int]]]) -> Transducer:
        """From distinct words in ascending order. States are shared as soon as no later word can change them."""
        register: dict[tuple, int] = {}
        frozen: list[_State] = []

        def freeze(state: _State) -> int:
            key = (state.final, state.end, tuple((b, t, ids) for b, (t, ids) in sorted(state.arcs.items())))
            if key not in register:
                register[key] = len(frozen)
                frozen.append(state)
            return register[key]

        path, last = [_State()], b""
        for word, ids in words:
            if not word or (last and word <= last):
                raise ValueError("words must be distinct, ascending and not empty")
            out, same = tuple(int(i) for i in ids), 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            for i in range(len(last), same, -1):
                path[i - 1].arcs[last[i - 1]][0] = freeze(path[i])
            del path[same + 1 :]
            path += [_State() for _ in range(same, len(word))]
            for i in range(same):  # an arc keeps the ids that all words beyond it begin with
                arc, state = path[i].arcs[word[i]], path[i + 1]
                shared = _common(arc[1], out)
                rest, arc[1] = arc[1][len(shared) :], shared
                if rest:
                    for other in state.arcs.values():
                        other[1] = rest + other[1]
                    if state.final:
                        state.end = rest + state.end
                out = out[len(shared) :]
            for i in range(same, len(word)):
                path[i].arcs[word[i]] = [-1, out if i == same else ()]
            path[-1].final = True
            if same == len(word):
                path[-1].end = out
            last = word
        for i in range(len(last), 0, -1):
            path[i - 1].arcs[last[i - 1]][0] = freeze(path[i])
        root = freeze(path[0])
        lists: dict[tuple, int] = {}
        arcs = [(s << 8 | b, t, lists.setdefault(ids, len(lists))) for s, state in enumerate(frozen) for b, (t, ids) in sorted(state.arcs.items())]
        ends = [lists.setdefault(state.end, len(lists)) if state.final else -1 for state in frozen]
        pool = Lists.of([*lists])
        table = np.array(arcs, np.int64).reshape(-1, 3)
        return Transducer(dict(zip(ARRAYS, (table[:, 0], table[:, 1], table[:, 2], np.array(ends, np.int64), pool.at, pool.ids), strict=True)), root)

    def dump(self) -> bytes:
        arrays = [np.ascontiguousarray(getattr(self, n), "<i8") for n in ARRAYS]
        head = np.array([self.root, *(a.size for a in arrays)], "<i8")
        return b"".join(a.tobytes() for a in (head, *arrays))

    @staticmethod
    def map(path: str) -> Transducer:
        """The file as memory that processes of a machine share."""
        whole = np.memmap(path, "<i8", "r")
        cuts = np.cumsum([len(ARRAYS) + 1, *whole[1 : len(ARRAYS) + 1]])
        return Transducer({n: whole[a:b] for n, a, b in zip(ARRAYS, cuts[:-1], cuts[1:], strict=True)}, int(whole[0]))

    def walk(self, words: Sequence[bytes]) -> tuple[np.ndarray, Lists]:
        """Which words are held, and the ids of those (none for others)."""
        size = np.array([len(w) for w in words], np.int64)
        if not self.keys.size or not size.size:
            return np.zeros(len(words), bool), Lists(np.zeros(len(words) + 1, np.int64), np.zeros(0, np.int64))
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        start = np.cumsum(size) - size
        live, state = np.arange(len(words)), np.full(len(words), self.root)
        held, gives = np.zeros(len(words), bool), []
        step = 0
        while live.size:
            ended = size[live] == step
            if ended.any():
                end = self.ends[state[ended]]
                at, end = live[ended][end >= 0], end[end >= 0]
                held[at] = True
                gives.append((at, end))
                live, state = live[~ended], state[~ended]
                continue
            key = state << 8 | data[start[live] + step]
            place = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
            on = self.keys[place] == key
            live, place = live[on], place[on]
            state = np.asarray(self.targets[place])
            gives.append((live, np.asarray(self.gives[place])))
            step += 1
        word, what = (np.concatenate([g[k] for g in gives]) for k in range(2))
        word, what = word[held[word]], what[held[word]]
        order = np.argsort(word, kind="stable")
        counts = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bincount(word, minlength=len(words)), out=counts[1:])
        return held, Lists(self.at, self.ids).take(what[order]).joined(counts)


def _chunks(texts: pa.Array) -> pa.ListArray:
    """What stands between spaces and line feeds of each text (null: nothing)."""
    return pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")


def _blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive slices of about ``BLOCK`` bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(texts):
        before = size[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(size, before + BLOCK, "right")))
        yield texts.slice(low, high - low)
        low = high


def frequent_chunks(df: DataFrame, text: str, most: int = FREQUENT) -> list[str]:
    """The most frequent chunks of all texts, ``most`` or fewer: those of the highest counts (in steps of an eighth
    of a power of two) that fit whole. Tasks add up their counts before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def total() -> pa.Table:
            return pa.concat_tables(held).group_by("chunk").aggregate([("n", "sum")]).rename_columns(["chunk", "n"])

        for batch in batches:
            for block in _blocks(batch.column(0)):
                some = _chunks(block).flatten().value_counts()
                held.append(pa.table({"chunk": some.field(0), "n": some.field(1)}))
                rows += len(some)
                if rows > 2 * HELD:
                    held = [total()]
                    rows = held[0].num_rows
                    if rows > HELD:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from total().to_batches()

    counts = df.select(text).mapInArrow(count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    counts = store(counts.withColumn("step", F.floor(F.log2("n") * 8)), "chunks")
    least, total = None, 0
    for r in sorted(counts.groupBy("step").count().collect(), reverse=True):  # at most 512 steps
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    found = [] if least is None else [r["chunk"] for r in counts.where(F.col("step") >= least).select("chunk").collect()]
    discard(counts)
    return sorted(found)


def build_lexicon(spark: SparkSession, chunks: Iterable[str], path: str) -> str:
    """Compile the words of ``chunks``, store the file in the shared folder, hand it to all executors; its name."""
    t = tokenizer(path)
    words = sorted({w for c in chunks for w in t.words(c) if w[:1] != b" "})
    merged = t.merge(words)
    body = Transducer.compile((w, merged.ids[merged.at[i] : merged.at[i + 1]].tolist()) for i, w in enumerate(words)).dump()
    name = f"lexicon-{uuid.uuid4().hex}"
    folder = scratch(spark, "lexicon")
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    stream = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(file)
    stream.write(bytearray(body))
    stream.close()
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


@lru_cache(maxsize=2)
def _lexicon(name: str) -> Transducer:
    return Transducer.map(SparkFiles.get(name))


def _ids(texts: pa.Array, t: Tokenizer, lexicon: Transducer) -> Lists:
    chunks = _chunks(texts)
    coded = chunks.flatten().dictionary_encode()
    number: dict[bytes, int] = {}
    parts = [[number.setdefault(w, len(number)) for w in t.words(c)] for c in coded.dictionary.to_pylist()]
    words = [*number]
    held, known = lexicon.walk(words)
    missing = np.flatnonzero(~held)
    merged = t.merge([words[i] for i in missing])
    both = known.plus(merged)
    where = np.arange(len(words))
    where[missing] = len(words) + np.arange(missing.size)
    of_chunk = Lists.of(parts)
    of_chunk = both.take(where[of_chunk.ids]).joined(of_chunk.at) if len(words) else Lists(np.zeros(len(parts) + 1, np.int64), of_chunk.ids)
    return of_chunk.take(coded.indices.to_numpy(zero_copy_only=False)).joined(chunks.offsets.to_numpy() - chunks.offsets[0].as_py())


def encode(df: DataFrame, key: str, text: str, path: str, lexicon: str | None = None) -> DataFrame:
    """``k``, ``n_tokens`` and ``ids`` (little-endian 32-bit) of every row's whole text.

    The ids are those of the tokenizers library with its settings as they are and no special tokens added; the
    content of an added token in a text gives its id. A null or empty text has none. Keys may be null or repeat; a row
    in is a row out. ``lexicon`` is the name :func:`build_lexicon` gave; without one, it is built from all texts. Other
    columns are ignored, so their names can't clash. An empty table gives an empty table.
    """
    name = lexicon or build_lexicon(df.sparkSession, frequent_chunks(df, text), path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, words = tokenizer(path), _lexicon(name)
        for batch in batches:
            low = 0
            for block in _blocks(batch.column(1)):
                ids = _ids(block, t, words)
                data = pa.py_buffer(ids.ids.astype("<u4"))
                column = pa.Array.from_buffers(pa.binary(), len(block), [None, pa.py_buffer((4 * ids.at).astype(np.int32)), data])
                keys = batch.column(0).slice(low, len(block))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(ids.at)), column], names=["k", "n_tokens", "ids"])
                low += len(block)
            pa.default_memory_pool().release_unused()

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(work, f"k {rows.schema['k'].dataType.simpleString()}, n_tokens long, ids binary")


def decode(df: DataFrame, key: str, ids: str, path: str, *extra: str) -> DataFrame:
    """``key``, the ``extra`` columns and ``text``, the ids' tokens with a space between.

    That is what the library does for a tokenizer without a decoder, special tokens kept. Unknown ids are left out,
    null or no ids give an empty text.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = token_table(path)
        for batch in batches:
            low = 0
            for block in _blocks(pc.fill_null(batch.column(batch.num_columns - 1), b"")):
                at = np.cumsum(np.r_[0, pc.binary_length(block).to_numpy(zero_copy_only=False)]) // 4
                number = np.minimum(np.frombuffer(b"".join(block.to_pylist()), "<u4").astype(np.int64), known.size - 1)
                keep = known[number]
                at = np.r_[0, np.cumsum(keep)][at]
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), table.take(pa.array(number[keep])))
                others = [c.slice(low, len(block)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*others, pc.binary_join(lists, " ")], names=[key, *extra, "text"])
                low += len(block)

    rows = df.select(key, *extra, ids)
    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in (key, *extra))
    return rows.mapInArrow(work, f"{kinds}, text string")

