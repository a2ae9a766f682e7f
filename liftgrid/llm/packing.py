"""Sequence packing by minimum bin slack.

Documents become token ids and are cut only where they exceed the window: full windows, then a
remainder. All remainders of one length are alike, so what has to be packed is a histogram with at
most ``window`` entries, however many documents there are. It is packed on the driver: the longest
remaining length opens a window, a bitset over reachable sums says which totals the remaining
counts can add up to, the largest that fits is backtracked into counts per length, and the pattern is
repeated for as long as its counts last. Each pattern uses up some length, so there are few.

The pieces themselves never move for that. Within each length they are numbered in the order of a hash,
in buckets, and a piece's number says which repetition of which pattern it belongs to.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from liftgrid.llm.common import store
from liftgrid.llm.sharding import bucket_count

WINDOW = 2048
#: Words whose ids a task remembers before it starts anew.
CACHE_WORDS = 600_000
#: Characters of text that are turned into ids at once, so that memory follows this and the longest text.
BATCH_CHARS = 4_000_000

# The tokenizer never joins a space or line feed to visible text before it, so its ids for a text are
# those of the parts that begin there, one after another. Runs of white space stay in one part; other
# white space before one of the two would be joined, so such a text is not cut.
_PART = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_JOINED = re.compile(r"[^\S \n][ \n]")
_RUNS = ("  ", " \n", "\n ", "\n\n")


class WordIds(dict):
    """Ids of texts by a tokenizer file, remembering those of words (a word follows a space, or
    begins with the line feed it follows).

    ``ranks`` is the same vocabulary as byte ranks. Words in Latin letters, where it has the same ids at
    a fraction of the time, then go by it; all others by the tokenizer.
    """

    def __init__(self, path: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.quick = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, part: str) -> bytes:
        if self.quick is not None and (part.isascii() or max(part) < "\u0250"):
            ids = self.quick.encode_ordinary(part)
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = ids = self.ids(word if word[:1] == "\n" else " " + word)
        return ids

    def encode(self, text: str) -> np.ndarray:
        if any(a in text for a in self.added):  # their content is their id, also in the middle of a word
            parts = [array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()]
        elif _JOINED.search(text):
            parts = [self.ids(text)]
        elif any(r in text for r in _RUNS):
            parts = map(self.ids, _PART.findall(text))
        else:
            first, *words = text.replace("\n", " \n").split(" ")
            parts = [self.ids(first), *map(self.__getitem__, words)]
        return np.frombuffer(b"".join(parts), dtype="<u4")


@cache
def _encoder(path: str, ranks: str | None) -> WordIds:
    return WordIds(path, ranks)


def pieces(df: DataFrame, key: str, text: str, tokenizer: str, ranks: str | None = None, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """``k, row, start, length, ids, doc_tokens``: windows of each text and its remainder.

    ``ids`` are little-endian 32-bit ids, the document's last being ``end_id``; a null text counts as
    empty and has that id only. ``row`` tells apart rows with equal keys, rows alike in both key
    and text excepted, which are interchangeable.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, ranks)
        names = ("k", "row", "start", "length", "ids", "doc_tokens")
        for batch in batches:
            out: list[list] = [[] for _ in names]
            chars = 0
            for k, row, t in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                body = t.as_py() or ""
                ids = np.append(encoder.encode(body), np.uint32(end_id)).astype("<u4")
                for start in range(0, ids.size, window):
                    part = ids[start : start + window]
                    for column, value in zip(out, (k.as_py(), row.as_py(), start, part.size, part.tobytes(), ids.size), strict=True):
                        column.append(value)
                chars += len(body)
                if chars >= BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(out, kinds, strict=True)], names=list(names))
                    out, chars = [[] for _ in names], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(out, kinds, strict=True)], names=list(names))
        encoder.clear()  # the worker lives on, for tasks of other kinds too

    rows = df.select(F.col(key).alias("k"), F.xxhash64(key, text).alias("row"), F.col(text).alias("t"))
    kinds = [to_arrow_type(rows.schema["k"].dataType), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(work, f"k {kind}, row long, start long, length long, ids binary, doc_tokens long")


def _fill(counts: dict[int, int], space: int) -> dict[int, int]:
    """Counts of lengths whose sum is the largest that fits ``space``, by subset sums as bits."""
    reach, limit, steps = 1, (1 << (space + 1)) - 1, []
    for length in sorted((n for n in counts if n <= space), reverse=True):
        left, unit = min(counts[length], space // length), 1
        while left:  # counts 1, 2, 4, ... and the rest make every count up to the bound
            take = min(unit, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & limit
            left, unit = left - take, unit * 2
        if reach >> space & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Patterns (counts per length) and how often each is used, using up the histogram."""
    counts, out = dict(histogram), []
    while counts:
        longest = max(counts)
        rest = {n: c - (n == longest) for n, c in counts.items() if c > (n == longest)}
        pattern = _fill(rest, window - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[n] // c for n, c in pattern.items())
        for n, c in pattern.items():
            counts[n] -= c * times
            if not counts[n]:
                del counts[n]
        out.append((pattern, times))
    return out


def _runs(spark: SparkSession, patterns: list[tuple[dict[int, int], int]]) -> DataFrame:
    """Per pattern and length: the range of piece numbers it takes, and where they go."""
    rows, used, sequence = [], {}, 0
    for pattern, times in patterns:
        place = 0
        for length in sorted(pattern, reverse=True):
            count, low = pattern[length], used.get(length, 0)
            used[length] = low + count * times
            rows.append((length, low, used[length], count, sequence, place))
            place += length * count
        sequence += times
    return spark.createDataFrame(rows, "length long, low long, high long, per long, sequence long, place long")


def pack(parts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the pieces; they abut from 0 and never pass ``window``.

    ``parts`` must be stored (see :func:`pieces`); extra columns stay. Which of several pieces of one
    length goes where depends on their key, row and start only. No pieces give no sequences.
    """
    spark = parts.sparkSession
    sizes = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    buckets = bucket_count(sum(sizes.values()))
    keyed = parts.withColumn("_hash", F.xxhash64("k", "row", "start")).withColumn(
        "_bucket", F.floor((F.col("_hash") / F.lit(2.0**64) + 0.5) * buckets)
    )
    counts = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("_hash", "k", "row", "start")
    numbered = (
        keyed.withColumn("_in", F.row_number().over(inside) - 1)
        .join(before, ["length", "_bucket"])
        .withColumn("_number", F.col("_before") + F.col("_in"))
    )
    # At most 63 different lengths share a window and each pattern uses up a length: a bounded table.
    runs = F.broadcast(_runs(spark, plan(sizes, window)).withColumnRenamed("length", "_length"))
    within = F.col("_number") - F.col("low")
    return numbered.join(
        runs, (F.col("length") == F.col("_length")) & (F.col("_number") >= F.col("low")) & (F.col("_number") < F.col("high"))
    ).select(
        *parts.columns,
        (F.col("sequence") + F.floor(within / F.col("per"))).alias("sequence_id"),
        (F.col("place") + F.col("length") * (within % F.col("per"))).alias("offset"),
    )


def sequences(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """``sequence_id, ids, length``: the pieces' ids joined in order and padded with zeros.

    A sequence whose length is a power of two is left unpadded.
    """
    joined = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("length")
    )
    body = F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))")
    even = F.expr("(length & (length - 1)) = 0")
    padded = F.expr(f"cast(rpad(a, {4 * window}, x'00') as binary)")
    return joined.select("sequence_id", body.alias("a"), "length").select(
        "sequence_id", F.when(even, F.col("a")).otherwise(padded).alias("ids"), "length"
    )


def pack_documents(df: DataFrame, key: str, text: str, tokenizer: str, ranks: str | None = None, end_id: int = 1, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Cut, store and pack all texts: :func:`pieces` with ``ids_crc32`` for ``ids``, and the placement.

    The ids stay in the stored table ``parts`` (first of the result), which the placement (second)
    joins on ``k, row, start``; only narrow rows are shuffled for it.
    """
    parts = store(pieces(df, key, text, tokenizer, ranks, end_id, window), "pieces")
    narrow = parts.select("k", "row", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return parts, pack(narrow, window)
