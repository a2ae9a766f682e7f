"""URL filtering with a bit-parallel wildcard automaton.

All glob rules become one long row of bits, packed into 64-bit words: a bit per literal character
of a pattern, with a self-loop on the bit before a wildcard. One Shift-And step moves all patterns
over one character of a canonical URL; a batch steps through its URLs together, so a step is a
handful of vector operations over (URLs still running) x (words).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftgrid.llm.common import map_batches

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; ``glob`` matches the whole canonical URL (``.host`` + path).

    ``*`` stands for any run without ``/``, ``**`` for any run.
    """

    name: str
    verdict: str
    glob: str
    weight: int


def subtree(verdict: str, name: str) -> Rule:
    """A rule ``host/path``: the host and its subdomains, paths that start with ``/path``."""
    return Rule(name, verdict, f"*.{name}**", len(name))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Automaton:
    """Shift-And masks of many glob patterns over UTF-8 bytes."""

    def __init__(self, globs: list[str]):
        starts, ends, literal, loops, strict = [], [], [], [], []
        for glob in globs:
            starts.append(len(literal))
            literal.append(-1)  # the state before the first literal
            loops.append(False)
            strict.append(False)
            data, k = glob.encode(), 0
            while k < len(data):
                if data[k] == 0x2A:
                    deep = data[k : k + 2] == b"**"
                    if deep:
                        loops[-1] = True
                    else:
                        strict[-1] = True
                    k += 1 + deep
                else:
                    literal.append(data[k])
                    loops.append(False)
                    strict.append(False)
                    k += 1
            ends.append(len(literal) - 1)
        self.words = max(1, -(-len(literal) // 64))
        self.ends = np.array(ends, dtype=np.int64)
        bits = np.zeros((256, self.words * 64), dtype=bool)
        loop = np.zeros((256, self.words * 64), dtype=bool)
        first = np.zeros((1, self.words * 64), dtype=bool)
        first[0, starts] = True
        for k, byte in enumerate(literal):
            if byte >= 0:
                bits[byte, k] = True
            loop[:, k] = loops[k] or strict[k]
            if strict[k] and not loops[k]:
                loop[0x2F, k] = False
        self.step, self.stay, self.first = map(self._pack, (bits, loop, first))

    @staticmethod
    def _pack(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view("<u8")

    def matches(self, urls: list[bytes]) -> np.ndarray:
        """(URLs, patterns) of booleans: the pattern matches the whole URL."""
        size = np.array([len(u) for u in urls], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(urls) or b"\0", dtype=np.uint8)
        begin = (np.cumsum(size) - size)[order]
        states = np.repeat(self.first, len(urls), axis=0)
        running = np.searchsorted(-size[order], -np.arange(1, size.max(initial=0) + 1), side="right")
        for k, live in enumerate(running):
            d, c = states[:live], data[begin[:live] + k]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            states[:live] = (moved & self.step[c]) | (d & self.stay[c])
        out = np.empty_like(states)
        out[order] = states
        return (out[:, self.ends // 64] >> (self.ends % 64).astype(np.uint64) & np.uint64(1)).astype(bool)


def filter_urls(df: DataFrame, key: str, url: str, rules: list[Rule], default: str = "allow") -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` and ``verdict`` of every row of ``df``.

    Of the rules that match, that with the largest weight wins, of equals the one listed first;
    ``rule`` is null and the verdict ``default`` where none does. A null URL, or one without
    ``://``, has an empty host and path, which no subtree rule matches. Repeated rows and null
    keys stay rows of their own.
    """
    ranked = sorted(rules, key=lambda r: -r.weight)
    names = pa.array([*(r.name for r in ranked), None], pa.string())
    verdicts = pa.array([*(r.verdict for r in ranked), default], pa.string())
    automaton = Automaton([r.glob for r in ranked])

    def judge(batch: pa.RecordBatch) -> dict[str, object]:
        hosts, paths = batch.column(1), batch.column(2)
        urls = [f".{h}{p}".encode() for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
        hit = automaton.matches(urls)
        hit = np.concatenate([hit, np.ones((len(urls), 1), dtype=bool)], axis=1)
        best = pa.array(hit.argmax(axis=1))
        return {"k": batch.column(0), "host": hosts, "path": paths, "rule": names.take(best), "verdict": verdicts.take(best)}

    rows = df.select(F.col(key).alias("k"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    kind = rows.schema["k"].dataType.simpleString()
    out = map_batches(rows, judge, f"k {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("k", key)
