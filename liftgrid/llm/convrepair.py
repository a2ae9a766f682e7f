"""Repair of conversation structure: cheapest edits by dynamic programming, the least of them by prefix doubling.

A conversation should read ``s?(ua)+`` in the initials of its roles, or be empty. Between two rows the repair is in
one of four states: nothing given out, a system row, a user row, an assistant row last. From a state only
one role can be inserted or assigned, so every edit leads to one state. Cost to go of each (place, state) comes
from a dynamic program that steps from the last place to the first, all conversations of a batch at once.

Arcs that lie on a cheapest repair are the optimal ones. The audit of a repair is the string of its edits' initials.
Nodes (place, state) are ranked by the first 1, 2, 4, ... letters of the least audit that starts there: the rank for twice
the letters is that of the pair of the node's own rank and its pointer's, and pointers double with it. At every node the arc with
the least letter, then the least rank of where it leads, stays; the doubled pointers then give the node of every
letter of a conversation's audit at once.

Rows are range-partitioned by conversation, turn, role and text, so a conversation of any length is cut between tasks
like any other run of rows. What a task sees whole, and is no longer than ``CHUNK`` rows, is repaired there. Others become
chunks: a chunk is first a 4 by 4 table of cheapest costs between states, which are combined per conversation (a row per
chunk); knowing the costs behind it, a chunk then has an audit per entry state; following those from the first chunk picks one for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from liftgrid.llm.common import store, with_group_min

#: Rows, and bytes of text, of a conversation that are worked on together.
CHUNK, CHUNK_BYTES = 4_096, 16_000_000
#: Rows of whole conversations that are repaired together.
TOGETHER = 20_000

REROLE, DELETE, INSERT, UNTRIMMED = 3, 4, 3, 3
FAR = 1 << 40
#: Edits in ASCII order.
LETTERS = "DIKR"
ROLES = {2: "user", 3: "assistant"}
# States: 0 nothing given out, 1 system, 2 user, 3 assistant. What can be inserted or assigned, and where it leads:
_NEXT = np.array([2, 2, 3, 2])
# Where a kept row leads by state and initial (s, u, a, other); -1: not allowed.
_KEEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
_INITIAL = {"s": 0, "u": 1, "a": 2}
#: Costs behind the last row: an assistant row or nothing ends a conversation.
END = np.array([0, 6, 3, 0])
_SPACE = " \t\n\x0b\x0c\r"


def damage(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, turn, role, text, n``: rows after damage by the checksum of ``conv:turn``, ``n`` copies of each.

    Nulls count as one space, except that the conversation and the turn keep theirs. A dropped row leaves one without
    role and text and with no copies, so that no conversation is lost.
    """
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)])
    kind = F.crc32(named.cast("binary")) % 20
    words, who = F.coalesce(F.col(text), F.lit(" ")), F.coalesce(F.col(role), F.lit(" "))
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), who.alias("role"), words.alias("text"), kind.alias("kind"))
    there = F.col("kind") != 0
    return rows.select(
        "conv",
        F.when(there, F.col("turn")).alias("turn"),
        F.when(there, F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).when(there, F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).when(there, 1).otherwise(0).cast("long").alias("n"),
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows by conversation, turn, role and text (nulls first), in tasks that each have a range of them.

    Equal rows always meet, so they are added up per batch before the shuffle.
    """
    keys = ["conv", "turn", "role", "text"]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from pa.Table.from_batches([batch]).group_by(keys).aggregate([("n", "sum")]).rename_columns([*keys, "n"]).combine_chunks().to_batches()

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in (*keys, "n"))
    return rows.mapInArrow(added, kinds).repartitionByRange(*keys).sortWithinPartitions(*keys)


def _inserted(togo: np.ndarray) -> np.ndarray:
    """Costs to go (..., state) if rows may also be inserted first; more than two in a row never pay."""
    for _ in range(2):
        togo = np.minimum(togo, INSERT + togo[..., _NEXT])
    return togo


def costs_to_go(first: np.ndarray, initial: np.ndarray, gone: np.ndarray, cut: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs to go of all nodes, four states per place, of many conversations one after another.

    Conversation ``c`` has the rows ``first[c]`` to ``first[c + 1]`` and a place more than rows; its nodes begin at place
    ``first[c] + c``. Per row: the role's initial, whether it must go, whether its text is cut off. ``end``: costs behind the last row.
    """
    size = np.diff(first)
    togo = np.full((initial.size + size.size, 4), FAR, np.int64)
    place = first[:-1] + np.arange(size.size)
    togo[place + size] = end
    order = np.argsort(-size, kind="stable")
    for step in range(1, int(size.max(initial=0)) + 1):
        order = order[: np.searchsorted(-size[order], -step, "right")]
        row, at = first[order] + size[order] - step, place[order] + size[order] - step
        after, extra = togo[at + 1], UNTRIMMED * cut[row]
        best = DELETE + after
        allowed = _KEEP[:, initial[row]].T
        kept = np.where(allowed >= 0, np.take_along_axis(after, np.maximum(allowed, 0), 1) + extra[:, None], FAR)
        kept = np.minimum(kept, REROLE + extra[:, None] + after[:, _NEXT])
        best = np.where(gone[row][:, None], best, np.minimum(best, kept))
        togo[at] = np.minimum(_inserted(best), FAR)
    return togo


def _arcs(first: np.ndarray, initial: np.ndarray, gone: np.ndarray, cut: np.ndarray, togo: np.ndarray, last: bool) -> np.ndarray:
    """``[letter, node]`` of the optimal arcs: the node that each letter leads to, -1 for none.

    ``last``: whether rows may be inserted behind the last row. A node is ``4 * place + state``.
    """
    size = np.diff(first)
    places = len(togo)
    ends = np.zeros(places, bool)
    ends[first[1:] + np.arange(size.size)] = True
    row = np.where(ends, 0, np.arange(places) - np.repeat(np.arange(size.size), size + 1))
    if not initial.size:
        initial, gone, cut = np.zeros(1, np.int64), np.ones(1, bool), np.zeros(1, bool)
    start, state = 4 * np.arange(places)[:, None], np.arange(4)
    after = np.vstack([togo[1:], togo[-1:]])
    extra, free = (UNTRIMMED * cut[row])[:, None], (~gone[row] & ~ends)[:, None]
    keep = _KEEP[:, initial[row]].T
    cost = [
        (np.where(ends[:, None], FAR, DELETE + after), start + 4 + state),
        (np.where(ends[:, None] & (not last), FAR, INSERT + togo[:, _NEXT]), start + _NEXT),
        (np.where(free & (keep >= 0), extra + np.take_along_axis(after, np.maximum(keep, 0), 1), FAR), start + 4 + np.maximum(keep, 0)),
        (np.where(free, REROLE + extra + after[:, _NEXT], FAR), start + 4 + _NEXT),
    ]
    return np.stack([np.where((togo < FAR) & (c == togo), t, -1).ravel() for c, t in cost])


def least_paths(arcs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The letter of each node's arc on its least path (0: it ends there), and the pointers doubled until all end.

    ``arcs[letter, node]`` is where a letter leads. Each letter leaves a node by one arc, so the least audits of the first
    ``2^k`` letters have one pointer each, and their ranks order nodes exactly.
    """
    letters, nodes = arcs.shape
    there = arcs >= 0
    letter = np.where(there.any(axis=0), there.argmax(axis=0) + 1, 0)
    pointer = np.where(letter > 0, arcs[np.maximum(letter - 1, 0), np.arange(nodes)], np.arange(nodes))
    rank, doubled = letter.astype(np.int64), []
    while True:
        doubled.append(pointer)
        pair = rank * (nodes + letters + 1) + rank[pointer]
        new = np.unique(pair, return_inverse=True)[1]
        after = pointer[pointer]
        if (after == pointer).all():
            rank = new
            break
        rank, pointer = new, after
    # The least letter, then the least rank behind it: the arc that stays.
    order = np.where(there, np.arange(letters)[:, None] * (nodes + 1) + rank[np.maximum(arcs, 0)], np.iinfo(np.int64).max)
    chosen = np.where(letter > 0, order.argmin(axis=0) + 1, 0)
    return chosen, doubled


def follow(start: np.ndarray, letter: np.ndarray, doubled: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The audits from the nodes ``start``, one after another: their nodes, and where each begins."""
    paths = start[:, None]
    for pointer in doubled:
        if not (letter[paths[:, -1]] > 0).any():
            break
        paths = np.hstack([paths, pointer[paths]])
    alive = letter[paths] > 0
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(alive.sum(axis=1), out=at[1:])
    return paths[alive], at


@dataclass
class Rows:
    """Rows of conversations one after another, as the dynamic program sees them."""

    first: list[int] = field(default_factory=lambda: [0])
    role: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    initial: list[int] = field(default_factory=list)
    blank: list[bool] = field(default_factory=list)
    twice: list[bool] = field(default_factory=list)
    cut: list[bool] = field(default_factory=list)

    def add(self, role: str, text: str, twice: bool) -> None:
        body = text.rstrip(_SPACE)
        self.role.append(role)
        self.text.append(text)
        self.initial.append(_INITIAL.get(role[:1], 3))
        self.blank.append(not body)
        self.twice.append(twice and bool(body))
        self.cut.append(bool(body) and not twice and body[-1] not in ".!?")

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        gone = np.array(self.blank, bool) | np.array(self.twice, bool)
        return np.array(self.first), np.array(self.initial, np.int64), gone, np.array(self.cut, bool)

    def lines(self, nodes: np.ndarray, letters: np.ndarray, conversation: int) -> list[str]:
        """The repaired ``role:text`` of a path."""
        out = []
        for node, letter in zip(nodes.tolist(), letters.tolist(), strict=True):
            row, state = node // 4 - conversation, node % 4
            if letter == 2:
                out.append(ROLES[int(_NEXT[state])] + ":")
            elif letter == 3:
                out.append(f"{self.role[row]}:{self.text[row]}")
            elif letter == 4:
                out.append(f"{ROLES[int(_NEXT[state])]}:{self.text[row]}")
        return out


def repair_whole(rows: Rows) -> tuple[np.ndarray, list[str], list[str]]:
    """Cost, audit and repaired text of every conversation."""
    first, initial, gone, cut = rows.arrays()
    togo = costs_to_go(first, initial, gone, cut, END)
    letter, doubled = least_paths(_arcs(first, initial, gone, cut, togo, True))
    start = 4 * (first[:-1] + np.arange(first.size - 1))
    audits, texts = [], []
    for low in range(0, start.size, 256):  # paths are as wide as the longest of them
        nodes, at = follow(start[low : low + 256], letter, doubled)
        for c in range(at.size - 1):
            mine = nodes[at[c] : at[c + 1]]
            audits.append("".join(LETTERS[x - 1] for x in letter[mine].tolist()))
            texts.append("\n".join(rows.lines(mine, letter[mine], low + c)))
    return togo[start // 4, 0], audits, texts


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True))


_TOTALS = "cost long, gaps long, blank long, duplicate long, truncated long, illegal long"
_PIECE = "chunk long, n_chunks long, " + _TOTALS + ", audit string, repaired string"
_HELD = "turns array<long>, roles array<string>, texts array<string>, copies array<boolean>"


def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _segments(ordered: DataFrame, chunk_rows: int) -> DataFrame:
    """Whole conversations repaired, and chunks (``roles`` not null) of the others; ``chunk`` follows the order."""
    columns = f"conv {ordered.schema['conv'].dataType.simpleString()}, {_PIECE}, {_HELD}"
    schema = _schema(columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        whole, waiting = Rows(), []
        number, conv, begun, cut_off = TaskContext.get().partitionId() << 32, None, False, True
        rows: list[tuple] = []
        size = held = 0
        before = None

        def end(part: bool) -> None:
            """The rows held become a chunk if the conversation may go on elsewhere, else a whole conversation."""
            nonlocal number, rows, size
            number += 1
            base = {"conv": conv, "chunk": number}
            if part:
                turns, roles, texts, copies = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [])
                out.append(base | {"turns": turns, "roles": roles, "texts": texts, "copies": copies})
            else:
                low, seen = len(whole.role), set()
                for _, role, text, copy in rows:
                    whole.add(role, text, copy or (role, text) in seen)
                    if not copy:
                        seen.add((role, text))
                whole.first.append(len(whole.role))
                turns = [r[0] for r in rows if r[0] is not None]
                waiting.append(
                    base
                    | {
                        "n_chunks": 1,
                        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                        "blank": sum(whole.blank[low:]),
                        "duplicate": sum(whole.twice[low:]),
                        "truncated": sum(whole.cut[low:]),
                        "illegal": _illegal([r[1][:1] for r in rows]),
                    }
                )
            rows, size = [], 0

        def repaired() -> Iterator[pa.RecordBatch]:
            nonlocal whole, held
            if waiting:
                for base, cost, audit, text in zip(waiting, *repair_whole(whole), strict=True):
                    out.append(base | {"cost": int(cost), "audit": audit, "repaired": text})
            waiting.clear()
            whole, held = Rows(), 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()

        for batch in batches:
            for who, turn, role, text, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if begun and who != conv:
                    end(cut_off)  # the first conversation of a task may have begun in another
                    cut_off = False
                    if len(whole.role) >= TOGETHER or held >= CHUNK_BYTES:
                        yield from repaired()
                conv, begun = who, True
                again, before = before == (who, turn, role, text), (who, turn, role, text)
                for i in range(n):
                    copy = again or i > 0
                    # Copies always go; what matters of their text is whether it is blank.
                    rows.append((turn, role, ("." if text.strip(_SPACE) else "") if copy else text, copy))
                    size += 0 if copy else len(text)
                    held += 0 if copy else len(text)
                    if len(rows) >= chunk_rows or size >= CHUNK_BYTES:
                        end(True)
                        cut_off = True  # and so is its rest
                        yield from repaired()
        if begun:
            end(True)  # the last conversation may go on in another task
        yield from repaired()

    return ordered.mapInArrow(work, columns)


def _rows_of(chunk: dict) -> Rows:
    twice, rows = set(chunk["twice"] or ()), Rows()
    for i, (role, text, copy) in enumerate(zip(chunk["roles"], chunk["texts"], chunk["copies"], strict=True)):
        rows.add(role, text, copy or i in twice)
    rows.first.append(len(rows.role))
    return rows


def _chunk_table(chunk: dict) -> dict:
    """What a conversation needs to know of its chunk: costs from each state before it to each behind it, and its counts."""
    rows = _rows_of(chunk)
    costs = [costs_to_go(*rows.arrays(), np.where(np.arange(4) == s, 0, FAR))[0] for s in range(4)]
    turns = [t for t in chunk["turns"] if t is not None]
    return {
        "conv": chunk["conv"],
        "chunk": chunk["chunk"],
        "costs": np.stack(costs, axis=1).ravel().tolist(),
        "n_rows": len(rows.role),
        "blank": sum(rows.blank),
        "duplicate": sum(rows.twice),
        "truncated": sum(rows.cut),
        "illegal": _illegal([r[:1] for r in rows.role]),
        "head": rows.role[0][:1] if rows.role else None,
        "tail": rows.role[-1][:1] if rows.role else None,
        "turns": len(set(turns)),
        "low": min(turns, default=None),
        "high": max(turns, default=None),
    }


def _chunk_path(chunk: dict, entries: list[int]) -> tuple[list[int], Rows, np.ndarray, np.ndarray, np.ndarray]:
    """From each state at its begin: the state at its end, and the path (nodes, where each begins, letters)."""
    rows = _rows_of(chunk)
    arrays = rows.arrays()
    togo = costs_to_go(*arrays, np.array(chunk["end"]))
    letter, doubled = least_paths(_arcs(*arrays, togo, chunk["last"]))
    start = np.array(entries)
    nodes, at = follow(start, letter, doubled)
    return (doubled[-1][start] % 4).tolist(), rows, nodes, at, letter


def _behind(chunks: pd.DataFrame) -> pd.DataFrame:
    """For the chunks of a conversation: the costs to go behind each, and the whole's counts."""
    chunks = chunks.sort_values("chunk")
    end, ends = END, []
    for costs in reversed(chunks["costs"].tolist()):
        ends.append(end.tolist())
        end = np.minimum((np.array(costs).reshape(4, 4) + end).min(axis=1), FAR)
    out = chunks[["conv", "chunk"]].copy()
    out["end"], out["last"] = ends[::-1], [False] * (len(chunks) - 1) + [True]
    some = chunks[chunks["n_rows"] > 0]
    heads, tails = some["head"].tolist(), some["tail"].tolist()
    timed = chunks[chunks["turns"] > 0]
    lows, highs = timed["low"].astype("int64").tolist(), timed["high"].astype("int64").tolist()
    distinct = int(timed["turns"].sum()) - sum(a == b for a, b in zip(highs[:-1], lows[1:], strict=True))
    out["n_chunks"] = len(chunks)
    out["cost"] = int(end[0])
    out["gaps"] = max(highs) - min(lows) + 1 - distinct if lows else 0
    for name in ("blank", "duplicate", "truncated"):
        out[name] = int(chunks[name].sum())
    out["illegal"] = int(chunks["illegal"].sum()) + sum(a + b not in ("su", "ua", "au") for a, b in zip(tails[:-1], heads[1:], strict=True))
    return out


def _entered(chunks: pd.DataFrame) -> pd.DataFrame:
    """The state in which each chunk of a conversation is entered."""
    chunks = chunks.sort_values("chunk")
    state, entries = 0, []
    for exits in chunks["exits"].tolist():
        entries.append(state)
        state = int(exits[state])
    return chunks[["chunk"]].assign(entry=entries)


def _each(work: Callable[[dict], dict], ddl: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on every row, one chunk in memory at a time."""
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist([work(batch.slice(i, 1).to_pylist()[0])], schema=schema)

    return run


def _chunked(segments: DataFrame) -> DataFrame:
    """The pieces of conversations that were cut into chunks."""
    kind = segments.schema["conv"].dataType.simpleString()
    chunks = segments.where("roles IS NOT NULL").select("conv", "chunk", *[c.split()[0] for c in _HELD.split(", ")])
    rows = chunks.select("conv", "chunk", F.posexplode(F.arrays_zip("roles", "texts", "copies")).alias("pos", "r"))
    rows = rows.where("NOT r.copies").select(
        F.sha2(F.to_json(F.struct("conv", "r.roles", "r.texts")), 256).alias("key"), "chunk", "pos", F.struct("chunk", "pos").alias("place")
    )
    later = with_group_min(rows, "key", "place", "first", ["chunk", "pos"]).where("place > first")
    twice = later.groupBy("chunk").agg(F.collect_list("pos").alias("twice"))
    chunks = store(chunks.join(twice, "chunk", "left"), "chunks")

    counts = "n_rows long, blank long, duplicate long, truncated long, illegal long, head string, tail string, turns long, low long, high long"
    table = f"conv {kind}, chunk long, costs array<long>, {counts}"
    tables = chunks.select("conv", "chunk", "turns", "roles", "texts", "copies", "twice").mapInArrow(_each(_chunk_table, table), table)
    behind = f"conv {kind}, chunk long, end array<long>, last boolean, n_chunks long, {_TOTALS}"
    known = chunks.join(store(tables.groupBy("conv").applyInPandas(_behind, behind), "behind").drop("conv"), "chunk")

    def exits(chunk: dict) -> dict:
        return {"conv": chunk["conv"], "chunk": chunk["chunk"], "exits": _chunk_path(chunk, [0, 1, 2, 3])[0]}

    def piece(chunk: dict) -> dict:
        _, rows, nodes, _, letter = _chunk_path(chunk, [chunk["entry"]])
        lines = rows.lines(nodes, letter[nodes], 0)
        audit = "".join(LETTERS[x - 1] for x in letter[nodes].tolist())
        return chunk | {"audit": audit, "repaired": "\n".join(lines) if lines else None}

    left = known.mapInArrow(_each(exits, f"conv {kind}, chunk long, exits array<long>"), f"conv {kind}, chunk long, exits array<long>")
    entered = left.groupBy("conv").applyInPandas(_entered, "chunk long, entry long")
    pieces = f"conv {kind}, {_PIECE}"
    return known.join(entered, "chunk").mapInArrow(_each(piece, pieces), pieces)


def repair(df: DataFrame, conv: str, turn: str, role: str, text: str, chunk_rows: int = CHUNK) -> DataFrame:
    """Pieces of the repaired conversations: ``conv, chunk, n_chunks``, the whole's counts, ``audit`` and ``repaired``.

    Most conversations are one piece. Those of several have their audit and text (lines joined by line feeds; null: no lines)
    in the order of ``chunk``; the counts (``cost, gaps, blank, duplicate, truncated, illegal``) repeat. Rows go by turn, nulls first; rows of
    one turn by role, then text. A null conversation is one like any other. A null role or text is one space. One that
    loses all rows has zero counts, no audit and an empty text. Equal rows are duplicates. Other columns are ignored, so
    their names can't clash. An empty table gives an empty table.
    """
    segments = store(_segments(_ordered(damage(df, conv, turn, role, text)), chunk_rows), "segments")
    whole = segments.where("roles IS NULL").select("conv", *[c.split()[0] for c in _PIECE.split(", ")])
    return whole.unionByName(_chunked(segments))


def digests(pieces: DataFrame) -> DataFrame:
    """``conv``, the counts, ``audit`` and ``repaired_sha256`` of each whole conversation.

    Pieces of one conversation stream through a task in order; only its audit is held.
    """
    kind = pieces.schema["conv"].dataType.simpleString()
    totals = [c.split()[0] for c in _TOTALS.split(", ")]
    columns = f"conv {kind}, {_TOTALS}, audit string, repaired_sha256 string"
    schema = _schema(columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, digest, lines = None, [], None, False

        def given() -> pa.RecordBatch:
            row = {n: now[n] for n in ("conv", *totals)}
            return pa.RecordBatch.from_pylist([row | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                piece = batch.slice(i, 1).to_pylist()[0]
                if now is None or piece["conv"] != now["conv"]:
                    if now is not None:
                        yield given()
                    now, audit, digest, lines = piece, [], hashlib.sha256(), False
                audit.append(piece["audit"])
                if piece["repaired"] is not None:
                    digest.update((("\n" if lines else "") + piece["repaired"]).encode())
                    lines = True
        if now is not None:
            yield given()

    single = pieces.where("n_chunks = 1").select(
        "conv", *totals, "audit", F.sha2(F.coalesce("repaired", F.lit("")).cast("binary"), 256).alias("repaired_sha256")
    )
    several = pieces.where("n_chunks > 1").repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(work, columns)
    return single.unionByName(several)
