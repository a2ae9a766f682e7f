"""Word codes, vector codes and conversation repair against the library, plain rounds and a plain search."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from liftgrid.llm import convrepair, queries, vectorcodes, wordcodes

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_transducer_holds_its_words_and_shares_suffixes(tmp_path):
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abcd", k=rng.randint(1, 7))) + rng.choice(["", "tion", "ed"]) for _ in range(3000)})
    ids = [rng.choices(range(9), k=rng.randint(0, 3)) for _ in words]
    built = wordcodes.Transducer.compile((w.encode(), i) for w, i in zip(words, ids, strict=True))
    (tmp_path / "t").write_bytes(built.dump())
    mapped = wordcodes.Transducer.map(str(tmp_path / "t"))
    other = ["", "a" * 40, "zzz", "tion"]
    held, lists = mapped.walk([w.encode() for w in words + other])
    assert held.tolist() == [True] * len(words) + [w in words for w in other]
    assert [lists.ids[lists.at[i] : lists.at[i + 1]].tolist() for i in range(len(words))] == ids
    plain = wordcodes.Transducer.compile((w.encode(), ()) for w in words)
    assert plain.ends.size < len({w[:k] for w in words for k in range(len(w) + 1)}) / 3
    # Minimal: no two states of an acceptor have the same words behind them.
    arcs: dict[int, list] = {s: [] for s in range(plain.ends.size)}
    for key, target in zip(plain.keys.tolist(), plain.targets.tolist(), strict=True):
        arcs[key >> 8].append((key & 255, target))
    assert len({(plain.ends[s] >= 0, tuple(a)) for s, a in arcs.items()}) == plain.ends.size
    assert wordcodes.Transducer.compile([]).walk([b"a"])[0].tolist() == [False]


TEXTS = [
    "", "  \n\n ", "Hello, world! It's 2024; don't.", "a<|endoftext|>b <|startoftext|>x<|endoftext|><|startoftext|>",
    "<|ENDOFTEXT|> <|endoftext|", "\u0130stanbul \u03a3\u0391\u03a3 \u1e9e STRASSE e\u0301 caf\u00e9 \u01c5", "b\x1cc\x85d\xa0e\u2028f\tg\r\nh \x00 \x7f",
    "123 \u0661\u0662 \u00bd \u2460", "'ll I'LL we've 'S", "x" * 5000 + " " + "ab" * 3000 + "!?" * 2000 + "a" * 3001,
    "\u65e5\u672c\u8a9e\u30c6\u30ad\u30b9\u30c8 \u4e2d\u6587" * 300, "\U0001f642\U0001f643 \ufeff\u200b", "the the the of of in",
]


def test_word_codes_are_those_of_the_library(spark):
    library = Tokenizer.from_file(WORDS)
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(None, "no key", 1, "x"), (3, None, 1, "x"), (0, "again", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int, ids string")
    for lexicon in (None, wordcodes.build_lexicon(spark, [], WORDS)):
        coded = wordcodes.encode(df, "doc_id", "text", WORDS, lexicon)
        back = wordcodes.decode(coded, "k", "ids", WORDS, "n_tokens").collect()
        found = Counter((r["k"], r["n_tokens"], bytes(r["ids"])) for r in coded.collect())
        want = [(k, library.encode(t or "", add_special_tokens=False).ids) for k, t, *_ in rows]
        assert found == Counter((k, len(ids), np.array(ids, "<u4").tobytes()) for k, ids in want)
        assert Counter((r["k"], r["text"]) for r in back) == Counter((k, library.decode(ids, skip_special_tokens=False)) for k, ids in want)
    assert wordcodes.encode(df.limit(0), "doc_id", "text", WORDS).collect() == []
    odd = spark.createDataFrame([(1, bytearray(np.array([0, 70000, 49407], "<u4").tobytes())), (2, None)], "k int, ids binary")
    assert [r["text"] for r in wordcodes.decode(odd, "k", "ids", WORDS).orderBy("k").collect()] == ["! <|endoftext|>", ""]


def test_merging_at_once_equals_merging_with_a_heap():
    t = wordcodes.tokenizer(WORDS)
    assert t.together
    rng = random.Random(5)
    words = ["".join(rng.choices("aabbcelnortsé", k=rng.randint(1, 40))).encode() for _ in range(2000)] + [b"a" * n for n in range(1, 60)]
    lists = t.merge(words)
    assert [lists.ids[lists.at[i] : lists.at[i + 1]].tolist() for i in range(len(words))] == [t._merge_long(w) for w in words]


def test_frequent_chunks_count_all_texts(spark):
    texts = ["a b b", None, "", "b c\nc c", "c d"] * 30
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    # c: 120 times, b: 90, nothing: 60 (null and empty texts are one each), a and d: 30.
    assert wordcodes.frequent_chunks(df, "text", 2) == ["b", "c"]
    assert wordcodes.frequent_chunks(df, "text", 4) == ["", "b", "c"]
    assert wordcodes.frequent_chunks(df, "text", 5) == ["", "a", "b", "c", "d"]
    assert wordcodes.frequent_chunks(df.limit(0), "text") == []


def test_word_query_on_documents(spark, folder):
    library = Tokenizer.from_file(WORDS)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_word_transducer"](spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids),
            hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(),
        )


def plain_lloyd(rows, parts=16, entries=64, rounds=2):
    """Whole rescans in Python integers; ``rows``: (key, vector, label) in codebook order."""
    width = -(-len(rows[0][1]) // parts)
    whole = []
    for _, v, _ in rows:
        ints = [math.floor(256 * x) if abs(x) < 1e15 else 256 * int(x) for x in v] + [0] * (width * parts - len(v))
        whole.append([ints[p * width : (p + 1) * width] for p in range(parts)])
    books = [[w[p] for w in whole[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c, strict=True)), j) for j, c in enumerate(book))

    for _ in range(rounds):
        at = [[nearest(w[p], books[p])[1] for p in range(parts)] for w in whole]
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [w[p] for w, a in zip(whole, at, strict=True) if a[p] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [[nearest(w[p], books[p]) for p in range(parts)] for w in whole]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [("".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f)) for f in found], digest


def checked_codes(spark, rows, **settings):
    df = spark.createDataFrame([(k, v, y, 1, "x") for k, v, y in rows], "vec_id long, embedding array<double>, label int, code int, v string")
    coded, books = vectorcodes.encode(df, "vec_id", "embedding", "label", **settings)
    found = vectorcodes.with_label_error(coded).select("k", F.lower(F.hex("code")).alias("code"), "error", "label", "label_error", "length").collect()
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    want = []
    for length in {len(v) for _, v, _ in kept}:
        mine = sorted((r for r in kept if len(r[1]) == length), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        codes, digest = plain_lloyd(mine, **settings)
        assert books[length].digest() == digest
        want += [(r[0], code, error, r[2]) for r, (code, error) in zip(mine, codes, strict=True)]
    fit = [(k, c, e if e < 1 << 63 else None, y) for k, c, e, y in want]
    assert Counter((r["k"], r["code"], r["error"], r["label"]) for r in found) == Counter(fit)
    for y in {w[3] for w in want}:
        errors = [w[2] for w in fit if w[3] == y]
        total = None if None in errors or sum(errors) >= 1 << 63 else sum(errors)
        assert {r["label_error"] for r in found if r["label"] == y} == {total}


def test_vector_codes_equal_plain_rounds(spark):
    rng = np.random.default_rng(7)
    rows = [(i, v, int(i % 3)) for i, v in enumerate((rng.standard_normal((300, 32)) * 0.2).round(2).tolist())]
    rows += [(400 + i, rows[5][1], None) for i in range(40)] + [(7, rows[9][1], 1), (7, rows[8][1], 1), (None, rows[3][1], 0)]
    rows += [(500, None, 1), (501, [None] * 32, 1), (502, [float("nan")] * 32, 1), (503, [float("inf")] * 32, 1)]
    checked_codes(spark, rows)
    checked_codes(spark, rows, rounds=5)
    checked_codes(spark, rows, rounds=0)


def test_vector_codes_of_odd_lengths_and_huge_components(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v, 1) for i, v in enumerate(rng.integers(-3, 3, (90, 5)).astype(float).tolist())]
    rows += [(200 + i, v, i % 2) for i, v in enumerate((rng.standard_normal((80, 16)) * 10.0 ** rng.integers(-3, 9, (80, 1))).tolist())]
    rows += [(300, [1e300] * 16, 0), (-1, [-1.7e308] * 16, 0), (301, [], None), (302, [], 2), (303, [4095.0] * 16, 5)]
    checked_codes(spark, rows)
    checked_codes(spark, [(1, [0.5] * 16, None)])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    coded, books = vectorcodes.encode(empty, "vec_id", "embedding", "label")
    assert vectorcodes.with_label_error(coded).collect() == [] and books == {}


def test_stored_distances_spare_only_entries_that_stayed():
    rng = np.random.default_rng(3)
    rows, entries = rng.integers(-9, 9, (400, 8)), rng.integers(-9, 9, (2, 20, 4))
    before = vectorcodes.Codebooks(entries, np.ones((2, 20), bool))
    code, held = before.assign(rows, None, None)
    new = entries.copy()
    new[:, ::3] = rng.integers(-9, 9, new[:, ::3].shape)
    after = vectorcodes.Codebooks(new, (new != entries).any(axis=2))
    assert 0 < after.moved.mean() < 0.5
    for a, b in zip(after.assign(rows, code, held), after.assign(rows, None, None), strict=True):
        assert (a == b).all()


def test_decoded_vectors_have_the_stated_error(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((100, 32))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    coded, books = vectorcodes.encode(df, "vec_id", "embedding", "label")
    for r in coded.collect():
        apart = vectorcodes.decode(bytes(r["code"]), books[32], 32) - np.floor(256 * vectors[r["k"]]).astype(int)
        assert (apart * apart).sum() == r["error"]


SPACE = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """Counts, cost, audit and digest of damaged ``(turn, role, text)`` by a search over (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        wanted = "a" if state == "u" else "u"
        word = {"u": "user", "a": "assistant"}[wanted]
        heapq.heappush(heap, (cost + 3, audit + "I", i, wanted, (*lines, word + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, lines))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, wanted, (*lines, f"{word}:{text}")))
                initial = role[:1]
                if initial == wanted or (initial == "s" and state == ""):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, initial, (*lines, f"{role}:{text}")))
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True)),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def plain_damage(rows):
    out: dict = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def talks(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User", "à"])
            text = rng.choice(["Yes.", "No", "Why?", " ok! ", "\u00a0", "", "\t\n", None, f"Line {turn}.", f"Line {turn}", "A:\nb."])
            rows.append((c, rng.choice([turn] * 8 + [None, 3, -2]), role, text))
    return rows


def compared(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, n string, chunk int").repartition(4)
    found = convrepair.digests(convrepair.repair(df, "conv_id", "turn", "role", "text", **settings)).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    want = {c: plain_repair(r) for c, r in plain_damage(rows).items()}
    assert len(found) == len(want)
    assert {r["conv"]: tuple(r[n] for n in names) for r in found} == want


@pytest.mark.parametrize("chunk_rows", [1, 3, 4096])
def test_repair_equals_a_plain_search(spark, chunk_rows):
    rows = talks(chunk_rows, 60, 14)
    compared(spark, rows + rows[:40] + [(None, t, r, x) for _, t, r, x in rows[:9]], chunk_rows=chunk_rows)


def test_repair_of_one_conversation_cut_between_tasks(spark):
    """A conversation with nearly all rows, many of them equal, in chunks of 16 rows."""
    long = [(5, t, r, x) for _, t, r, x in talks(9, 40, 12)]
    compared(spark, long + [(5, 7, "user", "Same again.")] * 100 + talks(2, 5, 6)[:20], chunk_rows=16)


def test_repair_of_nothing_and_of_conversations_that_lose_all(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert convrepair.digests(convrepair.repair(empty, "conv_id", "turn", "role", "text")).collect() == []
    lost = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:8]
    compared(spark, [(c, 0, "user", "Hello.") for c in lost])


def test_repair_query_on_conversations(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: plain_repair(r) for c, r in plain_damage(rows).items()}
    found = queries.QUERIES["op13_conversation_paths"](spark, folder).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert {r["conv_id"]: tuple(r[n] for n in names) for r in found} == want and len(found) == len(want)


def test_vector_query_on_embeddings(spark, folder):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    codes, digest = plain_lloyd(sorted(rows, key=lambda r: r[0]))
    want = {r[0]: (*c, r[2]) for r, c in zip(sorted(rows, key=lambda r: r[0]), codes, strict=True)}
    total = Counter()
    for _, error, label in want.values():
        total[label] += error
    found = queries.QUERIES["op12_active_codes"](spark, folder).collect()
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in found} == {
        k: (c, e, total[y], digest) for k, (c, e, y) in want.items()
    }
