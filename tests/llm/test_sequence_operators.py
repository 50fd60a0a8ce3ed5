"""Repair of conversations, repeated windows and periodic runs, against plain programmes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from intakelake.llm import conversation_repair as repair, periodic_runs as runs, queries, repeated_windows as windows
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, kept string, n_words int, runs int, _row int, _1 int, k1 int, _places int"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


# periodic runs


def runs_by_hand(words):
    out = {}
    for p in range(1, len(words) // 4 + 1):
        i = p
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - p]:
                j += 1
            if j > i and j - i + p >= max(6, 4 * p):
                out.setdefault((i - p, j), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in out.items())


@pytest.mark.parametrize("piece", [1 << 15, 7, 100])
def test_runs_by_hand(piece, monkeypatch):
    monkeypatch.setattr(runs, "PIECE", piece)
    rng, texts = random.Random(piece), [[], ["a"], ["a"] * 6, ["a"] * 5, list("abababab"), list("abababa")]
    for _ in range(600):
        n, k = rng.randrange(rng.choice([10, 60, 300])), rng.choice([1, 2, 3, 50])
        words = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            if n > 8:
                a = rng.randrange(n)
                p, b = rng.randrange(1, max(2, (n - a) // 3 + 1)), rng.randrange(a, n + 1)
                for i in range(a, b):
                    words[i] = words[a + (i - a) % p]
        texts.append(words)
    for words, got in zip(texts, runs.runs_of(texts)):
        assert got == runs_by_hand(words)


def test_long_periodic_texts_take_little():
    n = 300_000
    assert runs.runs_of([[0] * n]) == [[(0, n, 1)]]
    assert runs.runs_of([[i % 977 for i in range(n)]]) == [[(0, n, 977)]]
    assert len(runs.runs_of([[i // 6 for i in range(n)]])[0]) == n // 6


def test_runs_of_rows(spark):
    texts = [(1, None), (2, ""), (3, "a b " * 4), (3, "a b " * 4), (None, "x " + "no " * 6 + "y"), (4, "w\t" * 50_000)]
    rows = [(i, t, "k", 1, 2, 3, 4, 5, 6) for i, t in texts]
    out = runs.collapsed(spark.createDataFrame(rows, DOCS))
    assert out.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ") + ["runs_", "collapsed"]
    got = Counter((r.doc_id, r.collapsed, tuple(tuple(x) for x in r.runs_)) for r in out.collect())
    assert got == Counter([(1, "", ()), (2, "", ()), (3, "a b", ((0, 8, 2),)), (3, "a b", ((0, 8, 2),)), (None, "x no y", ((1, 6, 1),)), (4, "w", ((0, 50_000, 1),))])
    assert runs.collapsed(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_query(spark):
    want = {}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = (d.text or "").encode().split()
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = runs_by_hand(words) if n < 2500 else runs.runs_of([words])[0]
        gone = {i for s, k, p in found for i in range(s + p, s + k)}
        top = min(((-k, s, p) for s, k, p in found), default=None)
        want[d.doc_id] = (len(found), *((top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else [None] * 4), hashlib.sha256("".join(f"{s},{k},{p}\n" for s, k, p in found).encode()).hexdigest(),
                          hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in queries.op13_runs(spark, SF).collect()} == want


# repeated windows


def kept_by_hand(texts, size=windows.WINDOW):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def planted_texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    passages = [" ".join(rng.choices(words, k=n)) for n in (34, 35, 36, 80, 200)]
    texts = [None, "", "w1", " ".join(["no"] * 34), " ".join(["no"] * 35), " ".join(["no"] * 36), " \t\x0b".join(rng.choices(words, k=60))]
    for _ in range(120):
        parts = [" ".join(rng.choices(words, k=rng.randrange(90)))]
        if rng.random() < 0.7:
            parts += [rng.choice(passages), " ".join(rng.choices(words, k=rng.randrange(40)))]
        texts.append("\n".join(parts))
    texts += texts[-8:] + [texts[-1] + " end", "w9 " * 20_000]
    return texts


@pytest.mark.parametrize("sketch", ["as usual", "full"])
def test_windows_by_hand(spark, sketch, monkeypatch):
    if sketch == "full":  # whatever the sketch lets through, the second pass decides

        def full(docs):
            out = windows.Sketch(windows.BLOCK)
            out.bits[:] = 255
            return out

        monkeypatch.setattr(windows, "sketch_of", full)
    texts = planted_texts()
    docs = spark.createDataFrame([(None if i == 9 else i, t, "k", 1, 2, 3, 4, 5, 6) for i, t in enumerate(texts)], DOCS).repartition(5)
    out = windows.without_repeats(docs)
    assert out.columns[-3:] == ["kept_", "n_words_", "n_removed"] and out.columns[:-3] == docs.columns
    got = Counter((r.doc_id, r.n_words_, r.n_removed, r.kept_, r.k1) for r in out.collect())
    assert got == Counter((None if i == 9 else i, *x, 5) for i, x in enumerate(kept_by_hand(texts)))


def test_windows_without_rows(spark):
    assert windows.without_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_windows_query(spark, con):
    assert compare(spark, con, SF, queries.op12_windows, queries.OP12_SQL).startswith("ok")


def test_sketch_never_says_less():
    rng = random.Random(8)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(120))).encode() for _ in range(300)]
    got = windows.Windows(texts, windows.WordMarks(), windows.Powers())
    count, places = Counter(got.counted.tolist()), Counter()
    for i in np.flatnonzero(got.whole):
        places[int(got.anchor[i]), int(got.hash[0][i]), int(got.hash[1][i])] += 1
    assert places and all(n <= count[a] for (a, *_), n in places.items())


# conversation repair


def plain_best(symbols):
    """Row by row, audits as strings."""
    ins = {(a, b): s for a, b, s in [(0, 0, ""), (0, 2, "I"), (0, 3, "II"), (1, 1, ""), (1, 2, "I"), (1, 3, "II"), (2, 2, ""), (2, 3, "I"), (3, 3, ""), (3, 2, "I")]}

    def insert(now):
        out = {}
        for (a, b), s in ins.items():
            if a in now:
                out[b] = min(out.get(b, (10**9, "")), (now[a][0] + 2 * len(s), now[a][1] + s))
        return out

    now = {0: (0, "")}
    for c in symbols:
        new = {}
        for a, (cost, said) in insert(now).items():
            ways = [(a, 3, "D")]
            if c != "x":
                more = c.isupper()
                ways += [(b, more, "K") for (x, role), b in repair.MOVES.items() if x == a and role == c.lower()]
                ways += [(b, 2 + more, "R") for (x, role), b in repair.MOVES.items() if x == a and role != "s"]
            for b, plus, edit in ways:
                new[b] = min(new.get(b, (10**9, "")), (cost + plus, said + edit))
        now = new
    return min(v for s, v in insert(now).items() if s in repair.ENDS)


def test_plain_programme_by_enumeration():
    """The programme the tests compare with, against all audits of short strings."""

    def roles_of(symbols, audit):
        cost, rows, said = 0, iter(symbols), []
        for edit in audit:
            c = None if edit == "I" else next(rows)
            if edit == "D":
                cost += 3
                continue
            if c == "x":
                return []
            cost += {"K": 0, "R": 2, "I": 2}[edit] + (c is not None and c.isupper())
            said.append(c.lower() if edit == "K" else "ua")
        out = []
        for text in product(*said):
            text = "".join(text)
            rest = text[1:] if text[:1] == "s" else text
            if not text or (rest and rest == "ua" * (len(rest) // 2)):
                out.append((cost, audit))
        return out

    for n in range(4):
        for symbols in product("suaoUx", repeat=n):
            best = min(x for k in range(n, n + 4) for audit in product("DIKR", repeat=k) if k - audit.count("I") == n for x in roles_of(symbols, "".join(audit)))
            assert best == plain_best(symbols), symbols


def test_ropes_are_strings():
    rng, ropes = random.Random(4), [(repair.Rope(x), x) for x in ("", "D", "I", "K", "R", "DI", "KKR")]
    for _ in range(400):
        (a, s), (b, t) = rng.choice(ropes), rng.choice(ropes)
        if len(s + t) < 300:
            ropes.append((a + b, s + t))
    for _ in range(4000):
        (a, s), (b, t) = rng.choice(ropes), rng.choice(ropes)
        assert (a < b) == (s < t) and str(a) == s and (a.mark == b.mark) == (s == t)


def test_grammar_gives_the_same(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["ua", "ua", "u", "a", "sua", "A", "x", "O"]) for _ in range(rng.choice([1, 3, 6, 200]))) for _ in range(300)] + ["a" * 500, "ua" * 500]
    known = repair.grammar(spark.createDataFrame([(x,) for x in texts], "symbols string"))
    assert known.rounds and all(len(x) <= repair.PER_ROUND for x in known.rounds)
    for x in texts:
        packed = known.packed(x)
        walk = repair.Walk(known)
        for part in (x[: len(x) // 3], x[len(x) // 3 :]):
            walk.piece(part)
        assert walk.end() == plain_best(x) and len(packed) <= len(x)
    assert len(known.packed("ua" * 500)) < 50


CONV = "conv_id long, turn long, role string, text string, mark int, piece int"


def test_repair_rows(spark):
    long = [(7, i, "user" if i % 2 else "assistant", f"text {i}." if i % 5 else "cut off") for i in range(3000)]
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "system", "Be."), (2, None, "user", "Null first."), (3, 4, None, "x."), (3, 9, "user", None), (4, 0, "user", " "), (None, 1, "user", "No id."),
            (5, 0, "user", "Same."), (5, 0, "user", "Same."), (5, 3, "user", "Same."), (5, 3, "tool", "A?")] + long
    given = spark.createDataFrame([(*r, 1, 2) for r in rows], CONV).repartition(4)
    audits = {r.conv_id: r for r in repair.audited(given).collect()}
    out = {}
    for r in sorted(repair.repaired(given).collect(), key=lambda r: r.place):
        out.setdefault(r.conv_id, []).append(r)
    assert set(audits) == {1, 2, 3, 4, 5, 7, None}
    assert audits[1].audit == "KK" and audits[4].audit == "D" and (audits[4].cost, audits[4].blank) == (3, 1)
    assert (audits[5].duplicate, audits[5].gaps, audits[3].gaps, audits[3].blank) == (2, 2, 4, 1)
    assert audits[2].illegal == 1 and audits[None].audit == "KI"
    # order within a turn: by role, then hash
    assert [(r.edit, r.role, r.text) for r in out[5]] == [("K", "user", "Same."), ("D", "user", "Same."), ("R", "assistant", "A?"), ("D", "user", "Same.")]
    kinds = {"user": "u", "assistant": "a"}
    seen, symbols = set(), ""
    for _, _, role, text in long:
        symbols += "x" if (role, text) in seen else kinds[role].upper() if text[-1] != "." else kinds[role]
        seen.add((role, text))
    want = plain_best(symbols)
    assert (audits[7].cost, audits[7].audit) == want and len(out[7]) == len(want[1])
    for rows_ in out.values():
        said = "".join(r.role[:1] for r in rows_ if r.edit != "D")
        rest = said[1:] if said[:1] == "s" else said
        assert not said or (rest and rest == "ua" * (len(rest) // 2))
    assert repair.audited(given.limit(0)).count() == 0 and repair.repaired(given.limit(0)).count() == 0


def test_repair_query(spark, con):
    assert compare(spark, con, SF, queries.op11_repair, queries.OP11_SQL).startswith("ok")
