"""Conversations repaired at least cost, by a grammar-compressed dynamic programme.

A repaired conversation has the roles ``(system? (user assistant)+)?``. Each row is kept (K, free), given
the role user or assistant (R), or deleted (D); rows of empty text with one of these roles are inserted
anywhere (I). Blank rows, and rows whose role and text stood earlier, must go; a truncated row that stays
costs one more. Of the cheapest audits, the strings of edits in order, the least in ASCII is taken; an
audit fixes the repaired roles.

A row's role and fault are one symbol, a conversation a string of symbols, cut into pieces. Re-Pair over
the distinct pieces of all conversations replaces the most frequent pairs by new symbols, round by round:
pairs are counted where the pieces lie, and only a round's most frequent ones come to the driver (PER_ROUND
for each of ROUNDS at most; a shorter grammar means more steps later, nothing else). Each symbol has one
transfer matrix: for two states (nothing, system, user or assistant said last) the least cost to get from
one to the other, and its audit as a rope. A rule's matrix is the min-plus product of its two symbols',
made once, bottom-up, and sent to all tasks; a conversation multiplies what its compressed pieces hold.
Audits of one cost over the same rows never begin one another (what is left would be paid insertions), so
the least audit of a product is made of least audits.

Rows are ordered by turn, role and hash of text, across tasks; pieces end where tasks end. Their matrices'
product goes on from piece to piece, and of the audits only the part in which the states differ is held
as rope. Texts move once, to be edited in order, in :func:`repaired`.

Defined cases: a null role or text is one space, and so blank; null turns come first; equal turns are in
the order of role and of the text's SHA-256; equal rows follow each other, the first is no duplicate; rows
without conv_id form one conversation; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import BATCH_BYTES, BATCH_ROWS, arrow_pass, written

#: States by what was said last: nothing, system, user, assistant. A conversation may end in the first and the last.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ENDS, SAYS = range(4), (0, 3), {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: A row's symbol: its role's initial (o for any other), upper case if it is truncated; x for rows that must go.
SYMBOLS = "suaoSUAOx"
#: Rows of a piece, rounds of Re-Pair and new symbols of a round, and pieces whose answer a task keeps at hand.
PIECE, ROUNDS, PER_ROUND, HELD = 1024, 16, 256, 100_000
#: A round is the last if it shortens the pieces by less than one part in this many.
WORTH = 1000
_FIRST, _PRIME, _BASE = 0xF0000, (1 << 61) - 1, 1_000_003


class Rope:
    """A string as a tree of parts; equal parts are known by size and hash."""

    __slots__ = ("size", "mark", "text", "left", "right")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None) -> None:
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.size, self.mark = len(text), 0
            for c in text:
                self.mark = (self.mark * _BASE + ord(c)) % _PRIME
        else:
            self.size = left.size + right.size
            self.mark = (left.mark * pow(_BASE, right.size, _PRIME) + right.mark) % _PRIME

    def __add__(self, other: Rope) -> Rope:
        return other if not self.size else self if not other.size else Rope("", self, other)

    def __lt__(self, other: Rope) -> bool:
        mine, its = [self], [other]
        while mine and its:
            a, b = mine.pop(), its.pop()
            if a.size == b.size and a.mark == b.mark:
                continue
            if a.left is not None and (a.size >= b.size or b.left is None):
                mine += (a.right, a.left)
                its.append(b)
            elif b.left is not None:
                its += (b.right, b.left)
                mine.append(a)
            else:
                n = min(a.size, b.size)
                if a.text[:n] != b.text[:n]:
                    return a.text[:n] < b.text[:n]
                if a.size > n:
                    mine.append(Rope(a.text[n:]))
                if b.size > n:
                    its.append(Rope(b.text[n:]))
        return bool(its)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if x.left is None:
                out.append(x.text)
            else:
                todo += (x.right, x.left)
        return "".join(out)


#: Of each pair of states the cheapest way and its audit; None where there is none.
Matrix = list[list["tuple[int, Rope] | None"]]


def better(a: tuple[int, Rope] | None, b: tuple[int, Rope] | None) -> tuple[int, Rope] | None:
    if a is None or b is None:
        return a or b
    return b if b[0] < a[0] or (b[0] == a[0] and b[1] < a[1]) else a


def times(row: list, matrix: Matrix) -> list:
    """A row of ways multiplied by a matrix."""
    out = []
    for j in STATES:
        best = None
        for k in STATES:
            if row[k] is not None and matrix[k][j] is not None:
                best = better(best, (row[k][0] + matrix[k][j][0], row[k][1] + matrix[k][j][1]))
        out.append(best)
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    return [times(row, b) for row in a]


def insertions() -> Matrix:
    """From state to state by insertions alone."""
    out: Matrix = [[(0, Rope()) if i == j else None for j in STATES] for i in STATES]
    for _ in STATES:
        for i in STATES:
            for (k, role), j in MOVES.items():
                if role in SAYS and out[i][k] is not None:
                    out[i][j] = better(out[i][j], (out[i][k][0] + INSERT, out[i][k][1] + Rope("I")))
    return out


def terminal(symbol: str) -> Matrix:
    """Insertions, then what one row can become."""
    own: Matrix = [[None] * 4 for _ in STATES]
    for i in STATES:
        own[i][i] = (DELETE, Rope("D"))
        for (k, role), j in MOVES.items():
            if k != i or symbol == "x":
                continue
            more = TRUNCATED * symbol.isupper()
            if role == symbol.lower():
                own[i][j] = better(own[i][j], (KEEP + more, Rope("K")))
            if role in SAYS:
                own[i][j] = better(own[i][j], (REROLE + more, Rope("R")))
    return product(insertions(), own)


class Grammar:
    """Rounds of rules, new symbol by pair, and the matrix of each symbol."""

    def __init__(self, rounds: list[dict[str, str]]) -> None:
        self.rounds = rounds
        self.matrices = {c: terminal(c) for c in SYMBOLS}
        for rules in rounds:
            for pair, symbol in rules.items():
                self.matrices[symbol] = product(self.matrices[pair[0]], self.matrices[pair[1]])

    def packed(self, symbols: str) -> str:
        for rules in self.rounds:
            symbols = replaced(symbols, rules)
        return symbols


def replaced(symbols: str, rules: dict[str, str]) -> str:
    """A round's pairs never share a place, so their order does not matter."""
    for pair, symbol in rules.items():
        if pair in symbols:
            symbols = symbols.replace(pair, symbol)
    return symbols


def chosen(pairs: list[tuple[str, int]], begin: int) -> dict[str, str]:
    """The most frequent pairs whose places cannot overlap: no symbol is the first of one and the second of another."""
    first: set[str] = set()
    second: set[str] = set()
    out: dict[str, str] = {}
    for pair, n in pairs:
        a, b = pair
        if n < 2 or len(out) == PER_ROUND or a in second or b in first or (a == b and a in first):
            continue
        first.add(a)
        second.add(b)
        out[pair] = chr(_FIRST + begin + len(out))
    return out


def pair_counts(pieces: DataFrame) -> DataFrame:
    """pair and n: how often each pair of symbols can be replaced in pieces that stand ``n`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter[str] = Counter()
            for symbols, n in zip(*(c.to_pylist() for c in b.columns)):
                for pair in {symbols[i : i + 2] for i in range(len(symbols) - 1)}:
                    counts[pair] += n * symbols.count(pair)
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["pair", "n"])

    return arrow_pass(pieces.select("symbols", "n"), run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def grammar(pieces: DataFrame) -> Grammar:
    """Re-Pair over the strings of ``symbols``."""
    left = written(pieces.groupBy("symbols").agg(F.count("*").alias("n")), "pieces")
    total = left.agg(F.sum(F.length("symbols") * F.col("n"))).first()[0] or 0
    rounds: list[dict[str, str]] = []
    for _ in range(ROUNDS):
        top = pair_counts(left).orderBy(F.desc("n"), "pair").limit(4 * PER_ROUND).collect()
        rules = chosen([(r.pair, r["n"]) for r in top], sum(map(len, rounds)))
        saved = sum(r["n"] for r in top if r.pair in rules)
        if not rules or saved * WORTH < total:
            break
        rounds.append(rules)

        def run(batches: Iterator[pa.RecordBatch], rules=rules) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([replaced(x, rules) for x in b.column(0).to_pylist()], pa.string()), b.column(1)], ["symbols", "n"])

        left = written(arrow_pass(left, run, "symbols string, n long"), "pieces")
    return Grammar(rounds)


def _rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and mark, the hash that orders rows of one turn and role."""
    space = lambda c: F.coalesce(c, F.lit(" "))
    return conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text")).withColumn("mark", F.sha2("text", 256))


ORDER = ["conv_id", "turn", "role", "mark"]


def faulted(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, mark, initial, blank, truncated, and later: whether role and text stood in an earlier turn. No texts."""
    initial = F.substring("role", 1, 1)
    light = _rows(conversations).select(*ORDER, F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
                                        F.col("text").rlike(r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z").alias("truncated"))
    # a null turn is the least one
    firsts = light.groupBy("conv_id", "role", "mark").agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("none"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("mark").alias("m"), F.when(~F.col("none"), F.col("least")).alias("first"))
    met = light.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("mark") == F.col("m")), "left")
    return met.select(*light.columns, (F.col("m").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))).alias("later"))


COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
LEGAL = {"su", "ua", "au"}


def pieces_of(rows: DataFrame) -> DataFrame:
    """Conversations as pieces: conv_id, piece (in order), symbols, first and last initial and turn, and COUNTS of what lies inside."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, piece long, symbols string, head string, tail string, low long, high long, " + ", ".join(f"{c} long" for c in COUNTS)
    laid = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out, conv_type = TaskContext.get().partitionId() << 40, [], None
        names = ["conv_id", "piece", "symbols", "head", "tail", "low", "high", *COUNTS]
        key, now, symbols, before = None, None, [], None

        def table() -> pa.RecordBatch:
            kinds = [conv_type, pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * 7]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        def done() -> None:
            nonlocal number
            out.append((key, number, "".join(symbols), now["head"], now["tail"], now["low"], now["high"], *[now[c] for c in COUNTS]))
            number += 1

        for b in batches:
            conv_type = b.schema.field(0).type
            for conv, turn, role, mark, initial, blank, truncated, later in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or conv != key or len(symbols) == PIECE:
                    if now is not None:
                        done()
                        if len(out) >= BATCH_ROWS:
                            yield table()
                            out.clear()
                    key, symbols, now = conv, [], dict.fromkeys(COUNTS, 0) | {"head": initial, "tail": None, "low": None, "high": None}
                again = later or before == (conv, turn, role, mark)
                fault = "blank" if blank else "duplicate" if again else "truncated" if truncated else None
                if fault:
                    now[fault] += 1
                symbols.append("x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
                if now["tail"] is not None and now["tail"] + initial not in LEGAL:
                    now["illegal"] += 1
                now["tail"] = initial
                if turn is not None and turn != now["high"]:
                    now["turns"] += 1
                    now["low"], now["high"] = turn if now["low"] is None else now["low"], turn
                before = (conv, turn, role, mark)
        if now is not None:
            done()
        if out:
            yield table()

    return arrow_pass(laid, run, schema)


class Walk:
    """Least costs and audits along one conversation."""

    def __init__(self, grammar: Grammar) -> None:
        self.grammar, self.said, self.row = grammar, [], [(0, Rope()), None, None, None]

    def piece(self, symbols: str) -> None:
        for symbol in self.grammar.packed(symbols):
            self.row = times(self.row, self.grammar.matrices[symbol])
        # what all states' audits begin with is settled
        texts = [None if x is None else str(x[1]) for x in self.row]
        common = commonprefix([x for x in texts if x is not None])
        self.said.append(common)
        self.row = [None if x is None else (x[0], Rope(t[len(common) :])) for x, t in zip(self.row, texts)]

    def end(self) -> tuple[int, str]:
        best = None
        for way in (times(self.row, insertions())[s] for s in ENDS):
            best = better(best, way)
        return best[0], "".join(self.said) + str(best[1])


def audited(conversations: DataFrame) -> DataFrame:
    """For each conversation: blank, duplicate, truncated and illegal counts, gaps between its turns, cost and audit."""
    pieces = written(pieces_of(written(faulted(conversations), "rows")), "pieces")
    known = pieces.sparkSession.sparkContext.broadcast(grammar(pieces))
    schema = f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, held, out, size, kind = known.value, {}, [], 0, None
        key, now, strings, walk = None, None, None, None

        def table() -> pa.RecordBatch:
            kinds = [kind, *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        def done() -> None:
            if walk is None:  # one piece, as most are
                if strings not in held:
                    if len(held) >= HELD:
                        held.clear()
                    short = Walk(rules)
                    short.piece(strings)
                    held[strings] = short.end()
                cost, audit = held[strings]
            else:
                walk.piece(strings)
                cost, audit = walk.end()
            gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
            out.append((key, gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], cost, audit))

        for b in batches:
            kind = b.schema.field(0).type
            for row in b.to_pylist():
                if now is None or row["conv_id"] != key:
                    if now is not None:
                        done()
                        size += len(out[-1][-1])
                        if len(out) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield table()
                            out, size = [], 0
                    key, now, strings, walk = row["conv_id"], row, row["symbols"], None
                    continue
                walk = walk or Walk(rules)
                walk.piece(strings)
                strings = row["symbols"]
                row["illegal"] += now["tail"] + row["head"] not in LEGAL
                row["turns"] -= row["low"] is not None and row["low"] == now["high"]
                for c in COUNTS:
                    row[c] += now[c]
                row["low"] = row["low"] if now["low"] is None else now["low"]
                row["high"] = now["high"] if row["high"] is None else row["high"]
                now = row
        if now is not None:
            done()
        if out:
            yield table()

    return arrow_pass(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece"), run, schema)


def repaired(conversations: DataFrame, audits: DataFrame | None = None) -> DataFrame:
    """The rows of each conversation after its cheapest repair, in order, and the rows deleted.

    conv_id, place (from 0), edit (K, R, D or I), turn (null for inserted rows), role and text: for deleted rows
    those they had. Rows of a conversation follow each other in a task, which holds its audit.
    """
    audits = audited(conversations) if audits is None else audits
    rows = _rows(conversations).select("conv_id", F.lit(1).alias("late"), F.col("turn").cast("long").alias("turn"), "role", "mark", "text")
    first = audits.select("conv_id", F.lit(0).alias("late"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("mark"), F.col("audit").alias("text"))
    laid = first.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "late", "turn", "role", "mark").drop("mark")
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place long, edit string, turn long, role string, text string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, kind = [], 0, None
        key, audit, place, last = None, "", 0, ""

        def table() -> pa.RecordBatch:
            kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        def put(turn: int | None, role: str | None, text: str) -> None:
            nonlocal place, last, size
            edit = audit[place]
            if edit != "D":
                role = role if edit == "K" else SAYS["a" if last == "u" else "u"]
                last = role[:1]
            out.append((key, place, edit, turn, role, text))
            place, size = place + 1, size + len(text)

        def inserted() -> None:
            while place < len(audit) and audit[place] == "I":
                put(None, None, "")

        for b in batches:
            kind = b.schema.field(0).type
            for conv, late, turn, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if not late:
                    key, audit, place, last = conv, text, 0, ""
                else:
                    put(turn, role, text)
                inserted()
                if len(out) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield table()
                    out, size = [], 0
        if out:
            yield table()

    return arrow_pass(laid, run, schema)


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, audit and repaired_sha256 of the rows that :func:`repaired` gives: their edits in order, and
    the hash of ``role:text`` of those that stay, joined by newlines."""
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, kind, edits, mark, some = [], None, None, None, None, False

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (kind, pa.string(), pa.string()))], ["conv_id", "audit", "repaired_sha256"])

        for b in batches:
            kind = b.schema.field(0).type
            for conv, place, edit, _, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if not place:
                    if edits is not None:
                        out.append((key, "".join(edits), mark.hexdigest()))
                    key, edits, mark, some = conv, [], hashlib.sha256(), False
                edits.append(edit)
                if edit != "D":
                    mark.update(("\n" * some + f"{role}:{text}").encode())
                    some = True
            if len(out) >= BATCH_ROWS:
                yield table()
                out = []
        if edits is not None:
            out.append((key, "".join(edits), mark.hexdigest()))
        if out:
            yield table()

    return arrow_pass(rows, run, schema)
