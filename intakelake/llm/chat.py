"""Prefix-target expansion of conversations.

Every assistant turn becomes an example of its own: all turns before it are its context, and only its
text is trainable. The example's text is the formatted prefix of the conversation up to and with that
turn; the loss mask is one span of it. Turns after the last assistant turn (or of a conversation that
has none) follow in one closing row without a trainable span, so that the output holds the whole
conversation and can be read back.

A turn is ``<|role|>`` + role + newline + text + ``<|end|>``. The bars of these marks cannot come from a
text: in roles and texts the escape sign is doubled and ``<|`` gets the escape sign between its two
characters, which :func:`unescape` undoes. So control strings of this or any template inside a text
stay text.

Conversations are dealt by conv_id and read in order of turn, one at a time; a task holds one
conversation's formatted prefix, which is what its last example holds in any case. Defined cases: a
null text or role is empty; turns that are equal are ordered by role and text, a null turn comes first;
rows without conv_id form one conversation; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BATCH_BYTES, BATCH_ROWS, arrow_pass

ROLE, END, ESCAPE = "<|role|>", "<|end|>", "\x10"
TRAINED = "assistant"
EXAMPLE = "conv_id long, example long, closing boolean, text string, loss_start long, loss_end long"
_TURN = re.compile(re.escape(ROLE) + r"(.*?)\n(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    """Reversibly, without leaving the two characters that begin a mark side by side."""
    return text.replace(ESCAPE, ESCAPE * 2).replace("<|", "<" + ESCAPE + "|")


def unescape(text: str) -> str:
    return re.sub(f"<{ESCAPE}\\||{ESCAPE}{ESCAPE}", lambda m: "<|" if len(m[0]) == 3 else ESCAPE, text)


def escape_role(role: str) -> str:
    """A role also keeps its newlines apart from the one that ends it."""
    return escape(role).replace("\n", ESCAPE + "n")


def unescape_role(role: str) -> str:
    return re.sub(f"<{ESCAPE}\\||{ESCAPE}{ESCAPE}|{ESCAPE}n", lambda m: {2: "\n" if m[0][1] == "n" else ESCAPE, 3: "<|"}[len(m[0])], role)


def examples(conversations: DataFrame) -> DataFrame:
    """One row for each assistant turn, in order, and a closing row where turns are left."""
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = [x.split()[0] for x in EXAMPLE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        conv, parts, length, number, left = None, None, 0, 0, 0
        for b in batches:
            for conv_id, _, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if parts is None or conv_id != conv:
                    if left:
                        out.append((conv, number, True, "".join(parts)[-left:], None, None))
                    conv, parts, length, number, left = conv_id, [], 0, 0, 0
                before, body = f"{ROLE}{escape_role(role)}\n", escape(text)
                parts.append(before + body + END)
                start, length = length + len(before), length + len(parts[-1])
                left += len(parts[-1])
                if role == TRAINED:
                    parts = ["".join(parts)]
                    out.append((conv, number, False, parts[0], start, start + len(body)))
                    number, left, size = number + 1, 0, size + length
                if len(out) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield batch()
                    out, size = [], 0
        if left:
            out.append((conv, number, True, "".join(parts)[-left:], None, None))
        if out:
            yield batch()

    return arrow_pass(rows, run, EXAMPLE)


def read_turns(text: str) -> list[tuple[str, str]]:
    """The turns a formatted text holds."""
    return [(unescape_role(role), unescape(body)) for role, body in _TURN.findall(text)]


def digests(expanded: DataFrame) -> DataFrame:
    """For each conversation what its examples say when read back.

    Reads the output of :func:`examples`, whose rows of a conversation follow each other in a task.
    Turns are read from the longest example and the closing row; trained text from each loss span.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, longest, out = None, None, "", []

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha" in n else pa.int64()) for c, n in zip(zip(*out), names)], names)

        def turns_of(text: str) -> None:
            for role, body in read_turns(text):
                state["n"] += 1
                state["turns"].update(f"{role}\n{body}\n".encode())

        def done() -> None:
            turns_of(longest)
            turns_of(state["rest"])
            out.append((conv, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"], state["examples"]))

        for b in batches:
            for conv_id, _, closing, text, start, end in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or conv_id != conv:
                    if state is not None:
                        done()
                    conv, longest, state = conv_id, "", {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "examples": 0, "rest": ""}
                state["size"] += len(text)
                if closing:
                    state["rest"] = text
                    continue
                trained = unescape(text[start:end])
                state["chars"] += len(trained)
                state["loss"].update(trained.encode())
                state["examples"] += 1
                longest = text
            if len(out) >= BATCH_ROWS:
                yield table()
                out = []
        if state is not None:
            done()
        if out:
            yield table()

    return arrow_pass(expanded, run, schema)
