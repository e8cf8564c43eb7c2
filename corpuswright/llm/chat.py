"""Chat formatting by token-level assembly.

Every turn becomes START role NEWLINE text END NEWLINE. Role and text are encoded
apart from the markers, whose ids are reserved ones that no text encodes to; which
tokens carry loss follows from the parts' lengths by prefix sums. Control strings
inside a text are escaped: one more backslash is put between the signs of an opening,
so that no text contains an opening as such, and reading back takes one away.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .batches import flat, kept_in_worker, slices

START_TEXT, END_TEXT = "<|im_start|>", "<|im_end|>"
LEARNT_ROLES = ("assistant",)
_OPENING = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPENING.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role stands on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


class Template:
    """Tokenizer with two reserved ids behind its vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.tokens = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.start = max(ranks.values()) + 1
        self.end = self.start + 1
        self.roles: dict[str, list[int]] = {}
        self.newline = self.tokens.encode_ordinary("\n")

    def encode(self, text: str) -> list[int]:
        """Ids of a text as a whole; the tokenizer's time is linear in a long run, too."""
        return self.tokens.encode_ordinary(text)

    def turn(self, role: str, text: str) -> tuple[list[int], list[int]]:
        """Ids of a turn, and the lengths of its parts: head, text, tail."""
        if role not in self.roles:
            if len(self.roles) > 1000:
                self.roles.clear()
            self.roles[role] = [self.start, *self.encode(escape_role(role)), *self.newline]
        head, body = self.roles[role], self.encode(escape(text))
        return [*head, *body, self.end, *self.newline], [len(head), len(body), 1 + len(self.newline)]

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str | None, int]:
        """Role, text, text under the mask (None if nothing is) and formatted
        characters of one turn, from its ids."""
        marks = np.flatnonzero(ids >= self.start)
        if len(marks) != 2 or ids[marks[0]] != self.start or ids[marks[1]] != self.end or marks[0] != 0:
            raise ValueError("not one turn")
        inside = self.tokens.decode(ids[1 : marks[1]].tolist())
        rest = self.tokens.decode(ids[marks[1] + 1 :].tolist())
        role, _, text = inside.partition("\n")
        under = np.flatnonzero(mask)
        learnt = None
        if len(under):
            if under[-1] - under[0] + 1 != len(under):
                raise ValueError("the mask of a turn has a gap")
            learnt = unescape(self.tokens.decode(ids[under[0] : under[-1] + 1].tolist()))
        return unescape_role(role), unescape(text), learnt, len(START_TEXT) + len(inside) + len(END_TEXT) + len(rest)


def _shipped(spark, ranks_path: str, pattern: str):
    with open(ranks_path, "rb") as f:
        raw = f.read()
    sent = spark.sparkContext.broadcast((hashlib.sha256(raw + pattern.encode()).hexdigest(), raw, pattern))

    def template() -> Template:
        def make():
            import base64

            lines = (line.split() for line in raw.splitlines() if line)
            return Template({base64.b64decode(a): int(b) for a, b in lines}, pattern)

        key, raw, pattern = sent.value
        return kept_in_worker(f"chat-{key}", make)

    return template


def assemble(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    column: str = "text",
    learnt: tuple[str, ...] = LEARNT_ROLES,
) -> DataFrame:
    """``key, position, token_start, ids, mask`` for every row.

    ``position`` numbers a conversation's rows from 0 by turn (null first; equal turns
    in the order of their tokens), ``token_start`` is the row's place in the
    conversation's tokens, ``mask`` marks the text tokens of ``learnt`` roles. A
    conversation's sequence is its rows' ids, one after the other, so a conversation
    of any length is never one row. Null roles and texts are empty; a null key is a
    conversation of its own. Turns are encoded before anything is shuffled.
    """
    template = _shipped(df.sparkSession, ranks_path, pattern)
    rows = df.select(F.col(key).alias("c0"), F.col(turn).alias("c1"), F.col(role).cast("string").alias("c2"), F.col(column).cast("string").alias("c3"))

    def encode(batches):
        for part in slices(batches, "c3"):
            t = template()
            made = [t.turn(r or "", x or "") for r, x in zip(part.column("c2").to_pylist(), part.column("c3").to_pylist())]
            ids = pa.array([array("I", i).tobytes() for i, _ in made], pa.binary())
            lengths = np.array([n for _, n in made], np.int64)
            # Where a part starts and ends among all tokens of the batch; loss is on
            # between a learnt text's start and end.
            ends = np.cumsum(lengths.ravel())
            on = np.array([r in learnt for r in part.column("c2").to_pylist()])
            marks = np.zeros(int(ends[-1]) + 1, np.int8)
            marks[(ends - lengths.ravel())[1::3][on & (lengths[:, 1] > 0)]] = 1
            marks[ends[1::3][on & (lengths[:, 1] > 0)]] -= 1
            mask = np.cumsum(marks[:-1], dtype=np.int8)
            cuts = np.append(0, ends[2::3])
            masks = pa.array([mask[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lengths.sum(1)), ids, masks], ["c0", "c1", "n", "ids", "mask"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    coded = rows.mapInArrow(encode, f"c0 {kinds[key]}, c1 {kinds[turn]}, n long, ids binary, mask binary")
    order = Window.partitionBy("c0").orderBy("c1", "ids", "mask")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return coded.select(
        F.col("c0").alias(key),
        (F.row_number().over(order) - 1).cast("long").alias("position"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("token_start"),
        "ids",
        "mask",
    )


def read_back(assembled: DataFrame, ranks_path: str, pattern: str, key: str = "conv_id") -> DataFrame:
    """Digests of every conversation from its assembled ids and masks:
    ``key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    Rows are read in order and digests grow row by row, so that a conversation's
    texts are never held together.
    """
    template = _shipped(assembled.sparkSession, ranks_path, pattern)
    kind = assembled.schema[key].dataType.simpleString()
    names = [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    class Sums:
        def __init__(self, conversation):
            self.conversation = conversation
            self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
            self.n = self.loss_chars = self.chars = 0

        def row(self):
            return self.conversation, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars

    def table(rows):
        columns = zip(*rows)
        kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return [pa.array(list(c), k) for c, k in zip(columns, kinds)]

    def run(batches):
        current, done, first_kind = None, [], None
        for batch in batches:
            first_kind = batch.column(0).type
            t = template()
            masks, mask_at = flat(batch.column(2))
            ids, ids_at = flat(batch.column(1))
            for i, conversation in enumerate(batch.column(0).to_pylist()):
                if current is None or current.conversation != conversation:
                    if current is not None:
                        done.append(current.row())
                    current = Sums(conversation)
                role, text, learnt, chars = t.read(ids[ids_at[i] : ids_at[i + 1]].view("<u4"), masks[mask_at[i] : mask_at[i + 1]])
                current.turns.update(f"{role}\n{text}\n".encode())
                current.n += 1
                current.chars += chars
                if learnt is not None:
                    current.loss.update(learnt.encode())
                    current.loss_chars += len(learnt)
            if len(done) > 5000:
                yield _typed(table(done), first_kind, names)
                done = []
        if current is not None:
            done.append(current.row())
            yield _typed(table(done), first_kind, names)

    schema = f"`{key}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ordered = assembled.repartition(F.col(key)).sortWithinPartitions(key, "position")
    return ordered.select(F.col(key).alias("c0"), "ids", "mask").mapInArrow(run, schema)


def _typed(columns, first_kind, names):
    return pa.RecordBatch.from_arrays([columns[0].cast(first_kind), *columns[1:]], names)

