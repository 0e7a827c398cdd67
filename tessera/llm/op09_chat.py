"""Chat formatting: a finite-state machine over roles, a declarative template, text pieces with loss spans.

Every turn becomes one piece of text: the role's opening mark, the escaped text, the closing mark; its loss spans are code
point ranges of the piece. The machine reads roles in turn order and flags turns that its transitions don't allow; no
turn is dropped. A backslash escapes: it is doubled in texts, and put behind the first character of every control string,
so that no control string remains in a text and parsing gives every text back.

Turns are dealt by conversation and sorted by turn inside a task, which then streams: it holds one batch and the state of
one machine, however long a conversation is. A conversation is one record with sequential digests, so one task has it.

Defined results: null text or role counts as empty. Roles that the template doesn't know get a mark with their name and no
loss. Order is by turn (null first), then role, then text; repeated rows are turns of their own. Rows with null conv_id
are one conversation. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks, the roles under the loss mask, control strings of this and common other templates, and the machine."""

    opening: dict = field(default_factory=lambda: {"system": "<|system|>", "user": "<|user|>", "assistant": "<|assistant|>"})
    other: tuple = ("<|role=", "|>")
    close: str = "<|end|>"
    loss: frozenset = frozenset({"assistant"})
    #: Every mark of this template starts with the first of them.
    controls: tuple = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    #: state -> role -> next state; a role that is missing is an error, and the state becomes that after the role.
    moves: dict = field(
        default_factory=lambda: {
            "start": {"system": "asked", "user": "user"},
            "asked": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    after: dict = field(default_factory=lambda: {"system": "asked", "user": "user", "assistant": "assistant"})
    final: frozenset = frozenset({"assistant"})

    def mark(self, role: str) -> str:
        return self.opening.get(role) or self.other[0] + quote(role, safe="") + self.other[1]

    def escape(self, text: str) -> str:
        found = re.compile("|".join(map(re.escape, ("\\", *sorted(self.controls, key=len, reverse=True)))))
        # the character behind the backslash may start another control string, so only the first one is consumed
        out, at = [], 0
        while m := found.search(text, at):
            out += [text[at : m.start()], "\\\\" if m[0] == "\\" else m[0][0] + "\\"]
            at = m.start() + 1
        return "".join(out) + text[at:]

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def piece(self, role: str, text: str) -> tuple[str, list[tuple[int, int]]]:
        start, body = self.mark(role), self.escape(text)
        return start + body + self.close, [(len(start), len(start) + len(body))] if role in self.loss else []

    def parse(self, piece: str) -> tuple[str, str]:
        """Role and text of one piece."""
        for role, mark in self.opening.items():
            if piece.startswith(mark):
                break
        else:
            end = piece.index(self.other[1], len(self.other[0]))
            role, mark = unquote(piece[len(self.other[0]) : end]), piece[: end + len(self.other[1])]
        if not piece.endswith(self.close) or not piece.startswith(mark):
            raise ValueError("not a piece of this template")
        return role, self.unescape(piece[len(mark) : len(piece) - len(self.close)])

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """Next state, and whether the turn was allowed."""
        to = self.moves.get(state, {}).get(role)
        return (to, True) if to else (self.after.get(role, state), False)


PIECES = "conv_id long, turn_no long, piece string, loss array<struct<first: int, end: int>>, allowed boolean, state string"


def format_chats(rows: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One piece per turn, in order inside each partition; a conversation is in one partition."""
    t = template or Template()
    turns = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, seen, state, number = None, False, "start", 0
        loss_type = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out = []
            for c, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if not seen or c != conv:
                    conv, seen, state, number = c, True, "start", 0
                state, allowed = t.step(state, role)
                piece, loss = t.piece(role, text)
                out.append((c, number, piece, [{"first": a, "end": b} for a, b in loss], allowed, state))
                number += 1
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), loss_type, pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "turn_no", "piece", "loss", "allowed", "state"])

    return turns.mapInArrow(scan, PIECES)


def digests(pieces: DataFrame, template: Template | None = None, in_order: bool = True) -> DataFrame:
    """Per conversation what its pieces say when they are parsed again; reads each partition once, in order.

    ``in_order``: the pieces are as ``format_chats`` gives them. Pieces that were stored and read again aren't: they are
    dealt by conversation and sorted first.
    """
    t = template or Template()
    if not in_order:
        pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "n_errors"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64())
        done: list = []
        now = None

        def over():
            return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6] == 0 and now[7] in t.final, now[6])

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

        for batch in batches:
            cols = (batch[n].to_pylist() for n in ("conv_id", "piece", "loss", "allowed", "state"))
            for c, piece, loss, allowed, state in zip(*cols, strict=True):
                if now is None or now[0] != c:
                    if now is not None:
                        done.append(over())
                    now = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, "start"]
                role, text = t.parse(piece)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    masked = t.unescape(piece[span["first"] : span["end"]])
                    now[3] += len(masked)
                    now[4].update(masked.encode("utf-8", "surrogatepass"))
                now[5] += len(piece)
                now[6] += not allowed
                now[7] = state
            if done:
                yield packed()
                done = []
        if now is not None:
            done.append(over())
            yield packed()

    return pieces.mapInArrow(scan, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, n_errors long")
