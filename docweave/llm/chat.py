"""Chat formatting with a grammar round trip.

A turn is rendered as START role NL text END NL. The parser is deterministic: it reads START, a role up to the first
line end, a text up to the first END, and a line end; a text then has one backslash taken out of every "<", backslashes,
"|" that holds any. A turn is rendered as it stands and parsed; where the turn recovered isn't the one that went in, the
role's or the text's control characters are escaped and the turn is rendered and parsed again, until both are the same.
Turns are independent in this grammar, so they are rendered in parallel; a conversation's output is the sequence of its
segments (one a turn, in order), whose concatenation is the formatted text, and is read back as a stream, so that a
conversation of any length needs the memory of one turn.

Null roles and texts count as empty. Turns stand in order of turn (nulls first), ties by role and text; repeated turns
stay. Rows with a null conv_id make one conversation without an id. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

START, END, NL = "<|im_start|>", "<|im_end|>", "\n"
_BARE, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _BARE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return role.replace("%", "%25").replace("\n", "%0A").replace("<", "%3C")


def unescape_role(role: str) -> str:
    return role.replace("%3C", "<").replace("%0A", "\n").replace("%25", "%")


class Parser:
    """Takes formatted text in pieces of any size, gives (role, text, rendered text's length); ValueError at what the grammar doesn't know."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str, int]]:
        data, at = self.rest + piece, 0
        while True:
            if not data.startswith(START, at):
                if START.startswith(data[at : at + len(START)]):
                    break
                raise ValueError(f"no turn starts at {data[at : at + 20]!r}")
            line = data.find(NL, at + len(START))
            end = data.find(END + NL, line + 1) if line >= 0 else -1
            first = data.find(END, line + 1) if line >= 0 else -1
            if first >= 0 and first != end and len(data) > first + len(END):
                raise ValueError(f"an end without a line end at {data[first : first + 20]!r}")
            if end < 0:
                break
            yield unescape_role(data[at + len(START) : line]), unescape(data[line + 1 : end]), end - line - 1
            at = end + len(END + NL)
        self.rest = data[at:]

    def close(self) -> None:
        if self.rest:
            raise ValueError(f"the last turn is cut short: {self.rest[:20]!r}")


def recovered(segment: str) -> list[tuple[str, str]] | None:
    parser = Parser()
    try:
        turns = [(r, t) for r, t, _ in parser.feed(segment)]
        parser.close()
        return turns
    except ValueError:
        return None


def render(role: str | None, text: str | None) -> str:
    """One turn, escaped only as far as its round trip needs."""
    role, text = role or "", text or ""
    for r, t in ((role, text), (role, escape(text)), (escape_role(role), text), (escape_role(role), escape(text))):
        segment = f"{START}{r}{NL}{t}{END}{NL}"
        if recovered(segment) == [(role, text)]:
            return segment
    raise ValueError("the escapes don't cover this turn")  # not reached: escaped parts hold no control string


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text (as given), segment (the formatted turn)."""
    own = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    cols = ["conv_id", "turn", "role", "text"]
    schema = {c: common.arrow_type(own, c) for c in cols} | {"segment": pa.string()}
    ddl = ", ".join(f"{c} {common.ddl_type(own, c)}" for c in cols) + ", segment string"
    return common.per_row(own, lambda: lambda r: (*r, render(r[2], r[3])), cols, schema, ddl)


def read_back(formatted: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """A row a conversation, from the segments alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. The loss mask covers the texts of the turns whose role is `learn_from`."""
    id_ddl, id_arrow = common.ddl_type(formatted, "conv_id"), common.arrow_type(formatted, "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("conv_id", id_arrow), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

        class Sums:
            def __init__(self, conv_id) -> None:
                self.conv_id, self.parser, self.n, self.loss, self.chars = conv_id, Parser(), 0, 0, 0
                self.turns, self.learnt = hashlib.sha256(), hashlib.sha256()

            def add(self, segment: str) -> None:
                self.chars += len(segment)
                for role, text, _ in self.parser.feed(segment):
                    self.n += 1
                    self.turns.update(f"{role}\n{text}\n".encode())
                    if role == learn_from:
                        self.loss += len(text)
                        self.learnt.update(text.encode())

            def row(self) -> tuple:
                self.parser.close()
                return self.conv_id, self.n, self.turns.hexdigest(), self.loss, self.learnt.hexdigest(), self.chars

        def rows() -> Iterator[tuple]:
            now = None
            for conv_id, segment in common.rows_of(batches, "conv_id", "segment"):
                if now is None or now.conv_id != conv_id:
                    if now:
                        yield now.row()
                    now = Sums(conv_id)
                now.add(segment)
            if now:
                yield now.row()

        return common.in_batches(rows(), pa.schema(fields))

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    dealt = formatted.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "segment")
    return dealt.mapInArrow(common.tidy(run), f"conv_id {id_ddl}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
