"""Chat formatting with a grammar round trip.

Grammar: a conversation is a sequence of turns, a turn is an opening mark, a body and the closing mark of the same kind.

    user       [INST] body [/INST]          system     <<SYS>> body <</SYS>>
    assistant  <s> body </s>                any other  <<ROLE>> name <<TEXT>> body <</TEXT>>

(without the spaces). ``parse`` reads this deterministically and fails on any mark out of place. A turn is first rendered with
its text as it is; if reparsing does not give back the same turn, the text is escaped: a backslash goes behind every ``<`` or ``[`` that
begins a mark or already stands before a backslash. Unescaping removes one backslash behind each such character, so the
original always comes back.

Turns are rendered row by row and written with their place in the conversation; nothing gathers a conversation in
memory. Reading back streams the sorted pieces of a conversation through the parser and running digests, so one
conversation may be of any length.

Defined results: null text is empty, a null role is a role without a name; equal turn numbers are ordered by role and
text; rows with a null conv_id form one conversation; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vacantia.llm.common import cut_lineage

OPEN = {"user": "[INST]", "assistant": "<s>", "system": "<<SYS>>"}
CLOSE = {"user": "[/INST]", "assistant": "</s>", "system": "<</SYS>>"}
ROLE, TEXT, TEXT_END = "<<ROLE>>", "<<TEXT>>", "<</TEXT>>"
_MARK = re.compile(r"</?s>|\[/?INST\]|<</?SYS>>|<<ROLE>>|<</?TEXT>>")
_CONFLICT = re.compile(r"<(?=\\|/?s>|<(?:/?SYS|ROLE|/?TEXT)>>)|\[(?=\\|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\")


class GrammarError(ValueError):
    pass


def escape(text: str) -> str:
    return _CONFLICT.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Parser:
    """Incremental reader: ``feed`` takes any piece of the rendered text and yields the turns it completes, as
    (role, text, start, stop) with the body's place in the rendered text."""

    def __init__(self) -> None:
        self.rest, self.done = "", 0
        self.opened: str | None = None
        self.role: str | None = None
        self.by_opening = {mark: role for role, mark in OPEN.items()}

    def feed(self, piece: str) -> Iterator[tuple[str, str, int, int]]:
        self.rest += piece
        at = 0
        for mark in _MARK.finditer(self.rest):
            body = self.rest[at : mark.start()]
            turn = self._take(mark[0], body, self.done + at)
            at = mark.end()
            if turn:
                yield turn
        self.done += at
        self.rest = self.rest[at:]

    def _take(self, mark: str, body: str, start: int) -> tuple[str, str, int, int] | None:
        if self.opened is None:
            if body or mark not in (*self.by_opening, ROLE):
                raise GrammarError(f"{mark!r} cannot begin a turn")
            self.opened, self.role = mark, self.by_opening.get(mark)
        elif self.opened == ROLE and mark == TEXT:
            self.opened, self.role = TEXT, unescape(body)
        elif mark == (TEXT_END if self.opened == TEXT else CLOSE.get(self.role)):
            self.opened = None
            return self.role, unescape(body), start, start + len(body)
        else:
            raise GrammarError(f"{mark!r} inside a turn opened by {self.opened!r}")
        return None

    def end(self) -> None:
        if self.opened is not None or self.rest:
            raise GrammarError("the text ends inside a turn")


def parse(rendered: str) -> list[tuple[str, str]]:
    parser = Parser()
    turns = [(role, text) for role, text, _, _ in parser.feed(rendered)]
    parser.end()
    return turns


def _wrapped(role: str, name: str, body: str) -> str:
    return OPEN[role] + body + CLOSE[role] if role in OPEN else ROLE + name + TEXT + body + TEXT_END


def render_turn(role: str | None, text: str | None) -> str:
    """The turn as text that parses back to it; escaped only where the plain form does not."""
    role, text = role or "", text or ""
    for change in (str, escape):
        rendered = _wrapped(role, change(role), change(text))
        try:
            if parse(rendered) == [(role, text)]:
                return rendered
        except GrammarError:
            pass
    raise GrammarError(f"a turn of role {role!r} cannot be rendered")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Written table (conv_id, place, piece): the formatted text of a conversation is its pieces in order of place, from 1."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [render_turn(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.string())], ["conv_id", "place", "piece"])

    told = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    rows = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), *told)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.withColumn("place", F.row_number().over(order).cast("bigint")).select("conv_id", "place", "role", "text")
    return cut_lineage(placed.mapInArrow(render, "conv_id bigint, place bigint, piece string"))


def _in_order(formatted: DataFrame) -> DataFrame:
    return formatted.select("conv_id", "place", "piece").repartition("conv_id").sortWithinPartitions("conv_id", "place")


class _Reading:
    """Running results of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.parser = conv_id, Parser()
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def feed(self, piece: str) -> list[tuple[str, str, int, int]]:
        self.chars += len(piece)
        turns = list(self.parser.feed(piece))
        for role, text, _, _ in turns:
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == "assistant":
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))
        return turns

    def row(self) -> tuple:
        self.parser.end()
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


READ_BACK = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)


def read_back(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, from the formatted text alone: number and digest of its turns (role, newline, text, newline), and length
    and digest of the unescaped assistant texts, which are what the loss mask covers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

        names = [c.split()[0] for c in READ_BACK.split(", ")]
        kinds = {"bigint": pa.int64(), "string": pa.string()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in READ_BACK.split(", ")])
        current: _Reading | None = None
        for batch in batches:
            done = []
            for conv_id, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        done.append(current.row())
                    current = _Reading(conv_id)
                current.feed(piece)
            yield out(done)
        if current is not None:
            yield out([current.row()])

    return _in_order(formatted).mapInArrow(read, READ_BACK)


def loss_spans(formatted: DataFrame) -> DataFrame:
    """(conv_id, start, stop): the places in the formatted text that the loss covers, one row for each assistant turn."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Reading | None = None
        for batch in batches:
            ids, starts, stops = [], [], []
            for conv_id, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if current is None or current.conv_id != conv_id:
                    current = _Reading(conv_id)
                for role, _, start, stop in current.feed(piece):
                    if role == "assistant":
                        ids.append(conv_id)
                        starts.append(start)
                        stops.append(stop)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, stops)], ["conv_id", "start", "stop"])

    return _in_order(formatted).mapInArrow(spans, "conv_id bigint, start bigint, stop bigint")
