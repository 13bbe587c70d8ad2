r"""Chat formatting with a grammar round trip.

    conversation := "<s>" turn*
    turn         := "[INST] " text " [/INST]"        (user)
                  | " " text "</s>"                  (assistant)
                  | "[ROLE:" name "] " text " [/ROLE]"   (any other role)

A backslash takes the next character literally, in texts and in names. The first character of a turn tells its form, and a text
ends at its own closing string, so the parser never looks back. A turn is first rendered as it is, then parsed; if the parser
does not recover its role and text exactly, its content is escaped one level further, until it does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN = "<s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE:", "[/ROLE]")
_CLOSE = {"user": " [/INST]", "assistant": "</s>"}
_OTHER_CLOSE = " [/ROLE]"
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
#: What an escape is put before, by level: nothing; control strings and escapes; every character that could begin either.
_LEVELS = (None, re.compile(r"\\|" + "|".join(re.escape(" " + c) + "|" + re.escape(c) for c in CONTROL)), re.compile(r"[\\<\[\] ]"))
_END = {c: re.compile(r"\\.|" + re.escape(c), re.DOTALL) for c in (*_CLOSE.values(), _OTHER_CLOSE, "] ")}


def escape(text: str, level: int) -> str:
    pattern = _LEVELS[level]
    return text if pattern is None else pattern.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _form(role: str, text: str, level: int) -> tuple[str, str, str]:
    """(before, content, after) of a turn."""
    body = escape(text, level)
    if role == "user":
        return "[INST] ", body, _CLOSE["user"]
    if role == "assistant":
        return " ", body, _CLOSE["assistant"]
    return f"[ROLE:{escape(role, level)}] ", body, _OTHER_CLOSE


def _until(text: str, at: int, close: str) -> tuple[str, int] | None:
    """What stands before the next unescaped ``close``, unescaped, and the place after it."""
    for m in _END[close].finditer(text, at):
        if m[0] == close:
            return unescape(text[at : m.start()]), m.end()
    return None


def parse_turn(text: str, at: int = 0) -> tuple[str, str, int] | None:
    """(role, text, place after the turn) of the turn that begins at ``at``; None if it is not complete."""
    if text.startswith("[INST] ", at):
        role, start, close = "user", at + 7, _CLOSE["user"]
    elif text.startswith("[ROLE:", at):
        if (name := _until(text, at + 6, "] ")) is None:
            return None
        role, start, close = name[0], name[1], _OTHER_CLOSE
    elif text.startswith(" ", at):
        role, start, close = "assistant", at + 1, _CLOSE["assistant"]
    else:
        return None
    got = _until(text, start, close)
    return None if got is None else (role, *got)


def render_turn(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """The rendered turn, and the span of its content if it is under the loss mask."""
    for level in range(len(_LEVELS)):
        before, body, after = _form(role, text, level)
        whole = before + body + after
        if parse_turn(whole) == (role, text, len(whole)):
            return whole, ((len(before), len(before) + len(body)) if role == "assistant" else None)
    raise ValueError("a turn does not survive the round trip")


class Parser:
    """Turns from the pieces of one formatted conversation; holds no more than an unfinished turn."""

    def __init__(self) -> None:
        self.rest, self.begun = "", False

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.rest += piece
        at = 0
        if not self.begun:
            if len(self.rest) < len(BEGIN):
                return
            if not self.rest.startswith(BEGIN):
                raise ValueError("a conversation must begin with " + BEGIN)
            self.begun, at = True, len(BEGIN)
        while (turn := parse_turn(self.rest, at)) is not None:
            at = turn[2]
            yield turn[0], turn[1]
        self.rest = self.rest[at:]

    def end(self) -> None:
        if self.rest:
            raise ValueError("a conversation is cut off")


_FORMATTED = "conv_id long, first boolean, piece string, loss_from int, loss_to int"


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: tuple | None = None
    for batch in batches:
        rows = []
        for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            first, now = now != (conv,), (conv,)
            whole, span = render_turn(role or "", text or "")
            shift = len(BEGIN) if first else 0
            rows.append((conv, first, BEGIN * first + whole, *((span[0] + shift, span[1] + shift) if span else (None, None))))
        kinds = (pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((),) * 5, kinds, strict=True)], ["conv_id", "first", "piece", "loss_from", "loss_to"])


def format_conversations(turns: DataFrame) -> DataFrame:
    """The formatted conversations, as a row per turn in order: (conv_id, first, piece, loss_from, loss_to).

    A conversation's text is the concatenation of its pieces; the loss span is in code points of the piece. The rows of a
    conversation are adjacent in one partition, sorted by turn, then role and text; the sort spills, and nothing holds a whole
    conversation, so one with very many turns costs time in one task but no memory.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")]
    placed = turns.select(*cols).repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return placed.select("conv_id", "role", "text").mapInArrow(_format, _FORMATTED)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    state, done = None, []

    def close() -> None:
        conv, parser, turns, n, loss, loss_chars, chars = state
        parser.end()
        done.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)
        done.clear()
        return out

    for batch in batches:
        for conv, first, piece, start, end in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if first:
                if state:
                    close()
                state = [conv, Parser(), hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, text in state[1].feed(piece):
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += 1
            if start is not None:
                under = unescape(piece[start:end])
                state[4].update(under.encode())
                state[5] += len(under)
            state[6] += len(piece)
        if len(done) >= 1000:
            yield flush()
    if state:
        close()
    if done:
        yield flush()


def read_conversations(formatted: DataFrame) -> DataFrame:
    """A row per conversation with the digests of what its formatted text says; ``formatted`` as format_conversations makes it."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4(turns: DataFrame) -> DataFrame:
    """Formats and reads back all conversations and the conflicting conversation -7.

    Null texts and roles are empty; a null conv_id is one conversation; null turns come first; equal turns are ordered by role
    and text, and repeated rows are repeated turns. Other columns are ignored. An empty table gives conversation -7 alone.
    """
    hard = "</s>[INST] ok [/INST]"
    spark = turns.sparkSession
    own = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    every = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).union(own)
    return read_conversations(format_conversations(every))


def _oracle() -> str:
    marks = "|".join(["\\\\", *(lead + re.sub(r"([\[\]])", r"\\\1", c) for c in CONTROL for lead in (" ", ""))])
    said = "role || chr(10) || text || chr(10)"
    order = "ORDER BY turn NULLS FIRST, role, text"
    hard = "'</s>[INST] ok [/INST]'"
    return f"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', {hard} UNION ALL SELECT -7, 1, 'assistant', {hard}),
f AS (SELECT *, CASE role WHEN 'user' THEN ' [/INST]' WHEN 'assistant' THEN '</s>' ELSE ' [/ROLE]' END AS ends,
    CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 16 + length(role) END AS around, len(regexp_extract_all(text, '{marks}')) AS marks FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg({said}, '' {order})) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' {order}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST({len(BEGIN)} + sum(around + length(text) + CASE WHEN contains(text, ends) OR contains(text, chr(92)) THEN marks ELSE 0 END) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


#: Holds for texts that need one level of escapes at most, which all texts do that hold control strings as such.
ORACLE_SQL = _oracle()
