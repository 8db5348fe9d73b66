"""Chat formatting with a grammar round trip: what doesn't parse back to its source is escaped."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, bounded_batches, table

#: Control strings of this template and of other common ones; none may stand inside a text.
CONTROL = re.compile(r"(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|[A-Za-z0-9_]+\|>)")
BOS, OPEN, CLOSE, EOS = "<s>", "[INST]", "[/INST]", "</s>"
LOSS_ROLE = "assistant"
#: A conversation is written in parts of at most this many turns, or characters once it has a turn.
PART_TURNS, PART_CHARS = 64, 1 << 18

Turn = tuple[str, str]


class ParseError(ValueError):
    pass


def escape(text: str) -> str:
    r"""Doubles backslashes and puts one behind the first character of each control string."""
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[Turn], escaped: list[bool]) -> str:
    """One line-ended group a turn: <s>ROLE[INST] TEXT[/INST]</s>, with ``!`` before an escaped text, a space before others."""
    return "".join(f"{BOS}{escape(role)}{OPEN}{'!' if e else ' '}{escape(text) if e else text}{CLOSE}{EOS}\n" for (role, text), e in zip(turns, escaped, strict=True))


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start and end of the text as written) of each turn.

    The lexer cuts at control strings; the grammar is (BOS role OPEN flag-text CLOSE EOS newline)*,
    so any other control string is an error.
    """
    parts = CONTROL.split(formatted)
    at = 0
    for k in range(0, len(parts) - 1, 8):
        if parts[k] != ("\n" if k else "") or [*parts[k + 1 : k + 8 : 2], *parts[k + 6 : k + 7]] != [BOS, OPEN, CLOSE, EOS, ""] or parts[k + 4][:1] not in ("!", " "):
            raise ParseError(f"no turn at character {at}")
        role, body = parts[k + 2], parts[k + 4]
        start = at + len(parts[k]) + len(BOS) + len(role) + len(OPEN) + 1
        yield unescape(role), unescape(body[1:]) if body[0] == "!" else body[1:], start, start + len(body) - 1
        at = start + len(body) - 1 + len(CLOSE) + len(EOS)
    if parts[-1] != ("\n" if at else ""):
        raise ParseError("text after the last turn")


def recovered(formatted: str) -> list[Turn] | None:
    try:
        return [(r, t) for r, t, _, _ in parse(formatted)]
    except ParseError:
        return None


def format_turns(turns: list[Turn]) -> tuple[str, int]:
    """(formatted text, escaped turns): turns that don't come back as they were are escaped until all do."""
    escaped = [False] * len(turns)
    while True:
        out = render(turns, escaped)
        if recovered(out) == turns:
            return out, sum(escaped)
        now = [e or recovered(render([t], [e])) != [t] for t, e in zip(turns, escaped, strict=True)]
        if now == escaped:  # each turn comes back alone but not all together
            now = [True] * len(turns)
        if now == escaped:
            raise AssertionError("an escaped conversation does not parse back")
        escaped = now


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Formats conversations, their rows by turn (ties by role, then text; nulls first).

    Returns ``conv``, part, n_turns, n_escaped and formatted, in parts of bounded size that stand in order in one
    partition; parts joined are the conversation's text.  Null texts and roles count as empty; rows of a
    null ``conv`` are one conversation; repeated rows are repeated turns; an empty table gives no rows.
    Rows are sorted by conversation and streamed, so a long conversation is never held as a whole.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    kind = df.schema[conv].dataType.simpleString()
    ddl = f"`{conv}` {kind}, part int, n_turns int, n_escaped int, formatted string"
    out = arrow_schema(ddl)
    rows = df.select(F.col(f"`{conv}`").alias("c"), F.col(f"`{turn}`").alias("n"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("r"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, turns, size = None, 0, [], 0
        done: list[tuple] = []

        def flush():
            done.append((now[0], part, len(turns), *reversed(format_turns(turns))))

        for batch in batches:
            for c, r, t in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if now != (c,) or len(turns) >= PART_TURNS or size + len(t) > PART_CHARS and turns:
                    if now is not None:
                        flush()
                    part = part + 1 if now == (c,) else 0
                    now, turns, size = (c,), [], 0
                turns.append((r, t))
                size += len(t)
            if done:
                yield rows_of(done, out)
                done.clear()
        if now is not None:
            flush()
            yield rows_of(done, out)

    return rows.repartition("c").sortWithinPartitions("c", "n", "r", "t").mapInArrow(run, ddl)


def rows_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, parsed from the text alone: turns, the loss text and their sizes.

    ``formatted`` is what format_conversations() returned, its partitions untouched.  The loss mask covers the texts
    of assistant turns as they stand in the formatted text; the digest is of those texts, unescaped.
    """
    conv = formatted.columns[0]
    ddl = f"`{conv}` {formatted.schema[0].dataType.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, masked_chars bigint"
    out = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def flush():
            done.append((now[0], n, every.hexdigest(), loss, masked.hexdigest(), size, wide))

        for batch in batches:
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now != (c,):
                    if now is not None:
                        flush()
                    now, n, loss, size, wide, every, masked = (c,), 0, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for r, t, start, end in parse(text):
                    n += 1
                    every.update(f"{r}\n{t}\n".encode())
                    if r == LOSS_ROLE:
                        loss += len(t)
                        wide += end - start
                        masked.update(t.encode())
                size += len(text)
            if done:
                yield rows_of(done, out)
                done.clear()
        if now is not None:
            flush()
            yield rows_of(done, out)

    return formatted.select(F.col(f"`{conv}`"), "formatted").mapInArrow(run, ddl)


#: The conversation that the query adds.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_conversations(rows.unionByName(probe))).drop("masked_chars")


#: The same rows; the template's size is worked out from its parts.
OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, '(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|[A-Za-z0-9_]+\|>)' AS control FROM c
), s AS (
  SELECT conv_id, turn, r, t,
    length(replace(r, '\', '\\')) + len(regexp_extract_all(replace(r, '\', '\\'), control)) AS role_size,
    CASE WHEN regexp_matches(t, control) THEN length(replace(t, '\', '\\')) + len(regexp_extract_all(replace(t, '\', '\\'), control)) ELSE length(t) END AS text_size
  FROM e
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(3 + role_size + 6 + 1 + text_size + 7 + 4 + 1) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
