"""Debiasing: benign-looking text loses points that only weak triggers gave it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions.batches import chunks
from ..functions.text import WHITE, contains_any, count_contains, fields, let, trimmed, words
from .scanners import keyword_gate

# Words of the context score, explanations by payload type (the first that fits is told), points by payload type.
OPENERS = ["the ", "a ", "an ", "this ", "these ", "those ", "it ", "they "]
CONNECTORS = ["please", "thank", "sorry", "however", "although", "because", "therefore", "additionally"]
DOC_HINTS = ["example", "note:", "tip:", "warning:", "see also", "refer to", "placeholder", "replace"]
DEV_HINTS = ["npm", "package", "config", "settings", "environment", "variable", "flag", "option"]
POLITE = ["kindly", "appreciate", "regards", "sincerely", "hello", "hi ", "dear "]
EXPLANATIONS = {"documentation": "documentation context, trigger-only signals", "developer": "developer context, trigger-only signals", "dumb-bot": "dumb-bot payload detected", "spam": "spam payload detected"}
PENALTIES = {"dumb-bot": 15, "spam": 10, "documentation": 10, "developer": 5}


def payload_types(text: Column, gate: Column | None = None) -> Column:
    """What a text looks like: ["attack"], or those of dumb-bot, spam, documentation and developer that fit, or ["unknown"]."""
    bound = let(F.lower(text), lambda low: F.struct(low.alias("low"), (keyword_gate(low) if gate is None else gate).alias("gate"), contains_any(low, lex.ROLE_PHRASES).alias("role")))
    return let(bound, lambda x: _payload_types(x["low"], x["gate"], x["role"]))


def _payload_types(low: Column, gate: Column, role: Column) -> Column:
    attack = gate & (role | contains_any(low, lex.EXFILTRATION_PHRASES) | contains_any(low, lex.JAILBREAK_PHRASES))
    bot = ~gate & ~role & (F.octet_length(low) < 300) & (count_contains(low, lex.BOT_WORDS) >= 2)
    spam = ~gate & contains_any(low, ["http://", "https://", ".com", ".net", ".org"]) & contains_any(low, lex.SPAM_WORDS) & ~contains_any(low, lex.MODEL_TERMS)
    doc = (count_contains(low, lex.DOC_WORDS) >= 2) | contains_any(low, lex.DOC_MARKUP)
    stands = [(low.contains(f" {w} ") | low.startswith(f"{w} ") | low.endswith(f" {w}")).cast("int") for w in lex.DEV_WORDS]
    dev = (sum(stands[1:], stands[0]) >= 2) | contains_any(low, lex.DEV_COMMANDS)
    types = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in (("dumb-bot", bot), ("spam", spam), ("documentation", doc), ("developer", dev))]), lambda x: x.isNotNull())
    return F.when(attack, F.array(F.lit("attack"))).otherwise(let(types, lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(F.lit("unknown")))))


def sentence_boundaries(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\.[ \n]|[!?] "))


def all_caps_run(text: Column) -> Column:
    """Longest run of tokens of two letters or more, all upper case; tokens without letters end a run."""
    letters = F.transform(fields(text), lambda w: F.regexp_replace(w, r"\P{L}", ""))
    caps = F.transform(letters, lambda w: (F.length(w) >= 2) & ~w.rlike(r"\P{Lu}"))
    state = lambda run, best: F.struct(run.alias("run"), best.alias("best"))

    def step(acc, cap):
        run = F.when(cap, acc["run"] + 1).otherwise(0)
        return state(run, F.greatest(acc["best"], run))

    return F.aggregate(caps, state(F.lit(0), F.lit(0)), step, lambda acc: acc["best"])


def average_word_bytes(text: Column) -> Column:
    """Mean bytes of the words of letters and digits; null without words."""
    return let(words(text), lambda w: F.when(F.size(w) > 0, F.octet_length(F.array_join(w, "")) / F.size(w)))


def shouts(text: Column) -> Column:
    """Whether all_caps_run() is 3 or more."""
    letters = F.regexp_replace(F.regexp_replace(text, rf"[^\p{{L}}{WHITE}]+", ""), f"[{WHITE}]+", " ")
    may = text.rlike(r"\p{Lu}") & letters.rlike(r"(?:\A| )\p{Lu}{2,} \p{Lu}{2,} \p{Lu}{2,}(?: |\z)")
    return may & (all_caps_run(text) >= 3)


def has_long_field(text: Column, octets: int = 40) -> Column:
    """Whether a token has more bytes than ``octets``."""
    may = text.rlike(rf"\S{{{octets + 1}}}") | (F.octet_length(text) > F.length(text)) & text.rlike(rf"\S{{{octets // 4 + 1}}}")
    return may & F.exists(fields(text), lambda t: F.octet_length(t) > octets)


def context_score(text: Column) -> Column:
    """0 to 100: how much a text reads like ordinary prose, documentation or developer talk."""
    return let(F.struct(text.alias("t"), F.lower(text).alias("low")), lambda x: _context_score(x["t"], x["low"]))


def _context_score(text: Column, low: Column) -> Column:
    points = lambda c, n: F.when(c, n).otherwise(0)
    total = (
        points(F.octet_length(low) > 300, 15)
        + points(F.octet_length(low) > 100, 10)
        + points(sentence_boundaries(low) >= 3, 10)
        + points(contains_any(low, OPENERS), 10)
        + points(count_contains(low, CONNECTORS) >= 2, 10)
        + points(contains_any(low, DOC_HINTS), 10)
        + points(contains_any(low, DEV_HINTS), 10)
        + points(contains_any(low, POLITE), 5)
        + points(trimmed(low).rlike(r"[.!?]\z"), 5)
        + points(F.coalesce(average_word_bytes(low).between(4.0, 8.0), F.lit(False)), 5)
        - points(shouts(text), 15)
        - points(text.rlike("[!?]{3,}"), 10)
        - points(has_long_field(low), 10)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def context_scores():
    """UDF text -> context_score(), in Python workers: a fraction of the time of the columns.  Null gives null."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from .readings import context

        for texts in chunks(batches):
            yield pd.Series([None if t is None else context(t) for t in texts], dtype="Int32")

    return run


def explanation(types: Column, lost: Column) -> Column:
    """Why a score was eased, by its payload types and the points it lost; null types are those of a row without a finding."""
    told = F.lit("trigger-only signals reduced")
    for kind, words in reversed(EXPLANATIONS.items()):
        told = F.when(F.array_contains(types, kind), words).otherwise(told)
    return F.when(F.coalesce(lost, F.lit(0)) > 0, F.concat(F.lit("debias: "), told, F.lit(" (-"), lost.cast("string"), F.lit(")"))).otherwise("debias: no debias applied")


def debiased(types: Column, context: Column, score: Column, trigger: Column, injection: Column, banned: Column) -> Column:
    """The score after debiasing, by payload types and context score; unchanged beside an injection, a ban-list match or an
    attack payload.  Each argument is named several times, so pass columns, not expressions."""
    payload = F.least(F.lit(30), F.aggregate(types, F.lit(0), lambda a, t: a + F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PENALTIES.items() for x in kv]), t), F.lit(0))))
    lowered = F.greatest(score - payload, F.lit(0))
    base = F.least(trigger, F.when(context >= 30, 25).otherwise(15))
    part = F.when(context >= 60, 100).when(context >= 30, 60).when(context >= 10, 30).otherwise(0)
    scaled = F.floor((base * part + 50) / 100).cast("int")
    eased = F.when(trigger <= 0, lowered).otherwise(F.greatest(lowered - F.when(part == 0, 0).otherwise(scaled), F.lit(0)))
    return F.when((injection > 0) | banned | F.array_contains(types, "attack"), F.greatest(score, F.lit(0))).otherwise(eased).cast("int")
