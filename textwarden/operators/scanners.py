"""Side scanners of the input: secrets, gibberish, toxicity, emotional manipulation, ban lists, keyword gate.

Each takes text columns and returns a column; all run in the JVM.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions.dialect import to_java
from ..functions.text import capped, contains_any, count_contains, entropy, fields, let, matches, none_of, trimmed, words
from .matching import folded

# The keyword gate, and characters that stand for letters in it.
KEYWORDS = r"\b(ignore|disregard|override|bypass|forget|previous|prior|instructions?|system|prompt|obey|comply|neutralize|circumvent|suppress|unrestricted|jailbreak|pretend|roleplay|act\s+as|developer\s+mode|exfiltrat(?:e|ion)|new\s+instructions?)\b"
LEET, LEET_LETTERS = "013457@$", "oieastas"

CODE_WORDS = r"\b(func|class|def|var|const|import|return)\b"
TOXIC_CODE_WORDS = r"\b(func|class|def|var|const|import|return|struct|interface)\b"

# Shapes of credentials, and strings of which such a credential holds one.  Which of them make a text's confidence high, medium or low is our own definition.
SECRET_PREFIXES = {
    "aws-access-key": (r"\bAKIA[0-9A-Z]{16}\b", ["AKIA"]),
    "github-token": (r"\b(?:ghp_[A-Za-z0-9]{36}|gho_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{59})\b", ["ghp_", "gho_", "github_pat_"]),
    "anthropic-key": (r"\bsk-ant-[A-Za-z0-9\-_]{90,}\b", ["sk-ant-"]),
    "openai-key": (r"\bsk-[A-Za-z0-9]{20,}\b", ["sk-"]),
    "huggingface-token": (r"\bhf_[A-Za-z0-9]{37}\b", ["hf_"]),
    "npm-token": (r"\bnpm_[A-Za-z0-9]{36}\b", ["npm_"]),
    "google-key": (r"\bAIza[0-9A-Za-z\-_]{35}\b", ["AIza"]),
    "stripe-key": (r"\b[sp]k_live_[A-Za-z0-9]{24,}\b", ["k_live_"]),
    "slack-token": (r"\bxox[baprs]-[0-9A-Za-z\-]{10,48}\b", ["xox"]),
}
SECRET_ASSIGNMENT = r"\b(?:api[_\-]?key|token|secret|password)\b\s*[:=]\s*\S{8,}"
AWS_SECRET, AWS_CONTEXT, AWS_WINDOW = r"\b[0-9a-zA-Z/+]{40}\b", r"\b(?:aws|secret)\b", 50
SECRET_NAMES = ["api", "token", "secret", "password"]
ENTROPY_TOKEN, ENTROPY_MIN_LENGTH, ENTROPY_MIN = r"^[A-Za-z0-9+/_=\-]+$", 32, 4.5
ENTROPY_RUN = r"[A-Za-z0-9+/_=\-]{32}"


def keyword_gate(text: Column) -> Column:
    """Whether the text has a word of an injection, as it stands or with digits read as letters."""
    return matches(text, KEYWORDS, True) | matches(F.translate(F.lower(text), LEET, LEET_LETTERS), KEYWORDS, True)


def secrets(text: Column) -> Column:
    """struct(types, confidence): credential shapes; confidence high (prefixes, AWS secrets by their context), medium
    (assignments), low (only tokens of high entropy) or empty.

    An expression only runs where the text has a string that it needs."""

    def found(t: Column, low: Column) -> Column:
        named = low.contains("aws") | low.contains("secret")
        aws = named & (matches(t, rf"(?is)(?:aws|secret).{{0,{AWS_WINDOW}}}?{AWS_SECRET}") | matches(t, rf"(?s){AWS_SECRET}.{{0,{AWS_WINDOW}}}?\b(?:aws|secret|AWS|SECRET)\b"))
        shapes = [(n, contains_any(t, needs) & t.rlike(to_java(r, False))) for n, (r, needs) in SECRET_PREFIXES.items()] + [("aws-secret-key", aws & matches(t, AWS_CONTEXT, True))]
        high = F.filter(F.array(*[F.when(hit, F.lit(n)) for n, hit in shapes]), lambda x: x.isNotNull())
        medium = F.when(contains_any(low, SECRET_NAMES) & matches(t, SECRET_ASSIGNMENT, True), F.array(F.lit("secret-assignment"))).otherwise(none_of("string"))
        dense = t.rlike(ENTROPY_RUN) & F.exists(fields(t), lambda w: (F.length(w) >= ENTROPY_MIN_LENGTH) & w.rlike(ENTROPY_TOKEN) & w.rlike("[0-9]") & (entropy(w) > ENTROPY_MIN))
        entropic = F.when(dense, F.array(F.lit("high-entropy-token"))).otherwise(none_of("string"))
        return F.struct(high.alias("high"), medium.alias("medium"), entropic.alias("low"))

    level = lambda x: F.when(F.size(x["high"]) > 0, "high").when(F.size(x["medium"]) > 0, "medium").when(F.size(x["low"]) > 0, "low").otherwise("")
    return let(let(F.struct(text.alias("t"), folded(text).alias("low")), lambda x: found(x["t"], x["low"])), lambda x: F.struct(F.concat(x["high"], x["medium"], x["low"]).alias("types"), level(x).alias("confidence")))


def etaoin_hits(text: Column) -> Column:
    """How many of e, t, a, o, i, n are among the six most frequent of a to z (ties by alphabet); null without letters."""
    count = lambda low, c: F.octet_length(low) - F.octet_length(F.replace(low, F.lit(c)))
    ranked = lambda low: F.slice(F.array_sort(F.filter(F.array(*[F.struct((-count(low, c)).alias("n"), F.lit(c).alias("c")) for c in "abcdefghijklmnopqrstuvwxyz"]), lambda x: x["n"] < 0)), 1, 6)
    return let(let(F.lower(text), ranked), lambda top: F.when(F.size(top) > 0, F.size(F.filter(top, lambda x: x["c"].isin(*"etaoin")))))


def gibberish_ratio(text: Column) -> Column:
    """Part of the words that have five letters and four consonants in a row; null without words."""
    odd = lambda w: (F.length(w) > 4) & w.rlike("[bcdfghjklmnpqrstvwxyz]{4}")
    return let(words(text), lambda tokens: F.when(F.size(tokens) > 0, F.size(F.filter(tokens, odd)) / F.size(tokens)))


def gibberish(text: Column) -> Column:
    """struct(is_gibberish, high_entropy_block, ratio)."""
    no = F.lit(False)

    def judged(bare: Column) -> Column:
        compact = F.translate(bare, "\n\r ", "")
        base64 = bare.endswith("=") & (F.length(compact) >= 24) & compact.rlike(r"\A[A-Za-z0-9+/]+={1,2}\z")
        clean = (F.length(bare) < 20) | bare.startswith("http://") | bare.startswith("https://") | matches(bare, CODE_WORDS, True) | base64
        block = lambda: bare.rlike(r"\S{16}") & F.exists(fields(bare), lambda t: (F.length(t) >= 16) & (entropy(t) > 4.8))
        told = lambda ratio: F.struct(
            F.coalesce((ratio > 0.30) | (ratio.isNotNull() & (F.length(bare) > 40) & (etaoin_hits(bare) < 2)), no).alias("is_gibberish"),
            F.coalesce(ratio.isNotNull() & block(), no).alias("high_entropy_block"),
            F.coalesce(ratio, F.lit(0.0)).alias("ratio"),
        )
        return let(F.when(~clean, gibberish_ratio(bare)), told)

    return let(trimmed(text), judged)


def toxicity(text: Column) -> Column:
    """struct(is_toxic, score, sentiment, tier1, tier2, tier3): coercion, identity override and hostile words."""

    def counted(bare: Column, low: Column) -> Column:
        hostile = F.when(contains_any(low, lex.TOXIC_HOSTILE), F.regexp_count(low, F.lit(to_java(r"\b(" + "|".join(lex.TOXIC_HOSTILE) + r")\b")))).otherwise(0)
        tiers = (capped(count_contains(low, lex.TOXIC_COERCION), 2), capped(count_contains(low, lex.TOXIC_IDENTITY), 2), capped(hostile, 3))
        return F.when(any_tier(low) & ~matches(bare, TOXIC_CODE_WORDS, True), F.struct(*[t.alias(f"n{k}") for k, t in enumerate(tiers, 1)])).otherwise(F.struct(*[F.lit(0).alias(f"n{k}") for k in (1, 2, 3)]))

    any_tier = lambda low: contains_any(low, [*lex.TOXIC_COERCION, *lex.TOXIC_IDENTITY, *lex.TOXIC_HOSTILE])

    def told(n: Column) -> Column:
        points = 20 * n["n1"] + 12 * n["n2"] + 6 * n["n3"]
        return F.struct(
            (points >= 15).alias("is_toxic"),
            F.least(points / 100.0, F.lit(1.0)).alias("score"),
            F.when(points > 0, "negative").otherwise("neutral").alias("sentiment"),
            *[(n[f"n{k}"] > 0).alias(f"tier{k}") for k in (1, 2, 3)],
        )

    lowered = let(trimmed(text), lambda bare: F.struct(bare.alias("bare"), F.lower(bare).alias("low")))
    return let(let(lowered, lambda x: counted(x["bare"], x["low"])), told)


#: kind: (phrases, points beside an injection, id)
EMOTIONS = {
    "urgency": (lex.EMOTION_URGENCY, 15, "em-001"),
    "fear": (lex.EMOTION_FEAR, 15, "em-002"),
    "guilt": (lex.EMOTION_GUILT, 12, "em-003"),
    "flattery": (lex.EMOTION_FLATTERY, 12, "em-004"),
    "false-authority": (lex.EMOTION_AUTHORITY, 15, "em-005"),
}


def emotion(text: Column, gate: Column | None = None) -> Column:
    """struct(manipulative, score, types, weighted): types sorted; weighted, the points beside an injection.

    ``gate``: the text's keyword gate, if it is at hand."""
    counts = let(F.lower(trimmed(text)), lambda low: F.struct((keyword_gate(low) if gate is None else gate).alias("gate"), *[count_contains(low, p).alias(k) for k, (p, _, _) in EMOTIONS.items()]))

    def told(n: Column) -> Column:
        weighted = F.when(n["gate"], reduce(add, [F.when(n[k] > 0, w).otherwise(0) for k, (_, w, _) in EMOTIONS.items()])).otherwise(0)
        points = F.when(n["gate"], weighted).otherwise(reduce(add, [5 * capped(n[k], 2) for k in EMOTIONS]))
        types = F.filter(F.array(*[F.when(n[k] > 0, F.lit(k)) for k in sorted(EMOTIONS)]), lambda x: x.isNotNull())
        return F.struct((points >= 10).alias("manipulative"), F.least(points / 100.0, F.lit(1.0)).alias("score"), types.alias("types"), weighted.alias("weighted"))

    return let(counts, told)


def attack_phrases(text: Column, gate: Column | None = None) -> Column:
    """Points of attack phrases, beside an injection word."""
    points = let(let(F.lower(text), lambda low: count_contains(low, lex.ATTACK_PHRASES)), lambda n: F.when(n >= 2, 20).when(n == 1, 10).otherwise(0))
    return F.when(keyword_gate(text) if gate is None else gate, points).otherwise(0)


def _word(phrase: str) -> str:
    import re

    return r"\b" + re.sub(r"([^\w\s])", r"\\\1", phrase.lower(), flags=re.ASCII) + r"\b"


def ban_lists(text: Column, substrings: list[str] = (), topics: list[str] = (), competitors: list[str] = (), regexes: list[str] = ()) -> Column:
    """struct(rules, n_substring, n_topic, n_competitor, n_regex): user-defined rules found; rules sorted."""
    if not any(x.strip() for xs in (substrings, topics, competitors, regexes) for x in xs):
        return F.struct(none_of("string").alias("rules"), *[F.lit(0).alias(n) for n in ("n_substring", "n_topic", "n_competitor", "n_regex")])
    return let(F.struct(text.alias("t"), F.lower(text).alias("low")), lambda x: _banned(x["t"], x["low"], substrings, topics, competitors, regexes))


def _banned(text: Column, low: Column, substrings: list[str], topics: list[str], competitors: list[str], regexes: list[str]) -> Column:
    hits = {
        "substring": [(s.strip(), low.contains(s.strip().lower())) for s in substrings if s.strip()],
        "topic": [(s.strip(), matches(low, _word(s.strip()))) for s in topics if s.strip()],
        "competitor": [(s.strip(), matches(low, _word(s.strip()))) for s in competitors if s.strip()],
        "custom-regex": [(s, matches(text, s)) for s in regexes if s.strip()],
    }
    named = [F.when(hit, F.lit(f"{kind}:{s}")) for kind, xs in hits.items() for s, hit in xs]
    rules = F.array_sort(F.array_distinct(F.filter(F.array(*named), lambda x: x.isNotNull()))) if named else none_of("string")
    count = lambda kind: reduce(add, [hit.cast("int") for _, hit in hits[kind]], F.lit(0))
    return F.struct(rules.alias("rules"), *[count(k).alias(n) for k, n in (("substring", "n_substring"), ("topic", "n_topic"), ("competitor", "n_competitor"), ("custom-regex", "n_regex"))])


