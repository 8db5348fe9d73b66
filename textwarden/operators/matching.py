"""Rule matching: which rules are found in which variants of a text.

Each rule has clauses, lists of strings of each of which any match must contain one; only where they hold does the regex
run.  The clauses are derived from the regex itself.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import to_python
from ..functions.rules import RULES, Rule

try:
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # Python before 3.11
    import sre_constants as _c
    import sre_parse as _p

CATEGORIES = list(dict.fromkeys(r.category for r in RULES))
LANGUAGES = {"en": "English", "fr": "French", "es": "Spanish", "de": "German", "ja": "Japanese"}
MATCH = "array<struct<rule_id:string,category:string,severity:int>>"


Clause = tuple[str, ...]


def _grade(clause: list[str]) -> tuple[int, int]:
    """What makes a clause tell more: long strings, and few of them."""
    return min(map(len, clause)), -len(clause)


def _clauses(tokens) -> list[list[str]]:
    """Of any match, lists of strings (lower case) of each of which it holds one."""
    out: list[list[str]] = []
    run = ""
    for op, arg in [*tokens, (None, None)]:
        if op is _c.LITERAL:
            run += chr(arg).lower()
            continue
        if run:
            out.append([run])
            run = ""
        if op is _c.SUBPATTERN:
            out += _clauses(arg[3])
        elif op is _c.BRANCH:
            parts = [_clauses(b) for b in arg[1]]
            if all(parts):
                out.append([s for p in parts for s in max(p, key=_grade)])
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] > 0:
            out += _clauses(arg[2])
    return out


@cache
def clauses(regex: str) -> tuple[Clause, ...]:
    """Of a rule's regex, lists of lower-case strings; any match contains a string of each.  Those that tell most come first."""
    found = dict.fromkeys(tuple(dict.fromkeys(c)) for c in _clauses(_p.parse(to_python(regex))))
    if not found:
        raise AssertionError(f"each rule must have a needed string: {regex}")
    return tuple(sorted(found, key=_grade, reverse=True))


_LOOKS = (_c.ASSERT, _c.ASSERT_NOT, _c.AT)


def _looks(op, arg) -> bool:
    """Whether a token takes no characters."""
    if op is _c.SUBPATTERN:
        return all(_looks(*t) for t in arg[3])
    return op in _LOOKS or op is _c.BRANCH and all(_looks(*t) for b in arg[1] for t in b)


def _starts(tokens) -> list[str]:
    """Of any match, strings (lower case) with one of which it begins; none if they can't be told."""
    run = ""
    for op, arg in tokens:
        if op is _c.LITERAL:
            run += chr(arg).lower()
        elif run:
            break
        elif not _looks(op, arg):
            if op is _c.SUBPATTERN:
                return _starts(arg[3])
            if op is _c.BRANCH:
                parts = [_starts(b) for b in arg[1]]
                return [s for p in parts for s in p] if all(parts) else []
            return _starts(arg[2]) if op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] > 0 else []
    return [run] if run else []


@cache
def starts(regex: str) -> Clause:
    """Of a rule's regex, lower-case ASCII strings with one of which any match begins; none if they can't be told."""
    found = tuple(dict.fromkeys(_starts(_p.parse(to_python(regex)))))
    return found if all(s.isascii() for s in found) else ()


def needed(regex: str) -> Clause:
    """The list of clauses() that tells most."""
    return clauses(regex)[0]


def folded(text: Column) -> Column:
    """Lower case as the rules fold it."""
    return F.translate(F.lower(text), "ſ", "s")


def find_rules(text: Column, rules: list[Rule] = RULES) -> Column:
    """Matches of a text as it stands, in the order of the rules."""
    from .normalize import rules_in

    return told(F.transform(rules_in(rules)(text), lambda r: r["rule"]), rules)


def catalogue(rules: list[Rule], *fields: str) -> Column:
    """The rules as one array of structs of the given fields (not regex)."""
    quoted = lambda v: str(v) if isinstance(v, int) else f"'{v}'"
    return F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'{f}', {quoted(getattr(r, f))}" for f in fields) + ")" for r in rules) + ")")


def told(numbers: Column, rules: list[Rule] = RULES) -> Column:
    """The matches of an array of rule numbers."""
    known = catalogue(rules, "rule_id", "category", "severity")
    return F.transform(numbers, lambda k: F.element_at(known, k + 1)).cast(MATCH)


def rules_table(spark: SparkSession, category: str | None = None, lang: str | None = None) -> DataFrame:
    """The rule catalogue, all or by category or language."""
    rows = [(*r, f"{r.category.replace('-', ' ')}, {LANGUAGES[r.lang]}, severity {r.severity}") for r in RULES if category in (None, r.category) and lang in (None, r.lang)]
    return spark.createDataFrame(rows, "rule_id string, category string, severity int, lang string, regex string, description string")


def matches_long(df: DataFrame, key: str, text: str, rules: list[Rule] = RULES) -> DataFrame:
    """(key, rule_id, category, severity, lang, matched) for each text and rule found in it; matched is the first match.

    The rule list is fixed and small, so it is part of the plan; no join is needed.  Other columns are not read; null
    and empty texts give no rows.
    """
    from .normalize import rules_in

    known = catalogue(rules, "rule_id", "category", "severity", "lang")
    rows = df.select(F.col(f"`{key}`").alias("k"), rules_in(rules)(F.col(f"`{text}`")).alias("found")).select("k", F.explode("found").alias("m"))
    return rows.select(F.col("k").alias(key), F.element_at(known, F.col("m.rule") + 1).alias("r"), "m.matched").select(key, "r.*", "matched")


def python_rules() -> list[tuple[Rule, re.Pattern]]:
    """The rules compiled for Python, for tests."""
    return [(r, re.compile(to_python(r.regex), re.IGNORECASE)) for r in RULES]
