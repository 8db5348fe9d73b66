"""Column helpers over text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dialect import to_java


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names, each with underscores before it until no column is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def col(name: str) -> Column:
    """A column by its very name, dots or not."""
    return F.col("`" + name.replace("`", "``") + "`")


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column (or replaces it) as a row of a generator: it is worked out once, and the optimizer neither copies it into
    what reads it nor moves filters on it below it."""
    if name not in df.columns:
        return df.select("*", F.explode(F.array(value)).alias(name))
    (fresh,) = unused(df, name)
    out = df.select("*", F.explode(F.array(value)).alias(fresh))
    return out.select(*[col(c) for c in df.columns if c != name], col(fresh).alias(name))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: What counts as white space when texts are trimmed and split (Unicode).
WHITE = " \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE = WHITE.replace(" ", "\\x20", 1)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def fields(text: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(text, f"[{_WHITE}]+"), lambda x: x != "")


def words(text: Column) -> Column:
    """Lower-case tokens of letters and digits only; tokens without any are left out."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, rf"[^\p{{L}}\p{{Nd}}{_WHITE}]+", "")), f"[{_WHITE}]+"), lambda x: x != "")


def matches(text: Column, regex: str, ignore_case: bool = False) -> Column:
    """Whether a regex of the rules' dialect is found."""
    return text.rlike(to_java(regex, ignore_case))


def literals(values: Sequence[str]) -> Column:
    """An array of literal strings, made in one call."""
    quoted = ["'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values]
    return F.expr("array(" + ", ".join(quoted) + ")") if values else none_of("string")


def contains_any(lowered: Column, phrases: Sequence[str]) -> Column:
    return let(lowered, lambda low: F.exists(literals(phrases), lambda p: low.contains(p)))


def count_contains(lowered: Column, phrases: Sequence[str]) -> Column:
    return F.size(found(lowered, phrases))


def found(lowered: Column, phrases: Sequence[str]) -> Column:
    """The phrases that stand in the text."""
    return let(lowered, lambda low: F.filter(literals(phrases), lambda p: low.contains(p)))


def entropy(token: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""

    def of(chars: Column) -> Column:
        size = F.size(chars).cast("double")
        part = lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double") / size
        term = lambda c: let(part(c), lambda p: p * F.log2(p))
        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - term(c))

    return F.when(F.length(token) == 0, F.lit(0.0)).otherwise(let(F.filter(F.split(token, ""), lambda c: c != ""), of))


def capped(value: Column, top: int) -> Column:
    return F.least(value, F.lit(top))


def none_of(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")
