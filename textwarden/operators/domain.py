"""URL and domain operators: host, allow-list match and check."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import none_of, trimmed
from .scoring import blocked, risk, safe

_HOST = r"\A[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(?:\[([^\]/?#]*)\]|([^:/?#\[\]@\s]*))(?::\d*)?(?:[/?#]|\z)"


def host(url: Column) -> Column:
    """Lower-case host without port; empty if there is none."""
    bare = trimmed(url)
    whole = F.when(bare.contains("://"), bare).otherwise(F.concat(F.lit("https://"), bare))
    found = F.concat(F.regexp_extract(whole, _HOST, 1), F.regexp_extract(whole, _HOST, 2))
    return F.when(bare == "", "").otherwise(F.lower(found))


def allowed(name: Column, allow: list[str]) -> Column:
    """Whether a host is allowed: ``*`` is any, ``*.x`` a subdomain of x but not x, else the very host."""
    one = lambda p: F.lit(True) if p == "*" else name.endswith(p[1:]) & (name != p[2:]) if p.startswith("*.") else name == p
    return reduce(or_, [one(p.strip().lower()) for p in allow if p.strip()], F.lit(False))


def check_domain(url: Column, allow: list[str], strict: bool = False) -> Column:
    """Risk of a URL: safe if allowed or nothing is listed, 70 if not allowed, 30 if it can't be read."""
    if not [p for p in allow if p.strip()]:
        return safe()
    name, none = host(F.coalesce(url, F.lit(""))), none_of("string")
    bad = lambda score, why: risk(F.lit(score), blocked(F.lit(score), strict), why, none, none)
    return F.when(name == "", bad(30, F.lit("Unable to parse domain from URL"))).when(allowed(name, allow), safe()).otherwise(bad(70, F.concat(F.lit("Domain not in allowlist: "), name)))


def allowed_by_table(df: DataFrame, url: str, patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Rows of ``df`` whose host an allow-list table allows; all columns stay.

    Each distinct host, with its parents, meets the list in equi-joins; the rows then meet the allowed hosts."""
    hosts = df.select(host(F.coalesce(F.col(url), F.lit(""))).alias("_host")).where("_host <> ''").distinct()
    parts = F.split("_host", r"\.")
    parents = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda k: F.concat(F.lit("*."), F.array_join(F.slice(parts, k, F.size(parts)), ".")))).otherwise(none_of("string"))
    keys = F.array_distinct(F.concat(F.array("_host", F.lit("*")), parents))
    listed = patterns.select(F.lower(F.col(pattern)).alias("_p")).distinct()
    good = hosts.select("_host", F.explode(keys).alias("_p")).join(listed, "_p", "left_semi").select("_host").distinct()
    return df.withColumn("_host", host(F.coalesce(F.col(url), F.lit("")))).join(good, "_host", "left_semi").drop("_host")
