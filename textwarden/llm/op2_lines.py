"""Line dedup by site-relative frequency: lines on more than a given part of a host's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, few, staged, table, unused

#: A line goes if more than this part of its host's pages has it, and at least so many pages.
RATIO, MIN_PAGES = 0.1, 5
#: The frequent lines are broadcast up to this number, else joined by salted host.
BROADCAST_LINES, SALTS = 100_000, 32

_WHITE = " \t\r\x0b\x0c"


def _key(line: Column) -> Column:
    """What makes lines equal: their text without white space around, as 96 bits."""
    bare = F.btrim(line, F.lit(_WHITE))
    return F.struct(F.xxhash64(bare).alias("h"), F.hash(bare).alias("g"), F.length(bare).alias("n"))


def frequent_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line key, pages) of boilerplate lines.

    A page and its exact copies on a host count as one page, for the line and for the host.  Blank lines are none.
    Only hashes are shuffled: one (host, line, page) each, then sums.  A host of P pages with L lines each on
    average has at most L / ratio such lines.
    """
    rows = pages.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{host}`").alias("host"), F.xxhash64(f"`{text}`").alias("page"), F.col(f"`{text}`").alias("t"))
    totals = rows.groupBy("host", "page").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("total"))
    keys = F.array_distinct(F.filter(F.transform(F.split("t", "\n"), _key), lambda k: k["n"] > 0))
    found = rows.select("host", "page", F.explode(keys).alias("k")).groupBy("host", "k", "page").agg(F.lit(1)).groupBy("host", "k").agg(F.count("*").alias("pages"))
    often = found.where(F.col("pages") >= min_pages)
    same = F.col("host").eqNullSafe(F.col("host2"))
    return often.join(totals.withColumnRenamed("host", "host2"), same).where(F.col("pages") > ratio * F.col("total")).select("host", "k", "pages")


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = False) -> DataFrame:
    """Drops boilerplate lines from ``text``; all columns stay, whatever their names, and n_lines and n_dropped are added (or
    replaced) if ``counts``.

    Null texts stay null and have no lines; empty texts are one blank line; pages of a null host are a host; repeated
    rows are kept and count as one page; ties can't arise; an empty table gives no rows.  The texts are not shuffled while
    the frequent lines fit in BROADCAST_LINES; beyond it they are, by host and a salt of the whole row, so that neither a
    hot host nor copies of one text are one task's.
    """
    own, often, mark, salt, spread_salt, kept = (unused(pages, n) for n in ("_host", "_often", "_mark", "_salt", "_spread", "_kept"))
    with Scratch(pages.sparkSession) as scratch:
        lines = scratch.table(frequent_lines(pages, host, text, ratio, min_pages))
        by_host = staged(lines.groupBy("host").agg(F.collect_list("k").alias(often)).withColumnRenamed("host", own))
        small = few(lines, BROADCAST_LINES)
    here = F.col(f"`{host}`").eqNullSafe(F.col(own))
    if small:
        both = pages.join(F.broadcast(by_host), here, "left")
    else:
        hashed = [f"`{c}`" for c, kind in pages.dtypes if "map<" not in kind and kind != "variant"]
        spread = by_host.withColumn(spread_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = pages.withColumn(salt, F.pmod(F.xxhash64(*hashed), F.lit(SALTS))).join(spread, here & (F.col(salt) == F.col(spread_salt)), "left").drop(salt, spread_salt)
    split = F.split(F.col(f"`{text}`"), "\n")
    known = F.coalesce(often, F.array().cast(by_host.schema[often].dataType))
    out = both.withColumn(kept, F.when(F.size(known) > 0, F.filter(split, lambda x: ~F.array_contains(known, _key(x)))).otherwise(split))
    told = {}
    if counts:
        size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
        zero = F.when(F.col(f"`{text}`").isNull(), F.lit(0).cast("bigint"))
        told = {"n_lines": zero.otherwise(size(split)), "n_dropped": zero.otherwise(size(split) - size(F.col(kept)))}
    same = [F.array_join(kept, "\n").alias(c) if c == text else F.col(f"`{c}`") for c in pages.columns if c not in told]
    return out.select(*same, *[c.alias(n) for n, c in told.items()])


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), counts=True)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Rows of documents without their boilerplate lines.
KEPT_SQL = r"""
  SELECT d.*, list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(often, []), trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)))) AS kept
  FROM {docs} d LEFT JOIN (
    SELECT l.source, list(l.line) AS often FROM (
      SELECT source, line, count(DISTINCT text) AS pages FROM (
        SELECT source, text, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12))))) AS line FROM {docs} WHERE text IS NOT NULL
      ) WHERE line <> '' GROUP BY source, line
    ) l JOIN (SELECT source, count(DISTINCT text) AS total FROM {docs} WHERE text IS NOT NULL GROUP BY source) t ON l.source IS NOT DISTINCT FROM t.source
    WHERE pages >= 5 AND pages > 0.1 * total GROUP BY l.source
  ) o ON d.source IS NOT DISTINCT FROM o.source
"""

OP2_SQL = f"""
WITH k AS ({KEPT_SQL.format(docs="documents")})
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(string_split(text, chr(10))) - len(kept), 0) AS BIGINT) AS n_dropped,
  sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256
FROM k
"""
