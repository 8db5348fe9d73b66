"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of test items."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, folded_spans, folded_words, map_rows, staged, table, unused, utf8

WINDOW = 10
#: Bytes of item text that one automaton takes; a larger item table is scanned for in blocks of this size.
BLOCK_BYTES = 8 << 20


@dataclass
class Patterns:
    """Windows of items as text, and the items of each; the automaton is built once a worker."""

    windows: list[str]
    items: list[list[str]]

    def automaton(self) -> ahocorasick.Automaton:
        found = self.__dict__.get("_built")
        if found is None:
            found = ahocorasick.Automaton()
            for k, w in enumerate(self.windows):
                found.add_word(w, (k, w.count(" ") - 1))
            if self.windows:
                found.make_automaton()
            self.__dict__["_built"] = found
        return found

    def __getstate__(self) -> dict:
        return {"windows": self.windows, "items": self.items}


def patterns(items: Iterable[tuple], window: int = WINDOW) -> Patterns:
    """Patterns of (item id, text) pairs; windows that several items share are one pattern.

    An item of fewer words than ``window``, but not none, is one window; null and wordless texts give none.
    """
    owners: dict[bytes, set[str]] = {}
    for key, text in items:
        words = folded_words((text or "").encode())
        for k in range(max(1, len(words) - window + 1) if words else 0):
            owners.setdefault(b" ".join(words[k : k + window]), set()).add(str(key))
    return Patterns([f" {w.decode()} " for w in owners], [sorted(x) for x in owners.values()])


def item_blocks(items: DataFrame, key: str, text: str, limit: int) -> Iterator[list[tuple]]:
    """Blocks of items of at most about ``limit`` bytes; the driver holds one at a time."""
    block, size = [], 0
    for row in items.select(F.col(f"`{key}`"), F.col(f"`{text}`")).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def scan(text: bytes, one: Patterns) -> tuple[int, np.ndarray, list[str]]:
    """(words, which words are hit, sorted ids of items found) of a text."""
    words = folded_words(text)
    mask = np.zeros(len(words), dtype=bool)
    if not words or not one.windows:
        return len(words), mask, []
    flat = f" {b' '.join(words).decode()} "
    hits: list[tuple[int, int]] = []
    found: set[str] = set()
    for end, (k, n) in one.automaton().iter(flat):
        hits.append((end, n))
        found.update(one.items[k])
    if hits:
        at = np.frombuffer(flat.encode("utf-32-le"), dtype=np.uint32) == 32
        order = np.cumsum(at) - 1  # of the space at a pattern's end: the word after it
        for end, n in hits:
            last = order[end]
            mask[last - n : last] = True
    return len(words), mask, sorted(found)


def spans(text: bytes, mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Runs of hit words: (first word, the word after the last, and the byte range of the original text that they cover)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    if not edge.size:
        return []
    starts, ends = folded_spans(text)
    return [(int(a), int(b), int(starts[a]), int(ends[b - 1])) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def joined(runs: Iterable[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs of several blocks of items as one list; those that overlap or touch are one."""
    out: list[tuple[int, int, int, int]] = []
    for a, b, start, end in sorted(runs):
        if out and a <= out[-1][1]:
            _, high, first, last = out[-1]
            out[-1] = (out[-1][0], max(b, high), first, max(end, last))
        else:
            out.append((a, b, start, end))
    return out


_RUN = "struct<first:bigint,after:bigint,start:bigint,end:bigint>"


def _blocks(docs: DataFrame, items: DataFrame, item_key: str, item_text: str, window: int, block_bytes: int) -> Iterator[tuple[bool, Broadcast]]:
    """(whether it is the only one, patterns) of each block of items; driver and workers hold one block at a time."""
    sc, blocks = docs.sparkSession.sparkContext, item_blocks(items, item_key, item_text, block_bytes)
    block, after = next(blocks, []), next(blocks, None)
    only = after is None
    while block is not None:
        sent = sc.broadcast(patterns(block, window))
        yield only, sent
        if not only:
            sent.destroy()
        block, after = after, next(blocks, None)


def find_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Marks the words of each text that stand in an occurrence of an item's window.

    Returns ``key``, n_words, n_hit, items (sorted ids as strings) and spans (byte ranges of the original
    text that hit words cover).  Null and empty texts have no words; null item texts have no windows; rows of a null key
    are scanned as others; repeated rows are kept; an empty item table hits nothing; an empty table gives no rows; other
    columns are not read, whatever their names.

    An item table of at most ``block_bytes`` of text is one automaton, and the texts are read once.  A larger one is
    scanned for in blocks, one after another; what each finds in hit texts is written to the shared folder, and the
    runs of a text are joined by its key and hash.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("i"), F.xxhash64(utf8(f"`{text}`")).alias("h"), utf8(f"`{text}`").alias("t"))
    schema = f"i {kind}, h bigint, n bigint, runs array<{_RUN}>, items array<string>"
    pieces, lengths = [], None
    with Scratch(docs.sparkSession) as scratch:
        for only, sent in _blocks(docs, items, item_key, item_text, window, block_bytes):

            def work(ids, hashes, texts, sent=sent):
                for i, h, t in zip(ids, hashes, texts, strict=True):
                    n, mask, found = scan(t, sent.value)
                    yield i, h, n, [dict(zip(("first", "after", "start", "end"), r, strict=True)) for r in spans(t, mask)], found

            found = map_rows(rows, work, schema)
            if only:
                return _told(found, key)
            found = scratch.table(found)
            lengths = found.select("i", "h", "n") if lengths is None else lengths
            pieces.append(found.where(F.size("items") > 0).select("i", "h", "runs", "items"))
        every = pieces[0]
        for piece in pieces[1:]:
            every = every.unionByName(piece)
        # Repeated rows find the same, so each (key, hash) counts once.
        both = every.distinct().groupBy("i", "h").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

        def merged(ids, hashes, runs, found):
            for i, h, r, x in zip(ids, hashes, runs, found, strict=True):
                yield i, h, [dict(zip(("first", "after", "start", "end"), one, strict=True)) for one in joined(tuple(d.values()) for d in r)], x

        hit = map_rows(both, merged, f"i {kind}, h bigint, runs array<{_RUN}>, items array<string>").toDF("i2", "h2", "runs", "items")
        whole = lengths.join(hit, lengths.i.eqNullSafe(hit.i2) & (lengths.h == hit.h2), "left")
        return _told(staged(whole.select("i", "h", "n", F.coalesce("runs", F.array().cast(f"array<{_RUN}>")).alias("runs"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))), key)


def _told(found: DataFrame, key: str) -> DataFrame:
    n_hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, r: a + r["after"] - r["first"])
    return found.select(F.col("i").alias(key), F.col("n").alias("n_words"), n_hit.alias("n_hit"), "items", F.transform("runs", lambda r: F.struct(r["start"].cast("int").alias("start"), r["end"].cast("int").alias("end"))).alias("spans"))


def decontaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", max_share: float = 0.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` whose share of hit words is at most ``max_share``; all columns stay, whatever their names.

    Rows of null, empty and wordless texts stay; rows of a null key and repeated rows are judged as others; an empty
    item table drops nothing; an empty table gives no rows.  The texts are scanned in place, by a column expression, so
    nothing is shuffled; a further block of items scans what the one before left, from the shared folder.  With a
    ``max_share`` above 0, the keys and hashes of rejected rows are joined instead.
    """
    from pyspark.sql.functions import pandas_udf

    bounded_batches(docs.sparkSession)
    whole = utf8(f"`{text}`")
    if max_share > 0:
        i, h = unused(docs, "_i"), unused(docs, "_h")
        named = docs.select(F.struct(F.col(f"`{key}`").alias("k"), F.xxhash64(whole).alias("h")).alias("i"), F.col(f"`{text}`").alias("t"))
        bad = find_items(named, items, "i", "t", block_bytes=block_bytes).where(F.col("n_hit") > max_share * F.col("n_words"))
        bad = bad.select(F.col("i.k").alias(i), F.col("i.h").alias(h)).distinct()
        return docs.join(bad, F.col(f"`{key}`").eqNullSafe(F.col(i)) & (F.xxhash64(whole) == F.col(h)), "left_anti")
    out, before = docs, Scratch(docs.sparkSession)
    for only, sent in _blocks(docs, items, "item_id", "text", WINDOW, block_bytes):

        @pandas_udf("boolean")
        def clean(texts, sent=sent):
            return texts.map(lambda t: not scan(bytes(t), sent.value)[2]).astype(bool)

        out = out.where(clean(whole))
        if not only:
            now = Scratch(docs.sparkSession)
            out = now.table(out)
            before.clear()
            before = now
    return out


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The same rows by joining word windows.
OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[k:k + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS k FROM i WHERE len(ws) > 0)
), lens AS (SELECT DISTINCT n FROM iw), dw AS (
  SELECT doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM w, lens WHERE len(ws) >= n)
), hit AS (SELECT DISTINCT d.doc_id, d.k, d.n, iw.item_id FROM dw d JOIN iw ON d.win = iw.win AND d.n = iw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
