"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are cut into pieces of at most a sequence's capacity; full pieces are bins of their own, the rest are packed
by best fit, largest first.  Bins are kept in order of their residual.  Each carries bitmaps of its sources, one plane for
each document that a source may have in it, and of its duplicate clusters.  The search starts at the successor of the
piece's size, the tightest bin that has room, and goes on to the next larger until one is compatible.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Tokens of a sequence, and pieces of one source that a bin may hold.
CAPACITY, PER_SOURCE = 4096, 4
#: Pieces of a shard, which is packed by one task; what a shard leaves open is a few bins.
SHARD_PIECES = 4_000

def tokens(text: str = "text") -> Column:
    """Words between white space and one end mark, of which even null and empty texts have one."""
    bare = F.btrim(F.col(f"`{text}`"), F.lit(" \t\n\r\x0b\x0c"))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, 1).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+")) + 1)


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[tuple[int, int]]:
    """(bin, start) of each piece.  Pieces are placed largest first, ties by position.

    A bin takes a piece if it has room, holds fewer than ``per_source`` pieces of its source and none of its cluster;
    pieces of a null source or cluster conflict with none.
    """
    several = {c for c, n in _counts(clusters).items() if n > 1}
    source_bit = {s: k for k, s in enumerate(_counts(sources))}
    cluster_bit = {c: k for k, c in enumerate(several)}
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    residuals: list[tuple[int, int]] = []  # in order: (residual, bin)
    planes: list[list[int]] = []
    members: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for k in order:
        size = sizes[k]
        s = 1 << source_bit[sources[k]] if sources[k] is not None else 0
        c = 1 << cluster_bit[clusters[k]] if clusters[k] in several else 0
        at = bisect_left(residuals, (size, -1))
        while at < len(residuals):
            b = residuals[at][1]
            if not members[b] & c and not planes[b][-1] & s:
                break
            at += 1
        if at < len(residuals):
            left, b = residuals.pop(at)
        else:
            left, b = capacity, len(planes)
            planes.append([0] * per_source)
            members.append(0)
        out[k] = (b, capacity - left)
        members[b] |= c
        for n in range(per_source):  # the first plane that lacks the source takes it
            if not planes[b][n] & s:
                planes[b][n] |= s
                break
        if left > size:
            insort(residuals, (left - size, b))
    return out


def _counts(values: Iterable) -> dict:
    out: dict = {}
    for v in values:
        if v is not None:
            out[v] = out.get(v, 0) + 1
    return out


def pack(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", cluster: Column | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> DataFrame:
    """Places every document: ``key``, part, n_tokens, shard, bin and start (token offset in the bin) of each piece.

    ``cluster`` names the duplicates that must not share a bin; by default, exact copies.  Null and empty texts are one
    token; rows of a null source or a null ``cluster`` conflict with none; repeated rows are pieces that conflict;
    an empty table gives no rows; other columns are not read.

    Only (key, tokens, source, cluster) of each document are shuffled, spread over shards of about SHARD_PIECES by
    hash, whatever their source and cluster, so that a hot source or cluster is no task's alone.
    """
    cluster = F.when(F.length(f"`{text}`") > 0, F.xxhash64(f"`{text}`")) if cluster is None else cluster
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("i"), tokens(text).alias("n"), F.col(f"`{source}`").cast("string").alias("s"), cluster.alias("c"))
    shards = max(1, -(-docs.select(F.lit(1)).count() // SHARD_PIECES))
    spread = rows.withColumn("shard", F.pmod(F.xxhash64("i", "n"), F.lit(shards)).cast("int"))
    names = [f"`{key}` {kind}", "part int", "n_tokens int", "shard int", "bin int", "start int"]

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by([("i", "ascending"), ("n", "ascending"), ("s", "ascending"), ("c", "ascending")])
        ids, sizes, sources, clusters, shard = (group.column(x).to_pylist() for x in ("i", "n", "s", "c", "shard"))
        parts = [(k, p, min(capacity, n - p * capacity)) for k, n in enumerate(sizes) for p in range(-(-n // capacity))]
        rest = [k for k, (_, _, n) in enumerate(parts) if n < capacity]
        placed = best_fit([parts[k][2] for k in rest], [sources[parts[k][0]] for k in rest], [clusters[parts[k][0]] for k in rest], capacity, per_source)
        where = dict(zip(rest, placed, strict=True))
        used = max((b for b, _ in placed), default=-1) + 1
        for k in range(len(parts)):
            if k not in where:
                where[k] = (used, 0)
                used += 1
        cols = [[ids[k] for k, _, _ in parts], [p for _, p, _ in parts], [n for _, _, n in parts], [shard[0]] * len(parts), [where[k][0] for k in range(len(parts))], [where[k][1] for k in range(len(parts))]]
        types = [group.schema.field("i").type, *[pa.int32()] * 5]
        return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=[key, "part", "n_tokens", "shard", "bin", "start"])

    return spread.groupBy("shard").applyInArrow(place, ", ".join(names))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
