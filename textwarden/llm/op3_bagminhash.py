"""Near-duplicates by BagMinHash: signatures of weighted sets of word shingles, banded, then verified.

Each shingle of weight w (how often the text has it) stands for a Poisson process over time, weight and signature
component; the points below weight w count, and a component takes the first that falls to it.  Weights are whole
numbers, and the process is split at their powers of two, so a point of a lighter bag is also one of a heavier bag:
two bags agree in a component with the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, few, folded_words, map_rows, staged, table, unused, utf8

SHINGLE, SIMILARITY = 5, 0.8
#: Signature components and bands; at a similarity of 0.8, a pair shares no band with a chance of 3e-6.
COMPONENTS, BANDS = 96, 24
#: Rows of (id, id) that are broadcast; more are joined by shuffles.
BROADCAST_IDS = 1_000_000
#: Rows from which a key is hot, and hot keys that are broadcast at most.
HOT_ROWS, HOT_KEYS = 500, 100_000
#: Members up to which a bucket's unlinked members are compared pair by pair; larger buckets are in blocks.
SMALL_BUCKET = 32
#: Rows and bytes of a block of queries or of members, and blocks of queries that a round compares with all members.
BLOCK, BLOCK_BYTES, BLOCKS_AT_ONCE = 1000, 8 << 20, 2
#: Edges that a worker joins to trees at once, and edges of a partition after the first turn.
CHUNK, SPREAD = 200_000, 10_000
GROUP_BYTES = 2 << 20

U = np.uint64
_C1, _C2, _C3, _C4 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _C1
    x = (x ^ (x >> U(27))) * _C2
    return x ^ (x >> U(31))


def shingles(words: list[list[bytes]], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, name) of every shingle; a text of fewer words than ``size``, but not none, is one shingle."""
    counts = np.array([len(w) for w in words], dtype=np.int64)
    n = int(counts.sum())
    if not n:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=U)
    flat = np.empty(n, dtype=object)
    flat[:] = [x for w in words for x in w]
    h = pd.util.hash_array(flat, categorize=False)
    doc = np.repeat(np.arange(len(words)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)  # words from here to the text's end
    total = np.zeros(n, dtype=U)
    for k in range(size):
        there = left > k
        total[there] = total[there] * _C4 + h[np.flatnonzero(there) + k]
    first = np.repeat(np.cumsum(counts) - counts, counts) == np.arange(n)
    whole = (left >= size) | first
    return doc[whole], _mix(total[whole])


def bags(doc: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, weight) of the distinct shingles."""
    order = np.lexsort((name, doc))
    doc, name = doc[order], name[order]
    if not doc.size:
        return doc, name, np.empty(0, dtype=np.int64)
    at = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (name[1:] != name[:-1]))))
    return doc[at], name[at], np.diff(np.append(at, doc.size))


def signatures(doc: np.ndarray, name: np.ndarray, weight: np.ndarray, n: int, components: int = COMPONENTS) -> np.ndarray:
    """Signatures (n, components) of the bags of ``n`` texts; those of a text without shingles are all 0.

    Points are drawn in order of time up to a bound that starts near where most components have their first
    point; it is raised for the texts that have components left.  All points below the bound are known, so a component's
    first is its minimum.
    """
    level = np.zeros(weight.size, dtype=np.int64)
    rows = [(np.arange(weight.size), level)]
    k = 1
    while (more := np.flatnonzero(weight > 1 << (k - 1))).size:
        rows.append((more, np.full(more.size, k)))
        k += 1
    which, level = (np.concatenate(x) for x in zip(*rows, strict=True))
    d, w, seed = doc[which], weight[which], _mix(name[which] + level.astype(U) * _C4)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.where(level > 0, low, 1)
    rate = (components * width).astype(float)
    total = np.bincount(doc, weights=weight, minlength=n)
    limit = 6.0 / np.maximum(total, 1)
    time = np.full(n * components, np.inf)
    sig = np.zeros(n * components, dtype=U)
    draw = np.zeros(d.size, dtype=U)
    wait = lambda a, j: -np.log(((_mix(seed[a] ^ (j * _C3 + _C1)) >> U(11)).astype(float) + 0.5) / 9007199254740992.0) / rate[a]
    x = wait(np.arange(d.size), draw)
    todo = np.arange(d.size)
    while todo.size:
        alive = todo[x[todo] < limit[d[todo]]]
        while alive.size:
            bits = _mix(seed[alive] + draw[alive] * _C3 + _C2)
            at = low[alive] + (bits >> U(32)).astype(np.int64) % width[alive]
            kept = at < w[alive]
            a, b = alive[kept], bits[kept]
            slot = d[a] * components + (b & U(0xFFFFFFFF)).astype(np.int64) % components
            np.minimum.at(time, slot, x[a])
            won = x[a] == time[slot]
            sig[slot[won]] = _mix(b[won] ^ seed[a[won]])
            draw[alive] += U(1)
            x[alive] += wait(alive, draw[alive])
            alive = alive[x[alive] < limit[d[alive]]]
        full = (time.reshape(n, components) < np.inf).all(axis=1)
        todo = todo[~full[d[todo]]]
        limit[~full] *= 1.5
    return sig.reshape(n, components)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (sorted shingles, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    top = int(a[1].sum() + b[1].sum()) - low
    return low / top if top else 0.0


def _groups(texts: list[bytes]):
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < GROUP_BYTES):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def _sign(ids, texts):
    for at, end in _groups(texts):
        words = [folded_words(t) for t in texts[at:end]]
        doc, name = shingles(words)
        sig = signatures(*bags(doc, name), len(words))
        rows = COMPONENTS // BANDS
        band = np.zeros((len(words), BANDS), dtype=U)
        for k in range(rows):
            band = _mix(band * _C4 + sig[:, k::rows])
        band = (band + np.arange(BANDS, dtype=U)).view(np.int64)  # mixed names of different bands don't meet
        for k, (i, w) in enumerate(zip(ids[at:end], words, strict=True)):
            if w:
                yield i, xxhash.xxh3_128_digest(b" ".join(w)), band[k].tolist()


def _bags_of(ids, texts):
    """Bags of candidates: total weight, shingles and weights as bytes."""
    for at, end in _groups(texts):
        words = [folded_words(t) for t in texts[at:end]]
        doc, name, weight = bags(*shingles(words))
        edge = np.searchsorted(doc, np.arange(len(words) + 1))
        for k, i in enumerate(ids[at:end]):
            one = slice(edge[k], edge[k + 1])
            yield i, int(weight[one].sum()), name[one].tobytes(), weight[one].astype(np.uint32).tobytes()


_BAGS = "d bigint, total bigint, bag binary, weights binary"


def _bag(bag: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(bag, dtype=U), np.frombuffer(weights, dtype=np.uint32).astype(np.int64)


def _verify(threshold: float):
    def work(x, y, bag1, weights1, bag2, weights2):
        for i, j, *rest in zip(x, y, bag1, weights1, bag2, weights2, strict=True):
            if overlap(_bag(*rest[:2]), _bag(*rest[2:])) >= threshold:
                yield min(i, j), max(i, j)

    return work


def _units(bags: list[bytes], weights: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, name) of the units of several bags: the t-th copy of a shingle is a unit of its own, so that the common weight of
    two bags is the number of their common units."""
    row = np.repeat(np.arange(len(bags)), [len(b) // 8 for b in bags])
    name, weight = _bag(b"".join(bags), b"".join(weights))
    nth = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
    return np.repeat(row, weight), np.where(nth > 0, _mix(np.repeat(name, weight) + nth.astype(U) * _C2), np.repeat(name, weight))


def common_weights(a: tuple[list[bytes], list[bytes]], b: tuple[list[bytes], list[bytes]]) -> np.ndarray:
    """Common weight of each bag of one list with each of another: units of many bags by a product of matrices, the others
    one by one."""
    (ra, na), (rb, nb) = _units(*a), _units(*b)
    both = np.intersect1d(na, nb)
    out = np.zeros((len(a[0]), len(b[0])), dtype=np.float32)
    if not both.size:
        return out

    def held(row, name):
        col = np.minimum(np.searchsorted(both, name), both.size - 1)
        there = both[col] == name
        order = np.argsort(col[there], kind="stable")
        return row[there][order], col[there][order]

    (ra, ca), (rb, cb) = held(ra, na), held(rb, nb)
    fa, fb = np.bincount(ca, minlength=both.size), np.bincount(cb, minlength=both.size)
    dense = fa * fb > out.size / 200
    columns = np.flatnonzero(dense)
    for at in range(0, columns.size, 2048):
        chosen = columns[at : at + 2048]
        x, y = np.zeros((out.shape[0], chosen.size), dtype=np.float32), np.zeros((out.shape[1], chosen.size), dtype=np.float32)
        for m, rows, cols in ((x, ra, ca), (y, rb, cb)):
            place = np.minimum(np.searchsorted(chosen, cols), chosen.size - 1)
            one = chosen[place] == cols
            m[rows[one], place[one]] = 1
        out += x @ y.T
    sa, sb = np.cumsum(fa) - fa, np.cumsum(fb) - fb
    for k in np.flatnonzero(~dense):
        out[np.ix_(ra[sa[k] : sa[k] + fa[k]], rb[sb[k] : sb[k] + fb[k]])] += 1
    return out


def _closing(threshold: float):
    """Compares each query with all members of a block at once; tells the links that join classes, but none twice."""

    def work(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out, up = [], {}

        def root(c: int) -> int:
            while up.get(c, c) != c:
                up[c] = c = up.get(up[c], up[c])
            return c

        if len(members) and len(queries):
            low = common_weights((list(members["bag"]), list(members["weights"])), (list(queries["bag"]), list(queries["weights"]))).astype(float)
            top = members["total"].to_numpy()[:, None] + queries["total"].to_numpy()[None, :] - low
            c, q = members["c"].to_numpy(), queries["c"].to_numpy()
            near = np.argwhere((low / top >= threshold) & (c[:, None] != q[None, :]))
            for i, j in {(int(min(c[m], q[n])), int(max(c[m], q[n]))) for m, n in near}:
                if root(i) != root(j):
                    up[max(root(i), root(j))] = min(root(i), root(j))
                    out.append((i, j))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return work


def _trees(level: int):
    """Each node of a chunk of edges with the root of its tree in that chunk: the node of the least hash."""
    seed = _mix(np.array([level + 1], dtype=U))

    def joined(chunk: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [np.concatenate([b.column(k).to_numpy() for b in chunk]) for k in (0, 1)]
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        rank = _mix(nodes.view(U) ^ seed)
        order = np.argsort(rank, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(order.size)
        x, y = place[at[: ends[0].size]], place[at[ends[0].size :]]
        up = np.arange(order.size)
        while (up[x] != up[y]).any():
            np.minimum.at(up, np.maximum(up[x], up[y]), np.minimum(up[x], up[y]))
            while (up[up] != up).any():
                up = up[up]
        root = order[up[place]]
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(rank[root].view(np.int64)), pa.array(nodes[root])], names=["d", "h", "r"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, n = [], 0
        for batch in batches:
            chunk.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield joined(chunk)
                chunk, n = [], 0
        if n:
            yield joined(chunk)

    return run


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(d, c): the smallest id of each linked node's component.

    Workers join chunks of edges to trees.  A node that stands in several chunks links their roots, and those links are
    the edges of the next turn, dealt evenly.  As roots are the nodes of the least hash, another one each turn, a third of the
    nodes goes a turn at least, whatever the order of ids; commonly the links left fit in one chunk at once.  A node's roots are
    at most as many as there are chunks.
    """
    turns, now = [], edges.select("a", "b")
    while True:
        trees = now.mapInArrow(_trees(len(turns)), "d bigint, h bigint, r bigint")
        roots = F.transform(F.array_sort(F.collect_set(F.struct("h", "r"))), lambda x: x["r"])
        found = scratch.table(trees.groupBy("d").agg(roots.alias("roots")))
        first = F.element_at("roots", 1)
        turns.append(found.select("d", first.alias("c")))
        left = found.where(F.size("roots") > 1).select(F.explode("roots").alias("a"), first.alias("b")).where("a <> b")
        n = left.count()
        if not n:
            break
        now = left.repartition(-(-n // SPREAD))
    label = turns.pop()
    while turns:
        above = label.toDF("c", "root")
        above = F.broadcast(above) if few(above, BROADCAST_IDS) else above
        label = scratch.table(turns.pop().join(above, "c", "left").select("d", F.coalesce("root", "c").alias("c")))
    least = scratch.table(label.groupBy("c").agg(F.min("d").alias("least")))
    return scratch.table(label.join(F.broadcast(least) if few(least, BROADCAST_IDS) else least, "c").select("d", F.col("least").alias("c")))


def _renamed(ids: DataFrame, col: str, label: DataFrame) -> DataFrame:
    """``ids`` with the class of ``col`` by ``label`` (d, c) in its place; what has no label stays."""
    names = label.toDF(col, "_class")
    names = F.broadcast(names) if few(label, BROADCAST_IDS) else names
    return ids.join(names, col, "left").withColumn(col, F.coalesce("_class", col)).drop("_class")


def _met(rows: DataFrame, keyed: DataFrame, on: str, rest: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, a staged table of one row a key with the number ``n`` of the key's rows.

    The keys of the most rows are broadcast, at most HOT_KEYS of them, and their rows stay where they are; the others,
    of few rows each, are joined by a shuffle (``rest``: inner, or left where rows without a key stay)."""
    total = keyed.agg(F.sum("n")).first()[0] or 0
    least = max(HOT_ROWS, total // HOT_KEYS + 1)
    hot = F.broadcast(keyed.where(F.col("n") >= least))
    cold = rows.join(hot.select(on), on, "left_anti").join(keyed.where(F.col("n") < least), on, rest)
    return rows.join(hot, on).unionByName(cold)


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """(d, class) of each non-null ``key`` whose row has words; see near_duplicates().

    No bucket's pairs are emitted: members are compared with their bucket's smallest member and with one chosen by hash.
    Each document meets two of its buckets' so.  Then, in buckets that still hold several classes, the members outside
    the largest one are compared with all members of other classes there: pair by pair in small buckets, in blocks in
    large ones.  So no link in a bucket is missed between classes, and none is needed inside one.
    """
    rows = df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("bigint").alias("d"), utf8(f"`{text}`").alias("t"))
    with Scratch(df.sparkSession) as scratch:
        signed = scratch.table(map_rows(rows, _sign, "d bigint, content binary, bands array<bigint>"))
        nodes = signed.groupBy("content").agg(F.min("d").alias("d"), F.first("bands").alias("bands"))
        member = nodes.select("d", F.explode("bands").alias("k"))
        bucket = member.groupBy("k").agg(F.min("d").alias("p"), F.min_by("d", F.xxhash64("d")).alias("q"), F.count("*").alias("n")).where("n > 1")
        member = scratch.table(_met(member, scratch.table(bucket), "k"))
        pivot = scratch.table(member.groupBy("d").agg(F.min("p").alias("p"), F.min("q").alias("q")))
        ids = pivot.select("d")
        held = scratch.table(map_rows(rows.join(F.broadcast(ids) if few(ids, BROADCAST_IDS) else ids, "d", "left_semi"), _bags_of, _BAGS))
        bag = lambda x, n: held.select(F.col("d").alias(x), F.col("bag").alias(f"bag{n}"), F.col("weights").alias(f"weights{n}"))

        # A document of many buckets is first compared with two of its pivots only; what that leaves open is closed below.
        pairs = pivot.select(F.col("d").alias("x"), F.explode(F.array_distinct(F.array("p", "q"))).alias("y")).where("x <> y")
        full = pairs.join(bag("x", 1), "x").join(bag("y", 2), "y").select("x", "y", "bag1", "weights1", "bag2", "weights2")
        label = components(scratch.table(map_rows(full, _verify(threshold), "a bigint, b bigint")), scratch)

        here = _renamed(member.select("k", "d", "n", F.col("d").alias("c")), "c", label)
        open_ = here.groupBy("k").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.first("n").alias("n")).where("low < high").select("k", "n")
        here = scratch.table(_met(here.drop("n"), scratch.table(open_), "k"))
        small = here.where(F.col("n") <= SMALL_BUCKET)
        other = small.select("k", F.col("d").alias("e"), F.col("c").alias("f"))
        pairs = small.join(other, "k").where("d < e AND c <> f").groupBy("d", "e").agg(F.first("c").alias("c"), F.first("f").alias("f"))
        full = pairs.join(bag("d", 1), "d").join(bag("e", 2), "e").select(F.struct("c", "f"), F.lit(0), "bag1", "weights1", "bag2", "weights2")
        links = [scratch.table(map_rows(full, _verify_classes(threshold), "a bigint, b bigint"))]
        many = here.where(F.col("n") > SMALL_BUCKET).select("k", "d", "c")
        if not many.isEmpty():
            links += _closed(many, held, threshold, scratch)
        links = [x for x in links if not x.isEmpty()]
        node = scratch.table(signed.groupBy("content").agg(F.min("d").alias("node"), F.count("*").alias("n")).where("n > 1"))
        copies = signed.select("d", "content")
        named = copies.join(F.broadcast(node), "content", "left") if few(node, BROADCAST_IDS) else _met(copies, node, "content", "left")
        named = _renamed(named.select("d", F.coalesce("node", "d").alias("class")), "class", label)
        if links:
            found = links[0]
            for x in links[1:]:
                found = found.union(x)
            named = _renamed(named, "class", components(found, scratch))
        return staged(named.groupBy("d").agg(F.min("class").alias("class")))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """``key`` and class_id (the smallest key of the class) of each row; classes are what links of at least
    ``threshold`` connect.

    Texts of equal words are one node.  Null, empty and wordless texts, and rows of a null key, have no links; the
    former are classes of their own, the latter's class is null.  Rows that share a key count as one document with
    several texts; other columns are not read, whatever their names; an empty table gives no rows; ties can't
    arise.  ``key`` is a whole number.  The table of (key, class) that the result reads stays in the shared folder.
    """
    back = df.select(F.col(f"`{key}`"), F.col(f"`{key}`").cast("bigint").alias("_d"))
    found = back.join(classes(df, key, text, threshold), F.col("_d") == F.col("d"), "left")
    return found.select(F.col(f"`{key}`"), F.coalesce("class", "_d").alias("class_id"))


def _verify_classes(threshold: float):
    def work(pair, _, bag1, weights1, bag2, weights2):
        for p, *rest in zip(pair, bag1, weights1, bag2, weights2, strict=True):
            if overlap(_bag(*rest[:2]), _bag(*rest[2:])) >= threshold:
                yield min(p["c"], p["f"]), max(p["c"], p["f"])

    return work


def _closed(many: DataFrame, held: DataFrame, threshold: float, scratch: Scratch) -> list[DataFrame]:
    """Links between classes in large buckets (k, d, c).  Buckets that share members are one group; the documents outside the
    group's largest class are queries against all of the group, both in blocks, each pair of blocks one task's group.

    A round takes BLOCKS_AT_ONCE blocks of queries, so its shuffle holds each bag a few times, however large the group.
    """
    here = many.select("k", "c").distinct()
    star = here.join(here.groupBy("k").agg(F.min("c").alias("b")), "k").where("c <> b").select(F.col("c").alias("a"), "b")
    rows = many.select("d", "c").distinct().join(components(scratch.table(star.distinct()), scratch).toDF("c", "s"), "c")
    rows = scratch.table(rows.join(held, "d"))
    sizes = rows.groupBy("s", "c").agg(F.count("*").alias("n"), F.sum(F.lit(12) * F.col("total")).alias("bytes"))
    sizes = sizes.groupBy("s").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "c", "bytes")).alias("top"))
    blocks = lambda n, size: F.ceil(F.greatest(n / F.lit(float(BLOCK)), size / F.lit(float(BLOCK_BYTES)))).cast("bigint")
    n, top = F.col("n"), F.col("top")
    sizes = scratch.table(sizes.where(n > top["n"]).select("s", "main", blocks(n, F.col("bytes")).alias("nm"), blocks(n - top["n"], F.col("bytes") - top["bytes"]).alias("nq")))
    both = rows.join(F.broadcast(sizes) if few(sizes, BROADCAST_IDS) else sizes, "s")
    every = lambda first, last: F.explode(F.sequence(first, last))
    own = lambda n: F.pmod(F.xxhash64("d"), F.col(n))
    cols = ["s", "m", "q", "d", "c", "total", "bag", "weights"]
    links = []
    for first in range(0, sizes.agg(F.max("nq")).first()[0] or 0, BLOCKS_AT_ONCE):
        last = first + BLOCKS_AT_ONCE - 1
        now = both.where(F.col("nq") > first)
        members = now.withColumn("m", own("nm")).withColumn("q", every(F.lit(first).cast("bigint"), F.least(F.lit(last), F.col("nq") - 1))).select(cols).toDF(*cols)
        queries = now.where("c <> main").withColumn("q", own("nq")).where(F.col("q").between(first, last)).withColumn("m", every(F.lit(0).cast("bigint"), F.col("nm") - 1)).select(cols).toDF(*cols)
        found = members.groupBy("s", "m", "q").cogroup(queries.groupBy("s", "m", "q")).applyInPandas(_closing(threshold), "a bigint, b bigint")
        links.append(scratch.table(found.distinct()))
    return links


def first_of_class(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of each class's smallest key, and all rows of a null key or without words; all columns stay, whatever their names.

    Null, empty and wordless texts, repeated rows and empty tables are as in near_duplicates(): rows that share a key stay or go
    together."""
    name = unused(df, "_gone")
    gone = classes(df, key, text).where("d <> class").select(F.col("d").alias(name))
    gone = F.broadcast(gone) if few(gone, BROADCAST_IDS) else gone
    return df.join(gone, F.col(f"`{key}`").cast("bigint") == F.col(name), "left_anti")


def op3_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The same classes by all pairs.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), b AS (
  SELECT doc_id, s, count(*) AS n FROM (SELECT doc_id, array_to_string(ws[k:k + least(len(ws), 5) - 1], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS k FROM w WHERE len(ws) > 0)) GROUP BY doc_id, s
), t AS (SELECT doc_id, sum(n) AS total FROM b GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS low FROM b x JOIN b y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM p JOIN t ta ON ta.doc_id = a JOIN t tb ON tb.doc_id = b WHERE CAST(low AS DOUBLE) / CAST(ta.total + tb.total - low AS DOUBLE) >= 0.8),
ends AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, ends.b FROM r JOIN ends ON r.c = ends.a)
SELECT doc_id, min(c) AS class_id FROM r GROUP BY doc_id
"""
