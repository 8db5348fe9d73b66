"""Main text of pages by nearest-URL page differencing.

Pages of a host are ordered by URL path.  The text lines of each page are aligned with those of its two neighbours by
their longest common subsequence, and shared lines go: they belong to the site, not to the page.  Neighbours that share
more than COPY_SHARE of their unmarked lines may be copies; a run of such pages is aligned with the pages before and
after the run instead, and if the host has no other page, each with the next one of other lines.

Markup confirms: where the page marks its article, the article's own lines stay even if a neighbour has them too (a copy,
or a sentence that two articles share).  And it ends the work on what no neighbour shares: lines in menus, headers, footers,
sidebars, notices, adverts, forms and reader comments, and those outside the page's article, go.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import cache
from urllib.parse import urlsplit

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, few, map_rows, staged, table, utf8

#: Elements whose content is characters up to their own end tag, and no text of the page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that hold markup, but no text of the page.
UNSEEN = frozenset("noscript template object svg math canvas audio video select datalist".split())
#: Elements that are no part of a main text, wherever they stand.
CHROME = frozenset("nav footer aside form menu dialog button".split())
#: Elements that start and end a block of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are followed to their end: those above that hold others.
HOLDERS = UNSEEN | frozenset("address article aside blockquote details div dl fieldset figure footer form header main menu nav ol pre section table tbody td tfoot th thead tr ul dialog button".split())
#: Elements that the next one of their kind ends; a block ends an open p.
TEXTUAL = frozenset("p li dt dd h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class and id that mark what is no main text.
HINTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription paywall sidebar widget widgets menu menubar nav navbar navigation navi breadcrumb breadcrumbs comment comments disqus respond reply replies share sharing social related recommended recommendations popup modal overlay login signup register search pagination pager toolbar tags".split())
#: The same for elements outside an article; inside, they hold its title or its notes.
EDGE_HINTS = frozenset("header masthead topbar footer bottom copyright".split())
#: Words that only say where or what an element is.  Inside an article, a name of a hint and others ("search-and-rescue") is a subject.
PLACES = frozenset("area article articles bar block body bottom box btn button buttons card cards col column container content count feed footer form group head header holder icon icons image inline inner input item items label layer left line link links list main message more msg new outer page panel popular post posts primary right row secondary section site slot small tab text title top unit view wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())

FREE, ARTICLE, DROPPED = 0, 1, 2

#: Neighbours of which one shares more than this part of its free lines may be copies; pages beyond them tell what is the site's.
COPY_SHARE = 0.8
#: Equal pairs of lines up to which two pages are aligned pair by pair; beyond it, by halves.
PAIRS = 1_000_000

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|([^<]+|<)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_MAIN_ROLE = re.compile(r"role\s*=\s*[\"']?main\b")
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])|\Z", re.IGNORECASE)


def _hinted(name: str, inside: bool) -> bool:
    """Whether one name of a class or id marks what is no main text."""
    words = set(_WORD.findall(_CAMEL.sub(" ", name).lower()))
    if inside:
        return bool(words & HINTS) and all(w in HINTS or w in PLACES or w.isdigit() for w in words)
    return bool(words & (HINTS | EDGE_HINTS))


def _dropped(tag: str, text: str, inside: bool) -> bool:
    """Whether an element's tag or attributes mark what is no main text; ``inside`` an article other rules hold."""
    if tag in CHROME or tag in UNSEEN or tag == "header" and not inside:
        return True
    if not text or tag in ("html", "body", "main"):
        return False
    found = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTRIBUTE.finditer(text)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.IGNORECASE):
        return True
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    return any(_hinted(n, inside or tag == "article") for n in names)


def lines(page: str) -> list[tuple[str, int]]:
    """(text, zone) of each block of a page: FREE, ARTICLE or DROPPED.

    In a page with text in an article, other text is DROPPED, but FREE inside its main element; without one, the main
    element is the article.  Markup that ends in the middle of a tag, comment or script ends there; end tags may be left out."""
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, str]] = []  # tag, and what it makes of its text: dropped, unseen, article, main or nothing
    held: Counter = Counter()  # open elements by tag, and by what they make of their text
    at = 0

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, bool(held["=dropped"]), 2 if held["=article"] else 1 if held["=main"] else 0))

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[4] is not None:
            if not held["=unseen"]:
                parts.append(m[4])
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if not held["=unseen"]:
            if tag in BLOCKS:
                flush()
            elif tag == "br":
                parts.append(" ")
        closed = 0
        if m[1]:
            if held[tag]:
                closed = next(k for k, (t, _) in enumerate(reversed(stack), 1) if t == tag)
        elif tag in BLOCKS and stack and stack[-1][0] in TEXTUAL and (tag == stack[-1][0] or stack[-1][0] == "p"):
            closed = 1
        for _ in range(closed):
            if stack[-1][1] in ("article", "main", "dropped") and not held["=unseen"]:
                flush()
            name, makes = stack.pop()
            held[name] -= 1
            held[f"={makes}"] -= 1
        if m[1] or tag in VOID:
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                at = _end_of(tag).search(page, at).start()
            continue
        if _dropped(tag, m[3], bool(held["=article"] or held["=main"])):
            makes = "dropped" if tag in BLOCKS else "unseen"  # within a block, its text only is left out
        else:
            makes = "article" if tag == "article" else "main" if tag == "main" or _MAIN_ROLE.search(m[3]) else ""
        if makes or tag in HOLDERS:
            if makes in ("article", "main") and not held["=unseen"]:
                flush()
            stack.append((tag, makes))
            held[tag] += 1
            held[f"={makes}"] += 1
    flush()
    zones = ({0: FREE}, {0: DROPPED, 1: ARTICLE}, {0: DROPPED, 1: FREE, 2: ARTICLE})[max((c for _, gone, c in out if not gone), default=0)]
    return [(t, DROPPED if gone else zones[c]) for t, gone, c in out]


def address(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; null or without a host: empty."""
    try:
        parts = urlsplit((url or "").strip())
        return (parts.hostname or "").lower(), parts.path
    except ValueError:
        return "", ""


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and each prefix of ``b``, by bits: a bit that is off adds one."""
    where: dict[int, int] = defaultdict(int)
    for k, v in enumerate(b):
        where[v] |= 1 << k
    full = (1 << len(b)) - 1
    row = full
    for v in a:
        if v in where:
            hit = row & where[v]
            row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _halved(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence, in memory of one row: the best cut of ``b`` for each half of ``a``."""
    if not a or not b:
        return []
    if len(a) == 1:
        return [(0, b.index(a[0]))] if a[0] in b else []
    mid = len(a) // 2
    cut = int(np.argmax(_prefix_lengths(a[:mid], b) + _prefix_lengths(a[:mid - 1 : -1], b[::-1])[::-1]))
    return _halved(a[:mid], b[:cut]) + [(i + mid, j + cut) for i, j in _halved(a[mid:], b[cut:])]


def common(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Places in ``a`` and in ``b`` of a longest common subsequence."""
    where: dict[int, list[int]] = defaultdict(list)
    for j in range(len(b) - 1, -1, -1):  # later places first, so that a line is taken once
        where[b[j]].append(j)
    if sum(len(where.get(v, ())) for v in a) > PAIRS:
        got = _halved(a, b)
        return [i for i, _ in got], [j for _, j in got]
    pairs = [(i, j) for i, v in enumerate(a) for j in where.get(v, ())]
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):  # longest increasing run of places in b
        n = bisect_left(tails, j)
        tails[n : n + 1] = [j]
        ends[n : n + 1] = [k]
        back[k] = ends[n - 1] if n else -1
    got, k = [], ends[-1] if ends else -1
    while k >= 0:
        got.append(pairs[k])
        k = back[k]
    return [i for i, _ in reversed(got)], [j for _, j in reversed(got)]


def _parsed(ids, urls, pages):
    for i, u, p in zip(ids, urls, pages, strict=True):
        found = lines(p.decode())
        host, path = address(u)
        yield i, u, host, path, [xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63) for t, _ in found], bytes(z for _, z in found), [None if z == DROPPED else t for t, z in found]


def _aligned(a, za, b, zb) -> tuple[list[int], list[int], bool]:
    """Numbers of the lines that each of two pages shares with the other, but those of an article, and whether the pages may be
    copies."""
    both = list(zip(common(a, b), (za, zb), strict=True))
    alike = any(0 < COPY_SHARE * z.count(FREE) < sum(z[k] == FREE for k in got) for got, z in both)
    return *([k for k in got if z[k] != ARTICLE] for got, z in both), alike


def _neighbours(ranks, ids, hashes, zones, other_ids, other_hashes, other_zones):
    """Of each two neighbours, the first one's rank, and for both the lines that go as they share them."""
    for r, i, a, za, j, b, zb in zip(ranks, ids, hashes, zones, other_ids, other_hashes, other_zones, strict=True):
        own, other, alike = _aligned(a, za, b, zb)
        for key, gone in ((i, own), (j, other)):
            if gone:
                yield r, key, alike, gone


def _beyond(ids, hashes, zones, other_hashes, other_zones):
    """Lines that a page shares with another that is not its neighbour."""
    for i, a, za, b, zb in zip(ids, hashes, zones, other_hashes, other_zones, strict=True):
        if gone := _aligned(a, za, b, zb)[0]:
            yield i, gone


def ranked(keys: DataFrame, scratch: Scratch, *order: str) -> DataFrame:
    """Adds ``rank``, the place in the order of all rows.  Sorted by ranges, so that no host is one task's; the driver
    only sees the sizes of the partitions."""
    done = scratch.table(keys.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dict(done.groupBy(part.alias("p")).count().collect())
    starts, n = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(n)
        n += sizes.get(p, 0)
    return done.withColumn("rank", F.element_at(F.lit(starts or [0]).cast("array<bigint>"), (part + 1).cast("int")) + row).drop("_at")


def _next(at: DataFrame, *same: str) -> DataFrame:
    """Each page of a ranked table with the next one, of equal ``same``."""
    after = at.select((F.col("rank") - 1).alias("rank"), F.col("i").alias("j"), F.col("hashes").alias("hashes2"), F.col("zones").alias("zones2"), *[F.col(c).alias(f"{c}2") for c in same])
    return at.join(after, "rank").where(" AND ".join(f"{c} = {c}2" for c in same)).select("rank", "i", "hashes", "zones", "j", "hashes2", "zones2")


def _of_runs(at: DataFrame, alike: DataFrame, kind: str, scratch: Scratch) -> DataFrame:
    """(i, gone) of the pages in runs of possible copies; ``alike`` holds each rank ``r`` whose page is like the next one."""
    links = scratch.table(ranked(alike, scratch, "r").select("r", (F.col("r") - F.col("rank")).alias("run")))
    place = lambda name: at.select(F.col("rank").alias(name), F.col("host").alias(f"{name}_host"))
    runs = links.groupBy("run").agg(F.min("r").alias("first"), (F.max("r") + 1).alias("last")).withColumns({"before": F.col("first") - 1, "after": F.col("last") + 1})
    runs = runs.join(place("first"), "first").join(place("before"), "before", "left").join(place("after"), "after", "left")
    outer = F.filter(F.array(F.when(F.col("before_host") == F.col("first_host"), F.col("before")), F.when(F.col("after_host") == F.col("first_host"), F.col("after"))), F.isnotnull)
    members = links.select("run", F.explode(F.array("r", F.col("r") + 1)).alias("rank")).distinct()
    pages = scratch.table(members.join(runs.select("run", outer.alias("outer")), "run").join(at, "rank"))
    other = at.select(F.col("rank").alias("q"), F.col("hashes").alias("hashes2"), F.col("zones").alias("zones2"))
    far = pages.select("rank", "i", "hashes", "zones", F.explode("outer").alias("q")).where(F.abs(F.col("q") - F.col("rank")) > 1).join(other, "q")
    gone = map_rows(far.select("i", "hashes", "zones", "hashes2", "zones2"), _beyond, f"i {kind}, gone array<int>")
    alone = pages.where(F.size("outer") == 0)
    lists = alone.groupBy("run", "hashes", "zones").agg(F.min(F.struct("path", "rank")).alias("p")).select("run", "hashes", "zones", "p.path", F.col("p.rank").alias("i"))
    inner = map_rows(_next(ranked(lists, scratch, "run", "path", "i"), "run"), _neighbours, "rank bigint, lead bigint, alike boolean, gone array<int>")
    leads = alone.select("run", "hashes", "zones", "i").join(lists.withColumnRenamed("i", "lead").drop("path"), ["run", "hashes", "zones"])
    return gone.unionByName(leads.join(inner, "lead").select("i", "gone"))


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", broadcast_rows: int = 200_000) -> DataFrame:
    """The main text of each page.

    Returns ``key``, ``url``, text (blocks joined by newlines), and how many lines went: n_shared as a neighbour has them,
    n_marked by markup alone.  Null and empty pages have an empty text; pages of a null URL or one without a host are
    neighbours of each other; pages without lines are nobody's; rows that share a key share the lines that go; ties of
    path are ordered by key; other columns are not read, whatever their names; an empty table gives no rows.

    A page is parsed once; the hashes of its lines are sorted and joined, its lines themselves wait in the shared folder, in
    a table that stays as the result reads it.  The lines that go are broadcast if they concern at most
    ``broadcast_rows`` pages, else joined by key.
    """
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(f"`{key}`").alias("i"), F.col(f"`{url}`").alias("u"), utf8(f"`{html}`").alias("h"))
    parsed = staged(map_rows(rows, _parsed, f"i {kind}, u string, host string, path string, hashes array<bigint>, zones binary, lines array<string>"))
    with Scratch(pages.sparkSession) as scratch:
        at = ranked(parsed.where(F.size("hashes") > 0).select("i", "host", "path", "hashes", "zones"), scratch, "host", "path", "i")
        near = scratch.table(map_rows(_next(at, "host"), _neighbours, f"rank bigint, i {kind}, alike boolean, gone array<int>"))
        shared, alike = near.where("NOT alike").select("i", "gone"), near.where("alike").select(F.col("rank").alias("r")).distinct()
        if not alike.isEmpty():
            shared = shared.unionByName(_of_runs(at, alike, kind, scratch))
        gone = staged(shared.groupBy("i").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")))
    small = few(gone, broadcast_rows)
    both = parsed.select("i", "u", "zones", "lines").join(F.broadcast(gone) if small else gone, parsed.i.eqNullSafe(gone.i), "left").select(parsed.i, "u", "zones", "lines", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    kept = F.filter("lines", lambda t, k: t.isNotNull() & ~F.array_contains(F.col("gone"), k))
    n = F.size("gone").cast("bigint")
    return both.select(F.col("i").alias(key), F.col("u").alias(url), F.array_join(kept, "\n").alias("text"), n.alias("n_shared"), (F.size("lines") - F.size(kept) - n).cast("bigint").alias("n_marked"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = extract_main_text(table(spark, sf_dir, "pages"))
    return done.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_shared", "n_marked")
