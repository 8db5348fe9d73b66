"""Substring dedup by recompression: word runs and pairs get global names, round by round.

A name is a hash of what it stands for, so equal names mean equal words wherever they stand, without a
shared dictionary.  Whether two neighbours pair in a round depends on one bit of each name alone, so equal
substrings get equal symbols but for a few at their ends.  Two things follow:

* Of each window of words, a symbol that lies certainly inside it can be chosen from its words alone.  Where that
  symbol occurs once in the corpus, the window does too, and need not be looked at again.
* A high symbol that occurs earlier is a long repeat as a whole: all of its words go, without a look at its windows.

The windows that are left, those at the ends of long repeats and in short ones, are compared by fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, bounded_batches, table, utf8

WINDOW = 20
#: Pairing rounds whose symbols are chosen from for a window; four leave some inside nearly every 20 words.
LOW_ROUNDS = 4
#: After these rounds of runs and pairs, symbols stand for long repeats: of about 30, 75 and 180 words on average.
HIGH_ROUNDS = (12, 15, 18)
#: Bytes of text that are worked on at once.
GROUP_BYTES = 2 << 20

U = np.uint64
_C1, _C2, _C3 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
_BASES = (0xD1342543DE82EF95, 0x2545F4914F6CDD1D)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _C1
    x = (x ^ (x >> U(27))) * _C2
    return x ^ (x >> U(31))


def named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of the pair (a, b)."""
    return mix(a * _C3 + (b ^ (b >> U(32))))


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    have = _powers.get((base, inverse))
    if have is None or have.size < n:
        each = np.full(max(n, 1 << 20), pow(base, -1, 1 << 64) if inverse else base, dtype=U)
        each[0] = 1
        have = _powers[base, inverse] = np.cumprod(each, dtype=U)
    return have[:n]


class Parse:
    """The recompression of a group of texts, given as lists of words."""

    def __init__(self, docs: list[list[bytes]], window: int = WINDOW):
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.n = n = int(sizes.sum())
        flat = np.empty(n, dtype=object)
        flat[:] = [w for d in docs for w in d]
        self.words = pd.util.hash_array(flat, categorize=False) if n else np.empty(0, dtype=U)
        self.doc = np.repeat(np.arange(len(docs)), sizes)
        self.window = window
        self.at = np.concatenate([np.arange(s, e - window + 1) for s, e in zip(self.starts, self.ends, strict=True)] or [np.empty(0, dtype=np.int64)]) if n else np.empty(0, dtype=np.int64)
        self.at = self.at.astype(np.int64)
        last = np.zeros(n, dtype=bool)
        last[self.ends[sizes > 0] - 1] = True
        self._run(last)

    def _run(self, last: np.ndarray) -> None:
        sym, start, low, high = self.words, np.arange(self.n), self.at, self.at + self.window
        self.levels = [(sym, start, low, high)]
        highs = []
        for r in range(HIGH_ROUNDS[-1]):
            if r >= LOW_ROUNDS:
                sym, start, last = self._runs(sym, start, last)
                low = high = None
            sym, start, last, low, high = self._pairs(sym, start, last, r, low, high)
            if r < LOW_ROUNDS:
                self.levels.append((sym, start, low, high))
            if r + 1 in HIGH_ROUNDS:
                size = np.diff(np.append(start, self.n))
                long = size >= self.window
                highs.append((sym[long], start[long], size[long]))
        sym, start, size = (np.concatenate(x) for x in zip(*highs, strict=True))
        # A symbol that no later round touched stands once in the list, and in each level by its number there.
        _, one, number = np.unique(mix(sym + start.astype(U) * _C3), return_index=True, return_inverse=True)
        self.high, self.high_at, self.high_size = sym[one], start[one], size[one]
        self.high_levels = np.split(number, np.cumsum([h[0].size for h in highs])[:-1])

    @staticmethod
    def _pairs(sym, start, last, r, low, high):
        """Pairs a symbol whose r-th bit is set with a next one whose bit isn't.  low and high: of each window, the first
        symbol that certainly starts in it and the one after the last that certainly ends in it, whatever stands outside."""
        n = sym.size
        left = (sym >> U(r) & U(1)).astype(bool)
        one = np.flatnonzero(left[:-1] & ~left[1:] & ~last[:-1])
        keep = np.ones(n, dtype=bool)
        keep[one + 1] = False
        if low is not None:
            to = np.concatenate(([0], np.cumsum(keep)))
            right = np.append(~left, False)
            low, high = to[low + right[low]], to[high - left[high - 1]]
        sym, last = sym.copy(), last.copy()
        sym[one] = named(sym[one], sym[one + 1])
        last[one] = last[one + 1]
        return sym[keep], start[keep], last[keep], low, high

    @staticmethod
    def _runs(sym, start, last):
        """Names each run of one symbol."""
        n = sym.size
        if n < 2:
            return sym, start, last
        first = np.concatenate(([True], (sym[1:] != sym[:-1]) | last[:-1]))
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, n))
        out, several = sym[at].copy(), size > 1
        out[several] = named(out[several], size[several].astype(U))
        return out, start[at], last[at + size - 1]

    def chosen(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each window, the name of its chosen symbol and a number of that occurrence: at the highest level
        that has a symbol certainly inside, the longest one, then by name."""
        name, number = np.zeros(self.at.size, dtype=U), np.zeros(self.at.size, dtype=np.int64)
        todo = np.arange(self.at.size)
        for level in range(LOW_ROUNDS, -1, -1):
            sym, start, low, high = self.levels[level]
            here = todo[high[todo] > low[todo]]
            if here.size:
                size = np.minimum(np.diff(np.append(start, self.n)), 31).astype(U)
                best = (size << U(59)) | (sym >> U(35) << U(30)) | np.arange(sym.size, dtype=U)
                span = high[here] - low[here]
                found, width = np.zeros(here.size, dtype=U), 1
                while True:
                    now = (span >= width) & (span < 2 * width)
                    a = here[now]
                    found[now] = np.maximum(best[low[a]], best[high[a] - width])
                    if not (span >= 2 * width).any():
                        break
                    best = np.maximum(best, np.append(best[width:], np.zeros(width, dtype=U))[: best.size])
                    width *= 2
                k = (found & U((1 << 30) - 1)).astype(np.int64)
                name[here], number[here] = named(sym[k], np.full(k.size, level, dtype=U)), k * (LOW_ROUNDS + 1) + level
            todo = todo[high[todo] <= low[todo]]
            if not todo.size:
                break
        return name, number

    def fingerprints(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit fingerprints of word ranges."""
        out = []
        for k, base in enumerate(_BASES):
            value = mix(self.words ^ U(base)) * powers(base, self.n)
            total = np.concatenate((np.zeros(1, dtype=U), np.cumsum(value, dtype=U)))
            out.append(mix((total[end] - total[start]) * powers(base, self.n + 1, True)[start]))
        return out[0], out[1]

    def high_names(self) -> tuple[np.ndarray, np.ndarray]:
        """Name and fingerprint of the high symbols; odd, while chosen symbols of windows have 0."""
        return self.high, self.fingerprints(self.high_at, self.high_at + self.high_size)[0] | U(1)


def member(doc: np.ndarray, key: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether a document's list has the key."""
    known_doc, known = lists
    salt = lambda d, k: mix(k + d.astype(U) * _C3)
    return np.isin(salt(doc, key), salt(known_doc, known))


def first_of(doc: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether an entry is the first in its text with its document and key."""
    out = np.zeros(key.size, dtype=bool)
    order = np.argsort(at, kind="stable")
    out[order[np.unique(mix(key + doc.astype(U) * _C3)[order], return_index=True)[1]]] = True
    return out


def merged(a: np.ndarray, b: np.ndarray, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row for each (a, b): smallest id and sum of n."""
    order = np.lexsort((b, a))
    a, b, ids, n = a[order], b[order], ids[order], n[order]
    if not a.size:
        return a, b, ids, n
    at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return a[at], b[at], np.minimum.reduceat(ids, at), np.add.reduceat(n, at)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list, list[list[bytes]], list]]:
    """Parts of a batch of about GROUP_BYTES: ids, row numbers, words by text, further list columns."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    texts = batch.column(1)
    sizes = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1])
    lists = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False).view(U)) for c in batch.columns[2:]]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), GROUP_BYTES)))
        docs = [t.split() for t in texts.slice(at, end - at).to_pylist()]
        yield ids[at:end], list(range(at, end)), docs, [(np.repeat(np.arange(end - at), np.diff(o[at : end + 1])), v[o[at] : o[end]]) for o, v in lists]
        at = end


def _batch(schema: pa.Schema, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == U else c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_SYMBOLS = "a bigint, b bigint, d bigint, n bigint"


def _symbols(window: int):
    schema = arrow_schema(_SYMBOLS)

    def run(batches):
        for batch in batches:
            for ids, _, docs, _ in _groups(batch):
                p = Parse(docs, window)
                if not p.at.size:
                    continue
                name, number = p.chosen()
                _, one = np.unique(number, return_index=True)
                high, proof = p.high_names()
                a = np.concatenate((name[one], high))
                b = np.concatenate((np.zeros(one.size, dtype=U), proof))
                of = np.concatenate((p.doc[p.at[one]], p.doc[p.high_at]))
                yield _batch(schema, *merged(a, b, ids[of], np.ones(a.size, dtype=np.int64)))

    return run


def _open_windows(p: Parse, known) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, fingerprints of the windows that may repeat; which words stand in a high symbol that occurs earlier)."""
    high, proof = p.high_names()
    of = p.doc[p.high_at]
    repeat = ~(member(of, high ^ proof, known) & first_of(of, high ^ proof, p.high_at))
    count = lambda where: np.cumsum(np.bincount(where, minlength=p.n + 1))[: p.n]
    covered, whole, tail = np.zeros(p.n, dtype=bool), np.zeros(p.at.size, dtype=bool), p.at + p.window - 1
    for level in p.high_levels:  # symbols of one level don't overlap
        k = level[repeat[level]]
        begun, ended = count(p.high_at[k]), count(p.high_at[k] + p.high_size[k])
        covered |= begun > ended
        whole |= (begun > ended)[p.at] & (ended[p.at] == ended[tail]) & (begun[p.at] == begun[tail])
    name, _ = p.chosen()
    open_ = ~whole & ~member(p.doc[p.at], name, known)
    at = p.at[open_]
    return at, *p.fingerprints(at, at + p.window), covered


def _windows(window: int):
    schema = arrow_schema(_SYMBOLS)

    def run(batches):
        for batch in batches:
            for ids, _, docs, (known,) in _groups(batch.drop_columns(["key"])):
                p = Parse(docs, window)
                if not p.at.size:
                    continue
                at, a, b, _ = _open_windows(p, known)
                if at.size:
                    yield _batch(schema, *merged(a, b, ids[p.doc[at]], np.ones(at.size, dtype=np.int64)))

    return run


def _kept(window: int, ddl: str):
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for _, rows, docs, (known, firsts) in _groups(batch.drop_columns(["key"])):
                p = Parse(docs, window)
                gone = np.zeros(p.n, dtype=bool)
                if p.at.size:
                    at, a, b, gone = _open_windows(p, known)
                    of, k = p.doc[at], a ^ b
                    repeat = at[~(member(of, k, firsts) & first_of(of, k, at))]
                    edge = np.bincount(repeat, minlength=p.n + 1) - np.bincount(repeat + window, minlength=p.n + 1)
                    gone = gone | (np.cumsum(edge)[: p.n] > 0)
                kept, counts = [], []
                for words, s, e in zip(docs, p.starts, p.ends, strict=True):
                    mask = gone[s:e]
                    counts.append(int(mask.sum()))
                    kept.append(b" ".join(words if not counts[-1] else [w for w, g in zip(words, mask, strict=True) if not g]).decode())
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(rows[0], len(rows)), pa.array([len(w) for w in docs], type=pa.int64()), pa.array(counts, type=pa.int64()), pa.array(kept, type=schema.field(3).type)], schema=schema)

    return run


def drop_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Removes the words of every window of ``window`` words that starts earlier too (smaller key, or earlier in the text).

    Returns ``key`` (whole number), n_words, n_removed and kept (the kept words, joined by one space).  Null and empty
    texts have no words.  Rows of a null key come after all others.  Rows that share a key are judged on the
    same smaller keys and each on itself, so that repeated rows return equal results.  Other columns are not read.

    Shuffled are: chosen and high symbols (pre-aggregated, one key and id each), the open windows likewise, the
    texts once by key, and for each document the symbols and windows that are its own.  No list is longer than
    the document it belongs to, and no group of copies meets anywhere but in sums.
    Across documents, symbols and windows are told apart by 128 bits: names and a second fingerprint (high symbols, windows),
    or names alone where a name that stands once can only keep words (chosen symbols).  A document's own list of them, sent back
    to it, holds 64 bits each (``a ^ b``): in a text of n words, a chance of n * n / 2^64 that one is taken for another.
    """
    bounded_batches(df.sparkSession)
    last = F.lit((1 << 63) - 1)
    rows = df.select(F.coalesce(F.col(f"`{key}`").cast("bigint"), last).alias("d"), utf8(f"`{text}`").alias("t"), F.col(f"`{key}`").alias("key"))
    own = lambda found, where: found.groupBy("a", "b").agg(F.min("d").alias("d"), F.sum("n").alias("n")).where(where).groupBy("d").agg(F.collect_list(F.expr("a ^ b")).alias("k"))
    known = own(rows.select("d", "t").mapInArrow(_symbols(window), _SYMBOLS), "b <> 0 OR n = 1")
    none = F.array().cast("array<bigint>")
    held = rows.join(known, "d", "left").select("d", "t", F.coalesce("k", none).alias("known"), "key")
    firsts = own(held.mapInArrow(_windows(window), _SYMBOLS), "true")  # with all columns of held: both then read one exchange
    out = f"`{key}` {df.schema[key].dataType.simpleString()}, n_words bigint, n_removed bigint, kept string"
    both = held.join(firsts, "d", "left").select("d", "t", "known", F.coalesce("k", none).alias("firsts"), "key")
    return both.mapInArrow(_kept(window, out), out)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows by windows.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), w AS (
  SELECT doc_id, k, hash(array_to_string(ws[k:k + 19], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS k FROM d WHERE len(ws) >= 20)
), r AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) AS n FROM w) WHERE n > 1
), gone AS (
  SELECT doc_id, list(p) AS ps FROM (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS p FROM r) GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d
), gp AS (SELECT doc_id, unnest(ps) AS p FROM gone),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t FROM words ANTI JOIN gp ON words.doc_id = gp.doc_id AND words.p = gp.p GROUP BY words.doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
