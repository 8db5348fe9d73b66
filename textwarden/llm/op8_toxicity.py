"""Toxicity by compression distance: windows are compressed with two trained zstandard dictionaries.

One dictionary is trained on excerpts of toxic text, one on ordinary text without such excerpts.  A window is compressed
with the ordinary one alone and with both: what it saves is a measure of toxic strings in it, and nearly nothing else.
Calibrated thresholds on the savings of a text's windows make the score.
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass, field
from functools import cache
from math import log, log1p, sqrt

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, map_rows, table, utf8

#: Bytes of a window; it ends at the next word's end.
WINDOW = 128
#: Bounds of the labelled sample: rows and bytes of text of each class (0: ordinary, 1: toxic).
SAMPLE_ROWS = {1: 2000, 0: 3000}
SAMPLE_BYTES = {1: 12 << 20, 0: 16 << 20}
#: Bytes of trained content.
TOXIC_BYTES, ORDINARY_BYTES = 8 << 10, 64 << 10
#: A string marks toxic text if it stands in new contexts so many standard errors, and times, more often there.
MIN_Z, MIN_RATIO = 4.0, 10.0
#: Lengths of the word beginnings that count as strings, besides whole words.
STEMS = range(4, 10)
HEAD = 6

_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PARAMETERS = zstandard.ZstdCompressionParameters(compression_level=3, window_log=17, min_match=4, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)


def normal(text: str | None) -> bytes:
    """Words, one space around each, their first HEAD bytes in upper and the rest in lower case: what a word begins
    with then matches no inner part of another."""
    return b" " + b"".join(w[:HEAD].upper() + w[HEAD:] + b" " for w in (text or "").lower().encode().translate(_FOLD).split())


def windows(text: bytes) -> list[bytes]:
    """The whole text in windows; words beyond twice the size are cut."""
    out, at = [], 0
    while at < len(text):
        end = text.find(b" ", at + WINDOW, at + 2 * WINDOW)
        end = min(len(text), at + 2 * WINDOW) if end < 0 else end
        out.append(text[at:end])
        at = end
    return out


def strings(word: bytes):
    yield word + b" "
    for n in STEMS:
        if n > len(word):
            break
        yield word[:n]


def markers(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """Strings that mark toxic text.  A word after the same word counts once in all, so copies of a text count once."""
    counts, sizes = [], []
    for texts in (ordinary, toxic):
        seen: set[tuple] = set()
        found: Counter = Counter()
        for t in texts:
            words = t.split()
            new = set()
            for pair in zip([b"", *words], words):
                if pair not in seen:
                    seen.add(pair)
                    new.add(pair[1])
            found.update({s for w in new for s in strings(w)})
        counts.append(found)
        sizes.append(max(1, len(texts)))
    out = set()
    for s, n in counts[1].items():
        if n >= 3:
            here, there, both = n / sizes[1], counts[0][s] / sizes[0], (n + counts[0][s] + 1) / (sum(sizes) + 2)
            if here > MIN_RATIO * there and here - there > MIN_Z * sqrt(both * (1 - both) * (1 / sizes[1] + 1 / sizes[0])):
                out.add(s)
    return out


def trained(samples: list[bytes], size: int, k: int) -> bytes:
    """Content of a dictionary trained by zstandard; of too few samples to train on, the distinct samples, the most frequent last."""
    if sum(map(len, samples)) > 10 * size:
        try:
            return zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(s for s, _ in reversed(Counter(samples).most_common()))[-size:]


@dataclass
class Model:
    """Dictionary contents and the calibration of the savings they make."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray | None = None
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    base: float = 0.0
    _built: list = field(default_factory=list, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_built": []}

    def savings(self, text: bytes) -> np.ndarray:
        """Bytes that each window of a normal text saves with the toxic dictionary."""
        if not self._built:
            for content in (self.toxic + self.ordinary, self.ordinary):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=_PARAMETERS)
                self._built.append(zstandard.ZstdCompressor(dict_data=d, compression_params=_PARAMETERS).compress)
        with_toxic, without = self._built
        return np.array([len(without(w)) - len(with_toxic(w)) for w in windows(text)] or [0])

    def features(self, text: bytes) -> list[float]:
        s = self.savings(text)
        top = np.sort(s)[-3:]
        return [top[-1], top.sum(), s.mean(), log(s.size), (s >= 3).mean(), log1p(float((s >= 5).sum()))]

    def score(self, text: bytes) -> float:
        """0 to 1; without a calibration (no labels of one class) the share of toxic labels."""
        if self.weights is None:
            return self.base
        z = self.weights[0] + ((np.array(self.features(text)) - self.center) / self.scale) @ self.weights[1:]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    """Two separate dictionaries: of the marked words of toxic texts, and of all windows of ordinary texts that hold none."""
    marks, r = markers(toxic, ordinary), random.Random(7)

    @cache
    def marked(word: bytes) -> bool:
        return any(s in marks for s in strings(word))

    excerpts = [b" " + w + b" " for t in toxic for w in t.split() if marked(w)]
    plain = [w for t in ordinary for w in windows(t) if not any(map(marked, w.split()))]
    r.shuffle(excerpts)
    r.shuffle(plain)
    return Model(trained([b"".join(excerpts[k : k + 8]) for k in range(0, len(excerpts), 8)], TOXIC_BYTES, 32), trained(plain, ORDINARY_BYTES, 64))


def calibrated(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Ridge logistic regression by Newton's method."""
    model.center, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack((np.ones(len(x)), (x - model.center) / model.scale))
    w, ridge = np.zeros(z.shape[1]), np.diag([1e-6, *[0.1] * x.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
    model.weights = w
    return model


def fit(toxic: list[str | None], ordinary: list[str | None]) -> Model:
    """Dictionaries as above; the calibration is fitted on savings by dictionaries of the other half."""
    t, o = [normal(x) for x in toxic], [normal(x) for x in ordinary]
    model = dictionaries(t, o)
    model.base = len(t) / max(1, len(t) + len(o))
    if min(len(t), len(o)) < 4:
        return model
    x, y = [], []
    for half in (0, 1):
        other = dictionaries(t[1 - half :: 2], o[1 - half :: 2])
        for label, texts in ((1, t[half::2]), (0, o[half::2])):
            x += [other.features(text) for text in texts]
            y += [label] * len(texts)
    return calibrated(model, np.array(x, dtype=float), np.array(y, dtype=float))


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 5 == 0


def fit_tables(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Fits on a sample of the labelled rows that aren't held out, bounded by SAMPLE_ROWS and SAMPLE_BYTES.

    The rows of each class with the smallest hashes of their ids are taken; only their texts are read.
    Rows of a null id or label don't count.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).select("doc_id", F.col(label).cast("int").alias("label"))
    texts: dict[int, list[str | None]] = {}
    for kind, n in SAMPLE_ROWS.items():
        ids = [r[0] for r in rows.where(F.col("label") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
        taken, size = [], 0
        if ids:
            chosen = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id bigint").distinct()
            for r in docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").toLocalIterator():
                if size > SAMPLE_BYTES[kind]:
                    break
                taken.append(r[1])
                size += len(r[1] or "")
        texts[kind] = taken
    return fit(texts[1], texts[0])


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and score of every row.  Null and empty texts are scored as a text without words; rows of a null key are scored
    as others; equal texts have equal scores; repeated rows are kept; an empty table gives no rows; other columns are not
    read, whatever their names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(ids, texts):
        for i, t in zip(ids, texts, strict=True):
            yield i, sent.value.score(normal(t.decode()))

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(F.col(f"`{key}`"), utf8(f"`{text}`").alias("t")), work, f"`{key}` {kind}, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows that score below ``threshold``, with all their columns, whatever their names, in place.

    Null and empty texts are scored as a text without words; rows of a null key and repeated rows are scored as others; an
    empty table gives no rows."""
    from pyspark.sql.functions import pandas_udf

    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(texts):
        return texts.map(lambda t: sent.value.score(normal(bytes(t).decode()))).astype(float)

    return docs.where(score(utf8(f"`{text}`")) < threshold)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, fit_tables(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
