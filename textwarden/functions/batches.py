"""Bounds on what a Python worker holds at once: 10,000 rows, Arrow's own bound, may be gigabytes of text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession

#: Bytes that Arrow hands to a worker at once, and characters whose results a worker makes before it hands them back.
BATCH_BYTES, CHUNK_CHARS = 8 << 20, 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes; a smaller bound of the session's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = spark.conf.get(key)
    if not found.rstrip("bB").isdigit() or int(found.rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def chunks(batches: Iterator[pd.Series], chars: int = CHUNK_CHARS) -> Iterator[pd.Series]:
    """The same texts in the same order, in pieces of ``chars`` characters, or one text if that is longer."""
    for texts in batches:
        start = held = 0
        for k, t in enumerate(texts):
            size = len(t) if t else 0
            if k > start and held + size > chars:
                yield texts.iloc[start:k]
                start, held = k, 0
            held += size
        yield texts.iloc[start:]
