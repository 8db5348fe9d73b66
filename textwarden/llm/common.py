"""What the operators of this subpackage share: tables, batches, staging and word rules."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow hands a Python worker no more than this at once, so that a run of long texts stays small.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes; a smaller bound of the session's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = spark.conf.get(key)
    if not found.rstrip("bB").isdigit() or int(found.rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where none is set, a local session gets a temporary one; a cluster's is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="textwarden-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)  # found again by the next caller
    return found


def staged(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a compressed table in the shared folder.  It stays there: what is returned reads it."""
    return Scratch(df.sparkSession).table(df)


class Scratch:
    """Tables in the shared folder, written at once and read again; as a context, all go at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.clear()

    def clear(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        self.paths.clear()


def few(df: DataFrame, most: int) -> bool:
    """Whether ``df`` (a staged table) has at most so many rows, and so may be broadcast."""
    return df.count() <= most


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_rows(df: DataFrame, work: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """Applies ``work`` (columns of a batch as Python lists -> output rows) batch by batch.

    Text columns should be passed as BINARY: their values then arrive as bytes, without decoding.  Output goes back
    as it comes, in batches of about BATCH_BYTES of strings and bytes.
    """
    bounded_batches(df.sparkSession)
    out = arrow_schema(schema)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for row in work(*(c.to_pylist() for c in batch.columns)) if batch.num_rows else ():
                rows.append(row)
                size += sum(len(v) for v in row if isinstance(v, (bytes, str)))
                if size > BATCH_BYTES:
                    yield packed(rows)
                    rows, size = [], 0
            if rows:
                yield packed(rows)

    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def utf8(col: str = "text"):
    """The bytes of a text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


#: Bytes of a word of letters and digits: 0-9, a-z and all bytes of non-ASCII characters; A-Z fold to a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def folded_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(_FOLD).split()


def folded_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (starts, ends) of the same words in the original text."""
    inside = np.frombuffer(text.translate(_FOLD), dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]
