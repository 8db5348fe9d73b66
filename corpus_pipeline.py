"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.  The first four return the columns of
documents; the last one returns where each piece of each document lies.  Other columns of ``docs`` are dropped, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm.common import Scratch, table
from textwarden.llm.op2_lines import drop_boilerplate
from textwarden.llm.op3_bagminhash import first_of_class
from textwarden.llm.op4_packing import pack
from textwarden.llm.op8_toxicity import fit_tables, without_toxic
from textwarden.llm.op9_decontaminate import decontaminated

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier rejects go.

    Null and empty texts are scored as a text without words; equal texts are judged alike, repeated rows too."""
    model = fit_tables(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return without_toxic(docs, model).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; n_chars follows the text.

    All rows stay; null texts stay null; documents of a null source are one source; repeated rows count once."""
    return drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of the smallest id.

    Rows of a null id and texts without words stay; rows that share an id are one document and stay or go together."""
    return first_of_class(docs).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go.

    Null, empty and wordless texts stay; items without words are none; repeated rows are judged alike."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in training sequences.

    Null and empty texts are one token; ties of size are placed by id; repeated rows are pieces of their own."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL has no compression; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents; each but the last is written and read again, and what it read goes."""
    docs, before = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        now = Scratch(spark)
        docs = now.table(stage(spark, docs, sf_dir))
        before.clear()
        before = now
    return STAGES[-1][1](spark, docs, sf_dir)
