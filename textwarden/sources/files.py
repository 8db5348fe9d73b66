"""Sources and sinks: texts, labelled samples, results and reports."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate

SAMPLE = "id string, category string, label string, severity string, description string, content string, content_type string, attack_vector string, expected_pattern string"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a folder, one JSON object a file, by file name; other files and subfolders are passed over."""
    rows = spark.read.schema(SAMPLE).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("file", F.col("_metadata.file_name")).orderBy("file")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The malicious and the safe samples; the label in the file counts, not the folder."""
    return read_samples(spark, f"{path}/malicious").unionByName(read_samples(spark, f"{path}/safe"))


def result_json(risk: Column, sanitized: Column | None = None) -> Column:
    """A result as JSON; with ``sanitized``, its clean text and redactions too."""
    fields = [risk[n].alias(n) for n in ("score", "level", "blocked", "reason", "patterns", "categories", "ban_list_matches", "over_defense_risk", "is_output_scan", "pii_found", "pii_types", "redacted_text", "relevance_score", "code_detected", "harmful_code_patterns")]
    fields.append(F.when(risk["intent"] != "", risk["intent"]).alias("intent"))
    if sanitized is not None:
        fields += [sanitized["clean_text"].alias("clean_text"), F.size(sanitized["redactions"]).alias("redaction_count"), sanitized["redactions"].alias("redactions")]
    return F.to_json(F.struct(*fields))


def write_results(df: DataFrame, path: str, risk: str = "risk") -> None:
    df.write.mode("overwrite").json(path) if risk not in df.columns else df.withColumn(risk, result_json(F.col(risk))).write.mode("overwrite").json(path)


def write_sanitized(df: DataFrame, path: str, sanitized: str = "sanitized", as_json: bool = False) -> None:
    """The clean texts, one file line each (JSON strings where a text has line breaks of its own), or whole results as JSON."""
    found = df.select(F.col(sanitized).alias("s"))
    if as_json:
        out = found.select(F.col("s.clean_text").alias("clean_text"), F.size("s.redactions").alias("redaction_count"), F.col("s.redactions").alias("redactions"))
        out.write.mode("overwrite").json(path)
    else:
        text = F.col("s.clean_text")
        found.select(F.when(text.rlike(r"[\r\n]"), F.to_json(F.struct(text.alias("clean_text")))).otherwise(text).alias("value")).write.mode("overwrite").text(path)


def write_report(judged: DataFrame, path: str, stamp: str, config: dict | None = None, category: str = "category") -> str:
    """The evaluation of a judged table (see evaluate.classified) under ``path``: ``benchmark_<stamp>`` and ``latest``, each with
    the tables report (one row: time, settings, metrics, roll-up by category) and failures, and report.txt to read.  Returns
    the comparison with the best run ("regression", "better" or "same"), kept in ``best`` and replaced by a better one."""
    spark = judged.sparkSession
    m, categories, failed = evaluate.metrics(judged), evaluate.by_category(judged, category), evaluate.failures(judged)
    rolled = categories.agg(F.sort_array(F.collect_list(F.struct(F.col(category), *[c for c in categories.columns if c != category]))).alias("by_category"))
    report = m.select(F.lit(stamp).alias("timestamp"), F.lit(json.dumps(config or {})).alias("config"), F.struct(*m.columns).alias("metrics")).crossJoin(F.broadcast(rolled))  # one row by one row
    text = report_text(m, categories, failed)
    for name in (f"benchmark_{stamp}", "latest"):
        report.write.mode("overwrite").json(f"{path}/{name}/report")
        failed.write.mode("overwrite").json(f"{path}/{name}/failures")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}/report.txt")
    try:
        best = spark.read.schema(m.schema).json(f"{path}/best")
    except AnalysisException:  # the first run
        best = None
    verdict = evaluate.compared(m, best) if best is not None else "better"
    if verdict == "better":
        m.write.mode("overwrite").json(f"{path}/best")
    return verdict


def report_text(metrics: DataFrame, categories: DataFrame, failed: DataFrame | None = None, most: int = 50) -> str:
    """A report to read: one row of metrics, one line a category and the first ``most`` failures."""
    m = metrics.first().asDict()
    rows = [f"{k:<18}{v:.4f}" if isinstance(v, float) else f"{k:<18}{v}" for k, v in m.items()]
    for r in sorted(categories.toLocalIterator(), key=lambda r: r[0]):
        rows.append(f"{r[0]:<32}{r['correct']}/{r['total']}")
    if failed is not None:
        shown = [c for c in ("id", "category", "matched_pattern") if c in failed.columns]
        found = failed.select("classification", *shown).orderBy("classification", *shown).limit(most + 1).collect()
        rows += ["failures" if found else "all samples classified correctly", *[" ".join(str(v) for v in r) for r in found[:most]], *(["..."] if len(found) > most else [])]
    return "\n".join(rows)
