"""Evaluation over labelled samples: confusion classes, metrics, roll-ups and failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(is_malicious: Column, detected: Column) -> Column:
    return F.when(is_malicious & detected, "TP").when(is_malicious, "FN").when(detected, "FP").otherwise("TN")


def classified(df: DataFrame, label: str = "label", patterns: str = "risk.patterns") -> DataFrame:
    """Adds shield_detected (any pattern), matched_pattern (the first, or empty) and classification."""
    found = F.size(F.col(patterns)) > 0
    return df.withColumns({"shield_detected": found, "matched_pattern": F.coalesce(F.try_element_at(F.col(patterns), F.lit(1)), F.lit("")), "classification": classify(F.col(label) == "malicious", found)})


def _counts() -> dict[str, Column]:
    return {n: F.count_if(F.col("classification") == k).cast("int") for n, k in (("true_positives", "TP"), ("true_negatives", "TN"), ("false_positives", "FP"), ("false_negatives", "FN"))}


def metrics(df: DataFrame) -> DataFrame:
    """One row of counts, accuracy, precision, recall and F1; ratios without a divisor are 0."""
    c = df.agg(F.count("*").cast("int").alias("total_samples"), *[v.alias(k) for k, v in _counts().items()])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, tn, fp, fn = (F.col(k) for k in _counts())
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return c.withColumns({"malicious_count": tp + fn, "safe_count": tn + fp, "accuracy": ratio(tp + tn, F.col("total_samples")), "precision": p, "recall": r}).withColumn("f1_score", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def by_category(df: DataFrame, category: str = "category") -> DataFrame:
    c = _counts()
    return df.groupBy(category).agg(F.count("*").cast("int").alias("total"), F.count_if(F.col("classification").isin("TP", "TN")).cast("int").alias("correct"), *[c[k].alias(k) for k in ("true_positives", "false_negatives", "false_positives", "true_negatives")])


def failures(df: DataFrame) -> DataFrame:
    return df.where(F.col("classification").isin("FP", "FN"))


def worst_categories(df: DataFrame, n: int = 5, category: str = "category") -> DataFrame:
    """The ``n`` categories of the most failures."""
    return by_category(df, category).withColumn("failed", F.col("total") - F.col("correct")).orderBy(F.desc("failed"), category).limit(n)


def over_defense(df: DataFrame, score: str = "risk.score", limit: int = 40) -> DataFrame:
    """Part of benign rows that score ``limit`` or more."""
    return df.agg(F.count("*").alias("total"), F.count_if(F.col(score) >= limit).alias("flagged"), F.avg((F.col(score) >= limit).cast("double")).alias("rate"))


def counters(df: DataFrame, risk: str = "risk") -> DataFrame:
    """Totals of assessed, blocked, suspicious and clean rows, and the block rate; also on streams."""
    threat = F.size(F.col(f"{risk}.patterns")) > 0
    c = df.agg(F.count("*").alias("total"), F.count_if(F.col(f"{risk}.blocked")).alias("blocked"), F.count_if(threat).alias("threats"), F.count_if(~threat).alias("clean"))
    return c.withColumn("block_rate", F.coalesce(F.try_divide(F.col("blocked").cast("double"), F.col("total").cast("double")), F.lit(0.0)))


def compared(now: DataFrame, best: DataFrame) -> str:
    """"regression", "better" or "same": one row of metrics() against that of the best run.  More false positives or negatives
    are a regression; fewer, or a higher F1 at as many, are better."""
    a, b = now.first(), best.first()
    fp, fn = a.false_positives - b.false_positives, a.false_negatives - b.false_negatives
    if fp > 0 or fn > 0:
        return "regression"
    return "better" if fp < 0 or fn < 0 or a.f1_score > b.f1_score + 1e-9 else "same"
