"""Entry points: DataFrames of texts in, the same rows with one result column out.  No plan here shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import bounded_batches
from ..functions.text import col, let, settled, unused
from ..operators import output_scan, scanners, scoring
from ..operators.debias import debiased
from ..operators.domain import check_domain
from ..operators.matching import told
from ..operators.normalize import DECODE_DEPTH, DECODE_VARIANTS, clamped, prepare
from ..operators.sanitize import SanitizeConfig, sanitizer
from ..operators.wrap import wrap
from ..sources.config import Config, parse_mode, resolved
from ..sources.service import escalate


def input_risk(df: DataFrame, text: Column, cfg: Config, name: str = "risk") -> DataFrame:
    """Adds ``name``, the local risk of ``text``: rules and signals, then points, then the risk.  Each step is settled before the
    next one reads it, so the plan grows with their sum.  All columns of ``df`` stay, but one called ``name``."""
    bounded_batches(df.sparkSession)
    own, seen, won, sums = unused(df, "_own", "_seen", "_won", "_sums")
    udf = prepare(cfg.mode, cfg.max_decode_depth or DECODE_DEPTH, cfg.max_decoded_variants or DECODE_VARIANTS)
    out = df.withColumn(own, clamped(F.coalesce(text, F.lit("")), cfg.max_input))
    out = settled(out.withColumn(seen, udf(col(own))), won, F.struct(col(own).alias("text"), F.coalesce(col(seen)["analysis"], col(own)).alias("analysis"), col(seen).alias("p")))
    out = out.drop(own, seen).withColumnRenamed(won, own)
    p, a, t = col(own)["p"], col(own)["analysis"], col(own)["text"]

    of = lambda **named: F.struct(*[p[field].alias(n) for n, field in named.items()])
    signals = {
        "k": p["gate"],
        "m": told(p["rules"]),
        "s": of(types="secrets", confidence="secret_level"),
        "g": of(is_gibberish="gibberish", high_entropy_block="entropy_block"),
        "x": of(is_toxic="toxic", tier1="tier1", tier2="tier2", tier3="tier3"),
        "e": of(manipulative="manipulative", types="emotions", weighted="emotion_points"),
        "b": scanners.ban_lists(a, cfg.ban_substrings, cfg.ban_topics, cfg.ban_competitors, cfg.custom_regex),
    }
    out = settled(out, seen, F.struct(*[c.alias(n) for n, c in signals.items()]))
    m, s, g, x, e, b, k = (col(seen)[n] for n in ("m", "s", "g", "x", "e", "b", "k"))
    some, banned = F.size(m) > 0, F.size(b["rules"]) > 0
    live = (some | (F.size(s["types"]) > 0) | g["is_gibberish"] | g["high_entropy_block"] | x["is_toxic"] | e["manipulative"] | banned) & (t != "")
    # Only rows with a finding need what follows.
    points = {
        "types": p["payload"],
        "context": p["context"],
        "cats": scoring.category_names(m, s, g, x, e, b),
        "raw": F.greatest(scoring.match_score(m) - scoring.context_penalty(a, m), F.lit(0)) + F.when(some, scoring.signal_boost(p)).otherwise(0) + p["attack"] + scoring.scanner_points(s, g, x, e, b, k),
        "weak": scoring.trigger_points(s, g, x, k).cast("int"),
        "reason": scoring.reason(m, scoring.category_names(m, s, g, x, e, b), p, s, g, x, e, b),
        "patterns": scoring.pattern_ids(m, s, g, x, e, b),
    }
    out = settled(out, won, F.when(live, F.struct(*[c.alias(n) for n, c in points.items()])))
    w = col(won)

    def summed(raw: Column) -> Column:
        score = F.when(p["attribute"] & some, F.greatest(raw + 45, F.lit(70))).otherwise(raw)
        return let(F.struct(score.alias("score"), F.when(some, w["weak"]).otherwise(F.greatest(w["weak"], score)).alias("trigger")), lambda n: F.struct(n["score"].alias("score"), n["trigger"].alias("trigger"), F.when(some, F.greatest(n["score"] - n["trigger"], F.lit(0))).otherwise(0).alias("injection")))

    out = settled(out, sums, let(w["raw"].cast("int"), summed))
    score, trigger, injection = (col(sums)[n] for n in ("score", "trigger", "injection"))
    eased = debiased(w["types"], w["context"], score, trigger, injection, banned) if cfg.debiases else score
    defense = F.when(banned | (trigger <= 0) | (injection != 0), 0.0).otherwise(F.least(trigger / 30.0, F.lit(1.0)))

    def found(final: Column) -> Column:
        return scoring.risk(final, scoring.blocked(final, cfg.strict, cfg.block_threshold), w["reason"], w["patterns"], w["cats"], ban_list_matches=b["rules"], over_defense_risk=defense, intent=scoring.intent(w["cats"]))

    risk = F.when(w.isNotNull(), let(F.least(eased, F.lit(100)).cast("int"), found)).otherwise(scoring.safe())
    return settled(out.drop(*[n for n in (name,) if n in df.columns]), name, risk).drop(own, seen, won, sums)


def assess(df: DataFrame, text: str = "text", url: str | None = None, cfg: Config = Config(), client: Callable | None = None) -> DataFrame:
    """Adds ``risk``: the risk of each input text, in deep mode by the service where it is asked and answers, and merged with
    the check of ``url`` where domains are listed.  Null texts are safe; all columns of ``df`` stay, but one named ``risk``;
    an empty table gives none."""
    cfg = resolved(cfg)
    out = input_risk(df, col(text), cfg)
    if cfg.mode == "deep" and cfg.service_url:
        (sent,) = unused(out, "_sent")
        out = escalate(out.withColumn(sent, clamped(col(text), cfg.max_input)), sent, url, cfg, client).drop(sent)
    if url and cfg.merge_domain and any(d.strip() for d in cfg.allowed_domains):
        (own,) = unused(out, "_own")
        out = out.withColumn(own, F.when(F.coalesce(col(url), F.lit("")) != "", check_domain(col(url), list(cfg.allowed_domains), cfg.strict)))
        out = settled(out, "risk", F.when(col(own).isNull(), F.col("risk")).otherwise(let(col(own), lambda d: scoring.merged(F.col("risk"), d)))).drop(own)
    return out


#: Another name of assess().
scan = assess


def assess_output(df: DataFrame, text: str = "text", prompt: str | None = None, cfg: Config = Config()) -> DataFrame:
    """Adds ``risk``: the risk of each model output, given its prompt.  Null outputs are safe; all columns of ``df`` stay, but
    one named ``risk``."""
    cfg = resolved(cfg)
    own, seen = unused(df, "_own", "_seen")
    asked = F.coalesce(col(prompt), F.lit("")) if prompt else F.lit("")
    out = settled(df, own, F.struct(F.btrim(F.coalesce(col(text), F.lit("")), F.lit(" \t\n\r\x0b\x0c")).alias("o"), asked.alias("asked")))
    o = col(own)["o"]
    (pii,) = unused(out, "_pii")
    out = out.withColumn(pii, output_scan.pii()(o))
    scans = {"leak": output_scan.prompt_leak(o), "urls": output_scan.url_scan(o), "pii": col(pii), "code": output_scan.code_scan(o, cfg.allow_output_code, cfg.ban_output_code), "rel": output_scan.relevance(o, col(own)["asked"])}
    out = settled(out, seen, F.struct(*[c.alias(n) for n, c in scans.items()]))
    found = output_scan.output_risk(o, *[col(seen)[n] for n in scans], cfg.strict, cfg.block_threshold)
    return settled(out.drop(*[n for n in ("risk",) if n in df.columns]), "risk", found).drop(own, pii, seen)


def assess_pair(df: DataFrame, prompt: str, output: str, cfg: Config = Config()) -> DataFrame:
    """Adds ``input_risk`` and ``output_risk``, independent of each other."""
    return assess_output(assess(df, prompt, None, cfg).withColumnRenamed("risk", "input_risk"), output, prompt, cfg).withColumnRenamed("risk", "output_risk")


def assess_by_mode(df: DataFrame, text: str, mode: str, engines: dict[str, Config], default: str = "balanced") -> DataFrame:
    """Adds ``risk`` by the engine that each row's mode names; an unknown mode is an error when the row is computed.

    The rows are read once: each engine is given the texts of its mode and nulls for the others."""
    base = df.drop("risk")
    chosen, *names = unused(base, "_mode", *[f"_risk{k}" for k in range(len(engines))])
    wanted = F.trim(F.coalesce(col(mode), F.lit("")))
    out = base.withColumn(chosen, F.when(wanted == "", F.lit(parse_mode(default))).otherwise(F.lower(wanted)))
    for name, (engine, cfg) in zip(names, engines.items(), strict=True):
        cfg = resolved(cfg)
        mine = F.when(col(chosen) == engine, col(text))
        if cfg.mode == "deep" and cfg.service_url:
            (sent,) = unused(out, "_sent")
            out = assess(out.withColumn(sent, mine), sent, None, cfg).drop(sent).withColumnRenamed("risk", name)
        else:
            out = input_risk(out, mine, cfg, name)
    risk = F.raise_error(F.concat(F.lit("engine is not configured for mode "), col(chosen))).cast(scoring.RISK)
    for name, engine in zip(names, engines, strict=True):
        risk = F.when(col(chosen) == engine, col(name)).otherwise(risk)
    return settled(out, "risk", risk).drop(chosen, *names)


def guarded(df: DataFrame, text: str, url: str, cfg: Config = Config(), max_chars: int = 512 * 1024) -> DataFrame:
    """The way of a page to a model: its domain is checked, then its text (at most ``max_chars``) is assessed, then wrapped.

    Adds ``risk`` (of the domain where that is blocked, its text is not assessed then) and ``wrapped``, null for blocked rows."""
    own, seen = unused(df, "_domain", "_text")
    out = settled(df, own, check_domain(col(url), list(cfg.allowed_domains), cfg.strict))
    out = out.withColumn(seen, F.when(~col(own)["blocked"], F.left(col(text), F.lit(max_chars))))
    out = assess(out, seen, None, cfg)
    out = settled(out, "risk", F.when(col(own)["blocked"], col(own)).otherwise(F.col("risk")))
    return out.withColumn("wrapped", F.when(~F.col("risk.blocked"), wrap(col(seen), col(url)))).drop(own, seen)


def sanitize(df: DataFrame, text: str = "text", cfg: SanitizeConfig = SanitizeConfig(), output: bool = False) -> DataFrame:
    """Adds ``sanitized`` (clean_text, redactions with byte offsets in the original)."""
    return df.withColumn("sanitized", sanitizer(cfg.for_output() if output else cfg)(col(text)))


def sanitize_and_assess(df: DataFrame, text: str = "text", cfg: Config = Config(), redaction: SanitizeConfig = SanitizeConfig()) -> DataFrame:
    """Adds both; the original text is assessed."""
    return assess(sanitize(df, text, redaction), text, None, cfg)


def chat_pairs(conversations: DataFrame) -> DataFrame:
    """Each assistant turn with the user turn before it: conv_id, turn, prompt, output."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = conversations.withColumn("prompt", F.when(F.lag("role").over(w) == "user", F.lag("text").over(w)))
    return pairs.where("role = 'assistant'").select("conv_id", "turn", F.coalesce("prompt", F.lit("")).alias("prompt"), F.col("text").alias("output"))


def over_defense_suite(spark: SparkSession, cfg: Config = Config()) -> DataFrame:
    """The built-in benign sentences, assessed."""
    from .benign import SENTENCES

    return assess(spark.createDataFrame(SENTENCES, "name string, text string"), "text", None, cfg)


__all__ = ["assess", "assess_by_mode", "assess_output", "assess_pair", "chat_pairs", "guarded", "over_defense_suite", "sanitize", "sanitize_and_assess", "scan"]
