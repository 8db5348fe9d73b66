"""The risk of an input: points, level, categories, reason and intent from matches, signals and scanners."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions.text import capped, contains_any, let, none_of
from .matching import CATEGORIES
from .scanners import EMOTIONS

RISK = (
    "struct<score:int,level:string,blocked:boolean,reason:string,patterns:array<string>,categories:array<string>,ban_list_matches:array<string>,over_defense_risk:double,is_output_scan:boolean,"
    "pii_found:boolean,pii_types:array<string>,redacted_text:string,relevance_score:double,code_detected:boolean,harmful_code_patterns:array<string>,intent:string>"
)
SAFE_REASON = "No threats detected"

# Points by severity, chains of categories, and the intent of a category, the gravest first.
SEVERITY_POINTS = [0, 10, 15, 25, 35, 45]
CHAINS = [
    ("instruction-override", "exfiltration", 20),
    ("jailbreak", "instruction-override", 15),
    ("role-hijack", "exfiltration", 15),
    ("agent-hijacking", "exfiltration", 20),
    ("agent-hijacking", "data-destruction", 20),
]
HIGH_SIGNAL = ["exfiltration", "jailbreak", "structural-injection", "data-destruction", "transaction-coercion", "agent-hijacking"]
INTENTS = {
    "data-destruction": "data-destruction",
    "exfiltration": "data-exfiltration",
    "transaction-coercion": "unauthorized-transaction",
    "agent-hijacking": "agent-hijacking",
    "structural-injection": "system-compromise",
    "jailbreak": "jailbreak",
    "instruction-override": "instruction-bypass",
    "indirect-command": "instruction-bypass",
    "social-engineering": "instruction-bypass",
    "output-steering": "output-steering",
    "role-hijack": "jailbreak",
    "resource-exhaustion": "resource-exhaustion",
}
TIERS = {"tier1": "tier-1: coercion", "tier2": "tier-2: identity-override", "tier3": "tier-3: hostile"}


def level(score: Column) -> Column:
    return F.when(score < 20, "safe").when(score < 40, "low").when(score < 60, "medium").when(score < 80, "high").otherwise("critical")


def block_limit(strict: bool = False, threshold: int = 0) -> int:
    return threshold if 1 <= threshold <= 100 else 40 if strict else 60


def blocked(score: Column, strict: bool = False, threshold: int = 0) -> Column:
    return score >= block_limit(strict, threshold)


def risk(score: Column, is_blocked: Column, reason: Column, patterns: Column, categories: Column, **rest: Column) -> Column:
    """A whole risk struct; what isn't given is empty."""
    none, no, text = none_of("string"), F.lit(False), F.lit("")
    given = {"ban_list_matches": none, "over_defense_risk": F.lit(0.0), "is_output_scan": no, "pii_found": no, "pii_types": none, "redacted_text": text, "relevance_score": F.lit(0.0), "code_detected": no, "harmful_code_patterns": none, "intent": text} | rest
    first = {"score": score, "level": level(score), "blocked": is_blocked, "reason": reason, "patterns": patterns, "categories": categories}
    return F.struct(*[c.alias(n) for n, c in (first | given).items()]).cast(RISK)


def safe(reason: str = SAFE_REASON, is_output: bool = False) -> Column:
    none = none_of("string")
    return risk(F.lit(0), F.lit(False), F.lit(reason), none, none, relevance_score=F.lit(-1.0), is_output_scan=F.lit(is_output))


def _of(matches: Column, category: str) -> Column:
    return F.filter(matches, lambda m: m["category"] == category)


def has(matches: Column, category: str) -> Column:
    return F.exists(matches, lambda m: m["category"] == category)


def match_score(matches: Column) -> Column:
    """Each category gives its gravest rule's points and a fifth of them for up to three more rules; more categories and known
    chains add to it; at most 100."""
    points = F.array(*[F.lit(p) for p in SEVERITY_POINTS])

    def of(category: str) -> Column:
        own = _of(matches, category)
        top = F.element_at(points, F.coalesce(F.array_max(F.transform(own, lambda m: m["severity"])), F.lit(0)) + 1)
        return F.when(F.size(own) > 0, top + F.least(F.size(own) - 1, F.lit(3)) * F.floor(top / 5).cast("int")).otherwise(0)

    n = F.size(F.array_distinct(F.transform(matches, lambda m: m["category"])))
    total = reduce(add, [of(c) for c in CATEGORIES]) + F.greatest(n - 1, F.lit(0)) * 15
    total = total + reduce(add, [F.when(has(matches, a) & has(matches, b), bonus).otherwise(0) for a, b, bonus in CHAINS])
    return capped(total, 100)


def context_penalty(text: Column, matches: Column) -> Column:
    """Points that a single weak category loses beside marks of documentation, code or legitimate use."""
    kinds = F.array_distinct(F.transform(matches, lambda m: m["category"]))
    top = F.array_max(F.transform(matches, lambda m: m["severity"]))
    eligible = (F.size(kinds) == 1) & ~F.exists(kinds, lambda k: k.isin(*HIGH_SIGNAL)) & ~((top >= 4) & (F.size(matches) >= 2))
    points = lambda c, n: F.when(c, n).otherwise(0)
    found = lambda low: points(contains_any(low, lex.PENALTY_DOC), 10) + points(contains_any(low, lex.PENALTY_CODE), 10) + points(contains_any(low, lex.PENALTY_LEGITIMATE), 5) + points(text.contains("aria-") | text.contains("data-"), 5)
    return F.when(eligible, capped(let(F.lower(text), found), 20)).otherwise(0)


def signal_boost(p: Column) -> Column:
    """Points of hidden content; ``p`` is what prepare() returned."""
    points = lambda c, n: F.when(c, n).otherwise(0)
    return points(p["hidden"], 45) + points(p["zero_width"] & p["hidden"], 20) + points(p["zero_width"] & ~p["hidden"], 10) + points(p["hidden"] & p["aria_hidden"], 15) + points(p["hidden"] & p["collapsed"], 10)


def secrets_points(s: Column) -> Column:
    return F.when(s["confidence"] == "high", 25).when(s["confidence"] == "medium", 15).when(s["confidence"] == "low", 10).otherwise(0)


def gibberish_points(g: Column, gate: Column) -> Column:
    both = F.when(g["is_gibberish"], 20).otherwise(0) + F.when(g["high_entropy_block"], 15).otherwise(0)
    return F.when(gate, both).when(g["is_gibberish"] | g["high_entropy_block"], 5).otherwise(0)


def toxicity_points(t: Column, gate: Column) -> Column:
    return capped(F.when(t["is_toxic"] & gate, 18).when(t["is_toxic"], 8).otherwise(0) + F.when(t["tier1"], 20).otherwise(0), 30)


def emotion_points(e: Column, gate: Column) -> Column:
    return F.when(e["manipulative"] & gate, capped(e["weighted"], 35)).when(e["manipulative"], 8).otherwise(0)


def ban_points(b: Column) -> Column:
    return capped(30 * b["n_substring"] + 20 * b["n_topic"] + 15 * b["n_competitor"] + 40 * b["n_regex"], 60)


def scanner_points(s: Column, g: Column, t: Column, e: Column, b: Column, gate: Column) -> Column:
    """Points of the side scanners."""
    return secrets_points(s) + gibberish_points(g, gate) + toxicity_points(t, gate) + emotion_points(e, gate) + ban_points(b)


def trigger_points(s: Column, g: Column, t: Column, gate: Column) -> Column:
    """Points that weak signals alone may have given."""
    hostile = t["is_toxic"] & t["tier3"] & ~t["tier1"] & ~t["tier2"] & ~gate
    only_entropy = (F.size(s["types"]) > 0) & ~F.exists(s["types"], lambda x: x != "high-entropy-token")
    odd = (g["is_gibberish"] | g["high_entropy_block"]) & ~gate
    return F.when(hostile, 8).otherwise(0) + F.when(only_entropy, secrets_points(s)).otherwise(0) + F.when(odd, 5).otherwise(0)


def intent(categories: Column) -> Column:
    out = None
    for category, found in INTENTS.items():
        here = F.array_contains(categories, category)
        out = F.when(here, found) if out is None else out.when(here, found)
    return out.otherwise("")


def _present(*named: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in named]), lambda x: x.isNotNull())


def pattern_ids(matches: Column, s: Column, g: Column, t: Column, e: Column, b: Column) -> Column:
    emotions = [(F.array_contains(e["types"], k), v[2]) for k, v in EMOTIONS.items()]
    return F.concat(
        F.transform(matches, lambda m: m["rule_id"]),
        F.transform(s["types"], lambda x: F.concat(F.lit("secret-"), x)),
        _present((g["is_gibberish"], "gibberish-pattern"), (g["high_entropy_block"], "gibberish-high-entropy-block"), (t["tier1"], "tx-001"), (t["tier2"], "tx-002"), (t["tier3"], "tx-003"), *emotions, (b["n_substring"] > 0, "bl-sub-001"), (b["n_topic"] > 0, "bl-top-001"), (b["n_competitor"] > 0, "bl-cmp-001"), (b["n_regex"] > 0, "bl-rgx-001")),
    )


def category_names(matches: Column, s: Column, g: Column, t: Column, e: Column, b: Column) -> Column:
    own = _present(
        (F.size(s["types"]) > 0, "secrets"),
        (g["is_gibberish"] | g["high_entropy_block"], "gibberish"),
        (t["is_toxic"], "toxicity"),
        (e["manipulative"], "emotional-manipulation"),
        (b["n_substring"] > 0, "ban-substring"),
        (b["n_topic"] > 0, "ban-topic"),
        (b["n_competitor"] > 0, "ban-competitor"),
        (b["n_regex"] > 0, "custom-regex"),
    )
    return F.array_sort(F.array_distinct(F.concat(F.transform(matches, lambda m: m["category"]), own)))


def reason(matches: Column, categories: Column, p: Column, s: Column, g: Column, t: Column, e: Column, b: Column) -> Column:
    """The explanation of an input's risk."""
    kinds = F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["category"])))

    def told(kind: Column) -> Column:
        n = F.size(F.filter(matches, lambda m: m["category"] == kind))
        return F.when(n == 1, F.concat(kind, F.lit(" pattern detected"))).otherwise(F.concat(n.cast("string"), F.lit(" "), kind, F.lit(" patterns detected")))

    head = F.concat(F.array_join(F.transform(kinds, told), "; "), F.when(F.size(categories) > 1, F.concat(F.lit(" [cross-category: "), F.size(categories).cast("string"), F.lit(" categories]"))).otherwise(""))
    tiers = F.array_join(_present(*[(t[k], v) for k, v in TIERS.items()]), ", ")
    some = F.size(matches) > 0
    more = [
        (F.size(s["types"]) > 0, F.lit("credential pattern detected")),
        (g["is_gibberish"], F.lit("gibberish text pattern detected")),
        (g["high_entropy_block"], F.lit("high entropy block detected")),
        (t["is_toxic"], F.concat(F.lit("manipulative or threatening language detected"), F.when(tiers != "", F.concat(F.lit(" ("), tiers, F.lit(")"))).otherwise(""))),
        (e["manipulative"], F.concat(F.lit("emotional manipulation tactic detected: "), F.array_join(e["types"], ", "))),
        (some & p["hidden"], F.lit("hidden HTML injection detected")),
        (some & p["zero_width"], F.lit("zero-width injection detected")),
        (some & p["hidden"] & p["aria_hidden"], F.lit("aria-hidden content abuse detected")),
        (some & p["hidden"] & p["collapsed"], F.lit("collapsed details injection detected")),
        (some & p["attribute"], F.lit("attribute-based injection detected")),
        (F.size(b["rules"]) > 0, F.concat(F.lit("user-defined ban rule matched: "), F.array_join(b["rules"], ", "))),
    ]
    parts = F.filter(F.array(F.trim(head), *[F.when(c, x) for c, x in more]), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise(SAFE_REASON)


def merged(a: Column, b: Column) -> Column:
    """The graver of two risks; their lists united and their reasons joined."""
    score = F.greatest(a["score"], b["score"])
    quiet = lambda r: (F.trim(r["reason"]) == "") | (F.trim(r["reason"]) == SAFE_REASON)
    why = F.when(quiet(a) & quiet(b), SAFE_REASON).when(quiet(a), F.trim(b["reason"])).when(quiet(b) | (F.trim(a["reason"]) == F.trim(b["reason"])), F.trim(a["reason"])).otherwise(F.concat(F.trim(a["reason"]), F.lit("; "), F.trim(b["reason"])))
    union = lambda n: F.array_union(a[n], b[n])
    kept = {n: a[n] for n in ("is_output_scan", "pii_found", "pii_types", "redacted_text", "relevance_score", "code_detected", "harmful_code_patterns", "intent")}
    return risk(score, a["blocked"] | b["blocked"], why, union("patterns"), union("categories"), ban_list_matches=union("ban_list_matches"), over_defense_risk=F.greatest(a["over_defense_risk"], b["over_defense_risk"]), **kept)
