"""Scanners of model output: prompt leaks, URLs, personal data, code, relevance; and the risk they make together."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from math import log2

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions.batches import chunks
from ..functions.dialect import to_java, to_python
from ..functions.text import capped, contains_any, count_contains, entropy, found, let, matches, none_of, trimmed
from .scanners import AWS_CONTEXT, AWS_SECRET, AWS_WINDOW, SECRET_ASSIGNMENT, SECRET_NAMES, SECRET_PREFIXES
from .domain import host
from .scoring import SAFE_REASON, blocked, risk, safe

# Expressions of URLs, code and personal data.
URL = r"https?://[^\s<>\"{}|\\^`\[\]]+"
BARE_DOMAIN = r"\b(?:[a-zA-Z0-9-]+\.)+(?:xyz|tk|ml|ga|cf|gq|pw|top|click|download|zip)\b"
IP_URL = r"^https?://\d{1,3}(?:\.\d{1,3}){3}"
DATA_URL = r"data:[^;]+;base64"
PORT = r"^https?://[^/]+:(\d{2,5})(?:/|\?|#|$)"
ENCODED = r"(?:%[0-9a-fA-F]{2}){4,}"
EXAMPLE_DOMAINS = ["example.com", "your-domain.com", "placeholder.com"]

FENCE = r"(?s)```([a-zA-Z0-9#+-]*)\n(.*?)```"
INLINE_CODE = [
    r"(?m)^\s*\$\s+\S+",
    r"\b(import\s+\w+|def\s+\w+\(|class\s+\w+|print\()",
    r"\b(function\s+\w*\(|const\s+\w+\s*=|let\s+\w+\s*=|require\()",
    r"\b(package\s+\w+|func\s+\w+\(|import\s*\()",
    r"(?i)(#!/bin/bash|\bcurl\b|\bwget\b|\bchmod\b)",
]
CODE_CRITICAL = {
    "file-deletion": r"(rm\s+-rf|rmdir\s+/s|os\.remove|shutil\.rmtree|Delete-Item\s+-Recurse)",
    "fork-bomb": r"(:\(\)\{.*\}|fork\(\)|while\s*true|while\s*1:\s*pass)",
    "system-file-modify": r"(/etc/passwd|/etc/shadow|C:\\Windows\\System32|HKEY_LOCAL_MACHINE|registry)",
    "reverse-shell": r"(bash\s+-i\s+>&|nc\s+-e|/dev/tcp/|python.*socket.*connect|powershell.*webclient)",
}
CODE_HIGH = {
    "network-ip-request": r"(curl|wget|fetch|requests\.(get|post)).*(https?://\d{1,3}(?:\.\d{1,3}){3}|\.xyz|\.tk|\.ml|\.ga)",
    "env-leak-network": r"(os\.environ|process\.env|\$env:|%[A-Z_]+%).*(curl|wget|requests\.|fetch|http)",
    "base64-network": r"(base64|b64encode|encode).*(curl|wget|requests\.|fetch|http)",
    "spawn-subprocess": r"(subprocess\.|os\.system\(|exec\.Command\(|child_process)",
    "obfuscated-code": r"(?:\b[a-zA-Z]\b\s*=){5,}|(?:0x[0-9a-f]{2}\s*){8,}",
}
CODE_MEDIUM = {
    "filesystem-traversal": r"(\.\./|\.\.\\|/home/|/root/|C:\\Users\\)",
    "security-bypass": r"(verify\s*=\s*false|ssl_verify\s*=\s*false|InsecureSkipVerify|--no-check-certificate|rejectUnauthorized\s*:\s*false)",
    "silent-install": r"(pip\s+install|npm\s+install|go\s+get|apt-get\s+install)",
}
CODE_TALK = ["for example", "this is how", "avoid"]

EMAIL = r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"
SSN = r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b"
CARD = r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b"
PHONE = r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b"
PRIVATE_IP = r"\b(?:10|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168)\.\d{1,3}\.\d{1,3}\b"
PUBLIC_IP = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
NAME = r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"
SAS = r"(?i)\bsig=[a-zA-Z0-9%]{40,}\b"
EXAMPLE_EMAILS = {"example@example.com", "user@domain.com", "test@test.com", "foo@bar.com"}
SSN_CONTEXT, SSN_WINDOW = ("ssn", "social security", "social sec"), 48
PHONE_CONTEXT, PHONE_WINDOW = ("phone", "call", "mobile", "cell", "tel", "contact"), 64

# Ids of what fired.
PATTERN_IDS = {
    "leak": "output.leak.system_prompt",
    "url": "output.url.suspicious",
    "pii": "output.pii.detected",
    "harmful": "output.code.harmful",
    "code": "output.code.present",
    "relevance": "output.relevance.low",
}

PII = "struct<types:array<string>,high:int,medium:int,low:int,redacted:string>"


def prompt_leak(text: Column) -> Column:
    """struct(high, medium, low): phrases that give a prompt or its rules away."""
    return let(F.lower(text), lambda low: F.struct(*[count_contains(low, p).alias(n) for n, p in (("high", lex.LEAK_HIGH), ("medium", lex.LEAK_MEDIUM), ("low", lex.LEAK_LOW))]))


def urls_of(text: Column) -> Column:
    """URLs, then bare domains of suspicious endings; each string once."""
    all_ = lambda r: F.regexp_extract_all(text, F.lit(to_java(r, False)), F.lit(0))
    return F.array_distinct(F.concat(all_(URL), all_(BARE_DOMAIN)))


def url_risk(url: Column) -> Column:
    """struct(url, high, medium, low, kinds) of one URL; documentation and well-known hosts have no risk."""
    low = F.lower(url)
    name = host(F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url)))
    known = let(name, lambda n: reduce(lambda a, d: a | (n == d) | n.endswith("." + d), [*EXAMPLE_DOMAINS, *lex.URL_SAFE_DOMAINS], F.lit(False)))
    values = F.transform(F.split(F.regexp_extract(low, r"\?([^#]*)", 1), "&"), lambda p: F.coalesce(F.try_url_decode(F.regexp_extract(p, r"(?s)=(.*)", 1)), F.lit("")))
    kinds = {
        "high": [
            ("ip-url", matches(low, IP_URL)),
            ("data-exfiltration", matches(low, DATA_URL)),
            ("high-entropy-query", F.exists(values, lambda v: (F.octet_length(v) >= 20) & (entropy(v) > 4.5))),
            ("tunnel-service", contains_any(low, lex.URL_TUNNELS)),
            ("non-standard-port", let(F.regexp_extract(low, to_java(PORT), 1), lambda p: (p != "") & ~p.isin(*lex.URL_SAFE_PORTS))),
        ],
        "medium": [
            ("suspicious-tld", contains_any(low, lex.URL_TLDS)),
            ("encoded-obfuscation", matches(low, ENCODED)),
            ("suspicious-path", contains_any(low, lex.URL_PATH_WORDS)),
            ("long-url", F.octet_length(url) > 200),
        ],
        "low": [("data-query", contains_any(low, lex.URL_QUERY_HINTS))],
    }
    present = F.filter(F.array(*[F.when(c, F.lit(k)) for xs in kinds.values() for k, c in xs]), lambda x: x.isNotNull())
    risky = let(known, lambda k: F.when(k, none_of("string")).otherwise(F.array_sort(present)))
    count = lambda found, n: F.size(F.filter(found, lambda k: k.isin(*[x for x, _ in kinds[n]])))
    return let(risky, lambda found: F.struct(url.alias("url"), *[count(found, n).alias(n) for n in kinds], found.alias("kinds")))


def url_scan(text: Column) -> Column:
    """struct(urls, suspicious, kinds, high, medium, low)."""
    total = lambda each, n: F.aggregate(each, F.lit(0), lambda a, u: a + u[n])
    bad = lambda each: F.filter(each, lambda u: F.size(u["kinds"]) > 0)
    told = lambda each: F.struct(
        F.array_sort(F.transform(each, lambda u: u["url"])).alias("urls"),
        F.array_sort(F.transform(bad(each), lambda u: u["url"])).alias("suspicious"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(each, lambda u: u["kinds"])))).alias("kinds"),
        *[total(each, n).alias(n) for n in ("high", "medium", "low")],
    )
    return let(F.transform(urls_of(text), url_risk), told)


#: The characters with one of which a match of each of INLINE_CODE begins; none where a line's start tells.
INLINE_FIRST = ["", "idcp", "fclr", "pfi", "#cwCW"]


def _led(regex: str, first: str) -> str:
    """A regex for Java that looks at a place only if one of some characters stands there; that spares the search for word edges."""
    made = to_java(regex, False)
    flags = made.index(")") + 1
    return f"{made[:flags]}(?=[{first}]){made[flags:]}" if first else made


def looks_like_code(text: Column) -> Column:
    """Whether one of INLINE_CODE is found."""
    own = [text.rlike(_led(r, first)) for r, first in zip(INLINE_CODE, INLINE_FIRST, strict=True)]
    return reduce(lambda a, x: a | x, own[1:], text.contains("$") & own[0])


def code_scan(text: Column, allow: bool = False, ban: bool = False) -> Column:
    """struct(has_code, languages, harmful, critical, high, medium) of fenced code, or of the whole text if it looks like code."""
    all_ = lambda g: F.regexp_extract_all(text, F.lit(to_java(FENCE, False)), F.lit(g))
    inline = looks_like_code(text)
    groups = (("critical", CODE_CRITICAL), ("high", CODE_HIGH), ("medium", CODE_MEDIUM))
    talk = contains_any(F.lower(text), CODE_TALK)

    def fired(blocks: Column) -> Column:
        """(group, name) of each rule and block where it fires."""
        rules = lambda b: F.array(*[F.when(matches(b, r, True), F.struct(F.lit(g).alias("g"), F.lit(n).alias("n"))) for g, xs in groups for n, r in xs.items()])
        return F.filter(F.flatten(F.transform(blocks, rules)), lambda x: x.isNotNull())

    def told(x: Column) -> Column:
        def number(g: str) -> Column:
            n = F.size(F.filter(x["fired"], lambda f: f["g"] == g))
            n = n + x["has_code"].cast("int") if ban and g == "medium" else n
            n = F.when(x["talk"], F.floor((n + 1) / 2).cast("int")).otherwise(n)
            return F.lit(0) if allow and not ban and g == "medium" else n

        names = F.transform(x["fired"], lambda f: f["n"])
        names = F.concat(names, F.when(x["has_code"], F.array(F.lit("code-present"))).otherwise(none_of("string"))) if ban else names
        return F.struct(x["has_code"].alias("has_code"), x["languages"].alias("languages"), F.array_sort(F.array_distinct(names)).alias("harmful"), *[number(g).alias(g) for g, _ in groups])

    def judged(fenced: Column) -> Column:
        blocks = F.when(F.size(fenced) > 0, fenced).when(inline, F.array(text)).otherwise(none_of("string"))
        languages = F.array_sort(F.array_distinct(F.filter(F.transform(all_(1), lambda v: F.lower(v)), lambda v: v != "")))
        return let(blocks, lambda b: let(F.struct((F.size(b) > 0).alias("has_code"), languages.alias("languages"), talk.alias("talk"), fired(b).alias("fired")), told))

    return let(all_(2), judged)


def terms(text: Column) -> Column:
    """Distinct terms of two bytes or more that are no stop words."""
    all_ = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9_-]*"), F.lit(0))
    return F.array_distinct(F.filter(all_, lambda t: (F.length(t) >= 2) & ~t.isin(*lex.STOP_WORDS)))


def relevance(output: Column, prompt: Column) -> Column:
    """struct(computed, relevance, prompt_terms, overlap, drift, is_low): how far an answer keeps to its prompt's terms."""
    out, asked = trimmed(F.lower(output)), trimmed(F.lower(F.coalesce(prompt, F.lit(""))))
    drift = F.array_sort(found(out, lex.DRIFT_PHRASES))

    def told(x: Column) -> Column:
        part = x["shared"] / x["wanted"]
        low = x["computed"] & (x["wanted"] >= 3) & ((part < 0.20) | ((part < 0.35) & (F.size(x["drift"]) > 0)))
        when = lambda v, other: F.when(x["computed"], v).otherwise(other)
        return F.struct(
            x["computed"].alias("computed"),
            when(part, F.lit(-1.0)).alias("relevance"),
            when(x["wanted"], F.lit(0)).alias("prompt_terms"),
            when(x["shared"], F.lit(0)).alias("overlap"),
            when(x["drift"], none_of("string")).alias("drift"),
            F.coalesce(low, F.lit(False)).alias("is_low"),
        )

    counted = lambda wanted: F.struct(((out != "") & (F.size(wanted) > 0)).alias("computed"), F.size(wanted).alias("wanted"), F.size(F.array_intersect(wanted, terms(out))).alias("shared"), drift.alias("drift"))
    return let(let(terms(asked), counted), told)


# --- personal data: contexts and replacements need offsets, so this is one UDF

_re = {n: re.compile(to_python(r)) for n, r in {"email": EMAIL, "ssn": SSN, "card": CARD, "phone": PHONE, "private": PRIVATE_IP, "public": PUBLIC_IP, "name": NAME, "aws": AWS_SECRET}.items()}
_assignment, _sas, _aws_context = re.compile(to_python(SECRET_ASSIGNMENT), re.I), re.compile(to_python(SAS[4:]), re.I), re.compile(to_python(AWS_CONTEXT), re.I)
_prefixes = {n: re.compile(to_python(r)) for n, (r, _) in SECRET_PREFIXES.items()}
_any_prefix = re.compile("|".join(f"(?:{p.pattern})" for p in _prefixes.values()))
TAGS = {"email": "[REDACTED-EMAIL]", "ssn": "[REDACTED-SSN]", "credit-card": "[REDACTED-CREDIT-CARD]", "phone": "[REDACTED-PHONE]", "ip-address": "[REDACTED-IP-ADDRESS]"}


#: Runs of the characters of an e-mail, and what such a run must hold: the expression itself takes time by the square of a
#: long run that holds none.
EMAIL_RUN, EMAIL_MARK = re.compile(r"[A-Za-z0-9._%+\-@]+"), re.compile(r"@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}")


def runs(text: str, run: re.Pattern, mark: re.Pattern):
    return (m for m in run.finditer(text) if mark.search(text, *m.span()))


def _fences(text: str) -> list[tuple[int, int]]:
    marks = [m.start() for m in re.finditer("```", text)]
    return [(a, b + 3) for a, b in zip(marks[::2], marks[1::2], strict=False)] + ([(marks[-1], len(text))] if len(marks) % 2 else [])


def _ignored(text: str, at: int, fences: list[tuple[int, int]]) -> bool:
    if any(a <= at < b for a, b in fences):
        return True
    start, end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
    return text[start : len(text) if end < 0 else end].strip().startswith(("//", "#"))


#: What an expression needs, as far as it is cheap to tell: it runs only where that stands.
_key_marks = tuple(x for _, needs in SECRET_PREFIXES.values() for x in needs)
_three_digits, _dotted_digits = re.compile("[0-9]{3}"), re.compile(r"[0-9]\.[0-9]")


def has_key_mark(text: str) -> bool:
    return any(x in text for x in _key_marks)


def has_name_of_secret(text: str) -> bool:
    low = text.lower().replace("ſ", "s")
    return any(x in low for x in SECRET_NAMES)


def secret_confidence(text: str) -> str:
    """The confidence that scanners.secrets() gives, in Python."""
    if has_key_mark(text) and _any_prefix.search(text) or aws_secrets(text):
        return "high"
    if has_name_of_secret(text) and _assignment.search(text):
        return "medium"
    for t in text.split():
        if len(t) >= 32 and re.fullmatch(r"[A-Za-z0-9+/_=\-]+", t) and re.search("[0-9]", t):
            counts = [t.count(c) / len(t) for c in set(t)]
            if -sum(p * log2(p) for p in counts) > 4.5:
                return "low"
    return ""


def aws_secrets(text: str) -> list[re.Match]:
    low = text.lower()
    if "aw" not in low and "ecret" not in low or not _aws_context.search(text):  # an s may be a long one
        return []
    return [m for m in _re["aws"].finditer(text) if _aws_context.search(text, max(0, m.start() - AWS_WINDOW), m.end() + AWS_WINDOW)]


def find_pii(text: str) -> dict:
    """Types, counts by confidence and a redacted copy.  Matches inside code fences and comment lines don't count; phone and
    social security numbers need a word of theirs near by."""
    low, fences = text.lower(), _fences(text)
    spans: list[tuple[int, int, str]] = []
    counts, types = {"high": 0, "medium": 0, "low": 0}, set()

    def near(m, words, window):
        return any(w in low[max(0, m.start() - window) : m.end() + window] for w in words)

    def take(kind, confidence, found):
        for m in found:
            if not _ignored(text, m.start(), fences):
                spans.append((m.start(), m.end(), kind))
                types.add(kind)
                counts[confidence] += 1

    if "@" in text:
        take("email", "high", (m for run in runs(text, EMAIL_RUN, EMAIL_MARK) for m in _re["email"].finditer(text, *run.span()) if m[0].lower() not in EXAMPLE_EMAILS))
    if _three_digits.search(text):
        take("ssn", "high", (m for m in _re["ssn"].finditer(text) if near(m, SSN_CONTEXT, SSN_WINDOW)))
        take("credit-card", "high", _re["card"].finditer(text))
        take("phone", "medium", (m for m in _re["phone"].finditer(text) if near(m, PHONE_CONTEXT, PHONE_WINDOW)))
    if _dotted_digits.search(text):
        take("ip-address", "medium", _re["private"].finditer(text))
        octets = lambda s: all(int(x) <= 255 and str(int(x)) == x for x in s.split("."))
        take("ip-address", "medium", (m for m in _re["public"].finditer(text) if not _re["private"].search(m[0]) and octets(m[0])))
    if counts["high"] + counts["medium"] and sum(not _ignored(text, m.start(), fences) for m in _re["name"].finditer(text)) >= 2:
        counts["low"] += 1
        types.add("name-pattern")
    secret = secret_confidence(text)
    if secret:
        types.add("api-key")
        if secret in ("high", "medium"):
            counts[secret] += 1
    if not types:
        return {"types": [], **counts, "redacted": ""}
    redacted = text
    for start, end, kind in sorted(spans, key=lambda s: -s[0]):
        redacted = redacted[:start] + TAGS[kind] + redacted[end:]
    if has_name_of_secret(redacted):
        redacted = _assignment.sub("[REDACTED-API-KEY]", redacted)
    if has_key_mark(redacted):
        redacted = _any_prefix.sub("[REDACTED-API-KEY]", redacted)
    redacted = _sas.sub("sig=[REDACTED-SAS]", redacted)
    for m in reversed(aws_secrets(redacted)):
        redacted = redacted[: m.start()] + "[REDACTED-AWS-SECRET]" + redacted[m.end() :]
    return {"types": sorted(types), **counts, "redacted": redacted if redacted.strip() else "[REDACTED]"}


def pii():
    """UDF text -> struct of PII."""

    @F.pandas_udf(PII)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in chunks(batches):
            yield pd.DataFrame([find_pii(t) if t else {"types": [], "high": 0, "medium": 0, "low": 0, "redacted": ""} for t in texts], columns=["types", "high", "medium", "low", "redacted"])

    return run


# --- the risk


def leak_points(k: Column) -> Column:
    return F.when((k["high"] + k["medium"] == 0), capped(8 * k["low"], 10)).otherwise(capped(30 * k["high"] + 18 * k["medium"] + 8 * k["low"], 60))


def output_risk(text: Column, leak: Column, urls: Column, personal: Column, code: Column, rel: Column, strict: bool = False, threshold: int = 0) -> Column:
    """Risk of an output from its five scans."""
    leaks, bad_url, private = leak["high"] + leak["medium"] + leak["low"] > 0, F.size(urls["suspicious"]) > 0, F.size(personal["types"]) > 0
    harmful = code["critical"] + code["high"] + code["medium"] > 0
    points = lambda s, a, b, c, top, n=("high", "medium", "low"): capped(a * s[n[0]] + b * s[n[1]] + c * s[n[2]], top)
    bonus = capped(F.when(leaks & private, 10).otherwise(0) + F.when(bad_url & private, 12).otherwise(0) + F.when(bad_url & harmful, 8).otherwise(0), 20)
    low = rel["is_low"]
    score = leak_points(leak) + points(urls, 25, 12, 5, 50) + points(personal, 25, 12, 5, 60) + points(code, 35, 20, 10, 65, ("critical", "high", "medium")) + F.when(low, capped(15 + 4 * F.size(rel["drift"]), 25)).otherwise(0) + bonus
    score = capped(score, 100)
    present = lambda *xs: F.array_sort(F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in xs]), lambda x: x.isNotNull()))
    why = present((leaks, "system prompt leakage indicators detected"), (bad_url, "suspicious URL indicators detected"), (private, "PII exposure detected"), (harmful, "harmful code patterns detected"), (code["has_code"] & ~harmful, "code present in output"), (low, "response relevance drift detected"))
    out = risk(
        score,
        blocked(score, strict, threshold),
        F.when(F.size(why) > 0, F.array_join(why, "; ")).otherwise(SAFE_REASON),
        present((leaks, PATTERN_IDS["leak"]), (bad_url, PATTERN_IDS["url"]), (private, PATTERN_IDS["pii"]), (code["has_code"], PATTERN_IDS["code"]), (harmful, PATTERN_IDS["harmful"]), (low, PATTERN_IDS["relevance"])),
        present((leaks, "system-prompt-leak"), (bad_url, "malicious-url"), (private, "pii"), (code["has_code"], "code"), (harmful, "harmful-code"), (low, "low-relevance")),
        is_output_scan=F.lit(True),
        pii_found=private,
        pii_types=personal["types"],
        redacted_text=F.when(private, personal["redacted"]).otherwise(""),
        relevance_score=rel["relevance"],
        code_detected=code["has_code"],
        harmful_code_patterns=code["harmful"],
        intent=F.when(leaks | private, "data-exfiltration").when(bad_url | harmful, "system-compromise").when(low, "output-steering").otherwise(""),
    )
    return F.when(trimmed(F.coalesce(text, F.lit(""))) == "", safe("No output text provided", True)).otherwise(out)
