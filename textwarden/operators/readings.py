"""What the side scanners, the context score and the payload types say of a text, read off in one pass by Python workers.

``scanners`` and ``debias`` give the same values as columns of the JVM, one scanner at a time; a whole assessment needs all of
them for each text, and there one search for all phrases at once takes a fraction of the time of one search for each.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections import Counter
from collections.abc import Iterable
from functools import cache
from math import log

from ..functions import lexicon as lex
from ..functions.dialect import to_python
from ..functions.text import WHITE
from . import debias, scanners

#: What read() returns, by name; ``context`` and those before it as ``scanners`` and ``debias`` define them.
READING = "gate:boolean,secrets:array<string>,secret_level:string,gibberish:boolean,entropy_block:boolean,toxic:boolean,tier1:boolean,tier2:boolean,tier3:boolean,manipulative:boolean,emotions:array<string>,emotion_points:int,attack:int,payload:array<string>,context:int"
NAMES = [f.split(":")[0] for f in READING.split(",")]

_white = re.compile(f"[{re.escape(WHITE)}]+")
_controls = re.compile("[\x1c-\x1f]")
_ascii_dead = {c: None for c in range(128) if chr(c) not in string.ascii_letters + string.digits + WHITE}
_ascii_word = bytes(set(range(128)) - set((string.ascii_letters + string.digits).encode()))
_consonants = re.compile("[bcdfghjklmnpqrstvwxyz]{4}")
_gate = re.compile(to_python(scanners.KEYWORDS), re.I)
#: How the words of the gate begin.
_stems = "ignore disregard override bypass forget previous prior instruction system prompt obey comply neutralize circumvent suppress unrestricted jailbreak pretend roleplay act developer exfiltrat new".split()
_leet = list(zip(scanners.LEET, scanners.LEET_LETTERS, strict=True))
_code, _toxic_code = re.compile(to_python(scanners.CODE_WORDS), re.I), re.compile(to_python(scanners.TOXIC_CODE_WORDS), re.I)
_code_marks = ("func", "class", "def", "var", "const", "import", "return", "struct", "interface")
_hostile = re.compile(to_python(r"\b(" + "|".join(lex.TOXIC_HOSTILE) + r")\b"), re.I)
_prefixes = {n: (re.compile(to_python(r)), needs) for n, (r, needs) in scanners.SECRET_PREFIXES.items()}
_aws = (
    re.compile(to_python(rf"(?:aws|secret).{{0,{scanners.AWS_WINDOW}}}?{scanners.AWS_SECRET}"), re.I | re.S),
    re.compile(to_python(rf"{scanners.AWS_SECRET}.{{0,{scanners.AWS_WINDOW}}}?\b(?:aws|secret|AWS|SECRET)\b"), re.S),
)
_aws_context, _assignment = re.compile(to_python(scanners.AWS_CONTEXT), re.I), re.compile(to_python(scanners.SECRET_ASSIGNMENT), re.I)
_entropy_token = re.compile(r"[A-Za-z0-9+/_=\-]+")
_base64 = re.compile("[A-Za-z0-9+/]+={1,2}")
_marks = re.compile("[!?]{3}")
_no_space = str.maketrans("", "", "\n\r ")
_capitals = re.compile("[A-Z][A-Z]|[^\x00-\x7f]|[A-Z][^A-Za-z \t\n]+[A-Z]")

_LINKS = ["http://", "https://", ".com", ".net", ".org"]
_PHRASES = [
    *lex.TOXIC_COERCION, *lex.TOXIC_IDENTITY, *lex.TOXIC_HOSTILE, *(p for ps, _, _ in scanners.EMOTIONS.values() for p in ps), *lex.ATTACK_PHRASES,
    *lex.ROLE_PHRASES, *lex.EXFILTRATION_PHRASES, *lex.JAILBREAK_PHRASES, *lex.BOT_WORDS, *_LINKS, *lex.SPAM_WORDS, *lex.MODEL_TERMS, *lex.DOC_WORDS, *lex.DOC_MARKUP, *lex.DEV_WORDS, *lex.DEV_COMMANDS,
    *debias.CONNECTORS, *debias.DOC_HINTS, *debias.DEV_HINTS, *debias.POLITE,
]


@cache
def _automaton():
    try:
        import ahocorasick
    except ImportError:
        return None
    out = ahocorasick.Automaton()
    for p in set(_PHRASES):
        out.add_word(p, p)
    out.make_automaton()
    return out


def _standing(low: str) -> set[str]:
    """The phrases that stand in a text of lower case."""
    automaton = _automaton()
    return {p for p in _PHRASES if p in low} if automaton is None else {p for _, p in automaton.iter(low)}


def split(text: str) -> list[str]:
    """Tokens between white space, as functions.text.fields()."""
    return [t for t in _white.split(text) if t] if _controls.search(text) else text.split()


#: Letters that ignoring case takes for ASCII ones.
_FOLDS = "ſıİK"


def _folded(low: str) -> str:
    """Lower case with _FOLDS as the letters that ignoring case takes them for."""
    return low if low.isascii() else low.replace("ſ", "s").replace("ı", "i").replace("i̇", "i")


def entropy(token: str) -> float:
    """As functions.text.entropy()."""
    out, size = 0.0, len(token)
    for n in Counter(token).values():
        out -= n / size * (log(n / size) / log(2))
    return out


def words(text: str) -> list[str]:
    """As functions.text.words()."""
    if text.isascii():
        return split(text.translate(_ascii_dead).lower())
    for c in set(text):
        if not (c.isalpha() or c.isdecimal() or c in WHITE):
            text = text.replace(c, "")
    return split(text.lower())


def _found(regex: re.Pattern, starts: Iterable[str], text: str, low: str) -> bool:
    """Whether a regex that ignores case is found; each match begins with one of ``starts``.  ``low``: the text in lower case."""
    if not text.isascii() and (len(low) != len(text) or any(c in text for c in _FOLDS)):
        return any(s in _folded(low) for s in starts) and bool(regex.search(text))
    for s in starts:
        at = low.find(s)
        while at >= 0:
            if regex.match(low, at):
                return True
            at = low.find(s, at + 1)
    return False


def keyword_gate(text: str, low: str) -> bool:
    if _found(_gate, _stems, text, low):
        return True
    read = low
    for c, letter in _leet:
        read = read.replace(c, letter)
    return read != low and _found(_gate, _stems, read, read)


def secrets(text: str, low: str, tokens: list[str]) -> tuple[list[str], str]:
    """(types, confidence)."""
    folded = low.replace("ſ", "s")
    high = [n for n, (r, needs) in _prefixes.items() if any(x in text for x in needs) and r.search(text)]
    if ("aws" in folded or "secret" in folded) and _aws_context.search(text) and any(r.search(text) for r in _aws):
        high.append("aws-secret-key")
    medium = ["secret-assignment"] if _found(_assignment, scanners.SECRET_NAMES, text, low) else []
    dense = any(len(w) >= scanners.ENTROPY_MIN_LENGTH and _entropy_token.fullmatch(w) and any(d in w for d in string.digits) and entropy(w) > scanners.ENTROPY_MIN for w in tokens)
    found = [*high, *medium, *(["high-entropy-token"] if dense else [])]
    return found, "high" if high else "medium" if medium else "low" if dense else ""


def etaoin_hits(low: str) -> int | None:
    ranked = sorted((-n, c) for c in string.ascii_lowercase if (n := low.count(c)))[:6]
    return sum(c in "etaoin" for _, c in ranked) if ranked else None


def gibberish(bare: str, low: str, tokens: list[str], own: list[str]) -> tuple[bool, bool]:
    """(is_gibberish, high_entropy_block); ``own`` are the words()."""
    if len(bare) < 20 or bare.startswith(("http://", "https://")) or not own:
        return False, False
    if _found(_code, _code_marks, bare, low.strip(WHITE)):
        return False, False
    if bare.endswith("=") and len(compact := bare.translate(_no_space)) >= 24 and _base64.fullmatch(compact):
        return False, False
    odd = sum(len(w) > 4 and bool(_consonants.search(w)) for w in own) / len(own) if _consonants.search(" ".join(own)) else 0.0
    hits = etaoin_hits(low) if odd <= 0.30 and len(bare) > 40 else None
    return odd > 0.30 or hits is not None and hits < 2, any(len(t) >= 16 and entropy(t) > 4.8 for t in tokens)


def toxicity(bare: str, low: str, seen: set[str]) -> tuple[bool, bool, bool, bool]:
    """(is_toxic, tier1, tier2, tier3)."""
    a, b = sum(p in seen for p in lex.TOXIC_COERCION), sum(p in seen for p in lex.TOXIC_IDENTITY)
    hostile = any(p in seen for p in lex.TOXIC_HOSTILE)
    if not (a or b or hostile) or _found(_toxic_code, _code_marks, bare, low.strip(WHITE)):
        return False, False, False, False
    c = sum(1 for _ in _hostile.finditer(low)) if hostile else 0
    return 20 * min(a, 2) + 12 * min(b, 2) + 6 * min(c, 3) >= 15, a > 0, b > 0, c > 0


def emotion(seen: set[str], gate: bool) -> tuple[bool, list[str], int]:
    """(manipulative, types, weighted)."""
    counts = {k: sum(p in seen for p in ps) for k, (ps, _, _) in scanners.EMOTIONS.items()}
    weighted = sum(w for k, (_, w, _) in scanners.EMOTIONS.items() if counts[k]) if gate else 0
    points = weighted if gate else sum(5 * min(n, 2) for n in counts.values())
    return points >= 10, sorted(k for k, n in counts.items() if n), weighted


def payload_types(low: str, octets: int, seen: set[str], gate: bool) -> list[str]:
    some = lambda ps: any(p in seen for p in ps)
    role = some(lex.ROLE_PHRASES)
    if gate and (role or some(lex.EXFILTRATION_PHRASES) or some(lex.JAILBREAK_PHRASES)):
        return ["attack"]
    stands = sum(w in seen and (f" {w} " in low or low.startswith(f"{w} ") or low.endswith(f" {w}")) for w in lex.DEV_WORDS)
    fits = {
        "dumb-bot": not gate and not role and octets < 300 and sum(w in seen for w in lex.BOT_WORDS) >= 2,
        "spam": not gate and some(_LINKS) and some(lex.SPAM_WORDS) and not some(lex.MODEL_TERMS),
        "documentation": sum(w in seen for w in lex.DOC_WORDS) >= 2 or some(lex.DOC_MARKUP),
        "developer": stands >= 2 or some(lex.DEV_COMMANDS),
    }
    return [k for k, fit in fits.items() if fit] or ["unknown"]


def _capital(token: str) -> bool:
    letters = [c for c in token if c.isalpha()]
    return len(letters) >= 2 and all(unicodedata.category(c) == "Lu" for c in letters)


def shouts(text: str, tokens: Iterable[str]) -> bool:
    """Whether debias.all_caps_run() is 3 or more."""
    if not _capitals.search(text):
        return False
    run = 0
    for t in tokens:
        run = run + 1 if (t.isupper() or not t.isascii()) and _capital(t) else 0
        if run == 3:
            return True
    return False


def context_score(text: str, low: str, octets: int, tokens: list[str], own: list[str], seen: set[str]) -> int:
    """As debias.context_score(); ``own`` are the words()."""
    some = lambda ps: any(p in seen for p in ps)
    mean = sum(len(w) if w.isascii() else len(w.encode()) for w in own) / len(own) if own else 0
    longest = (len(t) if t.isascii() else len(t.lower().encode()) for t in tokens)
    total = (
        15 * (octets > 300)
        + 10 * (octets > 100)
        + 10 * (low.count(". ") + low.count(".\n") + low.count("! ") + low.count("? ") >= 3)
        + 10 * any(p in low for p in debias.OPENERS)
        + 10 * (sum(p in seen for p in debias.CONNECTORS) >= 2)
        + 10 * some(debias.DOC_HINTS)
        + 10 * some(debias.DEV_HINTS)
        + 5 * some(debias.POLITE)
        + 5 * low.rstrip(WHITE).endswith((".", "!", "?"))
        + 5 * (4.0 <= mean <= 8.0)
        - 15 * shouts(text, tokens)
        - 10 * bool(_marks.search(text))
        - 10 * any(n > 40 for n in longest)
    )
    return max(0, min(100, total))


def context(text: str) -> int:
    """The context score of a text by itself."""
    low = text.lower()
    return context_score(text, low, len(low.encode("utf-8", "surrogatepass")), split(text), words(low), _standing(low))


def read(text: str) -> tuple:
    """The values of READING of a text."""
    low = text.lower()
    bare, octets, seen, tokens = text.strip(WHITE), len(low.encode("utf-8", "surrogatepass")), _standing(low), split(text)
    own = words(low)
    gate = keyword_gate(text, low)
    attack = sum(p in seen for p in lex.ATTACK_PHRASES) if gate else 0
    return (
        gate,
        *secrets(text, low, tokens),
        *gibberish(bare, low, tokens, own),
        *toxicity(bare, low, seen),
        *emotion(seen, gate),
        20 if attack >= 2 else 10 * attack,
        payload_types(low, octets, seen, gate),
        context_score(text, low, octets, tokens, own, seen),
    )


#: read() of an empty text.
NOTHING = read("")
