"""Normalization of untrusted text, HTML buckets and hidden-content signals, decoded variants.

What has no built-in (an HTML tree, NFKC, nested decoding) runs in one Arrow UDF, ``prepare``; the rest is columns.
"""

from __future__ import annotations

import base64
import binascii
import html
import re
import string
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.batches import CHUNK_CHARS, chunks
from ..functions.dialect import to_java, to_python
from ..functions.lexicon import LOOKALIKES
from ..functions.rules import RULES, Rule
from ..functions.text import matches, trimmed
from .matching import clauses, starts

# Expressions, characters and limits of the normal form.
CLOSING_TAG = r"(?is)</\s*[a-z][a-z0-9:-]*\s*>"
KNOWN_TAG = r"(?is)<\s*(?:!doctype|html|head|body|meta|title|div|span|p|a|img|section|article|main|header|footer|nav|aside|h[1-6]|ul|ol|li|table|thead|tbody|tr|th|td|form|input|button|label|textarea|select|option|code|pre|blockquote|strong|em|br|hr)\b"
HIDDEN_STYLES = [
    r"display:none", r"visibility:hidden",
    r"opacity:0(?:\.0+)?(?:;|!important|$)",
    r"filter:opacity\(0(?:\s*\)|\s*!important)",
    r"font-size:0(?:px|em|pt|rem|%)?(?:;|!important|$)",
    r"transform:scale\(0(?:\s*\)|\s*!important)",
    r"clip-path:(?:inset\((?:9[5-9]%|100%|100v[hw]|(?:100|[1-9]\d{2,})\s*px)\)|polygon\(0(?:\s+)?0\)|circle\(0\))",
    r"transform:translatex\(-|transform:translate\(-",
]
OFFSCREEN, OFFSCREEN_SIDES = r"position:(?:absolute|fixed)", r"(?:left|right|top|bottom|text-indent):-"
STYLE_COLOR, STYLE_BACKGROUND = r"(?:^|;)color:([^;]+)", r"(?:^|;)(?:background|background-color):([^;]+)"
COLOR_NAMES = "black white red blue green yellow orange purple pink brown grey gray cyan magenta lime navy maroon olive teal silver gold".split()
COLOR_FORM = r"^(?:#(?:[0-9a-f]{3}|[0-9a-f]{6})|rgb\(\d{1,3},\d{1,3},\d{1,3}\)|hsl\(\d+,\d+%?,\d+%?\)|" + "|".join(COLOR_NAMES) + r")$"
INSTRUCTION = r"\b(?:ignore\s+(?:all\s+)?(?:previous|prior)\s+instructions?|disregard\s+(?:all\s+)?(?:(?:previous|prior)\s+)?instructions?|override\s+(?:system|assistant)\s+(?:instructions?|prompt)|bypass\s+security(?:\s+controls?)?|reveal\s+(?:the\s+)?(?:system\s+prompt|secrets?)|jailbreak\s+(?:the\s+)?system|exfiltrat(?:e|ion)\s+(?:data|secrets?)|dump\s+secrets?)\b"
ZERO_WIDTH = "​‌‍﻿­⁠"
INVISIBLE = "​‌‍‎‏﻿⁠⁡⁢⁣⁤᠎­͏؜ᅟᅠ឴឵ﾠ⠀"
SPLIT_WORDS = "ignore disregard forget override bypass circumvent jailbreak exfiltrate developer instructions".split()
SEPARATORS = "-_.|+="
HTML_PREFIX, ATTRIBUTE_BYTES, SUBSTANTIAL = 512, 512, 20
DECODE_DEPTH, DECODE_VARIANTS = 3, 50
#: A run of characters that may be an encoded payload within a text (the reference's shape, and its URL-safe form).
ENCODED_TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"

IGNORED_TAGS = frozenset({"script", "style", "noscript", "template"})
TEXT_ATTRIBUTES = frozenset({"aria-label", "alt", "title", "placeholder"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of a key closes an open element of its values.
IMPLIED_END = {t: ("p",) for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()} | {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: The normal form (null where it is the text itself), the numbers of the rules found in it or its decodings, signals.
PREPARED = "struct<analysis:string,rules:array<int>,hidden:boolean,attribute:boolean,zero_width:boolean,aria_hidden:boolean,collapsed:boolean>"


# --- columns


def clamped(text: Column, limit: int | None) -> Column:
    """At most ``limit`` characters: three quarters of them from the start and the rest from the end."""
    if not limit or limit <= 0:
        return text
    head = limit * 3 // 4
    tail = limit - head - 1
    short = F.left(text, F.lit(limit))
    cut = short if limit <= 16 or tail <= 0 else F.concat(F.left(text, F.lit(head)), F.lit("\n"), F.right(text, F.lit(tail)))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def looks_like_html(text: Column) -> Column:
    bare = trimmed(text)
    return (F.octet_length(bare) >= 3) & bare.contains("<") & bare.contains(">") & (bare.contains("<!--") | matches(bare, CLOSING_TAG) | matches(bare, KNOWN_TAG))


def style_hidden(style: Column) -> Column:
    """Whether an inline style hides its element."""
    compact = F.lower(F.regexp_replace(style, r"[\s\x85\p{Z}]", ""))
    color = lambda r: F.regexp_extract(compact, to_java(r, False), 1)
    plain = lambda c: F.regexp_replace(c, "%", "")
    camouflage = color(STYLE_COLOR).rlike(to_java(COLOR_FORM, False)) & (plain(color(STYLE_COLOR)) == plain(color(STYLE_BACKGROUND)))
    hit = camouflage | (matches(compact, OFFSCREEN) & matches(compact, OFFSCREEN_SIDES))
    for r in HIDDEN_STYLES:
        hit = hit | matches(compact, r)
    return hit


def zero_width_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, ZERO_WIDTH, ""))


def rotated(text: Column, n: int) -> Column:
    """Letters moved on by ``n`` places."""
    lower, upper = string.ascii_lowercase, string.ascii_uppercase
    return F.translate(text, lower + upper, lower[n:] + lower[:n] + upper[n:] + upper[:n])


# --- one UDF

_closing, _known = re.compile(to_python(CLOSING_TAG[5:]), re.I | re.S), re.compile(to_python(KNOWN_TAG[5:]), re.I | re.S)
_instruction = re.compile(to_python(INSTRUCTION), re.I)
_styles = [re.compile(to_python(r)) for r in HIDDEN_STYLES]
_offscreen, _sides = re.compile(OFFSCREEN), re.compile(OFFSCREEN_SIDES)
_color, _background, _form = re.compile(STYLE_COLOR), re.compile(STYLE_BACKGROUND), re.compile(COLOR_FORM)
_split = [(re.compile(to_python(r"\b") + "[\\W_]*?".join(w) + to_python(r"\b"), re.I), w) for w in SPLIT_WORDS]
_joint = re.compile(r"[^\s\w]|[_  -     　 ]")
_no_zero = dict.fromkeys(map(ord, ZERO_WIDTH))


def is_html(text: str) -> bool:
    bare = text.strip()
    return len(bare.encode()) >= 3 and "<" in bare and ">" in bare and ("<!--" in bare or bool(_closing.search(bare)) or bool(_known.search(bare)))


def is_style_hidden(style: str) -> bool:
    compact = "".join(style.lower().split())
    if any(r.search(compact) for r in _styles) or _offscreen.search(compact) and _sides.search(compact):
        return True
    fore, back = _color.search(compact), _background.search(compact)
    return bool(fore and back and _form.match(fore[1]) and fore[1].replace("%", "") == back[1].replace("%", ""))


class _Buckets(HTMLParser):
    """Visible text, hidden text, comments and attribute texts of a page, in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.visible: list[str] = []
        self.hidden: list[str] = []
        self.comments: list[str] = []
        self.attrs: list[str] = []
        self.zero = self.aria = self.collapsed = False
        self.stack: list[dict] = []

    def _leave(self):
        top = self.stack.pop()
        if self.stack:
            self.stack[-1]["size"] += 0 if top["ignored"] else top["size"]
        if top["size"] > SUBSTANTIAL and not top["ignored"]:
            self.aria |= top["aria"]
            if top["details"]:
                self.collapsed = True
                if not top["hidden"]:  # what the details hold was taken for visible
                    held = self.visible[top["at"] :]
                    del self.visible[top["at"] :]
                    self.hidden[top["hidden_at"] : top["hidden_at"]] = held

    def handle_starttag(self, tag, attrs):
        while self.stack and self.stack[-1]["tag"] in IMPLIED_END.get(tag, ()):
            self._leave()
        up = self.stack[-1] if self.stack else {"ignored": False, "hidden": False}
        ignored, hidden, aria = up["ignored"] or tag in IGNORED_TAGS, up["hidden"], False
        if not ignored:
            for name, value in attrs:
                value = value or ""
                low = value.strip().lower()
                aria |= name == "aria-hidden" and low == "true"
                hidden |= name == "hidden" or name == "aria-hidden" and low == "true" or name == "style" and is_style_hidden(low)
                self.zero |= sum(c in ZERO_WIDTH for c in value) >= 3
                text = " ".join(value.split())
                if text and len(text.encode()) <= ATTRIBUTE_BYTES and (name in TEXT_ATTRIBUTES or tag == "meta" and name == "content"):
                    self.attrs.append(text)
        if tag not in VOID:
            self.stack.append({"tag": tag, "ignored": ignored, "hidden": hidden, "aria": aria, "details": tag == "details" and all(n != "open" for n, _ in attrs), "size": 0, "at": len(self.visible), "hidden_at": len(self.hidden)})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if any(e["tag"] == tag for e in self.stack):
            while self.stack[-1]["tag"] != tag:
                self._leave()
            self._leave()

    def handle_data(self, data):
        up = self.stack[-1] if self.stack else {"ignored": False, "hidden": False}
        if up["ignored"]:
            return
        self.zero |= sum(c in ZERO_WIDTH for c in data) >= 3
        text = " ".join(data.split())
        if text:
            (self.hidden if up["hidden"] else self.visible).append(text)
            if self.stack:
                self.stack[-1]["size"] += len(text)

    def handle_comment(self, data):
        text = " ".join(data.split())
        if text and not (self.stack and self.stack[-1]["ignored"]):
            self.comments.append(text)


def html_buckets(page: str) -> _Buckets:
    out = _Buckets()
    out.feed(page)
    out.close()
    while out.stack:
        out._leave()
    return out


def _glued(chars: str, k: int) -> bool:
    """Whether the separator at k only splits a word: a run of them between letters, or one between single letters."""
    a = b = k
    while a > 0 and _separates(chars[a - 1]):
        a -= 1
    while b + 1 < len(chars) and _separates(chars[b + 1]):
        b += 1
    if a == 0 or b + 1 == len(chars) or not chars[a - 1].isalpha() or not chars[b + 1].isalpha():
        return False
    if b > a:
        return True
    return chars[a] != "." and not (a > 1 and chars[a - 2].isalpha()) and not (b + 2 < len(chars) and chars[b + 2].isalpha())


def _separates(c: str) -> bool:
    return c in SEPARATORS or unicodedata.category(c) == "Pd"


def _plain(c: str) -> str:
    """Nothing for an invisible character, ASCII for a full-width one or a look-alike."""
    if c in INVISIBLE or unicodedata.category(c) == "Cf":
        return ""
    return (chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c).translate(LOOKALIKES)


_NO_ALNUM = bytes(set(range(128)) - set(b"abcdefghijklmnopqrstuvwxyz0123456789"))


def _folded(text: str) -> str:
    """Lower case as the rules fold it."""
    return text.lower().replace("ſ", "s")


def _joined(m: re.Match, word: str) -> str:
    between = [c for c in m[0] if c.lower() not in "abcdefghijklmnopqrstuvwxyz"]
    return word if all(_joint.match(c) for c in between) else m[0]


def normal_form(source: str) -> str:
    stage = unicodedata.normalize("NFKC", html.unescape(source))
    used = set(stage)
    between = [c for c in used if _separates(c)]
    if between:  # judged on the text as it stands, before anything is removed
        runs = re.finditer("[" + "".join(map(re.escape, between)) + "]+", stage)
        glued = [m.span() for m in runs if _glued(stage, m.start())]
        for a, b in reversed(glued):
            stage = stage[:a] + " " * (b - a) + stage[b:]
    if not stage.isascii():
        stage = stage.translate({ord(c): _plain(c) for c in used if not c.isascii()})
    stage = " ".join(stage.split())
    letters = _folded(stage).encode("ascii", "ignore").translate(None, _NO_ALNUM)
    for pattern, word in _split:
        if word.encode() in letters:
            stage = pattern.sub(lambda m, w=word: _joined(m, w), stage)
    return stage


def normalized(text: str) -> tuple[str, dict[str, bool]]:
    """(normal form, signals)."""
    signals = dict.fromkeys(("hidden", "attribute", "zero_width", "aria_hidden", "collapsed"), False)
    source = text
    if is_html(text):
        b = html_buckets(text)
        whole = "\n".join([*b.visible, *b.hidden, *b.comments, *b.attrs]).strip()
        if whole:
            source = f"{whole} {text[:HTML_PREFIX]}"
            clean = lambda parts: "\n".join(parts).translate(_no_zero)
            signals = {"hidden": bool(_instruction.search(clean(b.hidden))), "attribute": bool(_instruction.search(clean(b.attrs))), "zero_width": b.zero, "aria_hidden": b.aria, "collapsed": b.collapsed}
    return normal_form(source), signals


def _plausible(text: str) -> bool:
    size = len(text.encode("utf-8", "surrogatepass"))
    return bool(text) and len(text) / size >= 0.6 and bool(re.search(r"[A-Za-z][^A-Za-z]", text))


def _b64(text: str) -> str:
    if " " in text:
        return ""
    size = len(text.encode())
    try:
        raw = base64.b64decode((text + {2: "==", 3: "="}.get(size % 4, "")).replace("\r", "").replace("\n", ""), validate=True)
    except (binascii.Error, ValueError):
        return ""
    out = raw.decode("utf-8", "replace")
    return out if _plausible(out) else ""


def _hex(text: str) -> str:
    if len(text) % 2 or not re.fullmatch("[0-9A-Fa-f]+", text):
        return ""
    out = bytes.fromhex(text).decode("utf-8", "replace")
    return out if _plausible(out) else ""


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#34;", '"'), ("&#38;", "&"), ("&#60;", "<"), ("&#62;", ">"))


def _entities(text: str) -> str:
    if "&" not in text:
        return ""
    out = text
    for name, c in _ENTITIES:
        out = out.replace(name, c)
    out = re.sub("&#x([0-9A-Fa-f]+);", lambda m: chr(int(m[1], 16) & 0xFF) if int(m[1], 16) else m[0], out)
    return out if out != text and _plausible(out) else ""


def _percent(text: str) -> str:
    """%XX to bytes; every byte becomes one character, those of non-ASCII text too."""
    if "%" not in text and text.isascii():
        return ""
    raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]) if int(m[1], 16) else m[0], text.encode())
    out = raw.decode("latin-1")
    return out if out != text and _plausible(out) else ""


_ROTATIONS = [bytes.maketrans(string.ascii_letters.encode(), (string.ascii_lowercase[n:] + string.ascii_lowercase[:n] + string.ascii_uppercase[n:] + string.ascii_uppercase[:n]).encode()) for n in range(26)]
_letter = re.compile("[A-Za-z]")
#: Non-ASCII characters that fold to ASCII letters.
_folds = re.compile("[" + "".join(c for c in map(chr, range(128, 0x3000)) if re.search("[a-z]", _folded(c))) + "]")
_INVISIBLE_MARKS = dict.fromkeys(map(ord, "​‌‍﻿‮‏"))
_marked = re.compile("[" + "".join(map(chr, _INVISIBLE_MARKS)) + "]")


def _rotated(text: str, n: int) -> str:
    return text.encode("utf-8", "surrogatepass").translate(_ROTATIONS[n]).decode("utf-8", "surrogatepass") if n else text


def _walk(text: str, depth: int, limit: int) -> Iterator[tuple[str, int, str, int]]:
    """Decodings in order of discovery, at most ``limit``: (base, rotation, method, level), each ``base`` rotated by so many places."""
    left = limit
    seen: set[str] = set()

    def visit(now: str, level: int):
        nonlocal left
        if level > depth or not left or len(now.encode("utf-8", "surrogatepass")) < 8 or now in seen:
            return
        seen.add(now)

        def take(found: str, method: str, deeper: bool = True):
            nonlocal left
            if found and found != now:
                if left:
                    left -= 1
                    yield found, 0, method, level
                if deeper:
                    yield from visit(found, level + 1)

        yield from take(_b64(now), "base64")
        yield from take(_b64(now.replace("-", "+").replace("_", "/")), "base64-url")
        yield from take(_hex(now), "hex")
        if _letter.search(now):
            for n in range(13, 26):
                if left:
                    left -= 1
                    yield now, n, f"rot{n}", level
        yield from take(_entities(now), "html-entity")
        yield from take(now.translate(_INVISIBLE_MARKS) if _marked.search(now) else now, "unicode-normalize", False)
        yield from take(_percent(now), "url")

    yield from visit(text, 0)


def decoded(text: str, depth: int = DECODE_DEPTH, limit: int = DECODE_VARIANTS) -> list[tuple[str, str, int]]:
    """(decoded, method, level) in order of discovery, at most ``limit``."""
    return [(_rotated(base, n), method, level) for base, n, method, level in _walk(text, depth, limit)]


def variants(text: str, depth: int = DECODE_DEPTH, limit: int = DECODE_VARIANTS) -> list[str]:
    """The text and its decodings, each once."""
    return list(dict.fromkeys([text, *(d for d, _, _ in decoded(text, depth, limit))]))


class Finder:
    """Finds the rules of a text and its decodings.

    The strings of each rule's most telling clause are looked up as they stand and as each rotation would have to hide
    them, all in one pass over a text, so a rotation is only written out where a rule may be found in it.  The other
    clauses and the regex then decide.
    """

    def __init__(self, rules: Sequence[Rule] = tuple(RULES)):
        self.rules = [(clauses(r.regex), re.compile(to_python(r.regex), re.IGNORECASE)) for r in rules]
        self.starts = [starts(r.regex) for r in rules]
        owners: dict[str, set[tuple[int, int]]] = {}
        for k, (cs, _) in enumerate(self.rules):
            for s in cs[0]:
                for n in (0, *range(13, 26)):
                    owners.setdefault(_rotated(s, 26 - n) if n else s, set()).add((n, k))
        self.owners = {s: frozenset(ks) for s, ks in owners.items()}
        self.automaton = None
        try:
            import ahocorasick
        except ImportError:
            return
        self.automaton = ahocorasick.Automaton()
        for s in self.owners:
            self.automaton.add_word(s, s)
        self.automaton.make_automaton()

    def _standing(self, folded: str) -> set[str]:
        if self.automaton is not None:
            return {s for _, s in self.automaton.iter(folded)}
        return {s for s in self.owners if s in folded}

    def candidates(self, base: str) -> dict[int, list[int]]:
        """By rotation, the numbers of the rules that may be found in the rotated text."""
        out: dict[int, set[int]] = {}
        for s in self._standing(_folded(base)):
            for n, k in self.owners[s]:
                out.setdefault(n, set()).add(k)
        if not base.isascii() and _folds.search(base):  # these turn into ASCII letters, but only after a rotation
            for n in range(13, 26):
                for s in self._standing(_folded(_rotated(base, n))):
                    out.setdefault(n, set()).update(k for m, k in self.owners[s] if not m)
        return {n: sorted(ks) for n, ks in out.items()}

    def found(self, text: str, depth: int = DECODE_DEPTH, limit: int = DECODE_VARIANTS) -> list[int]:
        """Numbers of the rules found, by variant in order of discovery, then rule; each once."""
        out: dict[int, None] = {}
        known: dict[str, dict[int, list[int]]] = {}
        for base, n, *_ in ((text, 0), *_walk(text, depth, limit)):
            if base not in known:
                known[base] = self.candidates(base)
            may = [k for k in known[base].get(n, ()) if k not in out]
            if may:
                out |= dict.fromkeys(k for k, _ in self._confirmed(_rotated(base, n), may))
        return list(out)

    def _confirmed(self, text: str, may: list[int]) -> Iterator[tuple[int, str]]:
        """Of rules whose first clause holds, those found.  Where a match must begin with certain strings, the regex is only tried
        where these stand."""
        low = _folded(text)
        placed = text.isascii() or len(low) == len(text) and "ı" not in text  # else case folding has moved or hidden starts
        for k in may:
            cs, regex = self.rules[k]
            if placed and self.starts[k]:
                m = self._first(text, low, k)
            else:
                m = regex.search(text) if all(any(s in low for s in c) for c in cs[1:]) else None
            if m:
                yield k, m[0]

    def _first(self, text: str, low: str, k: int) -> re.Match | None:
        """The first match of a rule by its starts."""
        places = []
        for s in self.starts[k]:
            at = low.find(s)
            while at >= 0:
                places.append(at)
                at = low.find(s, at + 1)
        if not places or not all(any(s in low for s in c) for c in self.rules[k][0][1:]):
            return None
        match = self.rules[k][1].match
        return next((m for at in sorted(places) if (m := match(text, at))), None)

    def matched(self, text: str) -> list[tuple[int, str]]:
        """(number, first match) of the rules found in the text as it stands."""
        return list(self._confirmed(text, self.candidates(text).get(0, [])))


@cache
def _finder(rules: tuple[Rule, ...] = tuple(RULES)) -> Finder:
    """One for each worker."""
    return Finder(rules)


def rules_in(rules: list[Rule] = RULES):
    """UDF text -> array of (number of a rule, its first match) of the text as it stands; null and empty texts have none."""

    @F.pandas_udf("array<struct<rule:int,matched:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = _finder(tuple(rules))
        for texts in chunks(batches):
            yield texts.map(lambda t: [{"rule": k, "matched": m} for k, m in finder.matched(t)] if t else [])

    return run


def prepare(mode: str, depth: int = DECODE_DEPTH, limit: int = DECODE_VARIANTS):
    """UDF text -> struct of PREPARED and readings.READING (of the normal form).

    Normalization is skipped in ``fast`` mode.  Null gives the values of an empty text, so callers may pass null where there is
    no work.
    """
    from . import readings

    @F.pandas_udf(f"{PREPARED[:-1]},{readings.READING}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = _finder()
        signals = ("hidden", "attribute", "zero_width", "aria_hidden", "collapsed")
        for texts in chunks(batches):
            rows = []
            for t in texts:
                if not t:
                    rows.append((None, [], False, False, False, False, False, *readings.NOTHING))
                    continue
                form, s = (t, {}) if mode == "fast" else normalized(t)
                rows.append((None if form == t else form, finder.found(form, depth, limit), *(s.get(k, False) for k in signals), *readings.read(form)))
            yield pd.DataFrame(rows, columns=["analysis", "rules", *signals, *readings.NAMES])

    return run


def decoded_variants(depth: int = DECODE_DEPTH, limit: int = DECODE_VARIANTS):
    """UDF text -> array of its decoded variants (decoded, method, level)."""

    @F.pandas_udf("array<struct<decoded:string,method:string,level:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in chunks(batches, max(1, CHUNK_CHARS // limit)):
            yield texts.map(lambda t: None if t is None else [{"decoded": d, "method": m, "level": n} for d, m, n in decoded(t, depth, limit)])

    return run


class _Styles(HTMLParser):
    """Values of all style attributes of a page, in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.found += [value or "" for name, value in attrs if name == "style"]


def styles_of(page: str) -> list[str]:
    out = _Styles()
    out.feed(page)
    out.close()
    return out.found


def styles():
    """UDF page -> array of the values of its style attributes."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in chunks(batches):
            yield pages.map(lambda p: styles_of(p or ""))

    return run


def buckets():
    """UDF page -> struct(visible, hidden, comments, attrs) of an HTML page."""

    @F.pandas_udf("struct<visible:array<string>,hidden:array<string>,comments:array<string>,attrs:array<string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in chunks(batches):
            found = [html_buckets(p or "") for p in pages]
            yield pd.DataFrame({k: [getattr(b, k) for b in found] for k in ("visible", "hidden", "comments", "attrs")})

    return run
