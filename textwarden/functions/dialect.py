"""Rules are written for a linear-time regex dialect with ASCII classes; this translates them for Java.

In that dialect ``\\b \\s \\w \\d`` are ASCII, ``(?i)`` folds Unicode case, ``.`` excludes only newline and ``$`` is the end
of the text.  Java differs in each of these but ``\\w`` and ``\\d``.
"""

from __future__ import annotations

import re

_WORD = "[A-Za-z0-9_]"
#: Flags are off inside, or case folding would take the Kelvin sign for a word character.
_EDGE = f"(?-iu:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_INNER = f"(?-iu:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"
_SPACE = r"\t\n\f\r "


def to_java(regex: str, ignore_case: bool = True) -> str:
    """The same expression for java.util.regex; inline flags at the start are kept."""
    flags = re.match(r"\(\?([ims]+)\)", regex)
    given, body = (flags[1], regex[flags.end() :]) if flags else ("", regex)
    multiline = "m" in given
    out, k, in_class = [], 0, False
    while k < len(body):
        c = body[k]
        if c == "\\" and k + 1 < len(body):
            n = body[k + 1]
            if n == "b" and not in_class:
                out.append(_EDGE)
            elif n == "B" and not in_class:
                out.append(_INNER)
            elif n == "s":
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            elif n == "S" and not in_class:
                out.append(f"[^{_SPACE}]")
            else:
                out.append(c + n)
            k += 2
            continue
        if c == "[" and not in_class:
            in_class = True
            out.append(c)
            k += 1
            if body[k : k + 1] == "^":
                out.append("^")
                k += 1
            if body[k : k + 1] == "]":
                out.append("\\]")
                k += 1
            continue
        if c == "[" and in_class:
            out.append("\\[")
        elif c == "]" and in_class:
            in_class = False
            out.append(c)
        elif c == "&" and in_class:
            out.append("\\&")
        elif c == "$" and not in_class and not multiline:
            out.append("\\z")
        else:
            out.append(c)
        k += 1
    fold = "iu" if ignore_case or "i" in given else ""
    return f"(?{fold}d{'m' if multiline else ''}{'s' if 's' in given else ''})" + "".join(out)


def to_python(regex: str) -> str:
    """The same expression for Python's ``re`` over str, with explicit ASCII classes that no case folding widens."""
    out, k, in_class = [], 0, False
    while k < len(regex):
        c = regex[k]
        if c == "\\" and k + 1 < len(regex):
            n = regex[k + 1]
            plain = {"s": r"\t\n\f\r ", "d": "0-9", "w": "A-Za-z0-9_"}
            if n in plain:
                out.append(plain[n] if in_class else f"(?-i:[{plain[n]}])")
            elif n in "SDW" and not in_class:
                out.append(f"[^{plain[n.lower()]}]")
            elif n == "b" and not in_class:
                out.append(f"(?-i:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))")
            else:
                out.append(c + n)
            k += 2
            continue
        if c == "[" and not in_class:
            in_class = True
            out.append(c)
            k += 1
            if regex[k : k + 1] == "^":
                out.append("^")
                k += 1
            if regex[k : k + 1] == "]":
                out.append("\\]")
                k += 1
            continue
        if c == "[" and in_class:
            out.append("\\[")
        elif c == "]" and in_class:
            in_class = False
            out.append(c)
        elif c == "$" and not in_class:
            out.append(r"\Z")
        else:
            out.append(c)
        k += 1
    return "".join(out)


class DialectError(ValueError):
    pass


def validate(regex: str) -> None:
    """Rejects what the linear-time dialect rejects: look-around, back-references and expressions that don't compile."""
    if re.search(r"(?<!\\)\(\?(?:=|!|<=|<!|>)|(?<!\\)\\[1-9]|(?<!\\)\\k<", regex):
        raise DialectError(f"look-around and back-references are not supported: {regex}")
    try:
        re.compile(to_python(re.sub(r"^\(\?[imsU]+\)", "", regex)))
    except re.error as e:
        raise DialectError(f"{regex}: {e}") from e
