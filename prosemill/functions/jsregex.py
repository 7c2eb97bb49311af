"""ECMAScript patterns (flag u) rewritten so that Java and Python match the same text.

White space, digits, word boundaries, the dot and the end of the text mean other things in these three; each is
written out as an explicit class or look-around.
"""

from __future__ import annotations

from functools import lru_cache

WS = "\\t\\n\\u000B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
_WORD = "A-Za-z0-9_"
_BOUNDARY = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"


def translate(pattern: str, python: bool = False, multiline: bool = False) -> str:
    """pattern for Java, or for Python's regex module."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            d = pattern[i + 1]
            i += 2
            if d == "s":
                out.append(WS if inside else f"[{WS}]")
            elif d == "S":
                if inside:
                    raise ValueError("\\S inside a class can't be translated")
                out.append(f"[^{WS}]")
            elif d == "d":
                out.append("0-9" if inside else "[0-9]")
            elif d == "b" and not inside:
                out.append(_BOUNDARY)
            elif d == "w":
                out.append(_WORD if inside else f"[{_WORD}]")
            else:
                out.append("\\" + d)
            continue
        if inside:
            if c == "]":
                inside = False
                out.append(c)
            else:
                out.append("\\" + c if c in "[&~|" else c)
        elif c == "[":
            inside = True
            if pattern[i : i + 2] == "[^":
                out.append("[^")
                i += 1
            else:
                out.append(c)
        elif c == ".":
            out.append("[^\\n\\r\\u2028\\u2029]")
        elif c == "$":
            out.append("(?=[\\n\\r]|\\Z)" if multiline and python else "(?=[\\n\\r]|\\z)" if multiline else "\\Z" if python else "\\z")
        elif c == "^" and multiline:
            out.append("(?:(?<=[\\n\\r])|\\A)")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def java(pattern: str, multiline: bool = False) -> str:
    return translate(pattern, multiline=multiline)


def python(pattern: str, multiline: bool = False):
    import regex

    return regex.compile(translate(pattern, True, multiline), regex.V0)


def escape(text: str) -> str:
    return "".join("\\" + c if c in ".*+?^${}()|[]\\" else c for c in text)


def strings(values) -> list[str]:
    """The non-empty strings of an option; anything else counts as none."""
    return [v for v in values if isinstance(v, str) and v] if isinstance(values, (list, tuple)) else []


def begins(chars) -> str:
    """A look-ahead for the range of the characters that a match can begin with, so that a text of another script is passed over at one test a place. Nothing beyond the BMP."""
    if any(c > "\uffff" for c in chars):
        return ""
    sides = [sorted(c for c in chars if (c < "\x80") is low) for low in (True, False)]
    return "(?=[" + "".join(f"\\u{ord(x[0]):04x}-\\u{ord(x[-1]):04x}" for x in sides if x) + "])"


def heads(pattern: str) -> set[str] | None:
    """The characters that matches of a pattern begin with, None where that isn't plain to see."""
    branches, depth, inside, i, start, group = [], 0, False, 0, 0, None
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0 and group is None:
                group = i
        elif c == "|" and depth == 0:
            branches.append((pattern[start:i], group and group - start))
            start, group = i + 1, None
        i += 1
    out: set[str] = set()
    for b, close in [*branches, (pattern[start:], group and group - start)]:
        if b.startswith("(?:") and close and b[close + 1 : close + 2] not in ("?", "*", "{"):
            own = heads(b[3:close])
        else:
            own = {b[0]} if b and b[0] not in ".*+?^${}()|[]\\" and b[1:2] not in ("?", "*", "{") else None
        if own is None:
            return None
        out |= own
    return out


def any_literal(values) -> str | None:
    """An alternation of literals, None if there are none."""
    return _literals(tuple(strings(values)))


@lru_cache(maxsize=1024)
def _literals(words: tuple[str, ...]) -> str | None:
    p = "|".join(map(escape, words))
    return f"{begins({w[0] for w in words})}(?:{p})" if len(words) > 1 else p or None


def any_pattern(values) -> str | None:
    return _gated("|".join(strings(values)))


@lru_cache(maxsize=1024)
def _gated(p: str) -> str | None:
    first = heads(p) if p else None
    return f"{begins(first)}(?:{p})" if first else p or None
