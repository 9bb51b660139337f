"""Text predicates as Python expressions; :mod:`quire.functions.text` has the same as columns."""

from __future__ import annotations

import re

LIST_ITEM = re.compile(r"\s*(?:[-*•]\s|[0-9]+[.)]\s)")
CAPTION = re.compile(r"\s*(?i:figure|table|fig\.)\s*[0-9]")
LEVELS = re.compile(r"\s*[0-9]+(?:\.[0-9]+)*[\s:]")
ROMAN = re.compile(r"\s*[IVXLCDM]{1,6}\.\s")
CHAPTER = re.compile(r"\s*(?i:chapter|section|part|appendix)\s*(?:[0-9]|[A-Z](?:\Z|[:. \t]))")
FOOTNOTE = re.compile(r"\s*(?:[†‡§¶]|\*(?:\Z|\S)|[\u2070-\u2079]|[0-9]{1,3}(?:[.)]\s|\s))")
MATH = re.compile(r"[0-9=+\-*/^()\[\]{}\u0370-\u03ff\u2200-\u22ff]")
MATH_SHARE = 0.15
_DIGITS, _AGAIN = re.compile("[0-9]+"), re.compile("(?<=\x01 )\x01")


def is_list_item(t: str) -> bool:
    return LIST_ITEM.match(t) is not None


def is_caption(t: str) -> bool:
    return CAPTION.match(t) is not None


def has_heading_number(t: str) -> bool:
    return any(p.match(t) for p in (LEVELS, ROMAN, CHAPTER))


def has_footnote_mark(t: str) -> bool:
    return FOOTNOTE.match(t) is not None


def is_mathematical(t: str) -> bool:
    solid = [c for c in t if not c.isspace()]
    return bool(solid) and sum(MATH.match(c) is not None for c in solid) / len(solid) >= MATH_SHARE


def ends_in(t: str, marks: str) -> bool:
    t = t.rstrip()
    return bool(t) and t[-1] in marks


def running_text(t: str) -> str:
    """Page-independent form of a running head: spaces, ASCII case and numbers evened out.

    A run of digits is one ``#``; digits that follow on over a space add nothing.
    """
    t = " ".join(t.replace("\x01", "").split())
    t = _DIGITS.sub("\x01", t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))  # bytes know ASCII case only
    return _AGAIN.sub("", t).replace("\x01", "#")


def join_hyphenated(a: str, b: str) -> str:
    """Two lines as one; a hyphen behind a letter goes, else a space comes between."""
    a, b = a.rstrip(), b.lstrip()
    if a[-1:] in ("-", "\u2010") and a[-2:-1].isalpha():
        return a[:-1] + b
    return f"{a} {b}"
