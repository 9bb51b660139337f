"""Text predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, of which Java's ``\s`` and SQL's know the ASCII part only.
SPACE = r"[\s\x{85}\p{Z}]"
#: The white space of DuckDB's expressions, whose ``\s`` lacks the vertical tab.
SQL_SPACE = r"[\t\n\f\r\x{85}\p{Z}]"
LIST_ITEM = rf"^{SPACE}*([-*•]{SPACE}|[0-9]+[.)]{SPACE})"
CAPTION = rf"^{SPACE}*(?i:figure|table|fig\.){SPACE}*[0-9]"
LEVELS = rf"^{SPACE}*[0-9]+(\.[0-9]+)*({SPACE}|:)"
ROMAN = rf"^{SPACE}*[IVXLCDM]{{1,6}}\.{SPACE}"
CHAPTER = rf"^{SPACE}*(?i:chapter|section|part|appendix){SPACE}*([0-9]|[A-Z](\z|[:. \t]))"
FOOTNOTE = rf"^{SPACE}*([†‡§¶]|\*(\z|[^\s\x{{85}}\p{{Z}}])|[⁰-⁹]|[0-9]{{1,3}}([.)]{SPACE}|{SPACE}))"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MATH = r"[0-9=+\-*/^()\[\]{}\x{0370}-\x{03FF}\x{2200}-\x{22FF}]"


def trim_end(t: Column) -> Column:
    return F.regexp_replace(t, SPACE + r"+\z", "")


def trim_start(t: Column) -> Column:
    return F.regexp_replace(t, rf"^{SPACE}+", "")


def is_list_item(t: Column) -> Column:
    return t.rlike(LIST_ITEM)


def is_caption(t: Column) -> Column:
    return t.rlike(CAPTION)


def has_heading_number(t: Column) -> Column:
    return t.rlike(LEVELS) | t.rlike(ROMAN) | t.rlike(CHAPTER)


def has_footnote_mark(t: Column) -> Column:
    return t.rlike(FOOTNOTE)


def math_density(t: Column) -> Column:
    """Share of mathematical among visible characters; 0 without any."""
    solid = F.regexp_replace(t, SPACE, "")
    return F.when(F.length(solid) == 0, F.lit(0.0)).otherwise((F.length(solid) - F.length(F.regexp_replace(solid, MATH, ""))) / F.length(solid))


def ends_in(t: Column, marks: str) -> Column:
    return t.rlike(rf"[{marks}]{SPACE}*\z")


def starts_lower(t: Column) -> Column:
    return t.rlike(rf"^{SPACE}*\p{{Ll}}")


def _evened(t: Column, space: str) -> Column:
    x = F.translate(F.trim(F.regexp_replace(F.replace(t, F.lit("\x01"), F.lit("")), space + "+", " ")), _CAPITALS, _SMALL)
    return F.regexp_replace(x, "[0-9]+", "\x01")


def running_text(t: Column) -> Column:
    """Spaces, case and numbers evened out; see :func:`quire.operators.phrases.running_text`."""
    return F.regexp_replace(F.regexp_replace(_evened(t, SPACE), "(?<=\x01 )\x01", ""), "\x01", "#")


def running_key(t: Column) -> Column:
    """The same as SQL has it: digits that follow on take the space before them along, and a vertical tab is no space."""
    return F.regexp_replace(F.regexp_replace(_evened(t, SQL_SPACE), "\x01( \x01)+", "\x01"), "\x01", "#")


def join_hyphenated(a: Column, b: Column) -> Column:
    a, b = trim_end(a), trim_start(b)
    return F.when(a.rlike(r"\p{L}[-‐]$"), F.concat(F.regexp_replace(a, r"[-‐]$", ""), b)).otherwise(F.concat(a, F.lit(" "), b))


def is_bold_font(name: Column) -> Column:
    return F.lower(name).rlike("bold|black|heavy")


def is_bold(weight: Column, name: Column) -> Column:
    return F.when(F.coalesce(weight, F.lit(0)) >= 100, weight >= 700).otherwise(F.coalesce(is_bold_font(name), F.lit(False)))


def strip_bullet(t: Column) -> Column:
    return F.regexp_replace(t, rf"^{SPACE}*(?:[-*•] )?", "")


def footnote_id(t: Column) -> Column:
    first = F.split(trim_start(t), SPACE)[0]
    return F.when(F.octet_length(first) <= 3, first).otherwise(t)


def cell(t: Column) -> Column:
    """Text as a cell of a Markdown table."""
    return F.replace(F.replace(t, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def upper_median(values: Column) -> Column:
    """The middle of an array, of two values the larger; null for none."""
    v = F.array_sort(values)
    return F.when(F.size(v) > 0, F.element_at(v, (F.size(v) / 2).cast("int") + 1))


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)
