"""Boldness of characters."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

BOLD_SHARE = 0.8
BOLD_WEIGHT, REAL_WEIGHT = 700, 100
BOLD_NAMES = ("bold", "black", "heavy")


@lru_cache(4096)
def _bold(weight: int | None, font: str) -> bool:
    if weight is not None and weight >= REAL_WEIGHT:
        return weight >= BOLD_WEIGHT
    name = font.lower()
    return any(x in name for x in BOLD_NAMES)


def char_is_bold(c) -> bool:
    """By the weight if it is plausible, else by the font's name."""
    return _bold(c.weight, c.font)


def bold_share(chars) -> float:
    """Share of bold characters, 0 for none; counted by weight and font, of which there are few."""
    return bold_share_of(Counter([(c.size, c.weight, c.font) for c in chars]))


def bold_share_of(styles: Counter) -> float:
    """The same of characters counted by size, weight and font."""
    total = sum(styles.values())
    return sum(n for (_, weight, font), n in styles.items() if _bold(weight, font)) / total if total else 0.0


def is_bold(chars) -> bool:
    return bold_share(chars) >= BOLD_SHARE
