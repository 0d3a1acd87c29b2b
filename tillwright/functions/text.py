"""Text rules as SQL: trimming, place names, prefix flags."""

from __future__ import annotations

from tillwright.fixed_values import STATE_ALIASES, UNKNOWN_PLACE

# Everything Unicode counts as white space plus the four ASCII separators, as ``str.strip`` does.
WHITESPACE = "".join(f"\\u{ord(c):04x}" for c in map(chr, range(0x3001)) if c.isspace())


def strip(column: str) -> str:
    return f"btrim({column}, '{WHITESPACE}')"


def place(column: str) -> str:
    """Upper-cased, trimmed place name; missing and blank become UNKNOWN."""
    return f"coalesce(nullif(upper({strip(column)}), ''), '{UNKNOWN_PLACE}')"


def state(column: str) -> str:
    """``place`` with known spellings folded; only whole values are replaced."""
    words = ", ".join(f"'{word}'" for pair in STATE_ALIASES.items() for word in pair)
    return f"coalesce(try_element_at(map({words}), {place(column)}), {place(column)})"


def has_prefix(column: str, prefix: str) -> str:
    return f"coalesce(CAST(startswith({column}, '{prefix}') AS INT), 0)"
