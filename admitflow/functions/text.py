"""Text normalising and character-set stripping, as built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: handles, anything but letters, digits, space and tab, links,
# a leading "rt", and "http" with the character after it.
NOISE_PATTERN = r"(@[A-Za-z0-9]+)|([^0-9A-Za-z \t])|(\w+:\/\/\S+)|^rt|http.+?"

# The same deletions, and those of digits, for a text without "://": no link can
# match there, so no word has to be searched for one at each of its letters. The
# ranges are all characters but letters, space, tab and "@".
PLAIN_PATTERN = r"@[A-Za-z0-9]*|[\x00-\x08\x0A-\x1F!-?\[-`{-\x{10FFFF}]+|^rt|http.+?"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """Lower-case, then delete noise, then delete digits.

    ``(?U)``: Unicode word characters; ``(?d)``: only \\n ends a line.
    """
    lowered = F.lower(_col(c))
    linked = F.regexp_replace(F.regexp_replace(lowered, "(?Ud)" + NOISE_PATTERN, ""), "[0-9]+", "")
    return F.when(lowered.contains("://"), linked).otherwise(F.regexp_replace(lowered, "(?d)" + PLAIN_PATTERN, ""))


def strip_charsets(c, steps: Sequence[tuple[str, str]]) -> Column:
    """Apply ``("left"|"right", characters)`` steps; each strips any run of those characters."""
    out = _col(c)
    for side, characters in steps:
        trim = F.ltrim if side == "left" else F.rtrim
        out = trim(out, F.lit(characters))
    return out


def measurement_text(c, steps: Sequence[tuple[str, str]]) -> Column:
    """Strip wording around a measurement and use a decimal point."""
    return F.replace(strip_charsets(c, steps), F.lit(","), F.lit("."))
