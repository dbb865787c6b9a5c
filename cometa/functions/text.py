"""Text primitives with Python ``str``/``re`` semantics, written as Java regex.

Spark's regex engine is ``java.util.regex``; its ``\\w``, ``\\s``, ``\\d`` and
``\\b`` are ASCII-only, while the audit rules were specified with Python's
Unicode classes. The classes below restate the Unicode meaning explicitly so
every rule stays a plain built-in expression (``rlike``, ``regexp_replace``,
``regexp_count``) inside whole-stage codegen -- no Python UDF on the hot path.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() over the BMP: Unicode White_Space plus the four
# information separators U+001C..U+001F.
WS = r"\p{IsWhite_Space}\x{1C}-\x{1F}"
# Python's Unicode \w: letters, numbers and underscore.
WORD = r"\p{L}\p{N}_"
# Python's Unicode \d.
DIGIT = r"\p{Nd}"


def bounded(pattern: str) -> str:
    """Wrap ``pattern`` in Unicode word boundaries (Python's ``\\b...\\b``).

    Lookarounds are used instead of ``\\b`` because Java's ``\\b`` follows
    ASCII word characters on recent JDKs.
    """
    return f"(?<![{WORD}])(?:{pattern})(?![{WORD}])"


# The same whitespace set spelled out (derived from str.isspace over the BMP)
# for ``btrim``, which trims without a regex.
WS_CHARS = "".join(chr(i) for i in range(0x10000) if chr(i).isspace())


def trim_ws(c: Column) -> Column:
    """``str.strip()``: drop leading/trailing whitespace of every kind.

    Spark's one-argument ``trim`` only removes U+0020, so tabs, newlines and
    no-break spaces would survive it; ``btrim`` with the explicit set does
    the same as ``str.strip()`` without running a regex.
    """
    return F.btrim(c, F.lit(WS_CHARS))


def has_special_char(c: Column) -> Column:
    """Any character that is neither a word character nor whitespace."""
    return c.rlike(f"[^{WORD}{WS}]")


def has_digit(c: Column) -> Column:
    return c.rlike(DIGIT)


def digit_run_count(c: Column) -> Column:
    """Number of maximal digit runs (``len(re.findall(r'\\d+', c))``)."""
    return F.regexp_count(c, F.lit(f"{DIGIT}+"))


def first_digit_run(c: Column) -> Column:
    """First maximal digit run, or '' when there is none."""
    return F.regexp_extract(c, f"({DIGIT}+)", 1)


def _ranges(chars: list[int]) -> str:
    """Code points as ranges of a Java character class."""
    out, start = [], None
    for k, x in enumerate(chars):
        start = x if start is None else start
        if k + 1 == len(chars) or chars[k + 1] != x + 1:
            out.append(rf"\x{{{start:X}}}-\x{{{x:X}}}")
            start = None
    return "".join(out)


# str.isdigit() also holds for digits that are no decimals (superscripts,
# circled digits, ...), unlike \d: the extra ones, by that rule.
DIGIT_LIKE = DIGIT + _ranges([i for i in range(sys.maxunicode + 1) if chr(i).isdigit() and not chr(i).isdecimal()])


def words_with_digit_count(c: Column) -> Column:
    """Number of whitespace-separated words that hold a ``str.isdigit()`` character."""
    return F.regexp_count(c, F.lit(f"[^{WS}]*[{DIGIT_LIKE}][^{WS}]*"))
