"""String functions whose results must equal Python's `str` and `re` behaviour.

Java's regex shorthand classes differ from Python's (`\\s`, `\\d`, `\\b`, `.`), so patterns in this
package spell the classes out. The spelled-out forms mean the same to both engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code point ranges of the characters Python's str.isspace() accepts.
SPACE_RANGES = (
    (0x09, 0x0D),
    (0x1C, 0x20),
    (0x85, 0x85),
    (0xA0, 0xA0),
    (0x1680, 0x1680),
    (0x2000, 0x200A),
    (0x2028, 0x2029),
    (0x202F, 0x202F),
    (0x205F, 0x205F),
    (0x3000, 0x3000),
)
# Code point ranges of the single-character line ends of Python's str.splitlines().
LINE_END_RANGES = ((0x0A, 0x0D), (0x1C, 0x1E), (0x85, 0x85), (0x2028, 0x2029))


def _members(ranges: tuple[tuple[int, int], ...]) -> str:
    return "".join(f"\\u{lo:04x}-\\u{hi:04x}" for lo, hi in ranges)


SPACE_CLASS = _members(SPACE_RANGES)
SPACE_CHARS = "".join(chr(c) for lo, hi in SPACE_RANGES for c in range(lo, hi + 1))
LINE_BREAK = rf"\r\n|[{_members(LINE_END_RANGES)}]"
# The space characters that end no line.
BLANK = r"[\t\x1f \u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]"
# The same set for Java, as a property it looks up in a table instead of range by range.
S = r"[\x1c\x1d\x1e\x1f\p{IsWhite_Space}]"
NOT_S = f"[^{SPACE_CLASS}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once and use it many times inside `body`, also from nested lambdas.

    Catalyst does not share common subexpressions inside lambda functions, and may inline a
    projected column into them. A lambda variable is evaluated exactly once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column behind a generator.

    A filter on a projected column is pushed below the projection with the whole expression copied
    into it, once per use. It cannot pass a generator, so the value is computed once per row.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))


def sub(text: Column, pattern: str, replacement: str) -> Column:
    """`regexp_replace` with literal arguments, so no SQL string unescaping happens."""
    return F.regexp_replace(text, F.lit(pattern), F.lit(replacement))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACE_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE_CHARS))


def plain_breaks(text: Column) -> Column:
    """A line feed for every line end: one native search for each end costs a fraction of a pattern that offers a choice."""
    for end in ("\r\n", *(chr(c) for lo, hi in LINE_END_RANGES for c in range(lo, hi + 1) if c != 0x0A)):
        text = F.replace(text, F.lit(end), F.lit("\n"))
    return text


def _cut(text: Column, pattern: str | Column) -> Column:
    return let(
        F.split(text, pattern),
        lambda parts: F.when(
            F.get(parts, F.size(parts) - 1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
        ).otherwise(parts),
    )


def lines(text: Column) -> Column:
    """The lines of a text without their ends; a final line break opens no extra line."""
    return _cut(text, LINE_BREAK)


def column_lines(text: Column) -> Column:
    """The same for a plain column, which is read several times.

    A text whose only ends are line feeds is cut at that one sign: native searches for all other ends and this cut cost
    half of a pattern that offers a choice.
    """
    others = [chr(c) for lo, hi in LINE_END_RANGES for c in range(lo, hi + 1) if c != 0x0A]
    mixed = reduce(or_, [F.contains(text, F.lit(end)) for end in others])
    return _cut(text, F.when(mixed, F.lit(LINE_BREAK)).otherwise(F.lit("\n")))


def unlines(parts: Column) -> Column:
    return F.array_join(parts, "\n")


@lru_cache(maxsize=1)
def digit_class() -> str:
    """Regex class members for Python's str.isdigit(): decimals and the other digit characters."""
    others = "".join(c for c in map(chr, range(0x110000)) if c.isdigit() and not c.isdecimal())
    return r"\p{Nd}" + others


@lru_cache(maxsize=1)
def _decimal_digits() -> tuple[str, str]:
    chars = [c for c in map(chr, range(0x80, 0x110000)) if c.isdecimal()]
    return "".join(chars), "".join(str(int(c)) for c in chars)


def ascii_digits(text: Column) -> Column:
    """Replace decimal digits of any script by 0-9."""
    source, target = _decimal_digits()
    return F.translate(text, source, target)
