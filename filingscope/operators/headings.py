"""Repair of item headings that the layout broke over two lines.

A merged pair never overlaps another one, so each repair is a test on direct neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingscope.functions.text import BLANK, NOT_S, digit_class, plain_breaks, sub, with_once

NOT_WORD = r"(?![\p{L}\p{N}_])"
# Heading words, in this spelling only. The pattern starts with a sign, so the search skips ordinary text.
SPACE_AFTER_ITEM = rf"I(?<![\p{{L}}\p{{N}}_]I)(tems?){NOT_WORD}(?={NOT_S})"
ITEM_NUMBER = rf"Item{BLANK}+\p{{Nd}}+"
LETTER_DOT = r"[A-Za-z]?\."


def _merge_with_next(head: str, tail: str, glue: str) -> Callable[[Column], Column]:
    """Append a line to the one before it if the first is `head` and the second starts with `tail`, blanks around them left out.

    Works on a text whose lines all stand behind a line feed.
    """
    pattern = rf"\n{BLANK}*+({head}){BLANK}*+\n{BLANK}*+(?={tail})"
    return lambda text: sub(text, pattern, f"\n$1{glue}")


_SPLIT_WORD = _merge_with_next("I", "tem", "")
_NUMBER_LINE = _merge_with_next("Items?", f"[{digit_class()}]", " ")
_SUFFIX_LINE = _merge_with_next(ITEM_NUMBER, LETTER_DOT, "")


def _on_lines(text: Column, *steps: Callable[[Column], Column], merges: int = 1) -> Column:
    """Apply steps to a text with plain line feeds; each merge drops one final line break."""
    text = F.concat(F.lit("\n"), plain_breaks(text))
    for step in steps:
        text = step(text)
    return F.substr(sub(text, rf"\n{{1,{merges}}}\z", ""), F.lit(2))


def merge_split_word(text: Column) -> Column:
    """A line `I` and a line starting `tem` become one."""
    return _on_lines(text, _SPLIT_WORD)


def space_after_item(text: Column) -> Column:
    """One blank between `Item` or `Items` and a directly following sign; `Item1` is one word and stays."""
    return sub(text, SPACE_AFTER_ITEM, "I$1 ")


def merge_number_line(text: Column) -> Column:
    """A line `Item` and a line starting with a digit become one."""
    return _on_lines(text, _NUMBER_LINE)


def merge_suffix_line(text: Column) -> Column:
    """A line `Item 1` and a line starting `A.` or `.` become one."""
    return _on_lines(text, _SUFFIX_LINE)


def repair_headings(df: DataFrame, text: str = "text") -> DataFrame:
    """All repairs in this order, on the whole text: it is not cut into lines."""
    steps = (_SPLIT_WORD, space_after_item, _NUMBER_LINE, _SUFFIX_LINE)
    return with_once(df, text, _on_lines(F.col(text), *steps, merges=3))
