"""HTML filings to plain text: a projection of native column expressions and one scan for nested empty elements, no shuffle.

Every step takes and returns a text column, so steps can be used alone. Each pattern starts with a
case-sensitive sign or a small class, so that the search passes over ordinary text quickly; `[^>]`
replaces lazy dots, and leading whitespace is anchored at the start of its run, so no pattern
rescans a long run of blanks.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingscope.functions.text import S, let, lines, lstrip, rstrip, strip, sub, unlines, with_once

# Ship the scan with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A tag is recognised at a line's end if its "<" lies in the last 300 characters.
TAG_WINDOW = 300
DOCUMENT_START = "<SEC-DOCUMENT>"
SECOND_DOCUMENT = "<SEQUENCE>2"

# A whole run of blanks; the test behind the first one keeps a search from starting inside the run.
RUN = rf"{S}(?<!{S}{S}){S}*+"
LATIN_SPACE = r"[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0]"

# Patterns, with \d, \s and lazy dots spelled out. "(?iu:" is any case, in Python's
# Unicode sense. Order matters.
HEAD = (r"<(?iu:head)>(?s:.*?)</(?iu:head)>", "")
STYLE_ATTRIBUTE = (S + r"""(?iu:style)=(?:"[^"\n]*"|'[^'\n]*')""", "")
ID_ATTRIBUTE = (RUN + r"""(?iu:id)=(?:"[^"\n]*"|'[^'\n]*')""", "")
ALIGN_ATTRIBUTE = (RUN + r"""(?iu:align)=(?:"[^"\n]*"|'[^'\n]*')""", "")
COMMENT = (r"<!--(?s:.*?)-->", "")
IMAGE = (r"<(?iu:img)[^>\n]*>", "")
LITERALS = (
    ("<span>", ""),
    ("</span>", ""),
    ("&#8217;", "'"),
    ("&#8220;", '"'),
    ("&#8221;", '"'),
    ("&nbsp;", " "),
    ("&#146;", "'"),
)
THREE_DIGIT_REFERENCE = (r"&#\p{Nd}{3};", " ")
# An opening tag becomes a line break, a closing tag vanishes; br and hr vanish. The patterns match
# prefixes on purpose: the one for "a" also takes "article".
UNWRAP = (
    (r"<(?iu:ix:[a-zA-Z0-9_:]+)[^>\n]*>", "\n"),
    (r"</(?iu:ix:[a-zA-Z0-9_:]+)>", ""),
    (r"<(?iu:html)[^>]*>", "\n"),
    (r"</(?iu:html)>", ""),
    (r"<(?iu:font)[^>]*>", "\n"),
    (r"</(?iu:font)>", ""),
    (r"<(?iu:br)[^>]*>", ""),
    (r"<(?iu:hr)[^>]*>", ""),
    (r"<(?iu:b)>", "\n"),
    (r"</(?iu:b)>", ""),
    (r"<(?iu:center)>", "\n"),
    (r"</(?iu:center)>", ""),
    (r"<(?iu:a)[^>]*>", "\n"),
    (r"</(?iu:a)>", ""),
    (r"<(?iu:table)[^>]*>", "\n"),
    (r"</(?iu:table)>", ""),
    (r"<(?iu:tr)[^>]*>", "\n"),
    (r"</(?iu:tr)>", ""),
    (r"<(?iu:td)[^>]*>", "\n"),
    (r"</(?iu:td)>", ""),
)
TAG_IN_TAG = r"<[^<>]*+<"
# NAMES stands for the names that have a closing tag.
XBRLI_BLOCK = (r"<(?iu:xbrli:(NAMES)[^>]*>(?s:.*?)</xbrli:\1)>", "")
XBRLI_CLOSING = r"</(?iu:xbrli:([a-zA-Z0-9_:]+))>"
EMPTY_ELEMENT = rf"<(?iu:p>{S}*+</p|div>{S}*+</div)>"
SHALLOW = 4  # levels of empty elements that are removed round by round
ELEMENT_TAG = re.compile(r"</?(?:p|div)>", re.IGNORECASE)
PARAGRAPH = (r"<(?iu:p)[^>\n]*>", "\n$0")
ANY_TAG = (r"<[^>\n]*>", "")
NUMERIC_ENTITY = (r"&#(?:\p{Nd}{1,8}|[xX][0-9A-Fa-f]{1,8});", "")
# The cheap tests come first: most signs neither follow a blank nor lead to an "i".
ITEM_HEAD = (
    rf"(?<!{LATIN_SPACE})(?={S}*+(?iu:i))(?<!{S})(?!\A){S}*+"
    rf"(?iu:items?(?![\p{{L}}\p{{N}}_]){S}*\p{{Nd}}+[A-Za-z]?"
    rf"(?:{S}*(?:and|to|through|-){S}*\p{{Nd}}+[A-Za-z]?)*{S}*\.)",
    "\n$0",
)
BLANKS_AT_LINE_END = (r"[ \t](?<![ \t][ \t])[ \t]*+\n", "\n")
XBRL_KINDS = ("XBRL", "XML")
XBRL_BLOCKS = (r"(?s)<XBRL[^>]*>.*?</XBRL>|<XML[^>]*>.*?</XML>", "")
INLINE_XBRL_TAG = (r"</?ix:[^>\n]*>", "")


# A noncharacter: no text has it after a "<".
SET_ASIDE = "<\ufdd0"


def through_last(text: Column, opening: str, closing: str, step: Callable[[Column], Column]) -> Column:
    """Apply a step to the part of a text that ends with the last closing mark; the rest cannot match.

    An opening mark without a closing one makes a search run to the end of the text, so many of them
    take quadratic time. In the first part every search succeeds.
    """
    first = F.regexp_extract(text, rf"\A(?s:.*)(?:{closing})", 0)
    parts = let(first, lambda head: F.concat(step(head), F.substr(text, F.length(head) + 1)))
    return F.when(F.rlike(text, F.lit(opening)), parts).otherwise(text)


def ends_with_tag(line: Column) -> Column:
    return let(
        rstrip(line),
        lambda s: F.endswith(s, F.lit(">")) & F.contains(F.right(s, F.lit(TAG_WINDOW)), F.lit("<")),
    )


def starts_with_tag(line: Column) -> Column:
    return F.startswith(lstrip(line), F.lit("<"))


def unwrap_lines(text: Column) -> Column:
    """Join a line to the next unless a tag ends the first or starts the second."""

    def rebuild(bound: Column) -> Column:
        parts, joins = bound["parts"], bound["joins"]

        def piece(line: Column, i: Column) -> Column:
            after = F.when(i > 0, F.get(joins, i - 1)).otherwise(False)
            joined = F.get(joins, i)
            body = F.when(after, lstrip(line)).otherwise(line)
            trailing = F.endswith(body, F.lit(" ")) | F.endswith(body, F.lit("\t"))
            body = F.when(joined & trailing, rstrip(body)).otherwise(body)
            last = i == F.size(parts) - 1
            return F.concat(body, F.when(last, "").when(joined, " ").otherwise("\n"))

        return F.array_join(F.transform(parts, piece), "")

    def with_joins(parts: Column) -> Column:
        opens = F.transform(parts, starts_with_tag)
        joins = let(
            opens,
            lambda o: F.transform(
                parts, lambda line, i: ~ends_with_tag(line) & ~F.coalesce(F.get(o, i + 1), F.lit(True))
            ),
        )
        return F.struct(parts.alias("parts"), joins.alias("joins"))

    joined = let(let(lines(text), with_joins), rebuild)
    return F.when(text == "", text).otherwise(joined)


def from_document_start(text: Column) -> Column:
    at = F.instr(text, F.lit(DOCUMENT_START))
    return F.when(at > 0, F.substr(text, at)).otherwise(text)


def before_second_document(text: Column) -> Column:
    return F.substring_index(text, SECOND_DOCUMENT, 1)


def drop_head(text: Column) -> Column:
    return through_last(text, "<(?iu:head)>", "</(?iu:head)>", lambda part: sub(part, *HEAD))


def drop_style(text: Column) -> Column:
    return sub(text, *STYLE_ATTRIBUTE)


def drop_id(text: Column) -> Column:
    return sub(text, *ID_ATTRIBUTE)


def drop_align(text: Column) -> Column:
    return sub(text, *ALIGN_ATTRIBUTE)


def drop_comments(text: Column) -> Column:
    return through_last(text, "<!--", "-->", lambda part: sub(part, *COMMENT))


def drop_images(text: Column) -> Column:
    return sub(text, *IMAGE)


def replace_literals(text: Column) -> Column:
    for old, new in LITERALS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def blank_three_digit_references(text: Column) -> Column:
    return sub(text, *THREE_DIGIT_REFERENCE)


def unwrap_tags(text: Column) -> Column:
    """Open tags of the unwrapped elements become line breaks, closing ones vanish.

    The steps apply one after another. Where no "<" lies inside a tag, each tag is decided on its own,
    so one pass per replacement gives the same text; only other texts take all the passes.
    """
    stepwise = text
    for step in UNWRAP:
        stepwise = sub(stepwise, *step)
    at_once = text
    for replacement in ("\n", ""):
        kinds = "|".join(p.removeprefix("<") for p, r in UNWRAP if r == replacement)
        at_once = sub(at_once, f"<(?:{kinds})", replacement)
    return F.when(F.rlike(text, F.lit(TAG_IN_TAG)), stepwise).otherwise(at_once)


def drop_xbrli_blocks(text: Column) -> Column:
    """Remove blocks that have a closing tag.

    An opening tag fits a closing one whose name its own name starts with, the longest first. The
    pattern lists the names that are closed at all, so other opening tags fail at once.
    """
    pattern, replacement = XBRLI_BLOCK
    before, after = pattern.split("NAMES")
    closed = F.array_distinct(F.regexp_extract_all(text, F.lit(XBRLI_CLOSING), 1))
    longest_first = F.array_sort(closed, lambda x, y: F.length(y) - F.length(x))

    def drop(names: Column) -> Column:
        own = F.concat(F.lit(before), F.array_join(names, "|"), F.lit(after))
        return through_last(text, "<(?iu:xbrli:)", XBRLI_CLOSING, lambda part: F.regexp_replace(part, own, F.lit(replacement)))

    return F.when(F.rlike(text, F.lit(XBRLI_CLOSING)), let(longest_first, drop)).otherwise(text)


def without_empty_elements(text: str) -> str:
    """One scan: an opening tag waits as long as only blanks and removed elements follow it; its closing tag then takes it away."""
    out: list[str] = []
    waiting: list[tuple[int, str]] = []  # place in `out` and kind of opening tags
    at = 0
    for tag in ELEMENT_TAG.finditer(text):
        between = text[at : tag.start()]
        at = tag.end()
        if between:
            out.append(between)
            if not between.isspace():
                waiting.clear()
        mark = tag.group()
        kind = "p" if len(mark.strip("</>")) == 1 else "div"
        if mark[1] != "/":
            waiting.append((len(out), kind))
            out.append(mark)
        elif waiting and waiting[-1][1] == kind:
            del out[waiting.pop()[0] :]
        else:
            out.append(mark)
            waiting.clear()
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def _scanned(texts: pd.Series) -> pd.Series:
    return texts.map(without_empty_elements, na_action="ignore")


def drop_shallow_elements(text: Column) -> Column:
    """The text after up to SHALLOW rounds of removing empty elements; a text without one pays for one search."""

    def one_round(state: Column, _: Column) -> Column:
        changed = let(
            sub(state["text"], EMPTY_ELEMENT, ""),
            lambda t: F.struct(t.alias("text"), (t == state["text"]).alias("done")),
        )
        return F.when(state["done"], state).otherwise(changed)

    rounds = F.when(F.rlike(text, F.lit(EMPTY_ELEMENT)), F.sequence(F.lit(1), F.lit(SHALLOW))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, F.struct(text.alias("text"), F.lit(False).alias("done")), one_round, lambda state: state["text"])


def drop_empty_elements(text: Column) -> Column:
    """Remove empty p and div elements until none is left, however deep they nest.

    Two matches never overlap, so the result does not depend on the order of removal. In the chain ordinary texts are done after a few
    native rounds; what nests deeper is scanned once with a stack, which no built-in function can keep.
    """
    found = F.rlike(text, F.lit(EMPTY_ELEMENT))
    return F.when(found, _scanned(F.when(found, text))).otherwise(text)


def break_before_paragraphs(text: Column) -> Column:
    return sub(text, *PARAGRAPH)


def strip_tags(text: Column) -> Column:
    """Remove tags; a tag that spans lines stays."""
    return sub(text, *ANY_TAG)


def drop_numeric_entities(text: Column) -> Column:
    return sub(text, *NUMERIC_ENTITY)


def break_before_items(text: Column) -> Column:
    """Start a new line before an item heading, then tidy blanks before line ends."""
    return sub(sub(text, *ITEM_HEAD), *BLANKS_AT_LINE_END)


def clean_lines(text: Column) -> Column:
    """Drop blank lines and strip the others on the left."""
    kept = F.filter(lines(text), lambda line: strip(line) != "")
    return unlines(F.transform(kept, lstrip))


def drop_xbrl_blocks(text: Column) -> Column:
    """Remove whole blocks and inline tags. Opening tags after the last closing one of their kind are set aside meanwhile."""

    def aside(part: Column, kind: str) -> Column:
        first = F.regexp_extract(part, rf"\A(?s:.*)</{kind}>", 0)
        return let(
            first,
            lambda head: F.concat(
                head, F.replace(F.substr(part, F.length(head) + 1), F.lit(f"<{kind}"), F.lit(f"{SET_ASIDE}{kind}"))
            ),
        )

    blocks = text
    for kind in XBRL_KINDS:
        blocks = aside(blocks, kind)
    blocks = F.replace(sub(blocks, *XBRL_BLOCKS), F.lit(SET_ASIDE), F.lit("<"))
    found = F.contains(text, F.lit("<XBRL")) | F.contains(text, F.lit("<XML"))
    return sub(F.when(found, blocks).otherwise(text), *INLINE_XBRL_TAG)


CLEANING_STEPS = (
    unwrap_lines,
    from_document_start,
    before_second_document,
    drop_head,
    drop_style,
    drop_id,
    drop_align,
    drop_comments,
    drop_images,
    replace_literals,
    blank_three_digit_references,
    unwrap_tags,
    drop_xbrli_blocks,
    drop_shallow_elements,
    drop_empty_elements,
    break_before_paragraphs,
    strip_tags,
    drop_numeric_entities,
    break_before_items,
    clean_lines,
)


def html_to_text(df: DataFrame, body: str = "body", into: str = "text", drop_xbrl: bool = False) -> DataFrame:
    """Add the cleaned text of an HTML column and drop the raw one.

    Each step is its own projection: a step may read its input several times.
    """
    df = df.withColumn(into, drop_xbrl_blocks(F.col(body)) if drop_xbrl else F.col(body))
    if body != into:
        df = df.drop(body)
    for step in CLEANING_STEPS:
        df = df.withColumn(into, step(F.col(into)))
    return with_once(df, into, F.col(into))


def header_name(text: Column, firm: Column, form: Column) -> Column:
    """`firm_form_YYYY-MM-DD` from the accession line that opens a submission."""
    first = strip_tags(F.get(lines(from_document_start(text)), F.lit(0)))
    date = F.regexp_extract(first, r"^[^:]*:[ ]*(\d{8})", 1)
    iso = F.concat_ws("-", date.substr(1, 4), date.substr(5, 2), date.substr(7, 2))
    return F.when(date != "", F.concat_ws("_", firm, form, F.concat(iso, F.lit(".txt"))))
