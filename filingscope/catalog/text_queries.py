"""HTML to text: H1-H22."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingscope.catalog.registry import derived, query, re2
from filingscope.functions.text import SPACE_CLASS, S
from filingscope.operators import headings
from filingscope.operators import html_text as h

# Whole pages with the markup of filings put into them: markers, attributes in both quote styles,
# entities, nested empty elements, broken lines, inline XBRL and item headings.
derived(
    "filing_pages",
    """
    SELECT page_id, url,
      'leading text' || chr(10) || '<SEC-DOCUMENT>0000000000-06-' || lpad(CAST(page_id AS STRING), 6, '0')
      || '.txt : 2006' || lpad(CAST(page_id % 12 + 1 AS STRING), 2, '0') || '15' || chr(10) || '<TYPE>10-K' || chr(10)
      || replace(replace(replace(replace(replace(html,
        '<h1>', '<h1 style="color:red" ID=' || chr(39) || 'x' || chr(39) || chr(9) || ' align="left">&#8220;Item 1.&#8221;'
          || '&nbsp;&#160;<span>a &#x2014; b</span><IMG src="a.png">'),
        '</h1>', '<p><div> <p>' || chr(10) || '</p></div></p><DIV></DIV></h1>' || chr(10) || 'first part of a line  '
          || chr(10) || ' second part' || chr(9) || chr(13) || chr(10) || 'third' || chr(160) || chr(10) || '<hr size=2>'),
        '<article>', '<article><ix:nonNumeric name="a">kept</ix:nonNumeric><XBRL a>drop' || chr(10)
          || '</XBRL><xbrli:measure id="u">iso:USD</xbrli:measure><font' || chr(10) || 'size=1>Text   Item 1A. and ITEMS 2'
          || ' and 3. more items 4 - 5a. end</font><table border=0><tr><td>cell</td></tr></table>'),
        '<b>', '<B><!-- note' || chr(10) || '--><center>&#146;s &#8217;t</center>'),
        '</article>', '</article' || chr(10) || '><em' || chr(10) || 'x>multi</em><p class="y">last</p>   ' || chr(10) || chr(10))
      || chr(10) || '<SEQUENCE>2' || chr(10) || 'second document' AS body
    FROM {pages}
    """,
)

SPACES_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"


def _replace_all(text: str, pattern: str, replacement: str) -> str:
    out = "'" + replacement.replace("$0", "\\0").replace("'", "''") + "'"
    return f"regexp_replace({text}, {re2(pattern)}, {out}, 'g')"


# The checking side has its own patterns, written from the blueprint, and shares none with the operators.
LITERAL_PAIRS = [
    ("<span>", ""), ("</span>", ""), ("&#8217;", "'"), ("&#8220;", '"'), ("&#8221;", '"'), ("&nbsp;", " "), ("&#146;", "'"),
]
UNWRAPPED = [
    (r"(?i)<ix:[a-z0-9_:]+.*?>", "\n"), (r"(?i)</ix:[a-z0-9_:]+>", ""), (r"(?is)<html.*?>", "\n"), (r"(?i)</html>", ""),
    (r"(?is)<font.*?>", "\n"), (r"(?i)</font>", ""), (r"(?is)<br.*?>", ""), (r"(?is)<hr.*?>", ""), (r"(?i)<b>", "\n"),
    (r"(?i)</b>", ""), (r"(?i)<center>", "\n"), (r"(?i)</center>", ""), (r"(?is)<a.*?>", "\n"), (r"(?i)</a>", ""),
    (r"(?is)<table.*?>", "\n"), (r"(?i)</table>", ""), (r"(?is)<tr.*?>", "\n"), (r"(?i)</tr>", ""),
    (r"(?is)<td.*?>", "\n"), (r"(?i)</td>", ""),
]


def _plain(text: str, pattern: str, replacement: str) -> str:
    pattern, replacement = pattern.replace("'", "''"), replacement.replace("'", "''")
    return f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"


def _literals(text: str) -> str:
    for old, new in LITERAL_PAIRS:
        text = "replace({}, '{}', '{}')".format(text, old.replace("'", "''"), new.replace("'", "''"))
    return text


def _unwrap(text: str) -> str:
    for step in UNWRAPPED:
        text = _plain(text, *step)
    return text


def _empty_elements(text: str) -> str:
    for _ in range(12):
        text = _plain(text, r"(?i)<p>\s*</p>|<div>\s*</div>", "")
    return text


def _lines(text: str) -> str:
    """Lines of a text; the derived pages only have CR LF and LF ends."""
    parts = f"string_split(replace({text}, chr(13) || chr(10), chr(10)), chr(10))"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


def _join_lines(text: str) -> str:
    tag_end = f"(right(rtrim(l, {SPACES_SQL}), 1) = '>' AND contains(right(rtrim(l, {SPACES_SQL}), 300), '<'))"
    return f"""(SELECT string_agg(piece, '' ORDER BY i) FROM (
      SELECT i, CASE WHEN next_join AND (right(body, 1) = ' ' OR right(body, 1) = chr(9)) THEN rtrim(body, {SPACES_SQL})
          ELSE body END || CASE WHEN is_last THEN '' WHEN next_join THEN ' ' ELSE chr(10) END AS piece
      FROM (SELECT i, is_last, next_join, CASE WHEN prev_join THEN ltrim(l, {SPACES_SQL}) ELSE l END AS body
        FROM (SELECT i, l, next_join, lead(i) OVER (ORDER BY i) IS NULL AS is_last,
                coalesce(lag(next_join) OVER (ORDER BY i), false) AS prev_join
          FROM (SELECT i, l, NOT {tag_end} AND coalesce(NOT starts_with(ltrim(lead(l) OVER (ORDER BY i), {SPACES_SQL}), '<'), false)
                  AS next_join
            FROM (SELECT unnest({_lines(text)}) AS l, generate_subscripts({_lines(text)}, 1) AS i))))))"""


def _from_start(text: str) -> str:
    return f"CASE WHEN contains({text}, '<SEC-DOCUMENT>') THEN substr({text}, instr({text}, '<SEC-DOCUMENT>')) ELSE {text} END"


def _before_second(text: str) -> str:
    return f"string_split({text}, '<SEQUENCE>2')[1]"


ITEM_HEAD_SQL = (
    rf"(?i)(^|[^{SPACE_CLASS}])({S}*items?\b{S}*\d+[A-Za-z]?(?:{S}*(?:and|to|through|-){S}*\d+[A-Za-z]?)*{S}*\.)"
)


def _break_items(text: str) -> str:
    """Without look-behind: keep the sign before the heading; none of the texts starts with one."""
    return _replace_all(_replace_all(text, ITEM_HEAD_SQL, "\\1\n\\2"), r"[ \t]+\n", "\n")


def _clean_lines(text: str) -> str:
    kept = f"list_filter({_lines(text)}, lambda l: trim(l, {SPACES_SQL}) <> '')"
    return f"array_to_string(list_transform({kept}, lambda l: ltrim(l, {SPACES_SQL})), chr(10))"


def _pattern(step: tuple[str, str]) -> Callable[[str], str]:
    return lambda text: _plain(text, *step)


STEPS: list[tuple[str, Callable[[Column], Column], Callable[[str], str] | None]] = [
    ("h1_join_lines", h.unwrap_lines, _join_lines),
    ("h2_from_document_start", h.from_document_start, _from_start),
    ("h3_before_second_document", h.before_second_document, _before_second),
    ("h4_drop_head", h.drop_head, _pattern((r"(?is)<head>.*?</head>", ""))),
    ("h5_drop_style", h.drop_style, _pattern((r"""(?i)\sstyle=(?:"[^"\n]*"|'[^'\n]*')""", ""))),
    ("h6_drop_id", h.drop_id, _pattern((r"""(?i)\s+id=(?:"[^"\n]*"|'[^'\n]*')""", ""))),
    ("h7_drop_align", h.drop_align, _pattern((r"""(?i)\s+align=(?:"[^"\n]*"|'[^'\n]*')""", ""))),
    ("h8_drop_comments", h.drop_comments, _pattern((r"(?s)<!--.*?-->", ""))),
    ("h9_drop_images", h.drop_images, _pattern((r"(?i)<img.*?>", ""))),
    ("h10_replace_literals", h.replace_literals, _literals),
    ("h11_three_digit_references", h.blank_three_digit_references, _pattern((r"&#\d{3};", " "))),
    ("h12_h13_unwrap_tags", h.unwrap_tags, _unwrap),
    ("h14_drop_xbrli_blocks", h.drop_xbrli_blocks, _pattern(
        (r"(?is)<xbrli:measure[^>]*>.*?</xbrli:measure>", ""))),
    ("h15_drop_empty_elements", h.drop_empty_elements, _empty_elements),
    ("h16_break_before_paragraphs", h.break_before_paragraphs, _pattern((r"(?i)<p.*?>", "\n\\0"))),
    ("h17_strip_tags", h.strip_tags, _pattern((r"<.*?>", ""))),
    ("h18_drop_numeric_entities", h.drop_numeric_entities, _pattern((r"(?i)&#(?:\d{1,8}|x[0-9a-f]{1,8});", ""))),
    ("h19_break_before_items", h.break_before_items, _break_items),
    ("h20_clean_lines", h.clean_lines, _clean_lines),
    ("h21_drop_xbrl_blocks", h.drop_xbrl_blocks, lambda text: _plain(
        _plain(text, r"(?s)<XBRL[^>]*>.*?</XBRL>|<XML[^>]*>.*?</XML>", ""), r"</?ix:.*?>", "")),
]


def _run_step(step: Callable[[Column], Column]):
    return lambda t: t["filing_pages"].select("page_id", step(F.col("body")).alias("text"))


for key, step, sql in STEPS:
    query(
        key,
        _run_step(step),
        None if sql is None else f"SELECT page_id, {sql('body')} AS text FROM {{filing_pages}}",
    )


def _chain(source: str = "{filing_pages}") -> str:
    """All steps as one SQL, one derived column per step."""
    for key, _, sql in STEPS[:-1]:
        source = f"(SELECT page_id, {sql('body')} AS body FROM {source})"
    return f"SELECT page_id, body AS text FROM {source}"


query(
    "h_html_to_text",
    lambda t: h.html_to_text(t["filing_pages"].select("page_id", "body")),
    _chain(),
)
query(
    "h_clean_pages",
    lambda t: headings.repair_headings(h.html_to_text(t["pages"], body="html")).select("page_id", "text"),
    # The pages hold no item headings, so the repairs change nothing.
    _chain("(SELECT page_id, html AS body FROM pages)"),
)
query(
    "h22_header_name",
    lambda t: t["filing_pages"].select(
        "page_id", h.header_name(F.col("body"), F.lit("0000000001"), F.lit("10-K")).alias("name")
    ),
    """
    SELECT page_id, '0000000001_10-K_2006-' || lpad(CAST(page_id % 12 + 1 AS STRING), 2, '0') || '-15.txt' AS name
    FROM {filing_pages}
    """,
)
