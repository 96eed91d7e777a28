"""Cleaning steps against hand-written cases and against Python's own regex engine."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from filingscope.functions.text import LINE_BREAK, SPACE_CHARS, SPACE_CLASS, S, lines, strip
from filingscope.operators import headings as hd
from filingscope.operators import html_text as h

SIGNS = [
    "<p>", "</p>", "<P>", "</P>", "<div>", "</div>", "<br/>", "<a href='x'>", "</a>", "<article>", "<font\nx>", "</font>",
    "<tr>", "<td>", "</td>", "<b>", "</B>", "<ix:non a>", "</ix:non>", "<xbrli:m>", "</xbrli:m>", "<img\n>", "<img a>",
    "<!--", "-->", "<", ">", "&#8217;", "&#160;", "&#x2014;", "&nbsp;", "&#12345678;", "&amp;", " style=\"a\"",
    "\tid='b'", "  align=\"c'\"", "  ", " ", "\t", "\n", "\r\n", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ",
    " ", "Item", "items", "ITEM", "ıtem", "İtems", "itemſ", " 1A", " 2", ".", " and 3", "-4", "١", "x", "café", "I", "tem",
    "<head>", "</head>", "<XBRL>", "</XBRL>", "<XML a>", "</XML>", "<xbrli:mm x>", "</XBRLI:mm>", "<hr>", "<html>", "<center>", "<table>", "_", "²",
]


def hostile(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


def apply(spark, texts, step):
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING").select("i", step(F.col("t")).alias("r"))
    return [r.r for r in df.orderBy("i").collect()]


def python_pattern(pattern):
    """The same pattern for Python: its own class for blanks, its flag and digit spellings."""
    pattern = pattern.replace("(?iu:", "(?i:").replace(S, f"[{SPACE_CLASS}]")
    return re.compile(pattern.replace(r"\p{Nd}", r"\d").replace(r"[\p{L}\p{N}_]", r"\w").replace("$0", ""))


# Written from the blueprint's own words, not taken from the operators.
OPENED = ("ix:[a-zA-Z0-9_:]+[^>\n]*", "html[^>]*", "font[^>]*", "b", "center", "a[^>]*", "table[^>]*", "tr[^>]*", "td[^>]*")
UNWRAPPING = [x for t in OPENED[:3] for x in ((f"(?i)<{t}>", "\n"), (f"(?i)</{t.split('[^')[0]}>", ""))]
UNWRAPPING += [(r"(?i)<br[^>]*>", ""), (r"(?i)<hr[^>]*>", "")]
UNWRAPPING += [x for t in OPENED[3:] for x in ((f"(?i)<{t}>", "\n"), (f"(?i)</{t.split('[^')[0]}>", ""))]
PATTERN_STEPS = [
    (h.drop_head, [(r"(?is)<head>.*?</head>", "")]),
    (h.drop_style, [(r"""(?i)\sstyle=(["']).*?\1""", "")]),
    (h.drop_id, [(r"""(?i)\s+id=(["']).*?\1""", "")]),
    (h.drop_align, [(r"""(?i)\s+align=(["']).*?\1""", "")]),
    (h.drop_comments, [(r"(?s)<!--.*?-->", "")]),
    (h.drop_images, [(r"(?i)<img.*?>", "")]),
    (h.blank_three_digit_references, [(r"&#\d{3};", " ")]),
    (h.unwrap_tags, UNWRAPPING),
    (h.drop_xbrli_blocks, [(r"(?is)<xbrli:([a-zA-Z0-9_:]+)[^>]*>.*?</xbrli:\1>", "")]),
    (h.break_before_paragraphs, [(r"(?i)(<p.*?>)", r"\n\1")]),
    (h.strip_tags, [(r"<.*?>", "")]),
    (h.drop_numeric_entities, [(r"(?i)&#\d{1,8};|&#x[0-9a-f]{1,8};", "")]),
    (h.drop_xbrl_blocks, [(r"(?s)<XBRL[^>]*>.*?</XBRL>|<XML[^>]*>.*?</XML>", ""), (r"</?ix:.*?>", "")]),
]


@pytest.mark.parametrize("step,patterns", PATTERN_STEPS, ids=lambda x: getattr(x, "__name__", ""))
def test_patterns_agree_with_python(spark, step, patterns):
    texts = hostile(600, step.__name__)
    expected = []
    for text in texts:
        for pattern, replacement in patterns:
            text = re.sub(pattern, replacement, text)
        expected.append(text)
    assert apply(spark, texts, step) == expected


@pytest.mark.parametrize(
    "step,mark,closing",
    [
        (h.drop_head, "<head>", "</head>"),
        (h.drop_comments, "<!--", "-->"),
        (h.drop_xbrli_blocks, "<xbrli:measure>", "</xbrli:other>"),
        (h.drop_xbrl_blocks, "<XBRL>", "</XML>"),
    ],
    ids=lambda x: getattr(x, "__name__", x),
)
def test_unclosed_marks_take_linear_time(spark, step, mark, closing):
    def seconds(marks):
        text = mark * marks + closing
        begin = time.perf_counter()
        result = apply(spark, [text], step)
        assert result == [re.sub(r"(?s)\A(<head>|<!--).*\Z", "", text) if step in (h.drop_head, h.drop_comments) else text]
        return time.perf_counter() - begin

    seconds(100)
    assert seconds(200_000) < 40 * max(seconds(20_000), 0.2)


def test_space_class_is_pythons(spark):
    texts = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    assert SPACE_CHARS == "".join(c for c in texts if c.isspace())
    stripped = apply(spark, texts, lambda t: F.regexp_replace(t, F.lit(S), F.lit("")))
    assert [c for c, r in zip(texts, stripped) if r == ""] == list(SPACE_CHARS)


def test_lines_and_strip_agree_with_python(spark):
    texts = hostile(500, 1) + ["", "\n", "a\n\n", "\r\n\r"]
    assert apply(spark, texts, lines) == [t.splitlines() for t in texts]
    assert apply(spark, texts, strip) == [t.strip() for t in texts]
    assert re.split(LINE_BREAK, "a\r\nb\x0bc") == ["a", "b", "c"]


def test_join_lines(spark):
    cases = {
        "a\nb": "a b",
        "a \t\n  b\nc": "a b c",
        "<p>a</p>\nb": "<p>a</p>\nb",
        "a\n <b>x": "a\n <b>x",
        "a\xa0\nb": "a\xa0 b",
        "a\n\nb": "a  b",
        "a > \nb": "a > b",
        "<" + "x" * 298 + ">\nb": "<" + "x" * 298 + ">\nb",
        "<" + "x" * 299 + ">\nb": "<" + "x" * 299 + "> b",
        "": "",
        "one": "one",
        "one\n": "one",
    }
    assert apply(spark, list(cases), h.unwrap_lines) == list(cases.values())


def test_empty_elements_to_any_depth(spark):
    deep = "<p>" * 60 + "</p>" * 60
    mixed = "<p><div> \n</div><P></p></P>x<div>"
    cases = {deep: "", mixed: "x<div>", "<p>a</p>": "<p>a</p>", "<p class='a'></p>": "<p class='a'></p>"}
    assert apply(spark, list(cases), h.drop_empty_elements) == list(cases.values())


def test_empty_elements_reach_a_fixpoint(spark):
    texts = hostile(400, 5)
    pattern = python_pattern(h.EMPTY_ELEMENT)
    for text, result in zip(texts, apply(spark, texts, h.drop_empty_elements)):
        while pattern.search(text):
            text = pattern.sub("", text, count=1)
        assert result == text


def test_nested_empty_elements_take_linear_time(spark):
    """Ten megabytes of empty elements inside each other, and beside one that is not empty."""
    import time

    deep = "<p><div> " * 500_000 + "</DIV>\n</P>" * 500_000
    start = time.time()
    assert apply(spark, [deep, f"<p>x{deep}</p>"], h.drop_empty_elements) == ["", "<p>x</p>"]
    assert time.time() - start < 30


def test_empty_element_scan_agrees_with_python():
    import random
    import re

    random.seed(9)
    pattern = re.compile(r"<p>\s*</p>|<div>\s*</div>", re.I)
    for _ in range(4000):
        text = "".join(random.choice(["<p>", "</p>", "<div>", "</div>", "<P>", "</DIV>", " ", "\n", "x", "<p a>", "\u2003"]) for _ in range(random.randint(0, 16)))
        plain, before = text, None
        while plain != before:
            before, plain = plain, pattern.sub("", plain)
        assert h.without_empty_elements(text) == plain, text


def test_document_bounds(spark):
    assert apply(spark, ["x<SEC-DOCUMENT>a<SEC-DOCUMENT>b", "none"], h.from_document_start) == [
        "<SEC-DOCUMENT>a<SEC-DOCUMENT>b", "none",
    ]
    assert apply(spark, ["a<SEQUENCE>20b<SEQUENCE>2", "none"], h.before_second_document) == ["a", "none"]


def test_breaks_before_item_headings(spark):
    cases = {
        "see   Item 1A. risk": "see\n   Item 1A. risk",
        "Item 1. a": "Item 1. a",
        "  Item 1. a": "  Item 1. a",
        "  Item 1. a": "  Item 1. a",
        "x Items 1 and 2. y items 3-4a. z": "x\n Items 1 and 2. y\n items 3-4a. z",
        "x Item1. y": "x Item1. y",
        "a item 1": "a item 1",
        "a  \n \t Item 2 .b": "a\n\n \t Item 2 .b",
        "trail \t\nnext": "trail\nnext",
        "xitem 3.": "x\nitem 3.",
        "a ıtem 1. İTEM 2.": "a\n ıtem 1.\n İTEM 2.",
    }
    assert apply(spark, list(cases), h.break_before_items) == list(cases.values())


def test_quirks_of_the_whole_chain(spark):
    cases = {
        "<article>a</article>": "a",
        "x<em\ny>z": "xz",
        "<p style=\"x\" id='y' align=\"z\"></p>a": "a",
        "&amp; &#8217; &#146; &nbsp;&#x2014;b": "&amp; ' '  b",
        "<p>one</p><p>two</p>": "one\ntwo",
        "<b>Item</b> 1. <b>x</b>": "Item 1.\nx",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i INT, body STRING")
    got = {r.i: r.text for r in h.html_to_text(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_cleaned_lines_stay_clean(spark):
    texts = hostile(300, 9)
    once = apply(spark, texts, h.clean_lines)
    assert apply(spark, once, h.clean_lines) == once
    assert once == ["\n".join(l.lstrip() for l in t.splitlines() if l.strip()) for t in texts]


def test_heading_repairs(spark):
    cases = [
        (hd.merge_split_word, "a\n I \n  tem 1. B\nI\nx", "a\nItem 1. B\nI\nx"),
        (hd.space_after_item, "Item1A Item- Items(a) item-", "Item1A Item - Items (a) item-"),
        (hd.merge_number_line, "Item\n 1. B\nItems \n²\nItem\nx", "Item 1. B\nItems ²\nItem\nx"),
        (hd.merge_suffix_line, "Item 1\nA. Risk\nItem  2 \n. P\nItem 3A\nB. x\nItem 4\nAB.", "Item 1A. Risk\nItem  2. P\nItem 3A\nB. x\nItem 4\nAB."),
    ]
    for step, text, expected in cases:
        assert apply(spark, [text], step) == [expected], step.__name__


def test_header_name(spark):
    df = spark.createDataFrame([("<SEC-DOCUMENT>0001-06-01.txt : 20060331\nx",), ("none",)], "t STRING")
    rows = df.select(h.header_name(F.col("t"), F.lit("0000000001"), F.lit("10-K")).alias("n")).collect()
    assert [r.n for r in rows] == ["0000000001_10-K_2006-03-31.txt", None]


def test_a_filter_does_not_repeat_the_chain(spark):
    df = spark.createDataFrame([(0, "a")], "i INT, body STRING")
    out = hd.repair_headings(h.html_to_text(df))

    def plan(frame):
        return frame._jdf.queryExecution().optimizedPlan().toString()

    assert plan(out.filter("text != '' AND text LIKE '%a%'")).count("(?iu:head)") == plan(out).count("(?iu:head)")
    # Python sees only what nests deeper than the native rounds go.
    assert plan(out).count("ArrowEvalPython") <= 1 and "BatchEvalPython" not in plan(out)
