"""Item sections: the quirks of headings, rounds and slices on hand-written filings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from filingscope.functions.text import LINE_BREAK, SPACE_CHARS, column_lines, lines
from filingscope.operators import headings as hd
from filingscope.operators import sections as sec

ACCESSION = "0000000000-06-000001"


def outlined(spark, texts, **options):
    df = spark.createDataFrame(
        [("0000000001", str(i), None, t) for i, t in enumerate(texts)],
        "cik STRING, accession STRING, filed_date DATE, text STRING",
    )
    return sec.outline_filings(df, **options)


def chosen(spark, text, **options):
    row = outlined(spark, [text], **options).first()
    return row.reason, [(h.item_n, h.line_no) for h in row.chosen or []]


def document(labels):
    return "\n".join(f"Item {label}. x" for label in labels)


def test_heading_labels(spark):
    cases = {
        "Item 1. Business": "1",
        "  ITEMS  1a.Risk": "1A",
        "item 7A Market": "7A",
        "Item1A. Risk": "",
        "Item 1A: Risk": "1A:",
        "Item 1A—Risk": "1A—RISK",
        "Item 400 of": "400",
        "see Item 1.": "",
        "Items and 1.": "",
        "Item": "",
        "Item2": "",
        "Item ١": "",
        "": "",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i INT, t STRING")
    got = [r.r for r in df.select("i", sec.heading_label(F.col("t")).alias("r")).orderBy("i").collect()]
    assert got == list(cases.values())


def test_contents_list_and_body(spark):
    contents = ["1", "1A", "2", "9", "10"]
    text = document(contents) + "\n" + "\n".join(f"Item {x}. x\nbody {x}" for x in contents)
    reason, found = chosen(spark, text)
    assert reason is None
    assert found == [("1", 6), ("1A", 8), ("2", 10), ("9", 12), ("10", 14)]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("no heading", "no_headings"),
        (document(["1", "2²", "3"]), "bad_item_number"),
        (document(["400", "21"]), "no_plausible_item_number"),
        (document(["1", "3"]), "no_round"),
        (document(["1", "2"]), "no_usable_round"),
        (document(["1", "2", "x"]) + "\nItem 2. y\nItem 3. z\nItem 2. again", "no_usable_round"),
    ],
)
def test_failures_keep_a_reason(spark, text, expected):
    assert chosen(spark, text)[0] == expected


def test_fallback_counts_the_highest_number(spark):
    text = document(["1", "3", "5"]) + "\nItem 6٠. q"
    assert chosen(spark, document(["1", "3", "5"]))[0] == "no_round"
    reason, found = chosen(spark, document(["1", "3", "5"]), rounds="max_or_previous")
    assert (reason, found) == (None, [("1", 1), ("3", 2), ("5", 3)])
    assert outlined(spark, [text]).first().rounds is not None
    with pytest.raises(ValueError):
        sec.round_count(F.array(F.lit(1)), rounds="other")


def ladder_of(top):
    return ["1", "1A", "1B", "1C", "1D", "2", "3", "4", "5", "6", "7", "7A", "8"] + [f"{n}{x}" for n in range(9, top + 1) for x in ("", "A", "B", "C")]


def test_rounds_and_choice_have_their_properties(spark):
    rng = random.Random(7)
    labels = ["1", "1A", "2", "3", "7", "7A", "8", "9", "9A", "10", "400", "1A:"]
    texts = []
    for _ in range(200):
        ordered = sorted(rng.sample(range(len(labels)), rng.randrange(2, len(labels))))
        body = [labels[i] for i in ordered] * rng.randrange(1, 4)
        for _ in range(rng.randrange(3)):
            body.insert(rng.randrange(len(body)), rng.choice(labels))
        texts.append("\n".join(f"Item {x}. t" + "\nline" * rng.randrange(3) for x in body))
    top = F.array_max(sec.plausible_numbers(sec.item_numbers(F.col("headings"))))
    rounds = sec.build_rounds(F.col("headings"), sec.label_ladder(top), F.col("rounds"))
    rows = outlined(spark, texts).filter("rounds > 0").withColumns({"top": top, "found": rounds}).collect()
    worked = 0
    for row in rows:
        ladder = ladder_of(row.top)
        heads = [(h.item_n, h.line_no) for h in row.headings]
        stretches, position = [], 0
        for taken in row.found:
            places = [ladder.index(h.item_n) for h in taken]
            below = [h.line_no for h in taken]
            assert places == sorted(set(places)) and below == sorted(set(below))
            # Between two taken labels no label of the ladder had a line left, and each taken line was the next one.
            steps = [(-1, position), *zip(places, below)]
            for (place, line), (after, here) in zip(steps, [*steps[1:], (len(ladder), None)]):
                assert not any(label in ladder[place + 1 : after] and at > line for label, at in heads)
                assert here is None or here == min(at for label, at in heads if label == ladder[after] and at > line)
            position = below[-1] if below else position
            stretches.append(below[-1] - below[1] if len(below) > 1 else None)
        if None in stretches or max(stretches, default=0) <= 0:
            assert row.chosen is None
        else:
            worked += 1
            assert row.chosen == row.found[stretches.index(max(stretches))]
    assert worked > 20


def test_slices_partition_the_lines(spark):
    body = "\n".join(f"Item {x}. x\nbody {x}\n\nmore" for x in ["1", "1A", "9", "10"])
    text = "head\n" + body
    df = spark.createDataFrame([("1", "a", None, text)], "cik STRING, accession STRING, filed_date DATE, text STRING")
    split = sec.split_items(df)
    rows = sec.sections(split).orderBy("start_line").collect()
    assert "\n".join(r.text for r in rows) == body
    assert [r.start_line for r in rows[1:]] == [r.end_line + 1 for r in rows[:-1]]
    assert rows[-1].end_line == len(text.split("\n"))
    assert sec.rejects(split).count() == 0
    cut = sec.sections(sec.split_items(df, last_line=16)).orderBy("start_line").collect()
    assert [r.text for r in cut[:-1]] == [r.text for r in rows[:-1]]
    assert cut[-1].text == "Item 10. x\nbody 10"
    early = sec.sections(sec.split_items(df, last_line=3)).orderBy("start_line").collect()
    assert early[-1].text == ""


def test_filing_date(spark):
    cases = {
        f"x\n{ACCESSION}.txt : 20060331\ny": "2006-03-31",
        f"<h>: {ACCESSION}.txt : 20060331": None,
        f"{ACCESSION}\n: 20060331": None,
        f"{ACCESSION}.txt : 20061331": None,
        "none : 20060331": None,
        f"a: 20070101 {ACCESSION}": "2007-01-01",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i INT, t STRING")
    rows = df.select("i", sec.filing_date(F.col("t"), F.lit(ACCESSION)).cast("string").alias("d")).orderBy("i").collect()
    assert [r.d for r in rows] == list(cases.values())


def test_a_filter_does_not_repeat_the_outline(spark):
    df = spark.createDataFrame([("1", "a", None, "x")], "cik STRING, accession STRING, filed_date DATE, text STRING")
    plan = sec.rejects(sec.split_items(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 1


def test_long_number_is_dropped(spark):
    assert spark.range(1).select(sec.item_number(F.lit("99999999999X"))).first()[0] == 2147483647
    assert spark.range(1).select(sec.item_number(F.lit("007A"))).first()[0] == 7


def test_lines_have_no_trailing_one(spark):
    assert spark.range(1).select(lines(F.lit("a\n"))).first()[0] == ["a"]


def test_filing_date_after_letters_that_grow_in_lower_case(spark):
    text = chr(0x130) * 60 + "\n0000000001-07-000001.txt : 20070310\n"
    df = spark.createDataFrame([(text, "0000000001-07-000001")], "t STRING, a STRING")
    assert str(df.select(sec.filing_date(F.col("t"), F.col("a")).alias("d")).first().d) == "2007-03-10"


def merged(text, head, tail, glue):
    """Line by line: a line that is all `head` before one that starts with `tail`."""
    parts = re.split(LINE_BREAK, text)
    parts, out = parts[:-1] if parts[-1] == "" else parts, []
    for line in parts:
        following = line.lstrip(SPACE_CHARS)
        if out and re.fullmatch(head, out[-1].strip(SPACE_CHARS)) and re.match(tail, following):
            out[-1] = out[-1].strip(SPACE_CHARS) + glue + following
        else:
            out.append(line)
    return "\n".join(out)


def test_headings_are_repaired_without_cutting_lines(spark):
    random.seed(7)
    signs = ["I", "tem 1", "Item", "Items", "Item 12", "A.", ".", " B. x", "2. P", " ", "\xa0", "\n", "\n", "\n", "\r\n", "\r", "\x0b", "\x85", "\u2028", "-", "_Item."]
    texts = [None, "", "\n", "\n\n", "\n\n\n\n", "I\ntem\n\n\n\n\n"] + ["".join(random.choices(signs, k=random.randint(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, text STRING")
    repaired = hd.repair_headings(df)
    assert "lambda" not in repaired._jdf.queryExecution().optimizedPlan().toString()
    for r in repaired.collect():
        if texts[r.i] is None:
            assert r.text is None
            continue
        text = merged(texts[r.i], "I", "tem", "")
        text = re.sub(r"(?<!\w)(Items?)(?!\w)(?=\S)", r"\1 ", text)
        text = merged(merged(text, "Items?", r"\d", " "), r"Item\s+\d+", r"[A-Za-z]?\.", "")
        assert r.text == text, texts[r.i]


def test_only_texts_with_other_line_ends_are_cut_by_the_pattern(spark):
    ends = ["\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    texts = ["", "\n", "a\nb", "a\n\nb\n", *[f"a\nb{end}c{end}{end}d\n" for end in ends], *[f"a{end}" for end in ends]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i INT, text STRING").select("i", column_lines(F.col("text")).alias("l"))
    assert [r["l"] for r in df.orderBy("i").collect()] == [*[t.splitlines() for t in texts], None]
    split = df.sparkSession.createDataFrame([("1", "a", None, "x")], "cik STRING, accession STRING, filed_date DATE, text STRING")
    plan = sec.split_items(split)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(text" in plan and "CASE WHEN" in plan.split("split(text", 1)[1][:40]
