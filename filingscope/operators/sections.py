"""Split cleaned filings into numbered items.

Headings, round count, label ladder, rounds and slices are array expressions over the lines of one
filing, so the whole job is one narrow stage. A filing that cannot be split keeps a row with a status and
a reason instead of disappearing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingscope.functions.text import S, ascii_digits, column_lines, digit_class, let, lines, strip, sub, unlines, with_once

# The blanks that count as a plain space in a heading line, the heading pattern, the
# opening labels of the ladder and the letters of the later ones.
HARD_BLANKS = chr(0xA0) + chr(0x2007) + chr(0x202F)
HEADING = r"(?iu)\Aitems?(?![\p{L}\p{N}_]) ?([0-9][^ .]*)"
HEADING_START = rf"\A{S}*+(?iu:items?)"
FIRST_LABELS = ("1", "1A", "1B", "1C", "1D", "2", "3", "4", "5", "6", "7", "7A", "8")
LATER_LETTERS = ("", "A", "B", "C")
LAST_FIXED_ITEM = 8
HIGHEST_ITEM = 20
# The end line (exclusive) that the last item is cut at in compatibility mode.
FIXED_LAST_LINE = 11849

ROUNDS = ("previous", "max_or_previous")


def heading_label(line: Column) -> Column:
    """The upper-case item label of a heading line, or an empty string.

    Nearly all lines fail the first, anchored test and are not normalised.
    """
    flat = strip(sub(F.translate(line, HARD_BLANKS, "   "), S + "+", " "))
    label = F.upper(F.regexp_extract(flat, HEADING, 1))
    return F.when(F.rlike(line, F.lit(HEADING_START)), label).otherwise(F.lit(""))


def all_headings(parts: Column) -> Column:
    """Every heading of an array of lines as (item_n, line_no), in line order."""
    marked = F.transform(
        parts, lambda line, i: F.struct(heading_label(line).alias("item_n"), (i + 1).alias("line_no"))
    )
    return F.filter(marked, lambda h: h["item_n"] != "")


def drop_repeats(headings: Column) -> Column:
    """Drop a heading whose label equals the one just before it."""
    return let(
        headings,
        lambda heads: F.filter(
            heads,
            lambda h, i: (i == 0) | (F.lower(h["item_n"]) != F.lower(F.get(heads, i - 1)["item_n"])),
        ),
    )


def item_number(label: Column) -> Column:
    """All digits of a label as one number; NULL if one of them is no decimal digit.

    Numbers too long for an INT come back as the largest one: they are dropped as too high anyway.
    """
    digits = ascii_digits(sub(label, f"[^{digit_class()}]", ""))
    plain = F.rlike(digits, F.lit(r"\A[0-9]+\z"))
    short = F.regexp_replace(digits, r"\A0+(?=[0-9])", "")
    return F.when(plain & (F.length(short) > 9), 2147483647).when(plain, short.try_cast("int"))


def item_numbers(headings: Column) -> Column:
    return F.transform(headings, lambda h: item_number(h["item_n"]))


def plausible_numbers(numbers: Column) -> Column:
    return F.filter(numbers, lambda n: n <= HIGHEST_ITEM)


def round_count(numbers: Column, rounds: str = "previous") -> Column:
    """How often the list of items repeats: the count of the second-highest possible number.

    `previous` counts (highest - 1) and is the rule results are defined by. `max_or_previous` falls
    back to the count of the highest number where (highest - 1) does not occur.
    """
    if rounds not in ROUNDS:
        raise ValueError(f"rounds must be one of {ROUNDS}")

    def count(ns: Column) -> Column:
        top = F.array_max(ns)
        previous = F.size(F.filter(ns, lambda n: n == top - 1))
        if rounds == "previous":
            return previous
        return F.when(previous > 0, previous).otherwise(F.size(F.filter(ns, lambda n: n == top)))

    return let(plausible_numbers(numbers), count)


def label_ladder(highest: Column) -> Column:
    """Item labels in the order they may follow each other, up to the highest number."""
    first = F.array(*[F.lit(x) for x in FIRST_LABELS])
    later = F.flatten(
        F.transform(
            F.sequence(F.lit(LAST_FIXED_ITEM + 1), highest),
            lambda n: F.transform(
                F.array(*[F.lit(x) for x in LATER_LETTERS]), lambda x: F.concat(n.cast("string"), x)
            ),
        )
    )
    return F.when(highest > LAST_FIXED_ITEM, F.concat(first, later)).otherwise(first)


def build_rounds(headings: Column, ladder: Column, count: Column) -> Column:
    """The headings of each round: per ladder label the first one below the last heading taken.

    The position carries over from one round to the next. Once a round finds fewer than two
    headings, no later round can find more, so the remaining ones are skipped.
    """

    def with_places(places: Column) -> Column:
        """`places`: per ladder label its line numbers in order, labels that do not occur left out."""

        def step(state: Column, place: Column) -> Column:
            line = F.get(F.filter(place["line_nos"], lambda n: n > state["last"]), F.lit(0))
            return let(
                line,
                lambda n: F.when(
                    n.isNotNull(),
                    F.struct(
                        n.alias("last"),
                        F.array_append(
                            state["taken"], F.struct(place["item_n"].alias("item_n"), n.alias("line_no"))
                        ).alias("taken"),
                    ),
                ).otherwise(state),
            )

        def one_round(acc: Column, _: Column) -> Column:
            start = F.struct(acc["last"].alias("last"), F.expr(NO_HEADINGS).alias("taken"))
            found = F.aggregate(places, start, step)
            grown = let(
                found,
                lambda r: F.struct(
                    r["last"].alias("last"),
                    F.array_append(acc["rounds"], r["taken"]).alias("rounds"),
                    (F.size(r["taken"]) < 2).alias("short"),
                ),
            )
            return F.when(acc["short"], acc).otherwise(grown)

        first = F.struct(
            F.lit(0).alias("last"), F.expr(f"cast(array() as array<{HEADINGS}>)").alias("rounds"),
            F.lit(False).alias("short"),
        )
        turns = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.aggregate(turns, first, one_round, lambda acc: acc["rounds"])

    places = F.transform(
        ladder,
        lambda label: F.struct(
            label.alias("item_n"),
            F.transform(F.filter(headings, lambda h: h["item_n"] == label), lambda h: h["line_no"]).alias(
                "line_nos"
            ),
        ),
    )
    return let(F.filter(places, lambda p: F.size(p["line_nos"]) > 0), with_places)


HEADINGS = "array<struct<item_n:string,line_no:int>>"
NO_HEADINGS = f"cast(array() as {HEADINGS})"


def best_round(rounds: Column) -> Column:
    """The round with the longest stretch from its second to its last heading; the first one on ties.

    NULL if there is no round, one has fewer than two headings, or no stretch is longer than zero.
    """

    def stretch(r: Column) -> Column:
        return F.get(r, F.size(r) - 1)["line_no"] - F.get(r, F.lit(1))["line_no"]

    def pick(best: Column, r: Column) -> Column:
        return F.when(
            stretch(r) > best["stretch"], F.struct(stretch(r).alias("stretch"), r.alias("taken"))
        ).otherwise(best)

    start = F.struct(F.lit(0).alias("stretch"), F.expr(f"cast(null as {HEADINGS})").alias("taken"))
    best = F.aggregate(rounds, start, pick, lambda acc: acc["taken"])
    return F.when(F.exists(rounds, lambda r: F.size(r) < 2), F.lit(None)).otherwise(best)


def slice_items(parts: Column, chosen: Column, last_line: int | None = None) -> Column:
    """Text and line range of each chosen heading; `last_line` (exclusive) cuts the last item."""

    def cut(bound: Column) -> Column:
        end_of_text = F.size(bound) + 1
        if last_line is not None:
            end_of_text = F.least(end_of_text, F.lit(last_line))

        def item(h: Column, i: Column) -> Column:
            end = F.coalesce(F.get(chosen, i + 1)["line_no"], end_of_text)
            length = F.greatest(end - h["line_no"], F.lit(0))
            return F.struct(
                h["item_n"].alias("item_n"),
                h["line_no"].alias("start_line"),
                (h["line_no"] + length - 1).alias("end_line"),
                unlines(F.slice(bound, h["line_no"], length)).alias("text"),
            )

        return F.transform(chosen, item)

    return let(parts, cut)


def filing_date(text: Column, accession: Column) -> Column:
    """The date after the first colon of the first line that names the accession number.

    Looks only around the first mention, so the text is not cut into lines.
    """

    # Lower case may be longer than the text, so place and line are taken from the same lowered text.
    def line_of(low: Column) -> Column:
        at = F.instr(low, accession)
        before = F.substring_index(F.substr(low, F.lit(1), at - 1), "\n", -1)
        return F.when(at > 0, F.concat(before, F.substring_index(F.substr(low, at), "\n", 1)))

    line = let(F.lower(text), line_of)
    digits = F.regexp_extract(line, rf"\A[^:]*:{S}*([0-9]{{8}})", 1)
    return F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date")


def outline(text: Column, rounds: str = "previous") -> Column:
    """Lines, headings, round count, chosen round and the reason of a failure, as one struct."""

    def choose(heads: Column, numbers: Column, count: Column) -> Column:
        top = F.array_max(plausible_numbers(numbers))
        found = let(top, lambda highest: build_rounds(heads, label_ladder(highest), count))
        return let(found, best_round)

    def with_numbers(parts: Column, heads: Column, numbers: Column) -> Column:
        reason = (
            F.when(F.size(heads) == 0, "no_headings")
            .when(F.exists(numbers, lambda n: n.isNull()), "bad_item_number")
            .when(F.size(plausible_numbers(numbers)) == 0, "no_plausible_item_number")
        )
        counted = F.struct(
            reason.alias("reason"), F.when(reason.isNull(), round_count(numbers, rounds)).alias("rounds")
        )

        def with_count(c: Column) -> Column:
            chosen = F.when(c["rounds"] > 0, choose(heads, numbers, c["rounds"]))
            return let(
                chosen,
                lambda picked: F.struct(
                    parts.alias("parts"),
                    heads.alias("headings"),
                    c["rounds"].alias("rounds"),
                    picked.alias("chosen"),
                    F.when(c["reason"].isNotNull(), c["reason"])
                    .when(c["rounds"] == 0, "no_round")
                    .when(picked.isNull(), "no_usable_round")
                    .alias("reason"),
                ),
            )

        return let(counted, with_count)

    def with_headings(parts: Column) -> Column:
        heads = drop_repeats(all_headings(parts))
        return let(heads, lambda h: let(item_numbers(h), lambda numbers: with_numbers(parts, h, numbers)))

    return let(column_lines(text), with_headings)


def outline_filings(filings: DataFrame, rounds: str = "previous") -> DataFrame:
    """Per filing the lines, headings, rounds and the chosen one, with a status and a reason."""
    return with_once(filings, "outline", outline(F.col("text"), rounds)).select(
        *filings.columns,
        "outline.*",
        F.when(F.col("outline.reason").isNull(), "ok").otherwise("failed").alias("status"),
    )


def split_items(
    filings: DataFrame, rounds: str = "previous", last_line: int | None = None
) -> DataFrame:
    """One row per item of each filing; a filing that fails keeps one row with its reason.

    `filings` has cik, accession, filed_date and text. `last_line=FIXED_LAST_LINE` reproduces the
    fixed cut of the last item. Write the result once, then take `sections` and `rejects` from it.
    """
    return (
        outline_filings(filings, rounds)
        .withColumn("item", F.explode_outer(slice_items(F.col("parts"), F.col("chosen"), last_line)))
        .select("cik", "accession", "filed_date", "item.*", "status", "reason")
    )


def sections(split: DataFrame, item: str | None = None) -> DataFrame:
    """The item rows, optionally of one item label."""
    rows = split.filter(F.col("status") == "ok").drop("status", "reason")
    return rows if item is None else rows.filter(F.col("item_n") == item)


def rejects(split: DataFrame) -> DataFrame:
    return split.filter(F.col("status") != "ok").select("cik", "accession", "status", "reason")
