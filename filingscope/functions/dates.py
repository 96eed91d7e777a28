"""Date parsing, key normalisation and the month anchors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingscope.functions.text import let

# The shape of a date text and the format that reads it. In a shape, 9 stands for a number of one or two digits, longer ones for
# as many digits, and a word for a month's name.
SHAPES = {
    "9999-9-9": "yyyy-M-d",
    "99999999": "yyyyMMdd",
    "9999/9/9": "yyyy/M/d",
    "9/9/9999": ("M/d/yyyy", "d/M/yyyy"),
    "9-9-9999": ("M-d-yyyy", "d-M-yyyy"),
    "9.9.9999": ("M.d.yyyy", "d.M.yyyy"),
    "9 month 9999": "d MMM yyyy",
    "month 9, 9999": "MMM d, yyyy",
}
MONTH_NAME = r"(?i)\b(jan)(?:uary)?\b|\b(feb)(?:ruary)?\b|\b(mar)(?:ch)?\b|\b(apr)(?:il)?\b|\b(may)\b|\b(jun)e?\b|\b(jul)y?\b|\b(aug)(?:ust)?\b|\b(sep)(?:t|tember)?\b|\b(oct)(?:ober)?\b|\b(nov)(?:ember)?\b|\b(dec)(?:ember)?\b"
# A time of day after the date, which is dropped.
TIME_OF_DAY = r"(?<=\d)[ T](?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?(?:Z|[+-]\d\d:?\d\d)?$"

# Fixed value: an accession number; the middle group is the two-digit year.
ACCESSION = r"^\d{10}-(\d{2})-\d{6}$"


def normalise_cik(cik: Column) -> Column:
    """A CIK as a trimmed string, zero-padded to ten; longer keys are kept whole."""
    text = F.trim(cik.cast("string"))
    return F.when(F.length(text) >= 10, text).otherwise(F.lpad(text, 10, "0"))


def parse_date(text: Column, day_first: bool) -> Column:
    """The date of a text in any of SHAPES, NULL if it is none; each value is parsed once, by the format of its shape.

    Where both readings of two leading numbers are possible, `day_first` decides; where the one that is asked for names no month,
    the other one holds.
    """
    bare = F.regexp_replace(F.trim(text), TIME_OF_DAY, "")
    short = F.when(F.rlike(bare, F.lit("[A-Za-z]")), F.initcap(F.regexp_replace(bare, MONTH_NAME, "$1$2$3$4$5$6$7$8$9$10$11$12"))).otherwise(bare)
    return let(short, lambda own: let(_shape(own), lambda shape: _read(own, shape, day_first))).cast("date")


def _shape(text: Column) -> Column:
    """The text with 9 for each digit, one for a number of one or two, and a word for a name of three letters."""
    digits = F.regexp_replace(F.regexp_replace(text, r"\d", "9"), r"(?<!9)99(?!9)", "9")
    return F.regexp_replace(digits, r"\b[A-Z][a-z]{2}\b", "month")


def _read(text: Column, shape: Column, day_first: bool) -> Column:
    """The text by the format of its shape. A leading number above 12 is no month, so the other reading holds."""
    leading = F.regexp_extract(text, r"^(\d+)[-/.](\d+)[-/.]", 2 if day_first else 1)
    swapped = (F.length(leading) == 2) & (leading > "12")
    out = F.lit(None).cast("timestamp")
    for pattern, form in SHAPES.items():
        if isinstance(form, tuple):
            usual, other = reversed(form) if day_first else form
            read = F.when(swapped, F.try_to_timestamp(text, F.lit(other))).otherwise(F.try_to_timestamp(text, F.lit(usual)))
        else:
            read = F.try_to_timestamp(text, F.lit(form))
        out = F.when(shape == pattern, read).otherwise(out)
    return out


def parse_mixed_date(text: Column) -> Column:
    """Day-first parse of a column whose values come in several formats; NULL if none fits."""
    return parse_date(text, day_first=True)


def parse_coerced_date(text: Column) -> Column:
    """Month-first parse of a column whose values come in several formats; NULL if none fits."""
    return parse_date(text, day_first=False)


def parse_iso_date(text: Column) -> Column:
    """ISO parse where anything invalid becomes NULL."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    ).cast("date")


def accession_year(accession: Column, pivot: int = 70) -> Column:
    """The four-digit year inside an accession number; NULL if the text is no accession number."""
    digits = F.regexp_extract(accession, ACCESSION, 1)
    yy = F.when(digits != "", digits.cast("int"))
    return F.when(yy >= pivot, yy + 1900).otherwise(yy + 2000)


def start_anchor(date: Column) -> Column:
    """The first day of the month after `date`, also when `date` is itself a first day."""
    return F.add_months(F.trunc(date, "MM"), 1)


def compact_date_parts(text: Column) -> dict[str, Column]:
    """Year, month and day substrings of a YYYYMMDD text."""
    return {
        "year": F.substring(text, 1, 4),
        "month": F.substring(text, 5, 2),
        "day": F.substring(text, 7, 2),
    }


def iso_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")
