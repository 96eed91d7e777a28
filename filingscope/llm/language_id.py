"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (one to three letters, word ends marked) in order of frequency. A text's
profile is compared with each language's by the out-of-place distance: the sum over the text's n-grams of how far their
ranks lie apart, or of the profile length where the language's profile lacks the n-gram. The nearest language wins.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingscope.llm.common import map_batches, shared

UNKNOWN = "und"
PROFILE_LENGTH = 400

# The profiles sent to the workers have at most so many languages of PROFILE_LENGTH n-grams.
MAX_LANGUAGES = 2000

# N-gram counts a training task gathers before it passes them on.
GATHERED_GRAMS = 1_000_000

BITS = np.int64(21)  # a code point, shifted by one so that 0 stands for no letter and 1 for a word end


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code of each code point: its number + 1 for letters, 1 (word end) for the rest."""
    return np.fromiter((c + 1 if chr(c).isalpha() else 1 for c in range(sys.maxunicode + 1)), np.int64)


def grams(text: str) -> np.ndarray:
    """All n-grams of a text as integers, repeats included."""
    points = np.frombuffer(("\n" + text.lower() + "\n").encode("utf-32-le", "replace"), np.uint32)
    codes = _letters()[points]
    codes = codes[np.r_[True, (codes[1:] != 1) | (codes[:-1] != 1)]]  # one word end between two words
    one = codes[codes != 1]
    if not len(one):
        return one
    two = codes[:-1] << BITS | codes[1:]
    three = (two[:-1] << BITS | codes[2:])[codes[1:-1] != 1]
    return np.concatenate([one, two, three])


def ranked(text: str, length: int = PROFILE_LENGTH) -> np.ndarray:
    """The n-grams of a text's profile, most frequent first, smaller number first among equals."""
    found, counts = np.unique(grams(text), return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:length]]


def profiles(docs: DataFrame, length: int = PROFILE_LENGTH) -> DataFrame:
    """lang, gram, rank (from 0): the profile of each non-null lang over all its whole texts."""

    def run(batches):
        gathered: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def passed_on():
            for lang, parts in gathered.items():
                found, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(counts)], ["lang", "gram", "n"])

        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                part = np.unique(grams("\n".join(own)), return_counts=True)
                gathered.setdefault(lang, []).append(part)
                held += len(part[0])
            if held > GATHERED_GRAMS:
                yield from passed_on()
                gathered, held = {}, 0
        yield from passed_on()

    known = docs.select("lang", "text").where("lang is not null and text is not null")
    counts = map_batches(known, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # The filter is on the row number itself: so Spark drops what is no candidate before the shuffle to one task for each language.
    first = counts.withColumn("place", F.row_number().over(by_count)).where(F.col("place") <= length)
    return first.select("lang", "gram", (F.col("place") - 1).alias("rank"))


def fit(docs: DataFrame, length: int = PROFILE_LENGTH) -> dict[str, list[int]]:
    """The profiles on the driver: at most MAX_LANGUAGES lists of `length` numbers."""
    found = profiles(docs, length).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("own"))
    rows = found.select("lang", F.col("own.gram").alias("grams")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {row["lang"]: list(row["grams"]) for row in rows}


class _Nearest:
    """The profiles as one table of ranks: a row for each n-gram that any has, a column for each language."""

    def __init__(self, model: dict[str, list[int]], length: int) -> None:
        self.names, self.length = sorted(model), length
        self.every = np.unique(np.array([g for name in self.names for g in model[name]], np.int64))
        self.ranks = np.full((len(self.every) + 1, max(1, len(self.names))), -1, np.int32)  # last row: in no profile
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.every, np.array(model[name], np.int64)), j] = np.arange(len(model[name]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        own = ranked(text, self.length) if text and len(self.every) else ()
        if not len(own):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.every, own), len(self.every) - 1)
        theirs = self.ranks[np.where(self.every[at] == own, at, len(self.every))]
        apart = np.where(theirs < 0, self.length, np.abs(theirs - np.arange(len(own))[:, None])).sum(0)
        best = int(np.argmin(apart))
        return self.names[best], 1.0 - float(apart[best]) / (self.length * len(own))


def predict(docs: DataFrame, model: dict[str, list[int]], length: int = PROFILE_LENGTH) -> DataFrame:
    """doc_id, lang_pred and score of every row.

    The score is 1 less the distance as a share of the largest possible. Texts that are null or have no letter, and all texts if
    there is no profile, are `und` with score 0. Equally near languages: the first by name. Repeated rows are scored each. A very long text is
    counted whole by one task. Other columns are not read.
    """
    sent = shared(docs.sparkSession, _Nearest(model, length))

    def run(batches):
        for batch in batches:
            found = [sent.value(text) for text in batch.column(1).to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "lang_pred", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, model: dict[str, list[int]], min_score: float, length: int = PROFILE_LENGTH) -> DataFrame:
    """The rows of `docs`, all columns, whose text has a language with a score of `min_score` or more."""
    sent = shared(docs.sparkSession, _Nearest(model, length))
    text_at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            found = [sent.value(text) for text in batch.column(text_at).to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in found], pa.bool_()))

    return map_batches(docs, run, docs.schema)
