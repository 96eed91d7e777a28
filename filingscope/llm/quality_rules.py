"""Quality rules as a short-circuit cascade.

A sample tells what each rule costs and how many rows it rejects. Rules run in order of rejections per second; the first that
rejects a text ends its checks. All rules must accept a kept text, so the order changes the work but never the verdict.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.common import WORD_SPACE, map_batches

SYMBOLS = "#*$%&|<>"

# Rows from which cost and selectivity are estimated.
SAMPLE_ROWS = 2000


class Text:
    """A text whose parts are worked out when a rule first asks for them."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, WORD_SPACE))

    @cached_property
    def symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """The lines with a word."""
        return [line for line in self.text.split("\n") if line.strip(WORD_SPACE)]

    @cached_property
    def duplicate_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def repeat_words(self) -> int:
        """Words in three-word windows that occur twice or more, the first occurrence included."""
        n = len(self.words)
        if n < 4:
            return 0
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in self.words), np.int64, n)
        pairs = ids[:-1] * len(numbers) + ids[1:]
        if len(numbers) >= 1 << 20:
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * len(numbers) + ids[2:]
        _, where, counts = np.unique(windows, return_inverse=True, return_counts=True)
        again = np.flatnonzero(counts[where] > 1)
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[again + k] = True
        return int(covered.sum())

    @cached_property
    def base_failed(self) -> bool:
        n = len(self.words)
        return n < 50 or 100 * self.repeat_words > 50 * n


def _capitals(text: Text) -> bool:
    upper = sum(map(text.text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return 10 * upper <= 4 * text.word_chars


# What a text must satisfy, in integers so that no rounding decides.
RULES: dict[str, Callable[[Text], bool]] = {
    "few_symbols": lambda t: 10 * t.symbols <= 3 * len(t.words),
    "word_length": lambda t: 2 * len(t.words) <= t.word_chars <= 20 * len(t.words),
    "no_shouting": _capitals,
    "few_exclamations": lambda t: 2 * t.text.count("!") <= len(t.words),
    "few_repeated_lines": lambda t: 10 * t.duplicate_lines <= 5 * len(t.lines),
    "no_ruling_word": lambda t: not t.words or 10 * Counter(t.words).most_common(1)[0][1] <= 3 * len(t.words),
}


def cascade_order(docs: DataFrame, rules: dict[str, Callable[[Text], bool]] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules, most rejections per second on a sample first."""
    total = docs.count()
    if not total:
        return list(rules)
    sample = docs.select("text").sample(min(1.0, sample_rows / total), seed=7)

    def run(batches):
        for batch in batches:
            spent, rejected = dict.fromkeys(rules, 0), dict.fromkeys(rules, 0)
            for text in batch.column(0).to_pylist():
                for name, rule in rules.items():
                    view = Text(text)  # afresh: the cost of a rule includes what it has to work out
                    start = time.perf_counter_ns()
                    rejected[name] += not rule(view)
                    spent[name] += time.perf_counter_ns() - start
            columns = [pa.array(list(rules)), pa.array(list(spent.values()), pa.int64()), pa.array(list(rejected.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["rule", "ns", "rejected"])

    rows = map_batches(sample, run, "rule string, ns long, rejected long").groupBy("rule").agg(F.sum("ns").alias("ns"), F.sum("rejected").alias("rejected")).collect()
    gain = {row["rule"]: (row["rejected"] / max(1, row["ns"]), -row["ns"]) for row in rows}
    return sorted(rules, key=lambda name: gain.get(name, (0, 0)), reverse=True)


def apply_rules(docs: DataFrame, rules: dict[str, Callable[[Text], bool]] = RULES, order: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_rules_run of every row.

    Null and empty texts have zeros and fail the base check; a text that fails it runs no rule. Repeated rows are judged each.
    """
    order = cascade_order(docs, rules) if order is None else order

    def run(batches):
        cascade = [rules[name] for name in order]
        for batch in batches:
            out: list[tuple] = []
            for raw in batch.column(1).to_pylist():
                text = Text(raw)
                kept, ran = not text.base_failed, 0
                if kept:
                    for rule in cascade:
                        ran += 1
                        if not rule(text):
                            kept = False
                            break
                out.append((len(text.words), text.word_chars, text.symbols, text.duplicate_lines, text.repeat_words, text.base_failed, kept, ran))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]
            columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], NAMES)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_rules_run long"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_rules_run"]
