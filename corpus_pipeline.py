"""From raw documents to tokens: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingscope.llm import bpe, decontamination, language_id, simhash_dedup, suffix_array_dedup
from filingscope.llm.common import free_names, read_table, saved

# A text this far from all learned languages is in none of them; clean texts score 0.4 and more, the shortest ones included.
MIN_LANGUAGE_SCORE = 0.25

# A passage is removed if it has so many words. Of 51 neighbouring words of the prose at hand 99 % have more than 204 bytes.
REPEATED_WORDS = 50
REPEATED_BYTES = 200


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus names; those without a letter or near no language go."""
    return language_id.identified(docs, language_id.fit(docs), MIN_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return simhash_dedup.one_of_each(docs, shingle_words=3, max_bits=3)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages: stretches of REPEATED_WORDS words or more, all of whose bytes lie in byte strings of REPEATED_BYTES
    that occur elsewhere too. Shorter repeated lines stay. Bytes of a character that was cut through go as well, and so do
    replacement characters in a text that was cut. A document stays even if nothing is left of it."""
    spans, kept, n_bytes = names = free_names(docs, "spans", "kept", "n_bytes")
    found = suffix_array_dedup.remove_repeats(docs, REPEATED_BYTES, REPEATED_WORDS, names)
    left = suffix_array_dedup.readable(F.col(kept))
    changed = {"text": left} | ({"n_chars": F.length(left).cast("long")} if "n_chars" in docs.columns else {})
    new = {name: F.when(F.size(spans) > 0, value).otherwise(F.col(name)) for name, value in changed.items()}
    return found.withColumns(new).select(*docs.columns)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontamination.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, with the hash of their decoded bytes."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.round_trip(docs, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )


STAGES = [
    ("languages", languages),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("contamination", contamination),
    ("tokens", tokens),
]

# Iterated components, suffix orders and merges have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
