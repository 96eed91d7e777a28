"""How the text of a section changed from one filing to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingscope.functions.edit_distance import (
    line_measures_left,
    line_measures_longer,
    token_line_difference,
    token_line_distance,
)
from filingscope.functions.ordered import broadcast_if_small, packed, stored

BASES = ("longer", "newer")
# Table cells, in tokens by tokens, that one task should have at most: about half a minute for unlike texts.
TASK_COST = 2e10
# A word list of up to this many rows is broadcast; a larger one is joined by shuffling.
LEXICON_BROADCAST_ROWS = 200_000
# Fixed value: the normaliser of a valence sum, valence / sqrt(valence^2 + 15).
VALENCE_ALPHA = 15
# Degree words, which only modify a neighbour and score 0 alone.
DEGREE_WORDS = (
    "absolutely amazingly awfully completely considerably decidedly deeply effing enormously entirely "
    "especially exceptionally extremely fabulously flipping flippin fricking frickin frigging friggin fully "
    "fucking greatly hella highly hugely incredibly intensely majorly more most particularly purely quite "
    "really remarkably so substantially thoroughly totally tremendously uber unbelievably unusually utterly "
    "very almost barely hardly kinda kindof less little marginally occasionally partly scarcely slightly "
    "somewhat sorta sortof"
).split()
# Fixed value: a word with one apostrophe before or after it is looked up without it.
QUOTED_WORD = r"\A'([a-z]{2,})\z|\A([a-z]{2,})'\z"

PAIR_KEY = ["cik", "filing_a", "filing_b"]


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), 0)


def token_line(text: Column) -> Column:
    """The same tokens joined by single blanks: a compact form to shuffle."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z']+", " "))


def token_count(line: Column) -> Column:
    blanks = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(line == "", 0).otherwise(blanks + 1).cast("int")


def similarity(distance: Column, len_a: Column, len_b: Column) -> Column:
    """1 - distance / (len_a + len_b); two empty texts are equal."""
    return 1 - F.coalesce(F.try_divide(distance, len_a + len_b), F.lit(0.0))


def pair_texts(sections: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs with the token lines of both sides, words_a and words_b, in partitions of about equal work.

    The work of a pair grows with the product of its lengths, not with its bytes. So pairs, keys and lengths only, are first packed into
    partitions by cumulated cost; then both texts are fetched by filing key, which is unique, and moved to the pair's partition.
    Texts are tokenised once.
    """
    spark = sections.sparkSession
    words = stored(sections.select("cik", "accession", token_line(F.col("text")).alias("words")).withColumn("_n", token_count(F.col("words"))))
    costed = pairs
    for side in ("a", "b"):
        lengths = words.select("cik", F.col("accession").alias(f"filing_{side}"), F.col("_n").alias(f"_n_{side}"))
        costed = costed.join(lengths, ["cik", f"filing_{side}"])
    cost = (F.col("_n_a") + 1.0) * (F.col("_n_b") + 1.0)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered, parts = packed(stored(costed), PAIR_KEY, cost, least, TASK_COST, into="_part")
    for side in ("a", "b"):
        texts = words.select("cik", F.col("accession").alias(f"filing_{side}"), F.col("words").alias(f"words_{side}"))
        numbered = numbered.join(texts, ["cik", f"filing_{side}"])
    return numbered.repartitionById(parts, "_part").select(*pairs.columns, "words_a", "words_b")


def with_tokens(sections: DataFrame) -> DataFrame:
    """Sections with at least one token; the test stops at the first one."""
    return sections.filter(F.rlike(F.lower("text"), F.lit("[a-z']")))


def uncomparable(texts: DataFrame) -> DataFrame:
    """Pairs with an empty side. Only these pairs are left out, not the whole firm."""
    return texts.filter((F.col("words_a") == "") | (F.col("words_b") == "")).select(
        *PAIR_KEY, F.lit("empty_section").alias("reason")
    )


def pair_rejects(sections: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs that cannot be compared: a side lacks the section, or its section has no token.

    `pairs` are those of all dated filings, so that a filing without the section costs its own two
    pairs and never moves its neighbours together.
    """
    state = sections.select("cik", "accession", (token_line(F.col("text")) == "").alias("empty"))
    joined = pairs.select(*PAIR_KEY)
    for side in ("a", "b"):
        own = state.select("cik", F.col("accession").alias(f"filing_{side}"), F.col("empty").alias(f"empty_{side}"))
        joined = joined.join(own, ["cik", f"filing_{side}"], "left")
    missing = F.col("empty_a").isNull() | F.col("empty_b").isNull()
    reason = F.when(missing, "missing_section").when(F.col("empty_a") | F.col("empty_b"), "empty_section")
    return joined.select(*PAIR_KEY, reason.alias("reason")).filter(F.col("reason").isNotNull())


def edit_distances(texts: DataFrame, key: list[str] = PAIR_KEY) -> DataFrame:
    """Token edit distance, similarity and token counts per pair."""
    a, b = F.col("words_a"), F.col("words_b")
    measured = texts.select(
        *key,
        token_line_distance(a, b).alias("distance"),
        token_count(a).alias("len_a"),
        token_count(b).alias("len_b"),
    )
    return measured.withColumn(
        "similarity", similarity(F.col("distance"), F.col("len_a"), F.col("len_b"))
    )


def _new_word_line(basis: str) -> Column:
    """Token line of the words that only one side has.

    `longer` takes the side with more tokens (the newer on ties), `newer` always the newer one. The
    difference is taken inside each row, so it needs memory for one pair only.
    """
    if basis not in BASES:
        raise ValueError(f"basis must be one of {BASES}")
    a, b = F.col("words_a"), F.col("words_b")
    swap = token_count(b) > token_count(a) if basis == "longer" else F.lit(False)
    return token_line_difference(F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b))


def _words(line: str) -> Column:
    """The tokens of a line; one NULL if there is none."""
    return F.explode_outer(F.when(F.col(line) != "", F.split(line, " "))).alias("word")


def new_word_rows(texts: DataFrame, basis: str = "longer", key: list[str] = PAIR_KEY) -> DataFrame:
    """One row per new word and occurrence: key, word; a pair without one has a single NULL word."""
    lines = texts.select(*key, _new_word_line(basis).alias("_line"))
    return lines.select(*key, _words("_line"))


def new_words(texts: DataFrame, basis: str = "longer", key: list[str] = PAIR_KEY) -> DataFrame:
    """New words with how often they occur: key, word, occurrences."""
    found = new_word_rows(texts, basis, key).filter(F.col("word").isNotNull())
    return found.groupBy(*key, "word").agg(F.count("*").alias("occurrences"))


def lexicon_key(word: Column) -> Column:
    """The form a single word is looked up by; NULL for words that always score 0."""
    bare = F.concat(F.regexp_extract(word, QUOTED_WORD, 1), F.regexp_extract(word, QUOTED_WORD, 2))
    key = F.when(bare != "", bare).otherwise(word)
    return F.when((F.length(key) > 1) & ~key.isin(*DEGREE_WORDS), key)


def word_score(valence: Column) -> Column:
    """The compound score of one word alone."""
    return F.coalesce(F.round(valence / F.sqrt(valence * valence + F.lit(VALENCE_ALPHA)), 4), F.lit(0.0))


def mean_sentiment(words: DataFrame, lexicon: DataFrame, key: list[str] = PAIR_KEY) -> DataFrame:
    """Mean score of the word rows of each key, 0 where all are NULL; unknown words count as 0."""
    scores = lexicon.select(F.col("word").alias("_lookup"), word_score(F.col("valence")).alias("_score"))
    # Rows without a lookup form get one that no lexicon has, a different one for each key: a shuffle spreads them.
    nowhere = F.concat(F.lit("\x00"), F.xxhash64(*key).cast("string"))
    scored = words.withColumn("_lookup", F.coalesce(lexicon_key(F.col("word")), nowhere)).join(
        broadcast_if_small(scores, LEXICON_BROADCAST_ROWS), "_lookup", "left"
    )
    total = F.coalesce(F.sum("_score"), F.lit(0.0))
    mean = F.coalesce(F.try_divide(total, F.count("word")), F.lit(0.0))
    return scored.groupBy(*key).agg(mean.alias("sentiment"))


def compare_sections(
    sections: DataFrame, pairs: DataFrame, lexicon: DataFrame, basis: str = "longer"
) -> DataFrame:
    """One row of measures per pair: ticker, dates, distance, similarity, lengths, sentiment.

    Distance and new words come from one pass over the joined texts; after it only the new words and
    a few numbers per pair move on.
    """
    if basis not in BASES:
        raise ValueError(f"basis must be one of {BASES}")
    measures = ["date_a", "date_b", "distance", "len_a", "len_b"]
    measure = line_measures_longer if basis == "longer" else line_measures_left
    texts = pair_texts(with_tokens(sections), pairs)
    measured = texts.select(*PAIR_KEY, "date_a", "date_b", measure("words_a", "words_b").alias("m")).select(
        *PAIR_KEY, "date_a", "date_b", "m.distance", "m.len_a", "m.len_b", F.col("m.new_words").alias("_line")
    )
    rows = mean_sentiment(
        measured.select(*PAIR_KEY, *measures, _words("_line")), lexicon, [*PAIR_KEY, *measures]
    )
    return rows.select(
        F.col("cik").alias("ticker"),
        "date_a",
        "date_b",
        "distance",
        similarity(F.col("distance"), F.col("len_a"), F.col("len_b")).alias("similarity"),
        "len_a",
        "len_b",
        "sentiment",
    )
