"""Pairs and text change: W2, O1, J6, J7, M1-M7."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingscope.catalog.registry import derived, query
from filingscope.functions.edit_distance import token_line_shared
from filingscope.functions.ordered import stored
from filingscope.operators import pairs as pr
from filingscope.operators import similarity as sim

WORDS = "regexp_extract_all(lower(text), '[a-z'']+')"

# Each source is a firm, each text a section; two texts share a day. Every 17th text has a row without a word after it.
derived(
    "doc_sections",
    """
    SELECT source AS cik, lpad(CAST(doc_id AS STRING), 10, '0') AS accession,
      DATE '2000-01-01' + CAST(floor(doc_id / 2) AS INT) AS filed_date, '1A' AS item_n, text
    FROM {documents}
    UNION ALL
    SELECT source, concat(lpad(CAST(doc_id AS STRING), 10, '0'), 'e'),
      DATE '2000-01-01' + CAST(floor(doc_id / 2) AS INT), '1A', '12 -- 34'
    FROM {documents} WHERE doc_id % 17 = 0
    """,
)
# Each conversation is a firm, each turn a section.
derived(
    "turn_sections",
    """
    SELECT lpad(CAST(conv_id AS STRING), 10, '0') AS cik, lpad(CAST(turn AS STRING), 10, '0') AS accession,
      DATE '2000-01-01' + CAST(turn AS INT) AS filed_date, '1A' AS item_n, text
    FROM {conversations}
    """,
)
derived(
    "lexicon",
    f"""
    SELECT word, CAST((length(word) * 3 + ascii(word)) % 9 - 4 AS DOUBLE) AS valence
    FROM (SELECT DISTINCT unnest({WORDS}) AS word FROM {{benchmark}})
    """,
    spark=lambda t: t["benchmark"]
    .select(F.explode(sim.tokens(F.col("text"))).alias("word"))
    .distinct()
    .withColumn("valence", ((F.length("word") * 3 + F.ascii("word")) % 9 - 4).cast("double")),
)

for name in ("doc", "turn"):
    derived(
        f"{name}_pairs",
        f"""
        SELECT cik, accession AS filing_a, filed_date AS date_a, filing_b, date_b
        FROM (SELECT cik, accession, filed_date, lag(accession) OVER w AS filing_b, lag(filed_date) OVER w AS date_b
          FROM {{{name}_sections}} WINDOW w AS (PARTITION BY cik ORDER BY filed_date, accession))
        WHERE filing_b IS NOT NULL
        """,
        spark=lambda t, name=name: pr.consecutive_pairs(t[f"{name}_sections"]),
    )
    derived(
        f"{name}_tokens_check",
        f"SELECT cik, accession, {WORDS} AS toks, len({WORDS}) AS n FROM {{{name}_sections}}",
    )
    derived(
        f"{name}_texts",
        f"""
        SELECT p.cik, filing_a, filing_b, date_a, date_b, a.toks AS ta, b.toks AS tb, a.n AS la, b.n AS lb
        FROM {{{name}_pairs}} p JOIN {{{name}_tokens_check}} a ON a.cik = p.cik AND a.accession = filing_a
        JOIN {{{name}_tokens_check}} b ON b.cik = p.cik AND b.accession = filing_b
        """,
        spark=lambda t, name=name: sim.pair_texts(sim.with_tokens(t[f"{name}_sections"]), t[f"{name}_pairs"]),
    )


def _new_words_sql(table: str, basis: str) -> str:
    newer = "true" if basis == "newer" else "la >= lb"
    return f"""
    SELECT cik, filing_a, filing_b, word, count(*) AS occurrences
    FROM (SELECT cik, filing_a, filing_b, unnest(side) AS word, other
      FROM (SELECT *, CASE WHEN {newer} THEN ta ELSE tb END AS side, CASE WHEN {newer} THEN tb ELSE ta END AS other
        FROM {{{table}}} WHERE la > 0 AND lb > 0))
    WHERE NOT list_contains(other, word) GROUP BY cik, filing_a, filing_b, word
    """


def _sentiment_sql(table: str, basis: str) -> str:
    degree = ", ".join(f"'{w}'" for w in sim.DEGREE_WORDS)
    key = """CASE WHEN regexp_matches(word, '^''[a-z]{2,}$') THEN word[2:]
        WHEN regexp_matches(word, '^[a-z]{2,}''$') THEN word[:-2] ELSE word END"""
    return f"""
    SELECT cik, filing_a, filing_b, round(sum(occurrences * coalesce(round(valence / sqrt(valence * valence + 15), 4), 0))
      / sum(occurrences), 9) AS sentiment
    FROM (SELECT *, {key} AS k FROM ({_new_words_sql(table, basis)})) w
    LEFT JOIN {{lexicon}} x ON x.word = w.k AND length(w.k) > 1 AND w.k NOT IN ({degree})
    GROUP BY cik, filing_a, filing_b
    UNION ALL
    SELECT cik, filing_a, filing_b, 0 FROM {{{table}}} t WHERE la > 0 AND lb > 0 AND NOT EXISTS (
      SELECT 1 FROM ({_new_words_sql(table, basis)}) n
      WHERE n.cik = t.cik AND n.filing_a = t.filing_a AND n.filing_b = t.filing_b)
    """


DISTANCE_SQL = """
    WITH RECURSIVE texts AS MATERIALIZED (
      SELECT row_number() OVER () AS p, * FROM {turn_texts} WHERE la > 0 AND lb > 0),
    walk AS (
      SELECT p, 0 AS i, CAST(unnest(range(0, lb + 1)) AS INT) AS j, CAST(unnest(range(0, lb + 1)) AS INT) AS d FROM texts
      UNION ALL
      SELECT p, i + 1, j, CAST(j + min(t - j) OVER (PARTITION BY p ORDER BY j) AS INT) FROM (
        SELECT w.p, w.i, w.j, CASE WHEN w.j = 0 THEN w.i + 1 ELSE least(w.d + 1, lag(w.d) OVER (PARTITION BY w.p ORDER BY w.j)
          + CASE WHEN ta[w.i + 1] = tb[w.j] THEN 0 ELSE 1 END) END AS t
        FROM walk w JOIN texts ON texts.p = w.p WHERE w.i < la)),
    measured AS (
      SELECT cik, filing_a, filing_b, date_a, date_b, d AS distance, 1 - d / (la + lb) AS similarity, la AS len_a, lb AS len_b
      FROM texts JOIN walk ON walk.p = texts.p AND i = la AND j = lb)
"""

query(
    "o1_newest_first",
    lambda t: pr.newest_first(t["doc_sections"]),
    """SELECT cik, accession, strftime(filed_date, '%Y-%m-%d') AS filed,
      row_number() OVER (ORDER BY filed_date DESC, accession DESC, cik DESC) AS place FROM {doc_sections}""",
)
query(
    "w2_consecutive_pairs",
    lambda t: pr.consecutive_pairs(t["doc_sections"]),
    "SELECT * FROM {doc_pairs}",
)
derived(
    "item_sections",
    "SELECT cik, accession, CASE WHEN filed_date < DATE '2000-04-01' THEN '7' ELSE '1A' END AS item_n FROM {doc_sections}",
)
query(
    "j6_with_section",
    lambda t: pr.with_section(t["doc_sections"].select("cik", "accession", "filed_date"), t["item_sections"]),
    """
    SELECT cik, accession, filed_date FROM {doc_sections} d WHERE EXISTS (
      SELECT 1 FROM {item_sections} i WHERE i.cik = d.cik AND i.accession = d.accession AND item_n = '1A')
    """,
)
query(
    "m1_tokens",
    lambda t: t["documents"].select(
        "doc_id",
        F.array_join(sim.tokens(F.col("text")), " ").alias("words"),
        sim.token_count(sim.token_line(F.col("text"))).alias("n"),
    ),
    f"SELECT doc_id, array_to_string({WORDS}, ' ') AS words, len({WORDS}) AS n FROM documents",
)
query(
    "m2_edit_distance_turns",
    lambda t: sim.edit_distances(t["turn_texts"]).drop("similarity"),
    DISTANCE_SQL + "SELECT cik, filing_a, filing_b, distance, len_a, len_b FROM measured",
)
query("m2_edit_distance_documents", lambda t: sim.edit_distances(t["doc_texts"]))


def _edited(t):
    """Each text beside a copy that loses every 7th token and gets a foreign word for every 5th other."""
    # The test for a token stops at the first one, and keys alone can be read without cutting a text.
    lines = sim.with_tokens(t["documents"]).select("doc_id", sim.token_line(F.col("text")).alias("words_b"))
    edited = F.filter(
        F.transform(F.split("words_b", " "), lambda w, i: F.when((i + 1) % 7 == 0, "").when((i + 1) % 5 == 0, "''''''''").otherwise(w)),
        lambda w: w != "",
    )
    return lines.select("doc_id", F.array_join(edited, " ").alias("words_a"), "words_b")


# No foreign word can match, so at most n - dropped - replaced tokens match and the distance is exactly
# dropped + replaced: whole texts are checked without a quadratic table.
query(
    "m2_edit_distance_edited",
    lambda t: sim.edit_distances(_edited(t), key=["doc_id"]).select(
        "doc_id", "distance", "len_a", "len_b", F.round("similarity", 9).alias("similarity")
    ),
    f"""
    WITH c AS (SELECT doc_id, len({WORDS}) AS n FROM documents),
    e AS (SELECT doc_id, n, n // 7 AS dropped, n // 5 - n // 35 AS replaced FROM c WHERE n > 0)
    SELECT doc_id, dropped + replaced AS distance, n - dropped AS len_a, n AS len_b,
      round(1 - (dropped + replaced) / (2 * n - dropped), 9) AS similarity FROM e
    """,
)
query(
    "m3_similarity",
    lambda t: sim.edit_distances(_edited(t), key=["doc_id"]).select(
        "doc_id", F.round(sim.similarity(F.col("distance"), F.col("len_a"), F.col("len_b")), 9).alias("similarity")
    ),
    f"""
    SELECT doc_id, round(1 - (n // 7 + n // 5 - n // 35) / (2 * n - n // 7), 9) AS similarity
    FROM (SELECT doc_id, len({WORDS}) AS n FROM documents) WHERE n > 0
    """,
)
for basis in sim.BASES:
    query(
        f"m4_new_words_{basis}",
        lambda t, basis=basis: sim.new_words(t["doc_texts"], basis),
        _new_words_sql("doc_texts", basis),
    )
    query(
        f"m5_sentiment_{basis}",
        lambda t, basis=basis: sim.mean_sentiment(sim.new_word_rows(t["doc_texts"], basis), t["lexicon"]).withColumn(
            "sentiment", F.round("sentiment", 9)
        ),
        _sentiment_sql("doc_texts", basis),
    )
query(
    "j7_words_not_in_other",
    lambda t: sim.new_words(t["turn_texts"], "newer").select(*sim.PAIR_KEY, "word"),
    f"SELECT cik, filing_a, filing_b, word FROM ({_new_words_sql('turn_texts', 'newer')})",
)
query(
    "m6_compare_sections",
    lambda t: sim.compare_sections(t["doc_sections"], t["doc_pairs"], t["lexicon"]),
)
# What an exact distance of whole documents must meet, beside lengths and sentiment in full.
query(
    "m6_section_facts",
    lambda t: sim.compare_sections(t["doc_sections"], t["doc_pairs"], t["lexicon"]).select(
        "ticker", "date_a", "date_b", "len_a", "len_b", F.round("sentiment", 9).alias("sentiment"),
        F.col("distance").between(F.abs(F.col("len_a") - F.col("len_b")), F.greatest("len_a", "len_b")).alias("possible"),
        (F.abs(F.col("similarity") - (1 - F.col("distance") / (F.col("len_a") + F.col("len_b")))) < 1e-12).alias("consistent"),
    ),
    f"""
    SELECT t.cik AS ticker, date_a, date_b, la AS len_a, lb AS len_b, coalesce(sentiment, 0) AS sentiment, TRUE AS possible, TRUE AS consistent
    FROM {{doc_texts}} t LEFT JOIN ({_sentiment_sql("doc_texts", "longer")}) USING (cik, filing_a, filing_b) WHERE la > 0 AND lb > 0
    """,
)


def _shared_by_word(texts):
    counts = [
        texts.select(*sim.PAIR_KEY, F.explode(F.split(f"words_{side}", " ")).alias("word")).groupBy(*sim.PAIR_KEY, "word").agg(F.count("*").alias(side))
        for side in ("a", "b")
    ]
    return counts[0].join(counts[1], [*sim.PAIR_KEY, "word"]).groupBy(*sim.PAIR_KEY).agg(F.sum(F.least("a", "b")).alias("shared"))


def _distance_facts(t):
    """The tokens that both sides share, repeats counted, bound the distance: at least what the longer side has beyond them."""
    texts = t["doc_texts"]
    # Taken inside the row; only keys that stand in several rows are counted word by word over all of them.
    alone = token_line_shared("words_a", "words_b").alias("alone")
    rows = stored(sim.edit_distances(texts.select("*", alone), [*sim.PAIR_KEY, "alone"]))
    repeated = rows.groupBy(*sim.PAIR_KEY).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    if repeated.isEmpty():
        rows = rows.withColumnRenamed("alone", "shared")
    else:
        shared = _shared_by_word(texts.join(repeated, sim.PAIR_KEY, "left_semi"))
        rows = rows.join(shared, sim.PAIR_KEY, "left").withColumn("shared", F.coalesce("shared", "alone"))
    least = F.greatest("len_a", "len_b") - F.coalesce("shared", F.lit(0))
    return rows.select(*sim.PAIR_KEY, "len_a", "len_b", least.alias("least"), F.col("distance").between(least, F.greatest("len_a", "len_b")).alias("possible"))


query(
    "m2_document_facts",
    _distance_facts,
    """
    WITH words AS (SELECT cik, filing_a, filing_b, unnest(ta) AS word, 1 AS a, 0 AS b FROM {doc_texts}
      UNION ALL SELECT cik, filing_a, filing_b, unnest(tb), 0, 1 FROM {doc_texts}),
    counts AS (SELECT cik, filing_a, filing_b, word, least(sum(a), sum(b)) AS n FROM words GROUP BY ALL),
    shared AS (SELECT cik, filing_a, filing_b, sum(n) AS shared FROM counts GROUP BY ALL)
    SELECT cik, filing_a, filing_b, la AS len_a, lb AS len_b, CAST(greatest(la, lb) - coalesce(shared, 0) AS BIGINT) AS least, TRUE AS possible
    FROM {doc_texts} LEFT JOIN shared USING (cik, filing_a, filing_b) WHERE la > 0 AND lb > 0
    """,
)
query(
    "m6_compare_turns",
    lambda t: sim.compare_sections(t["turn_sections"], t["turn_pairs"], t["lexicon"])
    .withColumn("similarity", F.round("similarity", 9))
    .withColumn("sentiment", F.round("sentiment", 9)),
    DISTANCE_SQL
    + f""", feeling AS ({_sentiment_sql("turn_texts", "longer")})
    SELECT cik AS ticker, date_a, date_b, distance, round(similarity, 9) AS similarity, len_a, len_b,
      coalesce(sentiment, 0) AS sentiment
    FROM measured LEFT JOIN feeling USING (cik, filing_a, filing_b)
    """,
)
# Firms with two filings: each text and its edited copy. All measures have a closed form or are plain SQL on whole texts.
derived(
    "edited_check",
    f"""
    SELECT doc_id, words, list_filter(list_transform(range(1, len(words) + 1), lambda i:
        CASE WHEN i % 7 = 0 THEN '' WHEN i % 5 = 0 THEN '''''''''' ELSE words[i] END), lambda w: w <> '') AS kept
    FROM (SELECT doc_id, {WORDS} AS words FROM documents) WHERE len(words) > 0
    """,
)


def _edited_firms(t):
    """Sections and pairs of the edited copies (older) and the texts themselves (newer)."""
    both = _edited(t).withColumn("n", F.explode(F.array(F.lit(1), F.lit(0))))
    filed = F.date_add(F.lit("2000-01-01").cast("date"), F.col("n"))
    sections = both.select(
        F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("cik"), F.col("n").cast("string").alias("accession"),
        filed.alias("filed_date"), F.lit("1A").alias("item_n"), F.when(F.col("n") == 1, F.col("words_b")).otherwise(F.col("words_a")).alias("text"),
    )
    return sections, pr.consecutive_pairs(sections)


def _compare_edited(t):
    rows = sim.compare_sections(*_edited_firms(t), t["lexicon"])
    return rows.select(
        F.col("ticker").cast("long").alias("doc_id"), "distance", F.round("similarity", 9).alias("similarity"), "len_a", "len_b",
        F.round("sentiment", 9).alias("sentiment"),
    )


EDITED_DEGREE = ", ".join(f"'{w}'" for w in sim.DEGREE_WORDS)
query(
    "m6_compare_edited",
    _compare_edited,
    f"""
    WITH new AS (
      SELECT doc_id, unnest(list_filter(words, lambda w: NOT list_contains(kept, w))) AS word FROM {{edited_check}} WHERE len(kept) > 0),
    scored AS (
      SELECT doc_id, sum(CASE WHEN length(word) > 1 AND word NOT IN ({EDITED_DEGREE})
          THEN coalesce(round(valence / sqrt(valence * valence + 15), 4), 0) ELSE 0 END) / count(*) AS sentiment
      FROM (SELECT doc_id, CASE WHEN regexp_matches(word, '^''[a-z]{{2,}}$') THEN word[2:]
          WHEN regexp_matches(word, '^[a-z]{{2,}}''$') THEN word[:-2] ELSE word END AS word FROM new) w
      LEFT JOIN {{lexicon}} x USING (word) GROUP BY doc_id)
    SELECT doc_id, n // 7 + n // 5 - n // 35 AS distance, round(1 - (n // 7 + n // 5 - n // 35) / (2 * n - n // 7), 9) AS similarity,
      n AS len_a, n - n // 7 AS len_b, round(coalesce(sentiment, 0), 9) AS sentiment
    FROM (SELECT doc_id, len(words) AS n FROM {{edited_check}} WHERE len(kept) > 0) LEFT JOIN scored USING (doc_id)
    """,
)
# Every third filing lacks the section: its pairs are rejected, its neighbours are not paired with each other.
derived("some_sections", "SELECT * FROM {doc_sections} WHERE CAST(left(accession, 10) AS BIGINT) % 3 <> 0")
query(
    "m7_missing_sections",
    lambda t: sim.pair_rejects(t["some_sections"], t["doc_pairs"]),
    """
    SELECT p.cik, filing_a, filing_b, CASE WHEN a.n IS NULL OR b.n IS NULL THEN 'missing_section' ELSE 'empty_section' END AS reason
    FROM {doc_pairs} p
    LEFT JOIN (SELECT t.* FROM {doc_tokens_check} t SEMI JOIN {some_sections} s ON s.cik = t.cik AND s.accession = t.accession) a
      ON a.cik = p.cik AND a.accession = filing_a
    LEFT JOIN (SELECT t.* FROM {doc_tokens_check} t SEMI JOIN {some_sections} s ON s.cik = t.cik AND s.accession = t.accession) b
      ON b.cik = p.cik AND b.accession = filing_b
    WHERE a.n IS NULL OR b.n IS NULL OR a.n = 0 OR b.n = 0
    """,
)
query(
    "m7_empty_sections",
    lambda t: sim.uncomparable(sim.pair_texts(t["doc_sections"], t["doc_pairs"])),
    "SELECT cik, filing_a, filing_b, 'empty_section' AS reason FROM {doc_texts} WHERE la = 0 OR lb = 0",
)
