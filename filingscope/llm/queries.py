"""The registered queries of this subpackage, each one operator applied to its whole table, and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingscope.llm import bpe, decontamination, html_extraction, jaccard_join, language_id, merkle_manifest, periodic_runs, quality_classifier
from filingscope.llm import quality_rules, simhash_dedup, substring_chaining, suffix_array_dedup, suffix_tree_lm
from filingscope.llm.common import read_table, remainder, saved

VOCABULARY = "byte_bpe_50k.json"


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read_table(spark, sf_dir, "documents")).drop("n_rules_run")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "reparameterised")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(read_table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = saved(quality_classifier.statistics(read_table(spark, sf_dir, "documents")))
    held_out = remainder("doc_id", 5) == 0
    rules = quality_classifier.fit(stats.where(~held_out), read_table(spark, sf_dir, "labels"))
    scored = stats.select("doc_id", held_out.alias("held_out"), quality_classifier.score(rules).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = suffix_tree_lm.scored(read_table(spark, sf_dir, "documents"), remainder("doc_id", 10) != 0)
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle_words=3, max_bits=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_chaining.passages(read_table(spark, sf_dir, "documents"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup.digests(read_table(spark, sf_dir, "documents"), length=400)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.similar_groups(read_table(spark, sf_dir, "documents"), width=3, num=90, den=100)
    return found.select("doc_id", F.col("n_grams").alias("n_shingles"), "component_id")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    # What is verified: every other row has lost its line ends.
    shown = F.when(remainder("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proofs = merkle_manifest.manifest(
        read_table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"text": shown}
    )
    return proofs.select("doc_id", "leaf", "subroot", "root", merkle_manifest.proof_hash().alias("proof_sha256"), "folded_root", "verified")


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_with_tails(read_table(spark, sf_dir, "documents")), least=12)
    longest = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    best = F.get(longest, 0)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.shorter")).alias("length"), "best.period",
        F.expr("-1000 * best.shorter div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def _with_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; one text in ten goes on from some word with a few repetitions of the words that follow it."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda word: word != "")
    chosen = docs.where(h % 10 == 0).select("doc_id", F.coalesce(words, F.array().cast("array<string>")).alias("words"), F.floor(h / 10).alias("g"))
    n = F.size("words")
    start = F.when(n > 0, F.col("g") % F.greatest(n, F.lit(1))).otherwise(0).cast("int")
    period = (F.floor((n - F.col("start")) / (F.col("g") % 8 + 3)) + 1).cast("int")
    placed = chosen.withColumn("start", start).withColumn("period", period).withColumn("rest", n - F.col("start"))
    cycle = F.slice("words", F.col("start") + 1, F.col("period"))
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil(F.col("rest") / F.col("period")).cast("int"))), F.lit(1), F.col("rest"))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("start")), tail), " ")
    return docs.where(h % 10 != 0).select("doc_id", "text").unionByName(placed.select("doc_id", changed.alias("text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_rules": op2_rules,
    "op3_decontamination": op3_decontamination,
    "op4_html": op4_html,
    "op5_quality": op5_quality,
    "op6_suffix_tree": op6_suffix_tree,
    "op7_simhash": op7_simhash,
    "op8_chaining": op8_chaining,
    "op9_suffix_array": op9_suffix_array,
    "op10_bpe": op10_bpe,
    "op11_jaccard": op11_jaccard,
    "op12_merkle": op12_merkle,
    "op13_runs": op13_runs,
}

RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
            FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, range(3) AS r(k) GROUP BY rid),
ruling AS (SELECT rid, max(c) AS top FROM (SELECT rid, word, count(*) AS c FROM (SELECT rid, unnest(words) AS word FROM w) GROUP BY ALL) GROUP BY rid),
base AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines) AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(t, '[^!]', '', 'g')) AS calls, coalesce(top, 0) AS top
         FROM w LEFT JOIN repeated USING (rid) LEFT JOIN ruling USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 10 * n_symbols <= 3 * n_words AND 2 * n_words <= word_chars AND word_chars <= 20 * n_words
       AND 10 * upper <= 4 * word_chars AND 2 * calls <= n_words AND 10 * n_dup_lines <= 5 * n_lines
       AND 10 * top <= 3 * n_words AS kept
FROM judged
"""

JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
      list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT rid, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d),
sized AS (SELECT rid, doc_id, s, len(s)::BIGINT AS n_shingles, md5(array_to_string(list_sort(s), chr(10))) AS k FROM sets),
one AS (SELECT k, any_value(s) AS s, any_value(n_shingles) AS n, min(doc_id) AS low FROM sized WHERE n_shingles > 0 GROUP BY k),
posted AS (SELECT k, n, unnest(s) AS g FROM one),
links AS (SELECT a, b FROM (SELECT x.k AS a, y.k AS b, any_value(x.n) AS m, any_value(y.n) AS n, count(*) AS shared FROM posted x JOIN posted y
      ON x.g = y.g AND x.k <> y.k AND 100 * x.n >= 90 * y.n AND 100 * y.n >= 90 * x.n GROUP BY x.k, y.k) WHERE 100 * shared >= 90 * (m + n - shared)),
reach(a, b) AS (SELECT k, k FROM one UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT reach.a AS k, min(low) AS component_id FROM reach JOIN one ON one.k = reach.b GROUP BY reach.a)
SELECT doc_id, n_shingles, CASE WHEN n_shingles = 0 THEN doc_id ELSE component_id END AS component_id FROM sized LEFT JOIN least USING (k)
"""

MERKLE_SQL = """
WITH RECURSIVE d AS (SELECT *, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS seen FROM (SELECT doc_id, source, lang, n_chars, text,
      xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT)),
          lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)),
          4294967295::BIGINT) % 2 = 0 AS even FROM documents)),
sized AS (SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text, seen FROM d),
hashed AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(seen) || ':' || seen, '-')) AS shown FROM sized),
leaves AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS total FROM hashed),
nodes(source, lvl, idx, h, total) AS (SELECT source, 0, idx, leaf, total FROM leaves
      UNION ALL SELECT source, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), any_value((total + 2) // 3) FROM nodes WHERE total > 1 GROUP BY source, lvl, idx // 3),
subroots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS total FROM nodes WHERE total = 1),
tops(lvl, idx, h, total) AS (SELECT 0, place, subroot, total FROM subroots
      UNION ALL SELECT lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), any_value((total + 2) // 3) FROM tops WHERE total > 1 GROUP BY lvl, idx // 3),
root AS (SELECT h AS root FROM tops WHERE total = 1),
steps AS (SELECT source, lvl, idx, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|'
      || coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS step FROM nodes WHERE total > 1 WINDOW run AS (PARTITION BY source, lvl, idx // 3 ORDER BY idx)),
top_steps AS (SELECT lvl, idx, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|'
      || coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS step FROM tops WHERE total > 1 WINDOW run AS (PARTITION BY lvl, idx // 3 ORDER BY idx)),
own AS (SELECT rid, list(step ORDER BY lvl) AS path FROM (SELECT leaves.rid, s.lvl, s.step FROM leaves JOIN steps s
      ON s.source IS NOT DISTINCT FROM leaves.source AND s.idx = leaves.idx // (3 ** s.lvl)::BIGINT) GROUP BY rid),
last AS (SELECT place, list(step ORDER BY lvl) AS path FROM (SELECT subroots.place, s.lvl, s.step FROM subroots JOIN top_steps s ON s.idx = subroots.place // (3 ** s.lvl)::BIGINT) GROUP BY place),
whole AS (SELECT doc_id, leaf, shown, subroot, root, list_concat(coalesce(own.path, []), coalesce(last.path, [])) AS path
      FROM leaves JOIN subroots ON subroots.source IS NOT DISTINCT FROM leaves.source CROSS JOIN root LEFT JOIN own USING (rid) LEFT JOIN last USING (place)),
folded AS (SELECT *, list_reduce(list_prepend(shown, path), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

# A run's words agree over a distance in six places in a row at least, so it shows as a row of six-word windows repeated at that distance.
RUNS_SQL = r"""
WITH hashed AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
      xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT)),
          lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)),
          4294967295::BIGINT) AS h FROM documents),
placed AS (SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM hashed),
paced AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
texts AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM paced),
windows AS (SELECT rid, i, array_to_string(w[i + 1:i + 6], ' ') AS g FROM (SELECT rid, w, unnest(range(n - 5)) AS i FROM texts WHERE n > 5)),
again AS (SELECT x.rid, x.i, y.i - x.i AS p FROM windows x JOIN windows y ON x.rid = y.rid AND x.g = y.g AND x.i < y.i),
islands AS (SELECT rid, p, min(i) AS start, count(*) + 5 + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS island FROM again) GROUP BY rid, p, island),
runs AS (SELECT rid, start, length, min(p) AS period FROM islands WHERE length >= 12 AND length >= 2 * p GROUP BY rid, start, length),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
listed AS (SELECT rid, count(*) AS n_runs, arg_min({'start': start, 'length': length, 'period': period}, [-length, start, period]) AS best,
      string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY rid),
left_over AS (SELECT t.rid, string_agg(t.w[t.i + 1], ' ' ORDER BY t.i) AS kept FROM (SELECT rid, w, unnest(range(n)) AS i FROM texts) t ANTI JOIN gone ON gone.rid = t.rid AND gone.i = t.i GROUP BY t.rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
       (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM texts LEFT JOIN listed USING (rid) LEFT JOIN left_over USING (rid)
"""

SQL: dict[str, str] = {"op2_rules": RULES_SQL, "op11_jaccard": JACCARD_SQL, "op12_merkle": MERKLE_SQL, "op13_runs": RUNS_SQL}
