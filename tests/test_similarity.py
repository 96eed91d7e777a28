"""Text change measures against brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filingscope.functions import edit_distance as ed
from filingscope.operators import pairs as pr
from filingscope.operators import similarity as sim

LISTS = st.lists(st.sampled_from("abcde"), max_size=25)


def table_distance(a, b):
    previous = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        current = [i]
        for j, y in enumerate(b, 1):
            current.append(min(previous[j] + 1, current[j - 1] + 1, previous[j - 1] + (x != y)))
        previous = current
    return previous[-1]


@settings(max_examples=400, deadline=None)
@given(LISTS, LISTS)
def test_distance_equals_the_full_table(a, b):
    d = ed.token_distance(a, b)
    assert d == table_distance(a, b) == ed.token_distance(b, a)
    assert (d == 0) == (a == b)
    assert abs(len(a) - len(b)) <= d <= max(len(a), len(b))


def test_distance_without_room_for_masks(monkeypatch):
    monkeypatch.setattr(ed, "MASK_BUDGET_BYTES", 0)
    rng = random.Random(3)
    for _ in range(100):
        a = [rng.choice("abcd") for _ in range(rng.randrange(30))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(30))]
        assert ed.token_distance(a, b) == table_distance(a, b)


def test_distance_beyond_the_characters_of_a_string():
    a = [f"w{i}" for i in range(60_000)]
    b = a[:100] + ["new"] + a[200:]
    assert ed.token_distance(a, b) == 100


def edited(rng, a, rate):
    """A copy that loses words and gets words nobody has for others."""
    return [w if rng.random() > rate else "new" for w in a if rng.random() > rate / 2]


def test_an_edited_copy_needs_no_table(monkeypatch):
    rng = random.Random(5)
    a = [f"w{rng.randrange(5000)}" for _ in range(2000)]
    b = [w if (i + 1) % 5 else "new" for i, w in enumerate(a) if (i + 1) % 7]
    monkeypatch.setattr(ed, "_whole", lambda *_: pytest.fail("columns computed"))
    monkeypatch.setattr(ed, "_banded", lambda *_: pytest.fail("columns computed"))
    wanted = 2000 // 7 + 2000 // 5 - 2000 // 35
    assert ed.token_distance(a, b) == ed.token_distance(b, a) == wanted


def test_a_walk_never_needs_fewer_edits_than_the_table(monkeypatch):
    rng = random.Random(6)
    walks = []
    walked = ed._walked
    monkeypatch.setattr(ed, "_walked", lambda *args: walks.append((walked(*args), args[2])) or walks[-1][0])
    for _ in range(300):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(40))]
        b = edited(rng, a, rng.choice((0.1, 0.3)))
        if rng.random() < 0.3:
            rng.shuffle(b)
        assert ed.token_distance(a, b) == table_distance(a, b)
        assert walked(a, b, 99) >= table_distance(a, b)
    assert {found == limit for found, limit in walks} == {True, False}


def words(rng, n, vocabulary=40):
    return " ".join(f"{chr(97 + rng.randrange(vocabulary) % 26)}{'x' * (rng.randrange(3))}" for _ in range(n))


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(11)
    rows = [("0000000001", f"n{i}", f"o{i}", words(rng, rng.randrange(1, 60)), words(rng, rng.randrange(1, 60))) for i in range(80)]
    return spark.createDataFrame(rows, "cik STRING, filing_a STRING, filing_b STRING, words_a STRING, words_b STRING")


def test_distance_agrees_with_the_builtin_on_single_letters(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice("abcd") for _ in range(30)), "".join(rng.choice("abcd") for _ in range(25))) for _ in range(50)]
    df = spark.createDataFrame(rows, "a STRING, b STRING")
    spaced = df.select(
        F.levenshtein("a", "b").alias("expected"),
        ed.token_line_distance(F.trim(F.regexp_replace("a", "(.)", "$1 ")), F.trim(F.regexp_replace("b", "(.)", "$1 "))).alias("got"),
    )
    assert spaced.filter("got <> expected OR got IS NULL").count() == 0


def test_pair_measures(texts):
    for r in sim.edit_distances(texts).join(texts, sim.PAIR_KEY).collect():
        a, b = r.words_a.split(), r.words_b.split()
        assert (r.len_a, r.len_b) == (len(a), len(b))
        assert r.distance == table_distance(a, b)
        assert r.similarity == 1 - r.distance / (len(a) + len(b))


@pytest.mark.parametrize("basis", sim.BASES)
def test_new_words_and_sentiment(spark, texts, basis):
    lexicon = spark.createDataFrame([("a", 3.0), ("bx", 2.0), ("cxx", -1.5), ("so", 3.0)], "word STRING, valence DOUBLE")
    found = {}
    for r in sim.new_words(texts, basis).collect():
        found.setdefault(r.filing_a, []).extend([r.word] * r.occurrences)
    scores = {"bx": round(2 / (4 + 15) ** 0.5, 4), "cxx": round(-1.5 / (2.25 + 15) ** 0.5, 4)}
    means = {r.filing_a: r.sentiment for r in sim.mean_sentiment(sim.new_word_rows(texts, basis), lexicon).collect()}
    swapped = 0
    for r in texts.collect():
        a, b = r.words_a.split(), r.words_b.split()
        if basis == "longer" and len(b) > len(a):
            a, b, swapped = b, a, swapped + 1
        expected = sorted(w for w in a if w not in set(b))
        assert sorted(found.get(r.filing_a, [])) == expected
        if expected:
            assert means[r.filing_a] == pytest.approx(sum(scores.get(w, 0.0) for w in expected) / len(expected))
        else:
            assert means[r.filing_a] == 0.0
    assert swapped > 0 or basis == "newer"
    with pytest.raises(ValueError):
        sim.new_words(texts, "older")


def test_lexicon_lookup_forms(spark):
    cases = {"risk": "risk", "risk'": "risk", "'risk": "risk", "'risk'": "'risk'", "a": None, "so": None, "a'": "a'", "don't": "don't", "'don't": "'don't"}
    df = spark.createDataFrame([(w,) for w in cases], "w STRING").select("w", sim.lexicon_key(F.col("w")).alias("k"))
    assert {r.w: r.k for r in df.collect()} == cases


def test_tokens(spark):
    text = "Café DON'T 12 e-mail\nKelvin"
    row = spark.createDataFrame([(text,)], "t STRING").select(
        sim.tokens(F.col("t")).alias("list"), sim.token_line(F.col("t")).alias("line")
    ).first()
    assert row.list == ["caf", "don't", "e", "mail", "kelvin"]
    assert row.line.split() == row.list


def test_similarity_of_empty_texts(spark):
    assert spark.range(1).select(sim.similarity(F.lit(0), F.lit(0), F.lit(0))).first()[0] == 1.0


@pytest.fixture(scope="module")
def filings(spark):
    rows = [
        ("1", "a1", "2006-03-01", "one two three"), ("1", "a2", "2007-03-01", "one two four"),
        ("1", "a4", "2007-03-01", "nine"), ("1", "a3", "2008-03-05", "12 34"), ("1", "a5", "2009-03-05", "nine ten"),
        ("2", "b1", "2006-05-01", "alone"),
    ]
    return spark.createDataFrame(rows, "cik STRING, accession STRING, d STRING, text STRING").select(
        "cik", "accession", F.to_date("d").alias("filed_date"), "text"
    )


def test_pairs_link_neighbours_across_months(filings):
    rows = pr.consecutive_pairs(filings).orderBy("date_a", "filing_a").collect()
    assert [(r.filing_a, r.filing_b) for r in rows] == [("a2", "a1"), ("a4", "a2"), ("a3", "a4"), ("a5", "a3")]


def test_an_empty_section_loses_only_its_pairs(spark, filings):
    pairs = pr.consecutive_pairs(filings)
    lexicon = spark.createDataFrame([("four", 1.0)], "word STRING, valence DOUBLE")
    rows = sim.compare_sections(filings, pairs, lexicon).orderBy("date_a", "distance").collect()
    assert [(str(r.date_a), r.distance, r.len_a, r.len_b) for r in rows] == [("2007-03-01", 1, 3, 3), ("2007-03-01", 3, 1, 3)]
    assert rows[0].sentiment == 0.25
    assert rows[1].sentiment == pytest.approx(0.25 / 3)
    bad = sim.uncomparable(sim.pair_texts(filings, pairs)).collect()
    assert sorted((r.filing_a, r.filing_b) for r in bad) == [("a3", "a4"), ("a5", "a3")]


def test_equal_texts_have_no_new_word(spark):
    df = spark.createDataFrame(
        [("1", "a", "2006-01-01", "x y"), ("1", "b", "2007-01-01", "x y")], "cik STRING, accession STRING, d STRING, text STRING"
    ).withColumn("filed_date", F.to_date("d"))
    lexicon = spark.createDataFrame([("x", 1.0)], "word STRING, valence DOUBLE")
    row = sim.compare_sections(df, pr.consecutive_pairs(df), lexicon).first()
    assert (row.distance, row.similarity, row.sentiment) == (0, 1.0, 0.0)


def test_results_do_not_depend_on_the_partition_count(spark, texts):
    def result(n):
        return sorted(tuple(r) for r in sim.new_words(texts.repartition(n)).collect())

    assert result(1) == result(7)


def test_plan_reuses_the_shuffled_text(spark, filings, tmp_path):
    filings.write.parquet(str(tmp_path / "f"))
    stored = spark.read.parquet(str(tmp_path / "f"))
    lexicon = spark.createDataFrame([("four", 1.0)], "word STRING, valence DOUBLE")
    out = sim.compare_sections(stored, pr.consecutive_pairs(stored), lexicon)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "ReusedExchange" in plan
    assert plan.count("ArrowEvalPython") == 1


def test_document_facts_shuffle_no_words(spark, monkeypatch):
    from filingscope.catalog import change_queries as cq

    key = {"cik": "1", "filing_b": "b"}
    once = [key | {"filing_a": "x", "words_a": "a b b c", "words_b": "b b b d"}, key | {"filing_a": "y", "words_a": "p", "words_b": "q"}]
    texts = spark.createDataFrame(once, "cik STRING, filing_a STRING, filing_b STRING, words_a STRING, words_b STRING")
    by_word = []
    whole = cq._shared_by_word
    monkeypatch.setattr(cq, "_shared_by_word", lambda t: by_word.append(1) or whole(t))
    got = {r.filing_a: (r.least, r.possible) for r in cq._distance_facts({"doc_texts": texts}).collect()}
    assert got == {"x": (2, True), "y": (1, True)} and not by_word
    # A key in two rows: a has b three times in all, b twice.
    twice = texts.limit(0).union(spark.createDataFrame([("1", "x", "b", "a b b", "a"), ("1", "x", "b", "b", "b b"), ("1", "z", "b", "a", "a")]))
    got = sorted((r.filing_a, r.least) for r in cq._distance_facts({"doc_texts": twice}).collect())
    assert got == [("x", -1), ("x", 0), ("z", 0)] and by_word
