"""Operators that hold texts against each other, and the pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from filingscope.llm import decontamination, simhash_dedup, substring_chaining, suffix_array_dedup
from filingscope.llm.components import components
from filingscope.llm.suffix_index import shared_starts

DOC = "doc_id long, text string"


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    random.seed(1)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == groups(edges, {n for a, b in edges if a != b for n in (a, b)})
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("max_bits", [0, 1, 3, 5])
def test_posted_positions_miss_no_pair(max_bits):
    from itertools import combinations

    for same in combinations(range(8), 8 - max_bits):
        assert any(set(g) <= set(same) for g in simhash_dedup._posted(max_bits))


@pytest.mark.parametrize("block", [2048, 7])
def test_simhash_links_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "LIST_BLOCK", block)
    random.seed(2)
    values = {random.getrandbits(64) for _ in range(30)}
    for v in list(values)[:12]:
        for _ in range(25):
            flips = 0
            for b in random.sample(range(64), random.randint(1, 6)):
                flips |= 1 << b
            values.add(v ^ flips)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash_dedup.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 3).collect()
    close = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3]
    assert all(((r["a"] ^ r["b"]) & ((1 << 64) - 1)).bit_count() <= 3 for r in found)
    assert groups([(r["a"], r["b"]) for r in found], signed) == groups(close, signed)


def test_simhash_hard_rows(spark, hard_docs, no_docs):
    rows = simhash_dedup.near_duplicates(hard_docs).collect()
    assert len(rows) == hard_docs.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[3][0]["component_id"] == 1 and len(by_id[3]) == 2
    empty = {r["component_id"] for i in (4, 5, 6) for r in by_id[i]}
    assert empty == {4} and all(by_id[i][0]["fp"] == 0 for i in (4, 5, 6))
    assert sorted(r["component_id"] for r in by_id[None]) == [2, 4]
    kept = simhash_dedup.one_of_each(hard_docs)
    assert kept.columns == hard_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 7, 8, 9, 10]
    assert simhash_dedup.near_duplicates(no_docs).collect() == [] and simhash_dedup.one_of_each(no_docs).collect() == []
    nameless = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "other words here now")], DOC)
    assert simhash_dedup.one_of_each(nameless).count() == 2


def test_simhash_keeps_each_component_of_a_repeated_id(spark):
    """One id on different texts: each component keeps its row."""
    one, two = " ".join(f"one{i}" for i in range(40)), " ".join(f"two{i}" for i in range(40))
    docs = spark.createDataFrame([(1, one), (1, two), (1, two), (2, one), (3, "some other words here")], DOC)
    kept = sorted(map(tuple, simhash_dedup.one_of_each(docs).collect()))
    assert kept == sorted([(1, one), (1, two), (3, "some other words here")])


def test_fingerprint_by_bits():
    import xxhash

    text = "A b\tC d e f g"
    words = "a b c d e f g".split(" ")
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), seed=42) for i in range(len(words) - 2)]
    expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash_dedup.fingerprint(text, 3) & ((1 << 64) - 1) == expected
    assert simhash_dedup.fingerprint("one two", 3) & ((1 << 64) - 1) == xxhash.xxh64_intdigest("one two", seed=42)


def test_interval_expansion_against_counting():
    random.seed(3)
    for _ in range(200):
        length = random.randint(2, 12)
        texts = [bytes(random.choice(b"abc") for _ in range(random.randint(0, 40))) for _ in range(random.randint(1, 6))]
        texts += texts[:1] * random.randint(0, 1)
        count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        for text, flags in zip(texts, shared_starts(texts, length)):
            assert flags.tolist() == [count[text[i : i + length]] > 1 for i in range(len(text) - length + 1)]


def plain_removal(rows, length, least_words=0):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), text in zip(rows, texts):
        covered = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if count[text[i : i + length]] > 1:
                covered[i : i + length] = b"\x01" * length
        if least_words:
            start = None
            for i, c in enumerate([*covered, 0]):
                if c and start is None:
                    start = i
                elif not c and start is not None:
                    if len(text[start:i].split()) < least_words:
                        covered[start:i] = bytes(i - start)
                    start = None
        spans = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        kept = bytes(b for b, c in zip(text, covered) if not c)
        out.append((doc_id, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [512, 3])
def test_repeats_against_counting(spark, group, monkeypatch):
    monkeypatch.setattr(suffix_array_dedup, "GROUP_RUNS", group)
    random.seed(5)
    passages = ["".join(random.choice("abcdeé ") for _ in range(90)) for _ in range(4)]
    rows = []
    for i in range(50):
        parts = [random.choice(passages)[random.randint(0, 30) : random.randint(50, 90)] + "".join(random.choice("xyz") for _ in range(random.randint(0, 30))) for _ in range(random.randint(0, 4))]
        rows.append((i if i % 11 else None, "".join(parts) if i % 13 else None))
    rows += rows[:5] + [(100, "a" * 200), (101, ""), (102, rows[3][1])]
    got = [tuple(r)[:5] for r in suffix_array_dedup.digests(spark.createDataFrame(rows, DOC), 40).collect()]
    assert sorted(got, key=str) == plain_removal(rows, 40)


def test_repeats_hard_rows(hard_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in hard_docs.collect()]
    got = [tuple(r)[:5] for r in suffix_array_dedup.digests(hard_docs).collect()]
    assert sorted(got, key=str) == plain_removal(rows, 400)
    assert suffix_array_dedup.digests(no_docs).collect() == []


QUESTION = "Yesterday, Bob bought 3 apples and 4 pears at the market for 9 dollars in total, then left."


LONG = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))


def test_decontamination_templates(spark):
    docs = [
        (1, "x y Yesterday, Alice bought 12 apples and 5 pears at the market for 30 dollars in total, then left. bla"),
        (2, "YESTERDAY, BOB BOUGHT 3 APPLES AND 4 PEARS AT THE MARKET FOR 9 DOLLARS IN TOTAL, THEN LEFT."),
        (3, "Yesterday, Alice bought 12 apples and some pears at a market for nothing and then left again with friends."),
        (4, "Yesterday, Alice bought 12 apples and 12 pears at the market for 12 dollars"),
        (5, None),
        (None, "so Bob bought 3 apples"),
        (6, " ".join("other" if i % 12 == 11 else w for i, w in enumerate(LONG.split()))),
        (16, " ".join(LONG.split()[:10]) + " and something else altogether"),
    ]
    items = [(7, QUESTION), (11, LONG), (8, None), (9, "Bob bought 3 apples"), (None, "")]
    docs, items = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_words"], r["reparameterised"]) for r in decontamination.contaminated(docs, items).collect()}
    assert got[6, 11][0] >= 20 and (16, 11) not in got  # single words changed; ten words only
    assert got[1, 7] == (18, True) and got[2, 7] == (18, False) and got[None, 9] == (4, False)
    assert (3, 7) not in got and (4, 7) not in got  # other words; one value for two slots that differ
    assert {r["doc_id"] for r in decontamination.remove_contaminated(docs, items).collect()} == {3, 4, 5, 16}


def test_dense_question_with_other_numbers(spark):
    """Few words, many numbers: the whole run is weighed. Numbers or names alone in the same order are no question."""
    question = "If 31 * 4 = 124 , then 31 * 7 = 217 and 31 * 9 = 279 , so what is 31 * 12 ?"
    other = "zz If 17 * 4 = 68 , then 17 * 8 = 136 and 17 * 6 = 102 , so what is 17 * 15 ? zz"
    mixed = "zz If 17 * 4 = 68 , then 18 * 8 = 136 and 19 * 6 = 102 , so what is 16 * 15 ? zz"
    items = spark.createDataFrame([(1, question), (2, "Rome Paris Bonn Oslo Bern Riga and Kyiv Baku Lima Quito Cairo Delhi Tokyo or Seoul Hanoi Dakar")], "item_id long, text string")
    names = " ".join(f"{w}a" if w[0].isupper() else w for w in "Rome Paris Bonn Oslo Bern Riga and Kyiv Baku Lima Quito Cairo Delhi Tokyo of Seoul Hanoi Dakar".split())
    docs = spark.createDataFrame([(1, other), (2, mixed), (3, " ".join(str(i) for i in range(500))), (4, names), (5, question.lower())], DOC)
    got = {(r["doc_id"], r["item_id"], r["reparameterised"]) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(1, 1, True), (5, 1, False)}


def test_template_windows_against_all_windows():
    """Windows of a batch, with the ones of placeholders alone kept only near others, against each text by itself."""
    random.seed(21)
    texts = [" ".join(random.choice(["the", "of", "Rome", "Oslo", "7", "12", "km", "--"]) for _ in range(random.randint(0, 60))) for _ in range(40)]
    got = {(r, pos, size, bool(slots)): len(slots) for r, pos, size, _, slots, *_ in decontamination._windows(texts, [3, 8], lambda h: np.ones(len(h), bool), 2)}
    for r, text in enumerate(texts):
        kinds = [decontamination.slot_kind(w) for w in text.split() if w != "--"]
        for size in (3, 8):
            n = max(0, len(kinds) - size + 1)
            bare = [all(kinds[i : i + size]) for i in range(n)]
            for i in range(n):
                assert (r, i, size, False) in got
                ahead = [j for j in range(n) if not bare[j] and abs(i - j) <= 2 and all(bare[min(i, j) + 1 : max(i, j)])]
                slots = sum(k is not None for k in kinds[i : i + size])
                assert ((r, i, size, True) in got) == (slots > 0 and (not bare[i] or bool(ahead)))


def test_decontamination_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, QUESTION), (2, "clean")], DOC).withColumns({n: F.lit(n) for n in ("d", "K1", "d_", "line", "windows", "hash")})
    left = decontamination.remove_contaminated(docs, spark.createDataFrame([(7, QUESTION)], "item_id long, text string"))
    assert left.columns == docs.columns and [r["doc_id"] for r in left.collect()] == [2]


def test_decontamination_hard_rows(spark, hard_docs, no_docs):
    no_items = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame([(1, None), (2, ""), (3, "the lazy dog were in the house of the old man that was by the river")], "item_id long, text string")
    assert decontamination.contaminated(hard_docs, no_items).collect() == []
    assert decontamination.remove_contaminated(hard_docs, no_items).count() == hard_docs.count()
    assert {r["doc_id"] for r in decontamination.contaminated(hard_docs, items).collect()} == {1, 3}
    left = decontamination.remove_contaminated(hard_docs, items)
    assert left.columns == hard_docs.columns and left.count() == hard_docs.count() - 3
    assert decontamination.contaminated(no_docs, items).collect() == []


def plain_chain(x, r):
    gain = []
    for i in range(len(x)):
        best = 0.0
        for j in range(i):
            if x[j] < x[i] and r[j] < r[i]:
                best = max(best, gain[j] - substring_chaining.GAP_COST * (x[i] - x[j] + r[i] - r[j]))
        gain.append(best + substring_chaining.ANCHOR_GAIN)
    return max(gain)


def test_chains_against_all_predecessors():
    random.seed(8)
    for _ in range(200):
        x = np.array(sorted(random.sample(range(40), 12)))
        r = np.array([random.randint(0, 25) for _ in x])
        best = substring_chaining.best_chains(x, r)[0]
        gain = sum(substring_chaining.ANCHOR_GAIN for _ in best) - sum(substring_chaining.GAP_COST * (x[j] - x[i] + r[j] - r[i]) for i, j in zip(best, best[1:]))
        assert all(x[i] < x[j] and r[i] < r[j] for i, j in zip(best, best[1:]))
        assert abs(gain - plain_chain(x, r)) < 1e-9


def test_fenwick_reach_against_all_places():
    random.seed(31)
    reach, items = substring_chaining._Reach(), []
    for i in range(400):
        r = random.randrange(200)
        best = max((v for p, v in items if r - substring_chaining.LARGEST_GAP <= p < r), default=None)
        assert reach.best(r) == best
        items.append((r, (random.random(), i)))
        reach.put(*items[-1])


def test_a_passage_whose_phrases_are_in_earlier_texts(spark):
    """Sixteen earlier texts hold eight words each of an 80-word passage; two later ones share all of it, one with single words changed."""
    random.seed(33)

    def text(n):
        return [f"w{random.randrange(10**6)}" for _ in range(n)]

    passage = text(80)
    rows = [(i, " ".join(text(30) + passage[5 * i : 5 * i + 8] + text(30))) for i in range(15)]
    changed = [f"v{i}" if i % 7 == 6 else w for i, w in enumerate(passage)]
    rows += [(100, " ".join(text(20) + passage + text(20))), (101, " ".join(text(40) + passage + text(10))), (102, " ".join(text(10) + changed + text(20)))]
    found = {r["doc_id"]: (r["start_word"], r["end_word"]) for r in substring_chaining.passages(spark.createDataFrame(rows, DOC)).collect()}
    assert set(found) == {100, 101, 102}
    for doc_id, start in ((100, 20), (101, 40), (102, 10)):
        assert found[doc_id][0] <= start + 7 and found[doc_id][1] >= start + 73


def agreeing(a, b):
    """Places of stretches of 50 words or more of either text that agree to 80 % with the other one, word for word."""
    out = set()
    for shift in range(-len(b) + 1, len(a)):
        lo, hi = max(0, shift), min(len(a), len(b) + shift)
        equal = np.array([a[i] == b[i - shift] for i in range(lo, hi)], int)
        if len(equal) < 50:
            continue
        sums = np.cumsum(np.r_[0, equal])
        for i in range(len(equal) - 49):
            if equal[i] and equal[i + 49] and sums[i + 50] - sums[i] >= 40:
                out |= set(range(lo + i, lo + i + 50))
    return out


def test_passages_against_all_pairs(spark):
    """Texts that share passages with words replaced, at random places or evenly spread: recall and precision by words."""
    random.seed(35)

    def text(n):
        return [f"w{random.randrange(3000)}" for _ in range(n)]

    sources, rows = [text(70) for _ in range(6)], []
    for i in range(30):
        words = text(random.randint(5, 40))
        own = list(random.choice(sources))
        for at in random.choice([[], range(5, 70, 6), random.sample(range(70), 8)]):
            own[at] = f"x{random.randrange(10**6)}"
        rows.append((i, " ".join(words + own + text(random.randint(5, 40)))))
    found = {}
    for r in substring_chaining.passages(spark.createDataFrame(rows, DOC)).collect():
        found.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    split, wanted = [t.split() for _, t in rows], {}
    for i, a in enumerate(split):
        wanted[i] = set().union(*(agreeing(a, b) for j, b in enumerate(split) if j != i))
    hit = sum(len(found.get(i, set()) & w) for i, w in wanted.items())
    assert hit >= 0.9 * sum(map(len, wanted.values())) > 1000
    assert hit >= 0.85 * sum(map(len, found.values()))


def test_a_long_chain_does_not_hide_nearer_matches():
    """Two passages of the same texts, too far apart for one chain, are a chain each."""
    x = np.r_[np.arange(0, 120, 5), np.arange(160, 190, 5)]
    chains = substring_chaining.best_chains(x, x + 7)
    assert sorted(len(c) for c in chains) == [6, 24]


def test_word_distance_against_table():
    random.seed(9)
    for _ in range(200):
        a, b = ([random.randint(0, 3) for _ in range(random.randint(0, 9))] for _ in range(2))
        table = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i][j] = min(table[i - 1][j - 1] + (a[i - 1] != b[j - 1]), table[i - 1][j] + 1, table[i][j - 1] + 1)
        assert substring_chaining.distance(np.array(a), np.array(b)) == table[-1][-1]


def test_passages(spark):
    random.seed(2)

    def words(n):
        return [f"w{random.randint(0, 5000)}" for _ in range(n)]

    exact, fuzzy = words(55), words(100)
    rows = []
    for i in range(14):
        own = list(fuzzy)
        for k in range(i % 5):
            own[20 + 17 * k] = f"z{i}"
        rows.append((i, " ".join(words(30) + (own if i % 2 else exact) + words(20))))
    clean = [(100 + i, " ".join(words(90))) for i in range(5)]
    copies = [(202, " ".join(words(70)))] * 2 + [(203, "a b"), (203, "a b"), (None, None), (204, "")]
    half = [(205, " ".join(words(10) + fuzzy[:30] + words(10)))]
    got = substring_chaining.passages(spark.createDataFrame(rows + clean + copies + half, DOC)).collect()
    spans = sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in got)
    assert spans == sorted([(i, 30, 130 if i % 2 else 85) for i in range(14)] + [(202, 0, 70)] * 2)


@pytest.mark.parametrize("every", [5, 6, 8])
def test_passages_with_evenly_spread_changes(spark, every):
    """Passages in which every fifth, sixth or eighth word differs are found, to where no end pays any more."""
    random.seed(every)
    rows = []
    for i in range(10):
        passage = [f"p{i}x{j}" for j in range(60)]
        changed = [f"c{i}x{j}" if j % every == every // 2 else w for j, w in enumerate(passage)]
        for k, own in enumerate((passage, changed)):
            rows.append((2 * i + k, " ".join([*(f"a{i}x{k}x{j}" for j in range(20)), *own, *(f"b{i}x{k}x{j}" for j in range(20))])))
    got = sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in substring_chaining.passages(spark.createDataFrame(rows, DOC)).collect())
    assert [i for i, _, _ in got] == list(range(20))
    assert all(20 <= start <= 24 and 76 <= end <= 80 for _, start, end in got)


def test_passages_of_templates(spark):
    """Equal sections are found although the texts as a whole, with all that differs between the sections, agree too little."""
    random.seed(7)
    rows = []
    for pair in range(150):
        sections = [[f"s{k}x{random.randint(0, 10**6)}" for _ in range(50)] for k in range(4)]
        for i in range(2):
            text = list(sections[0])
            for k, section in enumerate(sections[1:]):
                text += [f"own{pair}x{i}x{k}x{j}" for j in range(18)] + section
            rows.append((2 * pair + i, " ".join(text)))
    covered = {i: set() for i, _ in rows}
    for r in substring_chaining.passages(spark.createDataFrame(rows, DOC)).collect():
        covered[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert all(set(range(68 * k, 68 * k + 50)) <= own for own in covered.values() for k in range(4))


def test_passages_hard_rows(hard_docs, no_docs):
    got = sorted({(r["doc_id"], r["start_word"], r["end_word"]) for r in substring_chaining.passages(hard_docs).collect()})
    assert got == [(1, 0, 84), (3, 0, 84)]
    assert substring_chaining.passages(no_docs).collect() == []


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    random.seed(12)

    def text(n):
        return " ".join(random.choice(["the", "of", "and", "house", "river", "winter", "garden", "letter", "stone", "summer", "water", "friend"]) + random.choice("abcdefgh") for _ in range(n))

    shared_passage, question = text(90), text(25)
    rows = [(i, text(80), "en", "s", 0) for i in range(8)]
    rows += [(20, text(40) + " " + shared_passage, "en", "s", 0), (21, shared_passage + " " + text(40), "en", "s", 0)]
    rows += [(30, rows[0][1], "en", "s", 0), (31, "12 34 !!", "en", "s", 0), (32, None, None, None, None), (40, text(30) + " " + question + " " + text(30), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(out) == [*range(8), 20, 21]
    removed = {d[0]: d for d in plain_removal([(r[0], r[1]) for r in rows if r[0] in out], corpus_pipeline.REPEATED_BYTES, corpus_pipeline.REPEATED_WORDS)}
    assert all(out[i]["decoded_sha256"] == removed[i][4] for i in out) and removed[20][2] > 400


def test_pipeline_removes_passages_and_leaves_lines(spark):
    """Passages of 51 and more words go, whatever their bytes above 200; shorter repeated lines and clean texts stay; clashing columns too."""
    random.seed(14)

    def text(n):
        return " ".join(random.choice("abcdefghijklmnop") + random.choice(["en", "ar", "ion", "est", "a"]) + random.choice("bcdfgh") for _ in range(n))

    passages = [text(n) for n in (51, 55, 60, 90, 200)]
    line = text(45)
    rows = [(10 * k + i, f"{text(30)} {p} {text(30)}") for k, p in enumerate(passages) for i in range(4)]
    rows += [(100 + i, f"{text(40)}\n{line}\n{text(40)}") for i in range(5)] + [(200 + i, text(300)) for i in range(10)]
    docs = spark.createDataFrame(rows, DOC).withColumns({n: F.lit(n) for n in ("spans", "kept", "n_bytes", "d", "k1", "own_spans", "kept_id", "text_key")})
    out = corpus_pipeline.repeats(spark, docs, "")
    assert out.columns == docs.columns and {r["kept"] for r in out.collect()} == {"kept"}
    left, before = {r["doc_id"]: r["text"] for r in out.collect()}, dict(rows)
    assert all(left[i] == before[i] for i in before if i >= 100)
    assert all(passages[i // 10][3:-3] not in left[i] and len(left[i].split()) in (59, 60, 61) for i in before if i < 100)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert corpus_pipeline.contamination.__doc__


def test_one_of_each_keeps_clashing_columns(spark, hard_docs):
    named = hard_docs.withColumns({n: F.lit(n) for n in ("__key", "__kept", "__fp", "__own", "text_key", "kept_id", "KEPT_FP", "own_fp")})
    kept = simhash_dedup.one_of_each(named)
    assert kept.columns == named.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 7, 8, 9, 10]


def test_pipeline_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
