"""Operators that look at one text at a time."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filingscope.llm import bpe, html_extraction, language_id, quality_classifier, quality_rules, suffix_tree_lm

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(vocabulary, texts):
    return [np.frombuffer(ids, np.int32).tolist() for ids in vocabulary.encode(texts)]


@pytest.fixture(scope="module")
def vocabulary():
    with open(VOCABULARY, "rb") as file:
        return bpe.Vocabulary(file.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_bpe_equals_the_library(vocabulary, library):
    random.seed(1)
    pieces = ["a", "b", " ", "  ", "\n", "the", " in", "é", "'s", "'ll", "12", "<|endoftext|>", "!!", "\x1c", " ", "日本", "\x85", "aaa", "erbleation"]
    texts = ["".join(random.choice(pieces) for _ in range(random.randint(0, 60))) for _ in range(3000)]
    texts += ["z" * 5000, "ab" * 3000, "", "<|endoftext|>"]
    ids = ids_of(vocabulary, texts)
    assert ids == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [vocabulary.decode(i) for i in ids] == texts


def test_bpe_splits_every_character_like_the_library(vocabulary, library):
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c} {c}1{c}{c} b" for c in characters[i : i + 400]) for i in range(0, len(characters), 400)]
    assert ids_of(vocabulary, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_pair_check_agrees_with_merging(vocabulary):
    random.seed(2)
    a = np.array([random.randrange(50256) for _ in range(4000)])
    b = np.array([random.randrange(50256) for _ in range(4000)])
    stands = vocabulary.compatible(a.copy(), b.copy())
    for x, y, ok in zip(a.tolist(), b.tolist(), stands.tolist()):
        assert (vocabulary.merge(vocabulary.bytes_of[x] + vocabulary.bytes_of[y]) == [x, y]) == ok


def test_bpe_many_equals_one_by_one(vocabulary):
    random.seed(3)
    words = [bytes(random.choice(b"abeionrst ") for _ in range(random.randint(1, 30))) for _ in range(2000)] + [b"aaaa", b"a" * 40]
    assert vocabulary.merge_many(words) == [vocabulary.merge(w) for w in words]


def test_bpe_hard_rows(spark, hard_docs, no_docs, library):
    got = sorted((tuple(r) for r in bpe.digests(hard_docs, VOCABULARY).collect()), key=str)
    expected = []
    for row in hard_docs.select("doc_id", "text").collect():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        digest = [hashlib.sha256(v.encode()).hexdigest() for v in (",".join(map(str, ids)), text)]
        expected.append((row["doc_id"], len(ids), *digest))
    assert got == sorted(expected, key=str)
    assert bpe.digests(no_docs, VOCABULARY).collect() == []


def test_language_profiles_rank_by_frequency_and_code(spark):
    docs = spark.createDataFrame([("en", "ab ab ac"), ("en", None), (None, "zz")], "lang string, text string")
    rows = language_id.profiles(docs).collect()
    counts = Counter(language_id.grams("ab ab ac").tolist())
    expected = sorted(counts, key=lambda g: (-counts[g], g))
    assert [r["gram"] for r in sorted(rows, key=lambda r: r["rank"])] == expected
    assert {r["lang"] for r in rows} == {"en"}


def test_language_by_out_of_place_distance(spark):
    """Ranks and distances by dictionaries; candidates are cut before the shuffle."""
    random.seed(41)
    rows = [(i, " ".join(random.choice(words) for _ in range(random.randint(1, 40))), lang) for i, (lang, words) in enumerate([("xx", ["abra", "cad", "bra"]), ("yy", ["zot", "kip", "abr"])] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs.where("doc_id < 20"), 30)

    def order(counts):
        return [g for g, _ in sorted(counts.items(), key=lambda c: (-c[1], c[0]))][:30]

    profiles = {lang: order(Counter(g for i, t, own in rows if own == lang and i < 20 for g in language_id.grams(t).tolist())) for lang in ("xx", "yy")}
    assert model == profiles
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model, 30).collect()}
    for i, text, _ in rows:
        own = order(Counter(language_id.grams(text).tolist()))
        apart = {lang: sum(abs(own.index(g) - p.index(g)) if g in p else 30 for g in own) for lang, p in profiles.items()}
        best = min(apart, key=lambda lang: (apart[lang], lang))
        assert got[i][0] == best and abs(got[i][1] - (1 - apart[best] / (30 * len(own)))) < 1e-12
    assert "WindowGroupLimit" in language_id.profiles(docs)._jdf.queryExecution().executedPlan().toString()


def test_language_hard_rows(hard_docs, no_docs):
    model = language_id.fit(hard_docs.where("doc_id in (1, 2)"))
    got = {r["doc_id"]: r for r in language_id.predict(hard_docs, model).where("doc_id is not null").collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 6, 7)] == ["en", "fr", "en", "und", "und", "und", "und"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1]["score"] > 0.9
    assert language_id.predict(hard_docs, model).count() == hard_docs.count()
    assert language_id.fit(no_docs) == {}
    assert {r["lang_pred"] for r in language_id.predict(hard_docs, {}).collect()} == {"und"}
    kept = language_id.identified(hard_docs, model, 0.25)
    assert kept.columns == hard_docs.columns
    assert {1, 2, 3} <= {r["doc_id"] for r in kept.collect()} and not {4, 5, 6, 7} & {r["doc_id"] for r in kept.collect()}


def test_language_ties_go_to_the_first_name(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    same = language_id.ranked("abc").tolist()
    assert language_id.predict(docs, {"xx": same, "aa": same}).first()["lang_pred"] == "aa"


def plain_repeat_words(words):
    windows = Counter(zip(words, words[1:], words[2:]))
    return sum(any(windows[tuple(words[j : j + 3])] > 1 for j in range(max(0, i - 2), i + 1) if j + 3 <= len(words)) for i in range(len(words)))


def test_rules_base_counts():
    random.seed(4)
    for _ in range(200):
        text = "".join(random.choice(["a", "b", "c", " ", "\n", "#", " ", "\t"]) for _ in range(random.randint(0, 60)))
        view = quality_rules.Text(text)
        words = [w for w in text.replace("\n", " ").replace("\t", " ").split(" ") if w]
        assert [w.decode() for w in view.words] == words
        assert view.word_chars == sum(map(len, words)) and view.symbols == text.count("#")
        lines = [line for line in text.split("\n") if line.strip(" \t")]
        assert view.duplicate_lines == sum(line in lines[:i] for i, line in enumerate(lines))
        assert view.repeat_words == plain_repeat_words(words)


def test_rule_order_changes_no_verdict(hard_docs, no_docs):
    names = list(quality_rules.RULES)
    out = [sorted((str(r["doc_id"]), r["kept"]) for r in quality_rules.apply_rules(hard_docs, order=o).collect()) for o in (names, names[::-1])]
    assert out[0] == out[1]
    assert sorted(quality_rules.cascade_order(hard_docs)) == sorted(names)
    assert quality_rules.apply_rules(no_docs).collect() == []


def test_classifier_rules_compile_to_what_they_say(spark):
    rows = [(i, ("word%d other text here. " % (i % 7)) * 20 if i % 2 else "### ||| $$$ %%% " * 20) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(5, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    stats = quality_classifier.statistics(docs)
    rules = quality_classifier.fit(stats, labels)
    assert rules.weighted
    got = {r["doc_id"]: r["s"] for r in stats.select("doc_id", quality_classifier.score(rules).alias("s")).collect()}
    assert all((got[i] >= 0.3) == (i % 2 == 1) for i in range(200)) and all(0 <= s <= 1 for s in got.values())
    for i, text in rows[:2]:
        values = dict(zip(quality_classifier.FEATURES, quality_classifier.describe(text)))
        total = rules.intercept + sum(w for rule, w in rules.weighted if all((values[f] <= b) == at_most for f, at_most, b in rule))
        assert abs(got[i] - 1 / (1 + np.exp(-total))) < 1e-9


def test_classifier_hard_rows(spark, hard_docs, no_docs):
    stats = quality_classifier.statistics(hard_docs)
    assert all(np.isfinite(r[1:]).all() for r in stats.collect())
    one_class = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    for labels, low, high in ((one_class, 0.6, 0.9), (none, 0.4, 0.6)):
        rules = quality_classifier.fit(stats, labels)
        scores = [r[0] for r in stats.select(quality_classifier.score(rules)).collect()]
        assert all(low < s < high for s in scores)
    assert quality_classifier.statistics(no_docs).collect() == []


def test_tree_paths():
    printed = "x\n  If (feature 0 <= 1.5)\n   If (feature 3 <= 0.25)\n    Predict: 0.0\n   Else (feature 3 > 0.25)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n"
    a, b = quality_classifier.FEATURES[0], quality_classifier.FEATURES[3]
    assert quality_classifier.paths(printed) == [((a, True, 1.5),), ((a, True, 1.5), (b, True, 0.25)), ((a, True, 1.5), (b, False, 0.25)), ((a, False, 1.5),)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="with-sidebar">
<header><div>Site name</div></header><nav><ul><li><a href=/x>x</a></ul></nav><div class="sidebar">Side text</div>
<div id="wrap-12"><div class="post-content p7"><h1>Title &amp; more</h1><p>First <i>para</i> with <a href="x>y">link</a>.<br>next
 line<p>Second&nbsp;para a < b &copy;<ul><li>one<li>two</ul><div class="ad-box">Buy now</div><aside>rel</aside>
<form><label>Mail</label></form><div class="cookie-notice">cookies</div><section class="comments"><p>a reader said something long here</p></section></div></div>
<footer>foot</footer></body></html>"""


def test_html_page():
    assert html_extraction.vote(PAGE) == "/html/body.with-sidebar/div/div.#.post-content"
    assert html_extraction.extract(PAGE, []) == "Title & more\n\nFirst para with link. next line\n\nSecond para a < b ©\n\none\n\ntwo"


def test_html_consensus_reads_short_pages_like_long_ones(spark):
    def page(body):
        return f"<html><body><div class=top>{'menu words ' * 9}</div><div class=text>{body}</div></body></html>"

    pages = [(i, "http://h.example/%d" % i, page("<p>" + "long text " * 60 + "</p>")) for i in range(5)] + [(9, "http://H.example/9", page("<p>short</p>"))]
    rows = html_extraction.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in rows}[9] == "short"


def texts_of(spark, pages):
    rows = [(i, f"http://h.example/{i}", html) for i, html in enumerate(pages)]
    return [r["text"] for r in html_extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).orderBy("page_id").collect()]


LONG = "A sentence of the article that goes on for a while, as articles do. " * 9


@pytest.mark.parametrize("name", ["with-sidebar", "has-header", "comments-open", "sidebar", "page-header"])
def test_html_body_with_a_class_word(name):
    page = f"<html><body class='{name}'><nav>menu</nav><div class='{name}'><div class=text><p>{LONG}</p></div></div><footer>foot</footer></body></html>"
    assert html_extraction.extract(page) == LONG.strip()
    assert html_extraction.vote(page).endswith("/div.text")


def test_html_parts_of_an_article_stay():
    page = f"<body><article><p>{LONG}</p><section class='related-work'><p>Earlier work.</p></section><div class='ad-box'>Buy</div><div class=related-posts>More</div><div class='social share'>Share</div></article></body>"
    assert html_extraction.extract(page) == f"{LONG.strip()}\n\nEarlier work."


def test_html_host_with_many_templates(spark):
    """Twenty templates on one host, rare ones too; all pages have the teaser that a common template's article has."""
    pages, expected = [], []
    for kind in range(20):
        for i in range(30 if kind == 0 else 2):
            text = f"{kind} {i} {LONG}".strip()
            main = f"<article class='story'><p>{text}</p></article>" if kind == 0 else f"<div class='t{chr(97 + kind)}-body'><p>{text}</p></div><article class='story'><p>Tiny teaser</p></article>"
            pages.append(f"<html><body><div class=top>menu words</div>{main}</body></html>")
            expected.append(text)
    assert texts_of(spark, pages) == expected


def test_html_menu_voted_down(spark):
    """The menu is longer than some articles; the host's other pages have it and do not vote for it."""
    menu = "menu words " * 20
    pages = [f"<body><div class=top>{menu}</div><div class=text><p>{LONG if i % 4 else 'short'}</p></div></body>" for i in range(20)]
    assert texts_of(spark, pages) == [LONG.strip() if i % 4 else "short" for i in range(20)]


def test_html_votes_against_a_plain_count(spark):
    import random as r

    r.seed(8)
    pages = [f"<body><div class='{r.choice('abc')}'><p>{LONG if r.random() < 0.7 else 'x'}</p></div><section><p>{LONG if r.random() < 0.5 else 'y'}</p></section></body>" for _ in range(60)]
    rows = [(i, r.choice(["http://A/1", "http://a/2", "http://b/", None]), html) for i, html in enumerate(pages)]
    got = {(x["host"], x["path"]): (x["votes"], x["pages"]) for x in html_extraction.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {}
    for host in ("a", "b", ""):
        own = [html for _, url, html in rows if (url or "").lower().rstrip("/12").replace("http://", "") == host]
        for path in {html_extraction.vote(h) for h in own}:
            have = sum(any(p.path(i) == path and e.tag in html_extraction.CONTAINERS for i, e in enumerate(p.elements)) for p in map(html_extraction.parse, own))
            want[host, path] = (sum(html_extraction.vote(h) == path for h in own), have)
    assert got == want


def test_html_paths_of_deep_pages():
    deep = "<div>" * 40
    page = html_extraction.parse(f"<body>{deep}<p>x</p>{'</div>' * 40}{deep}</body>")
    keys = [e.key for e in page.elements if e.tag == "div"]
    assert len(set(keys)) == 40 and page.path(40) == "/body" + "/div" * 39


def test_html_hard_rows(spark):
    pages = [(1, None, None), (None, "no url", ""), (2, "http://[bad", "<p>x"), (3, "http://a/", "plain &amp text"), (4, "http://a/", "<"), (5, "http://a/", "<div>" * 3000 + "deep"), (6, "http://a/", "<!-- open <p>a</p>"), (1, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'z' AS text", "'z' AS host", "1 AS salt", "'z' AS paths")
    got = [tuple(r) for r in html_extraction.main_text(df).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, None, "", 0), (None, "no url", "", 0), (2, "http://[bad", "x", 1), (3, "http://a/", "plain & text", 12), (4, "http://a/", "<", 1), (5, "http://a/", "deep", 4), (6, "http://a/", "", 0), (1, None, "", 0)], key=str
    )
    assert html_extraction.main_text(df.limit(0)).collect() == []


def tree_of(docs):
    counts = suffix_tree_lm.word_counts(docs).cache()
    tree = suffix_tree_lm.root(counts)
    return suffix_tree_lm.fit(suffix_tree_lm.encode(docs, tree, F.lit(True)), tree), counts


def test_suffix_tree_is_a_distribution(spark):
    """The probabilities of all words after a context, the unknown word included, sum to one."""
    random.seed(6)
    texts = [" ".join(random.choice(["a b c d", "a b c e", "x y", "q"]) for _ in range(30)) for _ in range(60)]
    tree, counts = tree_of(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert len(tree.keys) == suffix_tree_lm.DEPTH + 1 and any((r != 0).any() for r in tree.log_rest)
    words = sorted({w for t in texts for w in t.split()} | {"never"})
    docs = spark.createDataFrame([(i, f"a b c {w}") for i, w in enumerate(words)], "doc_id long, text string")
    rows = suffix_tree_lm.score(suffix_tree_lm.encode(docs, tree, F.lit(False)), tree, counts)
    scored = {r["doc_id"]: r["score"] for r in rows.collect()}
    code = suffix_tree_lm.Coder(tree.keys[0])
    total = 0.0
    for text in ["a b c", *(f"a b c {w}" for w in words)]:
        _, codes, sizes = code([text])
        part = suffix_tree_lm.token_scores(tree, codes, sizes)
        mass = np.log10(tree.total + 0.1 * (tree.distinct + 1))
        total += 10 ** (part[3] + (np.log10(0.1) - mass if codes[3] < 0 else 0.0))
    assert abs(total - 1) < 1e-9
    assert scored[words.index("d")] > scored[words.index("x")] > scored[words.index("never")]


def plain_suffix_scores(rows, depth, least, discount, divergence):
    """Scores by a suffix tree in dictionaries; rows are (doc_id, text, learn)."""
    import math

    cut = lambda t: [*(t or "").lower().split(), ""]
    learnt = [cut(t) for _, t, learn in rows if learn]
    counts = Counter(tuple(w[i : i + n]) for w in learnt for n in range(1, depth + 2) for i in range(len(w) - n + 1))
    total, distinct = sum(len(w) for w in learnt), len({x for w in learnt for x in w})
    mass = total + 0.1 * (distinct + 1)
    root = lambda w: (counts.get((w,), 0) + 0.1) / mass
    p = {s: root(s[0]) for s, n in counts.items() if len(s) == 1 and n >= least}
    rest = {}  # of kept contexts
    for d in range(1, depth + 1):
        seen = {}
        for s, n in counts.items():
            if len(s) == d + 1 and n >= least:
                seen.setdefault(s[:-1], []).append(s)
        for context, own in seen.items():
            times = counts[context]
            free = max(1e-12, 1 - sum((counts[s] - discount) / times for s in own))
            left = max(0.0, 1 - sum(p[s[1:]] for s in own))
            smooth = {s: (counts[s] - discount) / times + free * p[s[1:]] for s in own}
            won = sum(q * math.log(q / p[s[1:]]) for s, q in smooth.items()) + free * left * math.log(free)
            if times * won > divergence:
                rest[context] = free
            p.update(smooth if context in rest else {s: p[s[1:]] for s in own})

    def prob(context, word):
        s = (*context, word)
        if not context:
            return root(word)
        if s in p:
            return p[s]
        return rest.get(context, 1.0) * prob(context[1:], word)

    return [sum(math.log10(prob(tuple(w[max(0, i - depth) : i]), w[i])) for i in range(len(w))) for w in (cut(t) for _, t, _ in rows)]


def test_suffix_tree_against_a_plain_one(spark):
    random.seed(23)
    rows = [(i, " ".join(random.choice(["a b c d", "a b c e", "x y", "Q", f"r{i % 9} s t", "u"]) for _ in range(random.randint(0, 25))) if i % 17 else None, i % 4 > 0) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(4)
    got = {r["doc_id"]: r["score"] for r in suffix_tree_lm.scored(docs.select("doc_id", "text"), F.col("doc_id") % 4 > 0).collect()}
    want = plain_suffix_scores(rows, suffix_tree_lm.DEPTH, suffix_tree_lm.LEAST, suffix_tree_lm.DISCOUNT, suffix_tree_lm.DIVERGENCE)
    assert [got[i] for i, _, _ in rows] == pytest.approx(want, abs=1e-9)


def test_packed_counts(spark):
    from filingscope.llm import packed

    rng = np.random.default_rng(4)
    for n, top in ((0, 1), (1, 1 << 60), (5000, 400), (5000, 1 << 63), (70000, 1 << 40)):
        keys = np.unique(rng.integers(0, top, n).astype(np.uint64))
        counts = rng.integers(1, 400, len(keys))
        back = packed.unpack(packed.pack(keys, counts, counts - 7))
        assert (back[0] == keys).all() and (back[1] == counts).all() and (back[2] == counts - 7).all()
    values = [[random.choice([random.getrandbits(63) - (1 << 62), random.randrange(50), -7]) for _ in range(random.randint(0, 200))] for _ in range(30)]
    rows = spark.createDataFrame([(v,) for v in values], "v array<long>").repartition(5)
    for expected in (1, 100_000_000):
        got = packed.counted(rows, lambda b: b.column(0).flatten().to_numpy(zero_copy_only=False), expected, 2)
        valued = packed.counted(rows, lambda b: (v := b.column(0).flatten().to_numpy(zero_copy_only=False), v ^ 5), expected, 2, valued=True)
        assert {(r["key"], r["n"]) for r in got.collect()} == {(r["key"], r["n"]) for r in valued.collect() if r["value"] == r["key"] ^ 5}
        assert {r["key"]: r["n"] for r in got.collect()} == {k: n for k, n in Counter(x for v in values for x in v).items() if n >= 2}


def test_suffix_tree_scores_do_not_depend_on_shares(spark, monkeypatch):
    """A context that occurs often enough counts, however small its share of the corpus is."""
    random.seed(11)
    texts = [" ".join(random.choice(["a b c d", "a b c e", "x y", "q", f"r{i % 40} s t"]) for _ in range(30)) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")

    def scores():
        return {r["doc_id"]: r["score"] for r in suffix_tree_lm.scored(docs, F.col("doc_id") % 4 > 0).collect()}

    expected = scores()
    for share in (0.01, 1.0):  # some states, or all, are looked up by a join
        monkeypatch.setattr(suffix_tree_lm, "SHARE", share)
        got = scores()
        assert got.keys() == expected.keys() and all(abs(got[i] - expected[i]) < 1e-6 for i in got)


def test_suffix_tree_hard_rows(hard_docs, no_docs):
    rows = suffix_tree_lm.scored(hard_docs, F.lit(True)).collect()
    assert len(rows) == hard_docs.count() and all(np.isfinite([r["score"], r["base_score"]]).all() for r in rows)
    plain = Counter()
    texts = [(r["doc_id"], [*(r["text"] or "").encode().lower().split(), b""]) for r in hard_docs.collect()]
    for _, words in texts:
        plain.update(words)
    n, v = sum(plain.values()), len(plain)
    expected = sorted((str(i), len(w), sum(plain[x] > 0 for x in w), n, round(float(sum(np.log10((plain[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)), 3)) for i, w in texts)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in rows) == expected
    assert all(np.isfinite(r["score"]) for r in suffix_tree_lm.scored(hard_docs, F.lit(False)).collect())
    assert suffix_tree_lm.scored(no_docs, F.lit(True)).collect() == []
