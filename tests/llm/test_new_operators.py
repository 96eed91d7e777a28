"""The n-gram Jaccard join, the Merkle manifest and periodic runs against brute force."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingscope.llm import jaccard_join, merkle_manifest, periodic_runs, queries

DOC = "doc_id long, text string"


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


# --- n-gram Jaccard join


def gram_set(text, width=3):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def similar(a, b, num=90, den=100):
    return bool(a) and bool(b) and den * len(a & b) >= num * len(a | b)


def brute_groups(rows):
    sets = [gram_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids and sets[i] else doc_id))
    return plain(out)


def edited(words, times):
    words = list(words)
    for _ in range(times):
        at = random.randrange(len(words))
        words[at : at + random.choice([0, 1, 1])] = [random.choice("abcdefgh") * random.randint(1, 3)]
    return words


def corpus(n=260):
    random.seed(11)
    texts = []
    while len(texts) < n:
        length = random.choice([1, 2, 3, 5, 12, 40, 120, 300])
        base = [f"w{random.randrange(400)}" for _ in range(length)]
        texts += [" ".join(edited(base, random.randint(0, max(1, length // 30)))) for _ in range(random.randint(1, 9))]
    texts += ["", None, " \n ", "One", "one", texts[5].upper(), "word " * 20000]
    rows = [(None if i % 41 == 7 else i, t) for i, t in enumerate(texts)]
    return rows + rows[3:6]


def test_similar_groups_against_all_pairs(spark):
    rows = corpus()
    got = jaccard_join.similar_groups(spark.createDataFrame(rows, DOC)).collect()
    assert plain(got) == brute_groups(rows)


def test_large_groups_are_dealt_without_loss(spark, monkeypatch):
    """One large group of near copies with some that differ more, far above what an index may hold."""
    monkeypatch.setattr(jaccard_join, "GROUP_SETS", 8)
    random.seed(12)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(edited(base, random.choice([1, 2, 3, 4, 9])))) for i in range(90)]
    got = jaccard_join.similar_groups(spark.createDataFrame(rows, DOC)).collect()
    assert plain(got) == brute_groups(rows)


def test_signatures_of_similar_sets_meet():
    random.seed(13)
    levels, met = jaccard_join.Levels(90, 100), 0
    for _ in range(1500):
        base = np.unique(np.array([random.getrandbits(64) for _ in range(random.randint(1, random.choice([20, 40, 400])))], np.uint64))
        cut, new = random.randint(0, len(base) // 12), random.randint(0, len(base) // 18)
        other = np.unique(np.r_[base[cut:], np.array([random.getrandbits(64) for _ in range(new)], np.uint64)])
        if similar(set(base.tolist()), set(other.tolist())) and len(np.union1d(base, other)) > len(np.intersect1d(base, other)):
            met += 1
            assert len(np.intersect1d(levels.signatures(base), levels.signatures(other)))
    assert met > 300


def test_divide_skip_against_all_pairs():
    random.seed(14)
    for _ in range(150):
        sets = [{random.getrandbits(24) for _ in range(random.randint(1, 60))} for _ in range(4)]
        while len(sets) < 25:
            sets.append(set(random.choice(sets)) ^ {random.getrandbits(24) for _ in range(random.randint(0, 3))})
        tied = [random.randrange(20) for _ in sets]
        names = [("class", c) for c in tied]
        edges = [(i, j) for i in range(25) for j in range(i) if names[i] == names[j] or similar(sets[i], sets[j])]
        found = jaccard_join.links([np.array(sorted(s), np.int64) for s in sets], tied)
        assert all(similar(sets[a], sets[b]) for a, b in found)
        same = [(i, j) for i in range(25) for j in range(i) if names[i] == names[j]]
        assert joined(edges, 25) == joined(found + same, 25)


def test_sets_that_share_much_and_are_not_similar_are_counted_at_once():
    rng = np.random.default_rng(15)
    sets = [np.sort(rng.choice(4000, 2000, replace=False)) for _ in range(400)]
    before = time.process_time()
    assert jaccard_join.links(sets, list(range(400))) == []
    assert time.process_time() - before < 5


def joined(edges, n):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


# --- Merkle manifest


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(hashes):
    paths, own, level = [[] for _ in hashes], [[i] for i in range(len(hashes))], list(hashes)
    while len(level) > 1:
        up, up_own = [], []
        for a in range(0, len(level), 3):
            run = level[a : a + 3]
            for j in range(len(run)):
                for i in own[a + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(H("".join(run)))
            up_own.append(sum(own[a : a + 3], []))
        level, own = up, up_own
    return level[0], paths


def brute_manifest(rows):
    """Rows of doc_id, source, lang, n_chars, text."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    trees = []
    for source in sorted(by_source, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(by_source[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *tree([leaf(r) for r in own])))
    root, tops = tree([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (own, subroot, paths), top in zip(trees, tops):
        for r, path in zip(own, paths):
            path, value = path + top, leaf(r)
            if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0 and r[4] is not None:
                value = leaf((*r[:4], r[4].replace("\n", "")))
            for left, right in path:
                value = H(left + value + right)
            out.append((r[0], leaf(r), subroot, root, H("".join(a + b for a, b in path)), value, value == root))
    return plain(out)


MERKLE = "doc_id long, source string, lang string, n_chars long, text string"


def written(df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def merkle_rows():
    random.seed(15)
    sources = [None, "", "b", "é", "\U0001f600"]
    rows = [(i, "hot", "en", i, f"line {i}\nend") for i in range(40)]
    rows += [(random.choice([None, *range(30)]), random.choice(sources), random.choice([None, "fr"]), random.choice([None, 3]), random.choice([None, "", "a\nb", "ü" * 9])) for _ in range(60)]
    return rows + rows[:2] + [(7, "alone", None, None, "x" * 100000)]


@pytest.mark.parametrize("digits", [6, 1, 2])
def test_manifest_against_brute_force(spark, tmp_path, digits, monkeypatch):
    """Several tiers of blocks, nulls in all columns, repeated rows and ids, a source of one row."""
    monkeypatch.setattr(merkle_manifest, "DIGITS", digits)
    rows = merkle_rows()
    docs = spark.createDataFrame(rows, MERKLE).withColumns({n: F.lit(n) for n in ("g", "rank", "node", "hash", "path", "block", "order", "leaf", "at", "part")})
    assert plain(queries.op12_merkle(spark, written(docs.repartition(5), tmp_path)).collect()) == brute_manifest(rows)


def test_manifest_of_little(spark, tmp_path):
    one = spark.createDataFrame([(1, None, None, None, None)], MERKLE)
    assert plain(queries.op12_merkle(spark, written(one, tmp_path / "one")).collect()) == brute_manifest([(1, None, None, None, None)])
    none = spark.createDataFrame([], MERKLE)
    assert queries.op12_merkle(spark, written(none, tmp_path / "none")).collect() == []


def test_manifest_shuffles_a_block_once(spark):
    nodes = spark.range(100).select((F.col("id") % 3).cast("string").alias("g"), F.col("id").alias("rank"), (F.col("id") % 2).alias("total"), F.struct(F.lit("h").alias("hash")).alias("node"))
    plan = merkle_manifest._blocks(nodes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


# --- periodic runs


def brute_runs(words, least=12):
    best = {}
    for p in range(1, len(words) // 2 + 1):
        start = None
        for i in range(len(words) - p + 1):
            if i + p < len(words) and words[i] == words[i + p]:
                start = i if start is None else start
            elif start is not None:
                if i - start + p >= max(least, 2 * p):
                    best.setdefault((start, i - start + p), p)
                start = None
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


def periodic_words(n, letters):
    words = [random.choice("abcde"[:letters]).encode() for _ in range(n)]
    if n and random.random() < 0.6:
        a = random.randrange(n)
        p = 1 + (n - a) // random.randint(3, 10)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_runs_against_all_periods():
    random.seed(16)
    for _ in range(1500):
        words, least = periodic_words(random.randint(0, 80), random.choice([1, 2, 2, 3, 5])), random.choice([12, 4, 7])
        assert periodic_runs.runs(words, least) == brute_runs(words, least), words


@pytest.mark.parametrize("words", [[b"a"] * 60000, [b"a", b"b"] * 30000, ([b"a"] * 999 + [b"x"]) * 60], ids=["one", "two", "nested"])
def test_runs_of_long_periodic_texts(words):
    found = periodic_runs.runs(words)
    assert (0, len(words), next(p for p in (1, 2, 1000) if words[p:] == words[:-p])) in found


def brute_op13(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    digest = [H("".join(f"{s},{n},{p}\n" for s, n, p in found)), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()]
    return (doc_id, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), *digest)


def test_op13_against_brute_force(spark, tmp_path):
    random.seed(17)
    rows = [(i, random.choice([" ", "\n", " \t"]).join(w.decode() for w in periodic_words(random.randint(0, 70), random.choice([1, 2, 3])))) for i in range(150)]
    rows += [(None, None), (None, "a b c " * 9), (1, ""), (2, " \n "), (3, "é é " * 30), *rows[:3]]
    docs = spark.createDataFrame(rows, DOC).withColumns({n: F.lit(n) for n in ("runs", "collapsed", "best", "start", "words", "g", "period", "rest")})
    got = queries.op13_runs(spark, written(docs, tmp_path)).collect()
    assert plain(got) == plain(brute_op13(*r) for r in rows)


def test_new_operators_on_hard_and_empty_tables(spark, hard_docs, no_docs):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    rows = hard_docs.select(*fields).collect()
    assert plain(jaccard_join.similar_groups(hard_docs).collect()) == brute_groups([(r[0], r[4]) for r in rows])
    assert periodic_runs.periodic_runs(hard_docs).count() == len(rows)
    shown = merkle_manifest.manifest(hard_docs, fields, "source", "doc_id").select("doc_id", "leaf", "verified").collect()
    assert plain(shown) == plain((r[0], leaf(r), True) for r in rows)
    assert jaccard_join.similar_groups(no_docs).collect() == []
    assert periodic_runs.periodic_runs(no_docs).collect() == []
    assert merkle_manifest.manifest(no_docs, fields, "source", "doc_id").collect() == []
