"""Quality classifier, spelling variants and hard negatives."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from differential import connect, differences
from pyspark.sql import functions as F

from bookpulse.llm import classifier, negatives, queries, spelling, sql

# Quality classifier


def test_features_by_definition():
    text = "Ab ab, ab ab"
    places, counts = classifier.features(text, classifier.Hashes())
    values = classifier.values_of(counts)
    assert len(places) == len(set(places.tolist())) and (np.diff(places) > 0).all()
    # Ab, ab (3 times), the comma; the pairs Ab ab, ab comma, comma ab, ab ab.
    assert len(places) == 7 and float(values @ values) == pytest.approx(1)
    assert values.max() == pytest.approx((1 + np.log(3)) / np.sqrt(6 + (1 + np.log(3)) ** 2))
    for again in ("x x", "y y"):
        assert len(set(classifier.features(again, classifier.Hashes())[0].tolist())) == 2
    assert np.intersect1d(*(classifier.features(t, classifier.Hashes())[0] for t in ("x x", "y y"))).size == 1
    assert classifier.features(" \n", classifier.Hashes())[0].size == 0


def test_updates_by_brute_force():
    """Against the update rule written out a coordinate at a time."""
    rng = random.Random(1)
    rates = classifier.Rates(0.7, 1.3, 0.05, 0.4)
    examples = []
    for _ in range(80):
        places = sorted(rng.sample(range(12), rng.randint(0, 5)))
        counts = np.array([rng.randint(1, 9) for _ in places], np.int32)
        examples.append((np.array(places, np.int32), counts, rng.randint(0, 1)))
    z, n = np.zeros(classifier.SIZE + 1), np.zeros(classifier.SIZE + 1)
    classifier.learn(examples, z, n, rates)
    zs, ns = Counter(), Counter()

    def weight(i):
        l1, l2 = (0, 0) if i == classifier.SIZE else (rates.l1, rates.l2)
        if abs(zs[i]) <= l1:
            return 0.0
        return -(zs[i] - (l1 if zs[i] > 0 else -l1)) / ((rates.beta + ns[i] ** 0.5) / rates.alpha + l2)

    for places, counts, label in examples:
        tf = [1 + np.log(c) for c in counts.tolist()]
        x = {p: v / sum(t * t for t in tf) ** 0.5 for p, v in zip(places.tolist(), tf)} | {classifier.SIZE: 1.0}
        w = {i: weight(i) for i in x}
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - label) * v
            sigma = ((ns[i] + g * g) ** 0.5 - ns[i] ** 0.5) / rates.alpha
            zs[i] += g - sigma * w[i]
            ns[i] += g * g
    for i in [*range(12), classifier.SIZE]:
        assert z[i] == pytest.approx(zs[i]) and n[i] == pytest.approx(ns[i])
    got = classifier.weights(z[[*range(12), classifier.SIZE]], n[[*range(12), classifier.SIZE]], rates)
    assert got == pytest.approx([weight(i) for i in [*range(12), classifier.SIZE]])


def labelled(spark, n=600):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(n):
        text = [w + "!!" if k % 3 == 0 and rng.random() < 0.5 else w for w in rng.choices(words, k=40)]
        docs.append((k, " ".join(text)))
        labels.append((k, int(k % 3 != 0)))
    return docs, labels


def test_quality_is_learned_and_held_out(spark):
    docs, labels = labelled(spark)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    y = spark.createDataFrame([*labels, (5, None), (None, 0), (9999, 1)], "doc_id long, label int")
    held = queries.fold(5) == 0
    learned = classifier.fit(d.where(~held), y.where(~held))
    scored = {r.doc_id: r.score for r in classifier.score(d, learned, [F.col("doc_id")]).collect()}
    assert all((scored[k] >= 0.3) == (k % 3 != 0) for k, _ in docs)
    again = classifier.fit(d.where(~held).repartition(7), y.where(~held))
    assert np.allclose(learned, again)
    few = classifier.fit(d, y, sample=60)
    right = [(r.score >= 0.5) == (r.doc_id % 3 != 0) for r in classifier.score(d, few, [F.col("doc_id")]).collect()]
    assert sum(right) > 0.9 * len(right)


def test_classifier_on_odd_rows(spark, odd, none):
    y = spark.createDataFrame([(3, 1), (3, 0), (5, 0), (7, None), (None, 1)], "doc_id long, label int")
    learned = classifier.fit(odd, y)
    rows = classifier.score(odd, learned, [F.col("doc_id")]).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 4)}) == 1  # no token: the offset alone
    assert len({r.score for r in rows if r.doc_id is None}) == 1
    nothing = classifier.fit(odd, y.limit(0))
    assert {r.score for r in classifier.score(odd, nothing, [F.col("doc_id")]).collect()} == {0.5}
    assert not classifier.fit(none, y).any() and classifier.score(none, learned, [F.col("doc_id")]).count() == 0


# Spelling variants


def brute_counts(docs):
    n = Counter()
    for ident, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            word = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if ident is None else ident}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_groups(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 5 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def groups(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_by_brute_force(spark):
    """Words over two letters, so that grams repeat within words and order ties are many."""
    rng = random.Random(5)
    docs = []
    for k in range(300):
        words = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 8))) for _ in range(40)]
        words += [rng.choice(["Schreibung", "schreibüng", "schreibungs", "shreibung"]) for _ in range(12)]
        docs.append((k, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    n = brute_counts(docs)
    assert len(n) > 200
    assert {r.word: r.n for r in spelling.variant_counts(df).collect()} == n
    assert groups(spelling.variant_groups(spelling.variant_counts(df))) == brute_groups(n)


def test_pairs_of_short_and_random_words(spark):
    rng = random.Random(6)
    words = {"", "a", "b", "ab", "ba", "abc", "abcd", "abcde", "bcde", "\U0001F600bcde", "\U0001F600bcd"}
    words |= {"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(250)}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = {(r.word, r.near) for r in spelling.near_pairs(df).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}
    hot = [f"{'x' * k}common{'y' * j}end" for k in range(12) for j in range(12)]
    df = spark.createDataFrame([(w, 7) for w in hot], "word string, n long")
    assert {(r.word, r.near) for r in spelling.near_pairs(df).collect()} == {(a, b) for a in hot for b in hot if one_edit(a, b)}


def test_forms_chain_to_the_root_and_ties_go_by_code_point(spark):
    rows = [("wordab", 5), ("wordabc", 25), ("wordabcd", 125), ("wordabce", 125), ("alonely", 9), ("alonely", 1), (None, 4)]
    got = groups(spelling.variant_groups(spark.createDataFrame(rows, "word string, n long")))
    assert got["wordab"] == ("wordabc", "wordabcd", 5, 1, 25)
    assert got["wordabc"] == ("wordabcd", "wordabcd", 25, 3, 125)
    assert got["wordabcd"] == (None, "wordabcd", 125, 2, None)
    assert got["alonely"] == (None, "alonely", 10, 0, None) and len(got) == 5


@pytest.mark.parametrize("places, cost", [([0, 1, 2], [5, 1, 1]), ([0, 2, 3], [9, 1, 1]), ([1, 2, 3, 4, 8], [4, 4, 1, 4, 3])])
def test_pivots_are_the_cheapest_disjoint_pair(places, cost):
    pairs = [(cost[i] + cost[j], a, b) for i, a in enumerate(places) for j, b in enumerate(places) if b >= a + 2]
    a, b = spelling.pivots(places, cost)
    assert b >= a + 2 and cost[places.index(a)] + cost[places.index(b)] == min(pairs)[0]


def test_variants_of_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert groups(spelling.variant_groups(spelling.variant_counts(odd))) == brute_groups(brute_counts(rows))
    assert spelling.variant_groups(spelling.variant_counts(none)).count() == 0


# Hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, __copy int, uid long, leaf long"


def written(tmp_path, spark, rows):
    spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def clusters(rng, n, dims, spread):
    centres = rng.normal(size=(8, dims))
    x = centres[rng.integers(0, 8, n)] + spread * rng.normal(size=(n, dims))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(float)


def against_sql(spark, path):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    return differences(queries.op13_hard_negatives(spark, path), con, sql.SQL["op13_hard_negatives"])


@pytest.mark.parametrize("spread", [0.05, 0.5])
def test_negatives_by_sql(spark, tmp_path, monkeypatch, spread):
    monkeypatch.setattr(negatives, "LEAF_SAMPLE", 40)
    monkeypatch.setattr(negatives, "ROWS", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    rng = np.random.default_rng(4)
    x = clusters(rng, 2000, 12, spread)
    rows = [(k, v.tolist(), int(rng.integers(0, 4))) for k, v in enumerate(x)]
    assert against_sql(spark, written(tmp_path, spark, rows)) == []


def test_negatives_of_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF_SAMPLE", 20)
    rng = np.random.default_rng(5)
    rows = [(k, v.tolist(), int(rng.integers(0, 3))) for k, v in enumerate(clusters(rng, 300, 5, 0.3))]
    same = [0.5, 0.5, 0.5, 0.5, 0.0]
    rows += [(1000 + k, same, k % 3) for k in range(400)]  # one vector, many times
    nan, inf = float("nan"), float("inf")
    rows += [(k, [nan, 1.0, 0.0, 0.0, 0.0], 1) for k in (5000, 5001)] + [(5002, [inf, 0.0, 0.0, 0.0, 0.0], 1), (5003, None, 1)]
    rows += [(5004, [None, 0.0, 0.0, 0.0, 0.0], 1), (5005, same, None), (-700, same, 2), (None, same, 1)]
    rows += [(6000, [0.0] * 5, 0), (6100, same, 7)]
    assert against_sql(spark, written(tmp_path, spark, rows)) == []


def test_repeated_rows_short_vectors_and_no_rows(spark):
    schema = "id long, label long, vector array<double>"
    rows = [(0, 1, [3.0, 4.0]), (0, 1, [3.0, 4.0]), (2, 1, [1.0]), (3, 2, [1.0, 1.0]), (4, 2, [1e200, 0.0]), (5, 2, [])]
    got = negatives.hard_negatives(spark.createDataFrame(rows, schema), F.col("id") == 0, percent=(0, 90))
    found = Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect())
    # Each copy is an anchor, the other its first positive; the short vector scores 3, too little for row 3.
    assert found == Counter({(0, 0, 1, 3, 25, 7): 2, (0, 0, 2, 5, 25, 0): 2, (0, 2, 1, 5, 3, 0): 2})
    empty = spark.createDataFrame([], schema)
    assert negatives.hard_negatives(empty, F.col("id") == 0).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame(rows, schema), F.col("id") == 77).count() == 0


def test_subtrees_left_out_hold_no_score_of_the_window():
    rng = np.random.default_rng(7)
    x = np.floor(256 * clusters(rng, 3000, 8, 0.03))
    longest = float((x * x).sum(axis=1).max())
    up = negatives.lifted(x, longest)
    tree = negatives.grown(up[:1000], longest)
    leaf = tree.leaf_of(up)
    for number, _, apart, nearest in tree.walk(up):
        node = tree.nodes[number]
        for j in np.unique(nearest):
            node.low[:, j] = np.minimum(node.low[:, j], apart[nearest == j].min(axis=0))
            node.high[:, j] = np.maximum(node.high[:, j], apart[nearest == j].max(axis=0))
    scores = x[:50] @ x.T
    low, high = np.full((50, 1), 0.55 * 65536), np.full((50, 1), 0.7 * 65536)
    reached = tree.reached(x[:50], low, high)
    inside = (scores >= low) & (scores <= high)
    for a in range(50):
        assert set(leaf[inside[a]]) <= set(np.flatnonzero(reached[a]))
    assert tree.leaves > 4 and not reached.all()
