"""Operators over the corpus: personal data, toxicity, duplicates, mixing, and the pipeline."""

import hashlib
import itertools
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from differential import connect, differences
from pyspark.sql import functions as F

from bookpulse.llm import exact_dedup, mixing, pii, queries, simhash, sql, toxicity
from bookpulse.llm.common import store, table
from bookpulse.llm.components import components

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no benchmark tables")
@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_against_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), sql.SQL[name]) == []


# Personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for number, (kind, regex) in enumerate(PLAIN.items()):
        for m in re.finditer(regex, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
            if {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(d) <= 19 and luhn % 10 == 0,
                "phone": 10 <= len(d) <= 15,
            }[kind]:
                out.append((m.start(), number, m.end(), kind))
    return ",".join(f"{kind}:{a}:{e}" for a, _, e, kind in sorted(out))


def test_base_matches_by_brute_force(spark, odd, none):
    rng = random.Random(2)
    texts = [
        "a@b.c_d@e.f.g x..y@z.q- +1 (017) 555-7713 4111 1111 1111 1111 é 1.2.3.4.5.6.7.8 001.255.0300.4 1.2.3.0255",
        "4111-1111--1111 1111 4111111111111111 " + "1" * 9000, "a@" + "b." * 9000 + "c", "x" * 20000 + "@y.z",
        *("".join(rng.choice("0123456789 .-+@ab()é") for _ in range(300)) for _ in range(60)),
        *("".join(rng.choice("0123456789 -") for _ in range(400)) for _ in range(40)),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    for k, text in enumerate(texts):
        want = base_spans(text)
        assert got[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), text[:80]
        assert [got[k][f"n_{kind}"] for kind in pii.KINDS] == [want.count(f"{kind}:") for kind in pii.KINDS]
    rows = pii.personal_data(odd).collect()
    assert len(rows) == odd.count() and sum(r.n_email + r.n_phone for r in rows) == 2
    assert pii.personal_data(none).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    ips = [f"10.0.{k}.{k + 1}" for k in range(40)]
    texts = [f"Then you connect to host {ip} without delay." for ip in ips]
    texts += ["Then you connect to host 10-20-30-77-x without delay.", "Elsewhere 10-20-30-77-x was seen.", "A sum of 77123456 was paid."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    assert all(got[k].spans == base_spans(texts[k]) for k in range(40))
    for k in (40, 41):
        at = texts[k].index("10-20")
        assert got[k].spans == f"ip:{at}:{at + len('10-20-30-77-x')}" and got[k].n_ip == 0
    assert got[42].spans == "" and got[42].n_spans == 0
    assert got[40].n_spans == 1 and all(got[k].n_spans == got[k].n_ip == 1 for k in range(40))


def test_instances_within_long_runs(spark):
    many = " ".join(f"id{k}77123@host" for k in range(8))
    texts = [f"contact address email me at {many}", "paid 4111 1111 1111 1111. 4471-882-19 2024-05-01", "key " + "9f" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.instances(pii.occurrences(df)[1]).collect()
    cores = sorted(texts[k][r.start : r.end] for r in found for k in range(3) if r.row == rows_of(df)[k])
    want = [*many.split(" "), "4111 1111 1111 1111", "4471-882-19", "2024-05-01", "9f" * 5000]
    assert cores == sorted(want)
    of = {r.value: r.patterns for r in found}
    assert of["id077123@host"] == ["2 me at", "1 at _ id0@host"]
    assert of["id377123@host"] == ["2 id0@host id0@host", "1 id0@host _ id0@host"]
    assert of["2024-05-01"] == ["2 1111. 0-0-0".replace("1111", "0")]


def test_seeds_are_whole_base_matches(spark):
    """A number of several groups is one seed; its parts are no instances of their own, and teach its context."""
    rng = random.Random(9)
    texts = [f"Please call us on +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} today." for _ in range(30)]
    texts += ["Please call us on 0800-77-12345 today.", "Part 0800-77-99999 is out of stock.", "mail <x.y@z.org>, or see 10.0.0.1:8080123"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.instances(pii.occurrences(df)[1]).collect()
    seeds = sorted(r.value for r in found if r.seed == "phone")
    assert seeds == sorted(t[18:-7] for t in texts[:30])
    assert {r.value for r in found if r.seed is None} == {"0800-77-12345", "0800-77-99999"}
    assert {r.value: r.patterns for r in found}["0800-77-12345"] == ["2 us on", "1 on _ today."]
    assert {r.seed for r in found if r.value in ("x.y@z.org", "10.0.0.1")} == {"email", "ip"}
    got = {r.doc_id: r.spans for r in pii.personal_data(df).collect()}
    assert got[30] == "phone:18:31" and got[31] == "" and got[0] == base_spans(texts[0])


def rows_of(df):
    return [r[0] for r in df.select(F.monotonically_increasing_id()).collect()]


def test_scores_of_the_graph_by_brute_force(spark):
    rng = random.Random(3)
    found = []
    for k in range(400):
        seed = "ip" if rng.random() < 0.5 else None
        found.append((rng.sample([f"p{i}" for i in range(4 if seed else 12)], 2), f"{seed}{k % 90}", seed))
    df = spark.createDataFrame(found, "patterns array<string>, value string, seed string")
    pairs = {(p, v) for ps, v, _ in found for p in ps}
    seeds = {v for _, v, seed in found if seed}
    score = dict.fromkeys(seeds, 1.0)
    for _ in range(pii.ROUNDS):
        trust = {}
        for p in {p for p, _ in pairs}:
            of = [v for q, v in pairs if q == p]
            worth = sum(score.get(v, 0) for v in of)
            if worth >= pii.SUPPORT and worth / (len(of) + pii.DOUBT) >= pii.TRUSTED:
                trust[p] = worth / (len(of) + pii.DOUBT)
        score = dict.fromkeys(seeds, 1.0)
        for v in {v for _, v in pairs} - seeds:
            met = [1 - trust[p] for p, w in pairs if w == v and p in trust]
            if met:
                score[v] = 1 - np.prod(met)
    want = {v for v, s in score.items() if v not in seeds and s >= pii.ACCEPT}
    assert {(r.value, r.kind) for r in pii.discovered(df).collect()} == {(v, "ip") for v in want}


# Toxicity

def test_toxic_words_are_learned(spark):
    rng = random.Random(4)
    common = [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(1200):
        words = rng.choices(common, k=rng.randint(20, 80))
        if k % 6 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty", "scum"]))
        docs.append((k, " ".join(words)))
        labels.append((k, int(k % 6 == 0)))
    docs += [(5000, None), (5000, ""), (None, "vile"), (5001, "vile " * 20000)]
    labels += [(7, None), (None, 1), (6000, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = toxicity.score(d, y, queries.fold(4), (0, 1), (3,), [F.col("doc_id")])
    got = [(r.doc_id, r.score) for r in scored.collect()]
    assert len(got) == len(docs) and all(0 <= s <= 1 for _, s in got)
    said = {k: s >= 0.3 for k, s in got}
    assert all(said[k] == (k % 6 == 0) for k in range(1200))
    unknown = toxicity.score(d, y.limit(0), queries.fold(4), (0, 1), (3,), [F.col("doc_id")])
    assert {round(r.score, 6) for r in unknown.collect()} == {0.0}
    assert toxicity.score(d.limit(0), y, queries.fold(4), (0, 1), (3,), [F.col("doc_id")]).count() == 0


def test_toxic_ratios_by_brute_force(spark, odd, none, monkeypatch):
    rng = random.Random(8)
    names = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choices(names, [1 / (i + 1) for i in range(60)], k=rng.randint(1, 40))), k % 5 == 0) for k in range(200)]
    docs = [(k, text + " Foul" * (toxic and k % 2), toxic) for k, text, toxic in docs]
    seen, lefts = (Counter(), Counter()), {}
    for text, toxic in {(text, toxic) for _, text, toxic in docs}:
        words = re.findall("[a-z0-9]+", text.lower())
        seen[not toxic].update(set(words))
        for left, word in zip(["", *words], words, strict=False):
            lefts.setdefault(word, set()).add(left)
    pairs = sum(map(len, lefts.values()))

    def chance(word, count):
        ones, twos = (sum(n == k for n in count.values()) for k in (1, 2))
        off = ones / (ones + 2 * twos) if ones and twos else 0.5
        return (max(count[word] - off, 0) + off * len(count) * len(lefts[word]) / pairs) / count.total()

    want = {}
    for word in lefts:
        ratio = np.log(chance(word, seen[0]) / chance(word, seen[1]))
        error = (1 / (seen[0][word] + 0.5) + 1 / (seen[1][word] + 0.5) + 0.3) ** 0.5
        part = round(max(abs(ratio) - 1.645 * error, 0) * 1e6) * (1 if ratio > 0 else -1)
        want |= {word: part} if part else {}
    monkeypatch.setattr(toxicity, "GATHERED", 50)
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic boolean").repartition(3)
    counted = store(toxicity.counts(df), "test-counts")
    assert {(r.word, r.toxic, r.ordinary, r.lefts) for r in counted.collect()} == {
        (toxicity.key(w), seen[0][w], seen[1][w], len(lefts[w])) for w in lefts
    }
    model = store(toxicity.ratios(counted), "test-ratios")
    assert want["foul"] > 0 and len(want) > 1
    got = {r.word: r.part for r in model.collect()}
    assert got.keys() == {toxicity.key(w) for w in want}
    assert all(abs(got[toxicity.key(w)] - part) <= 1 for w, part in want.items())
    for rows in (df, odd, none):
        by_table, by_join = (
            sorted((r.doc_id is None, r.doc_id or 0, r.raw) for r in way(rows, model, [F.col("doc_id")]).collect())
            for way in (toxicity.by_table, toxicity.by_join)
        )
        assert by_table == by_join and len(by_table) == rows.count()
    scores = {r.doc_id: r.raw for r in toxicity.raw_scores(df, model, [F.col("doc_id")]).collect()}
    for k, text, _ in docs:
        words = set(text.lower().split())
        assert abs(scores[k] - sum(want.get(w, 0) for w in words) / 1e6 / (15 + len(words))) < 1e-5


def test_toxicity_of_odd_rows(spark, odd, none):
    y = spark.createDataFrame([(k, k % 2) for k in range(1, 8)], "doc_id long, toxic int")
    keep = [F.col("doc_id")]
    rows = toxicity.score(odd, y, queries.fold(4), (0, 1), (3,), keep).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(none, y, queries.fold(4), (0, 1), (3,), keep).count() == 0


# Exact duplicates

@pytest.mark.parametrize("collide", [False, True])
def test_block_names_by_brute_force(spark, monkeypatch, collide):
    if collide:  # every block has the same hash, so names come from the texts
        monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    rng = random.Random(1)
    texts = [None, "", "a", "é" * 9, "abcdefgh" * 5, "abcdefgh" * 5, "abcdefgh" * 6]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(200)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, "a"), (None, None), (4, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {}
    for k, t in rows:
        groups.setdefault(t or "", []).append(k)
    want = Counter(
        (k, max((i for i in groups[t or ""] if i is not None), default=None), len(groups[t or ""]),
         hashlib.sha256((t or "").encode()).hexdigest())
        for k, t in rows
    )
    got = exact_dedup.duplicate_groups(df, size=8).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    left = exact_dedup.distinct_documents(df, size=8).collect()
    assert Counter(r.text or "" for r in left) == Counter(list(groups))


def test_duplicates_of_odd_rows(spark, odd, none):
    left = exact_dedup.distinct_documents(odd)
    assert left.columns == odd.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter([2, None, 3, 3, 4, 6, 7])
    assert exact_dedup.duplicate_groups(none).count() == 0 and exact_dedup.distinct_documents(none).count() == 0


# Near duplicates

def reachable(values, limit):
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= limit
    label = np.arange(len(values))
    while True:
        lower = np.where(near, label[None, :], len(values)).min(axis=1)
        if (lower == label).all():
            return label
        label = lower


@pytest.mark.parametrize("limit, bucket", [(2, 20_000), (2, 4), (0, 20_000), (8, 20_000)])
def test_links_by_brute_force(spark, monkeypatch, limit, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(limit)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = set(map(int, seeds)) | {0, 1, 3, (1 << 64) - 1}
    for seed in seeds[:12]:
        for _ in range(25):
            value = int(seed)
            for bit in rng.choice(64, rng.integers(1, limit + 3), replace=False):
                value ^= 1 << int(bit)
            values.add(value)
    array = np.array(sorted(values), np.uint64)
    signed = array.view(np.int64).tolist()
    nodes = spark.createDataFrame([(v, v, v) for v in signed], "id long, probe long, check long")
    found = store(simhash.links(nodes, limit), "links")
    label = {r.node: r.component for r in components(found).collect()}
    got, want = {}, {}
    for value, lowest in zip(signed, reachable(array, limit), strict=True):
        got.setdefault(label.get(value, value), set()).add(value)
        want.setdefault(int(lowest), set()).add(value)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert found.count() <= 12 * len(values)


def test_thresholds_add_up():
    work = [[0.0, 5.0, 9.0, 20.0], [0.0, 50.0, 60.0, 90.0], [0.0, 4.0, 7.0, 30.0]]
    best = min(
        (sum(w[t + 1] for w, t in zip(work, ts, strict=True)), list(ts))
        for ts in itertools.product((-1, 0, 1, 2), repeat=3) if sum(ts) == 0
    )
    assert simhash.allocate(work, 0) == best


def test_fingerprints_by_definition(spark, odd):
    for r in simhash.fingerprints(odd).collect():
        text = {x.doc_id: x.text for x in odd.collect() if x.doc_id in (1, 2, 4, 7)}.get(r.doc_id)
        if r.doc_id not in (1, 2, 4, 7):
            continue
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert r.fingerprint % (1 << 64) == want


def test_components_of_odd_rows(spark, odd, none):
    rows = simhash.fingerprint_components(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {1}
    assert simhash.fingerprint_components(none).count() == 0
    left = simhash.without_near_duplicates(odd)
    assert left.columns == odd.columns and simhash.without_near_duplicates(none).count() == 0
    assert Counter(r.doc_id for r in left.collect()) == Counter([1, None, 3, 3, 5, 7])


def test_one_of_each_group_stays_by_brute_force(spark):
    rng = random.Random(8)
    words = [f"word{k}" for k in range(4000)]
    rows = []
    for k in range(60):
        text = rng.choices(words, k=rng.randint(60, 400))
        rows.append((k, " ".join(text)))
        for j in range(k % 4):
            changed = list(text)
            for _ in range(j):
                changed[rng.randrange(len(text))] = rng.choice(words)
            rows.append((1000 + 10 * k + j, " ".join(changed)))
    prints = [simhash.fingerprint(simhash.shingle_hashes(simhash.words_of(t), 3)) % (1 << 64) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if group[i] != group[j] and (prints[i] ^ prints[j]).bit_count() <= 2:
            group = [group[i] if g == group[j] else g for g in group]
    want = {min(rows[k][0] for k, g in enumerate(group) if g == name) for name in set(group)}
    assert 60 <= len(want) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.without_near_duplicates(df).collect()} == want


def test_many_documents_share_a_passage(spark):
    rng = random.Random(9)
    words = [f"word{k}" for k in range(4000)]
    shared = " ".join(rng.choices(words, k=60))
    rows = [(k, f"{' '.join(rng.choices(words, k=80))} {shared}") for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.without_near_duplicates(df).count() == 2000


# Mixing

def test_targets_share_by_weight_up_to_the_cap(spark, odd, none):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 500), ("d", 0), (None, 300)], "source string, size long")
    rows = {r.source: r for r in mixing.source_targets(sizes).collect()}
    assert rows["b"].target == 30.0 and rows["d"].target == 0.0
    assert sum(r.target for r in rows.values()) == pytest.approx(1810)
    # Weights in order of names: a 1, b 2, c 3, d 1, null 2; the capped ones' rest goes to the others by weight.
    level = rows["a"].target
    assert rows["c"].target == pytest.approx(min(1500, 3 * level)) and rows[None].target == pytest.approx(min(900, 2 * level))
    mixed = mixing.mixed_sizes(odd)
    assert mixed.count() == odd.count() and mixed.where("taken > 3 * size").count() == 0
    assert mixing.mixed_sizes(none).count() == 0 and mixing.mixture(none).count() == 0
    out = mixing.mixture(odd)
    assert out.columns == odd.columns
    taken = Counter(r.doc_id for r in out.collect())
    assert taken == Counter({r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum("copies").alias("n")).collect() if r.n})


def test_sources_come_near_their_targets(spark):
    rng = random.Random(6)
    rows = [(k, "w " * rng.randint(1, 60), f"s{k % 7}") for k in range(4000)]
    mixed = mixing.mixed_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in mixed.groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) < 0.15 * r.target


# The whole

def test_pipeline_by_brute_force(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SF), name)
        after[name] = docs
    texts = {name: [(r.doc_id, r.text) for r in df.collect()] for name, df in after.items() if "text" in df.columns}
    good, exact, near, mixed = (texts[name] for name, _ in corpus_pipeline.STAGES[:4])
    assert Counter(t for _, t in exact) == Counter({t for _, t in good})
    assert set(near) <= set(exact) and set(mixed) <= set(near)

    prints = {k: simhash.fingerprint(simhash.shingle_hashes(simhash.words_of(t), 3)) % (1 << 64) for k, t in exact}
    kept = dict(near)
    for a, b in itertools.combinations(kept, 2):
        assert (prints[a] ^ prints[b]).bit_count() > 2
    for k in prints:  # what went is near another document
        assert k in kept or any((prints[k] ^ prints[j]).bit_count() <= 2 for j in prints if j != k)
    from bookpulse.llm import pieces

    model = pieces.Model(pieces.MODEL)
    want = Counter((k, tuple(model.file.encode(t))) for k, t in mixed)
    assert Counter((r.doc_id, tuple(r.ids)) for r in docs.collect()) == want
    assert corpus_pipeline.run(spark, SF).count() == len(mixed)


def test_every_numbered_query_is_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.fullmatch(r"op\d+_.*", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()
