import json
import random

import pytest
from fixtures import CLOCK, frames
from pyspark.sql import Window
from pyspark.sql import functions as F

from bookpulse.operators import chat, search
from bookpulse.operators.snapshot import portfolio_live
from bookpulse.plans.model import BOOK, check_relationship, query_model


@pytest.fixture(scope="module")
def sources(spark):
    events, positions = frames(spark)
    return {"events": events, "positions": positions, "live": portfolio_live(events, positions, CLOCK)}


def test_model_joins_and_filters(sources):
    rows = query_model(BOOK, sources, ["sector"], ["events", "trades"]).collect()
    got = {r.sector: (r.events, r.trades) for r in rows}
    # Warm-up rows are left out; unknown and missing positions form the NULL group.
    assert got["Health"] == (8, 2) and got[None] == (2, 2)
    only = query_model(BOOK, sources, ["event_type"], ["events"], where={"fund": ["Fund B"]}).collect()
    assert {r.event_type: r.events for r in only} == {"MARK": 2, "CREDIT_EVENT": 1}
    near = query_model(BOOK, sources, ["fund"], ["events"], where={"event_type": ["CREDIT_EVENT"]}).collect()
    assert {r.fund: r.events for r in near} == {"Fund A": 2, "Fund B": 1}


def test_model_measures(sources):
    rows = query_model(BOOK, sources, ["watchlist"], ["pnl"]).collect()
    assert {r.watchlist: r.pnl for r in rows}[True] == 20000.0
    top = query_model(BOOK, sources, ["sector"], ["par"], order=[F.desc("par")], limit=1).collect()
    assert [(r.sector, r.par) for r in top] == [("Health", 43292121.76)]


def test_model_refuses_fan_out(sources):
    with pytest.raises(ValueError):
        query_model(BOOK, sources, ["event_type"], ["par"])
    with pytest.raises(ValueError):
        query_model(BOOK, sources, ["sector"], ["par", "events"])


def test_model_metadata(spark, sources):
    assert sum(d.table in ("events", "positions") for d in BOOK.dimensions.values()) == 24
    assert BOOK.describe(spark).count() == len(BOOK.dimensions) + len(BOOK.measures)
    assert check_relationship(BOOK.relationships[0], sources).count() == 0


def test_search_finds_partial_and_misspelt(sources):
    hits = search.fuzzy_search(sources["positions"], ["Halden", "Haldn Frieght", "Mirrabel"], attributes=("sector",))
    rows = hits.orderBy("query_id", "rank").collect()
    assert {r.issuer for r in rows if r.query_id == 0} == {"Halden Freight Lines", "Halden Glassworks", "Halden Savings Bank"}
    assert [r.issuer for r in rows if r.query_id == 1][0] == "Halden Freight Lines"
    assert [r.position_id for r in rows if r.query_id == 2][:2] == ["P1", "P2"]
    assert rows[0].sector is not None


def trigram_score(a, b):
    def grams(s):
        s = "  " + " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split()) + " "
        return {s[i : i + 3] for i in range(len(s) - 2)}

    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def test_a_table_of_queries_loses_no_match(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 12))) for _ in range(150)]
    catalog = spark.createDataFrame(list(enumerate(names)), "position_id int, issuer string")
    queries = spark.createDataFrame([(k, n) for k, n in enumerate(names) if k % 10 == 0], "query_id int, query string")
    got = {(r.query_id, r.position_id): r.score for r in search.search_table(catalog, queries, least=0.4, max_results=1000).collect()}
    want = {
        (q, k): trigram_score(names[q], n)
        for q in range(0, 150, 10) for k, n in enumerate(names) if trigram_score(names[q], n) >= 0.4
    }
    assert got == pytest.approx(want)


def test_equal_texts_meet_once(spark, tmp_path):
    """The pairs of a table of queries don't grow with the copies of a text; the ranks are those of all pairs."""
    names = ["red bolt", "Red  BOLT!", "red bolts", "blue ring", "old red bolt", "A", ""]
    rows = [(k, names[k % 7] if k % 50 else None) for k in range(700)] + [(None, "red bolt")]
    catalog = spark.createDataFrame(rows, "position_id int, issuer string")
    queries = spark.createDataFrame([(k, n) for k, n in rows if k is not None and k % 9 == 0], "query_id int, query string")
    by_text = search.by_text(catalog, "issuer", "position_id", 10, str(tmp_path / "names"))
    assert by_text.rows.count() == 60 and by_text.texts.count() == 6
    asked = spark.createDataFrame([("red bolt",), ("blue ring",)], "_text string")
    near = search.near_texts(asked, by_text, 0.5, 10, str(tmp_path / "shared"))
    assert sorted((r._text, r._plain) for r in near.collect()) == [
        ("blue ring", "blue ring"), ("red bolt", "old red bolt"), ("red bolt", "red bolt"), ("red bolt", "red bolts"),
    ]
    pairs = queries.crossJoin(catalog.where("position_id is not null")).select(
        "*", search.jaccard(search.trigrams(F.col("issuer")), search.trigrams(F.col("query"))).alias("score"),
        F.levenshtein(search.plain(F.col("issuer")), search.plain(F.col("query"))).alias("distance"),
    ).where("score >= 0.3")
    for most in (10, 130, 250):  # full at once, some full, none full
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "distance", "position_id"))
        want = pairs.withColumn("rank", place).where(F.col("rank") <= most)
        got = search.search_table(catalog, queries, max_results=most)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_a_frequent_trigram_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(search, "PAIRS", 7)
    test_a_table_of_queries_loses_no_match(spark)
    test_equal_texts_find_the_closest_of_many(spark)


def test_equal_texts_find_the_closest_of_many(spark):
    """Distinct names: queries full at a high similarity and such as go on to the least one."""
    rng = random.Random(7)
    words = ["red", "blue", "bolt", "ring", "small"]
    names = sorted({f"{rng.choice(words)} {rng.choice(words)} {rng.randrange(10 ** rng.choice([1, 3]))}" for _ in range(300)})
    catalog = spark.createDataFrame(list(enumerate(names)), "position_id int, issuer string")
    queries = spark.createDataFrame([(k, names[k]) for k in range(0, len(names), 11)], "query_id int, query string")
    got = {}
    for r in search.search_table(catalog, queries, max_results=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.position_id, r.score))
    for q in range(0, len(names), 11):
        found = sorted(got[q])
        scores = sorted((trigram_score(names[q], n) for n in names), reverse=True)
        assert [s for _, _, s in found] == pytest.approx([s for s in scores[:3] if s >= 0.3])
        assert found[0][1] == q and all(s == pytest.approx(trigram_score(names[q], names[p])) for _, p, s in found)


def test_model_ranges_and_key_checks(sources):
    import bookpulse.plans.model as model

    every = query_model(BOOK, sources, ["event_type"], ["events"]).agg(F.sum("events")).first()[0]
    span = sources["events"].where("event_type <> 'WARMUP'").agg(F.min("event_ts"), F.max("event_ts")).first()
    within = {"event_ts": model.Between(span[0], span[1])}
    assert query_model(BOOK, sources, ["event_type"], ["events"], where=within).agg(F.sum("events")).first()[0] == every
    beyond = {"event_ts": model.Between(low=span[1])}
    assert query_model(BOOK, sources, ["event_type"], ["events"], where=beyond).agg(F.sum("events")).first()[0] == 1
    twice = {**sources, "positions": sources["positions"].unionByName(sources["positions"])}
    with pytest.raises(ValueError):
        query_model(BOOK, twice, ["sector"], ["events"], check_keys=True)


def test_scores_against_brute_force(spark):
    names = ["Élan Vital", "elan-vital co", "A", "Ab", "zz  top", "Zz/Top!", "日本 銀行"]
    catalog = spark.createDataFrame(list(enumerate(names)), "position_id int, issuer string")
    terms = ["elan vital", "zz top", "ab", "日本"]
    got = {(r.query, r.issuer): r.score for r in search.fuzzy_search(catalog, terms).collect()}
    want = {(t, n): trigram_score(t, n) for t in terms for n in names if trigram_score(t, n) > 0}
    assert got == pytest.approx(want)


def test_history_of_a_long_conversation(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(250)] + [(2, 0, "user", 'say "hi"')]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").orderBy(F.rand(3))
    said = {(r.conv_id, r.turn): json.loads(r.message) for r in chat.conversation_history(df).collect()}
    assert len(said) == 251
    assert said[(1, 202)] == {"role": "assistant", "content": [{"type": "text", "text": "t202"}]}
    assert said[(2, 0)]["content"][0]["text"] == 'say "hi"'


def expected_text(payload):
    """Brute force over the four payload shapes."""
    out = []
    content = payload.get("delta", {}).get("content", [])
    for item in content if isinstance(content, list) else [content]:
        if isinstance(item, dict) and item.get("type") == "text":
            out.append(item.get("text", ""))
    out += [c["delta"]["content"] for c in payload.get("choices", []) if isinstance(c["delta"].get("content"), str)]
    if isinstance(payload.get("text"), str):
        out.append(payload["text"])
    if isinstance(payload.get("content"), list):
        out += [i["text"] for i in payload["content"] if i.get("type") == "text"]
    return "".join(out)


def test_payload_shapes(spark):
    part = {"type": "text", "text": "x"}
    payloads = [
        {"delta": {"content": [part, {"type": "chart", "text": "no"}, part]}},
        {"delta": {"content": part}},
        {"choices": [{"delta": {"content": "y"}}, {"delta": {"content": 5}}, {"delta": {"content": "z"}}]},
        {"text": "plain"},
        {"text": 7},
        {"content": [part, {"type": "image", "text": "no"}]},
        {"delta": {"content": [part]}, "text": "both"},
        {},
        {"other": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)] + [(99, "{bad")], "i int, d string")
    got = {r.i: r.t for r in df.select("i", chat.content_text(F.col("d")).alias("t")).collect()}
    assert got == {**{i: expected_text(p) for i, p in enumerate(payloads)}, 99: ""}


def test_answers(spark):
    log = spark.createDataFrame(
        [
            (1, 2, "delta", '{"text":"world"}'), (1, 0, "response.status", '{"text":"thinking"}'),
            (1, 1, "delta", '{"text":"hello "}'), (2, 0, "delta", '{"text":"a"}'),
            (2, 1, "error", '{"message":"boom"}'), (3, 0, "delta", "[DONE]"),
        ],
        "response_id int, seq int, event_type string, data string",
    )
    rows = sorted(map(tuple, chat.answer_text(log).collect()))
    # An error stands in for the whole answer, whatever came before or after it.
    assert rows == [(1, 1, "hello ", None), (1, 2, "world", None), (2, 1, "", "boom")]


def test_an_answer_of_many_events_stays_one(spark):
    log = spark.range(1500).selectExpr(
        "1 AS response_id", "int(id) AS seq", "if(id = 1200, 'error', 'delta') AS event_type",
        "if(id = 1200, '{\"message\":\"late\"}', '{\"text\":\"x\"}') AS data",
    )
    assert list(map(tuple, chat.answer_text(log).collect())) == [(1, 1200, "", "late")]
    assert chat.answer_text(log.where("event_type <> 'error'")).count() == 1499
