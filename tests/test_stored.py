"""Stored tables that change a little at a time: upserts, the name index, compaction, order, sketched profiles."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bookpulse.operators import latency, profile, search, upsert
from bookpulse.operators.latest import numbered
from bookpulse.sources import tables
from bookpulse.sources.stored import StoredTable
from bookpulse.streaming.names import NameIndex

NOW = datetime(2024, 5, 1, 12)


def files_of(df):
    return {r[0] for r in df.select("_metadata.file_path").distinct().collect()}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def settings(spark, tmp_path):
    rows = [(k, f"v{k}", NOW) for k in range(200)] + [(None, "no key", NOW)]
    target = spark.createDataFrame(rows, "key long, value string, updated timestamp_ntz").cache()
    table = StoredTable(str(tmp_path / "settings"), "key", target.schema, folders=16)
    table.create(target)
    return table, target


def test_an_upsert_rewrites_the_folders_it_hits(spark, settings):
    table, target = settings
    stored = spark.read.parquet(table.path)
    before = files_of(stored)
    source = spark.createDataFrame([(5, "new"), (5, "newer"), (900, None)], "key long, value string")
    stamp = F.lit(NOW + timedelta(1)).cast("timestamp_ntz")
    for _ in range(2):  # a change that runs again changes nothing
        table.upsert(source, stamp)
        assert rows_of(table.read(spark)) == rows_of(upsert.merge_upsert(target, source, "key", stamp))
    after = files_of(spark.read.parquet(table.path))
    assert len(before - after) <= 2 and len(before & after) >= 14


def test_inserts_and_updates_in_place(spark, settings):
    table, target = settings
    before = files_of(spark.read.parquet(table.path))
    source = spark.createDataFrame([(5, "x", NOW), (901, "y", NOW)], target.schema)
    for _ in range(2):
        table.insert_only(source)
    want = upsert.merge_insert_only(target, source, "key")
    assert rows_of(table.read(spark)) == rows_of(want)
    assert before <= files_of(spark.read.parquet(table.path))
    test, change = F.col("value") == "v7", {"value": F.lit("seven")}
    table.update_where(test, change)
    assert rows_of(table.read(spark)) == rows_of(upsert.update_where(want, test, change))
    assert len(before - files_of(spark.read.parquet(table.path))) == 1
    table.update_where(F.col("value") == "nobody", change)
    with pytest.raises(ValueError):
        table.update_where(test, {"key": F.lit(1)})
    none = spark.createDataFrame([], "key long, value string")
    table.upsert(none, F.lit(NOW).cast("timestamp_ntz"))
    assert table.read(spark).count() == 202


WORDS = ["acme", "holding", "capital", "north", "bridge", "energy", "media", "group", "zinc", "quartz"]


def names_of(spark, keys, step=3):
    rows = [(k, f"{WORDS[k % 10]} {WORDS[(k * step) % 7]} {k % 23}") for k in keys]
    return spark.createDataFrame(rows, "position_id long, issuer string")


def test_the_index_gives_what_a_search_over_all_names_gives(spark, tmp_path):
    index = NameIndex(str(tmp_path / "index"), folders=8, compact=2)
    queries = spark.createDataFrame(
        [(1, "acme holdng 3"), (2, "zinc capital"), (3, "QUARTZ--north 5"), (4, ""), (5, None), (6, "nothing alike!")], "query_id long, query string"
    )
    assert index.search(queries).count() == 0
    current = {}
    changes = [(range(0, 40), 3), (range(30, 70), 5), (range(60, 75), 2), (range(10, 15), 6), ((), 1)]
    for number, (keys, step) in enumerate(changes):
        rows = names_of(spark, keys, step)
        leave = [k for k in (3, 33) if number == 2]
        gone = spark.createDataFrame([(k, None, True) for k in leave], "position_id long, issuer string, gone boolean")
        batch = rows.withColumn("gone", F.lit(False)).unionByName(gone)
        for _ in range(2 if number in (1, 2) else 1):  # a batch may come again
            index.change(batch, f"batch-{number}")
        current |= {r.position_id: r.issuer for r in rows.collect()}
        current = {k: v for k, v in current.items() if k not in leave}
        catalog = spark.createDataFrame(sorted(current.items()), "position_id long, issuer string")
        for least in {1: (0.3,), 2: (0.6,), 4: (0.3, 0.6)}.get(number, ()):
            want = search.search_table(catalog, queries, least=least)
            assert rows_of(index.search(queries, least=least)) == rows_of(want.select(*index.search(queries).columns))


def test_copies_in_the_index_meet_once(spark, tmp_path, monkeypatch):
    """Queries of one text search once, and no more copies of a name are ranked than may be asked for."""
    from bookpulse.streaming import names

    kept, by_text = [], names.by_text
    monkeypatch.setattr(names, "by_text", lambda *a: kept.append(by_text(*a)) or kept[-1])
    rows = [(k, ["red bolt", "blue ring", "Red Bolt."][k % 3]) for k in range(300)]
    catalog = spark.createDataFrame(rows, "position_id long, issuer string")
    index = NameIndex(str(tmp_path / "index"), folders=4, compact=100)
    index.change(catalog, "a")
    queries = spark.createDataFrame([(k, n) for k, n in rows if k % 4 == 0], "query_id long, query string")
    got = sorted((r.query_id, r.rank, r.position_id) for r in index.search(queries).collect())
    alike = {0: [k for k in range(300) if k % 3 != 1][:10], 1: [k for k in range(300) if k % 3 == 1][:10]}
    assert got == [(q, n + 1, k) for q in range(0, 300, 4) for n, k in enumerate(alike[int(q % 3 == 1)])]
    assert [(n.rows.count(), n.texts.count()) for n in kept] == [(20, 2)]  # all are full at the first similarity


def test_the_trigrams_of_a_text_are_stored_once_for_all_its_keys(spark, tmp_path):
    index = NameIndex(str(tmp_path / "index"), folders=4, compact=2)
    rows = [(k, ["red bolt", "blue ring", "Red Bolt."][k % 3]) for k in range(300)]
    stored = lambda path: spark.read.parquet(path).count()
    for part, name in ((rows[:150], "a"), (rows[150:], "b")):
        index.change(spark.createDataFrame(part, "position_id long, issuer string"), name)
    assert (stored(f"{index.postings}/changes/seq=0"), stored(f"{index.copies}/changes/seq=0")) == (9 + 10, 148)
    assert (stored(f"{index.postings}/base/seq=1"), stored(f"{index.copies}/base/seq=1")) == (9 + 10, 298)
    assert not list(tmp_path.glob("index/*ts/changes/seq=1"))  # the base holds them
    # The first keys of both texts change or leave; their postings stand for the others still.
    last = [(0, "blue ring", False), (1, None, True), (2, "green cog", False)]
    index.change(spark.createDataFrame(last, "position_id long, issuer string, gone boolean"), "c")
    queries = spark.createDataFrame([(1, "red bolt"), (2, "blue ring"), (3, "green cog")], "query_id long, query string")
    got = index.search(queries, least=0.9, max_results=3)
    assert sorted((r.query_id, r.rank, r.position_id) for r in got.collect()) == [
        (1, 1, 3), (1, 2, 5), (1, 3, 6), (2, 1, 0), (2, 2, 4), (2, 3, 7), (3, 1, 2),
    ]


def test_a_search_reads_few_postings_and_a_change_one_segment(spark, tmp_path):
    index = NameIndex(str(tmp_path / "index"), folders=32, compact=100)
    index.change(names_of(spark, range(300)), "a")
    before = files_of(spark.read.parquet(f"{index.postings}/changes"))
    index.change(names_of(spark, [500]), "b")
    after = files_of(spark.read.parquet(f"{index.postings}/changes"))
    assert before <= after and all("seq=1" in f for f in after - before)
    asked = spark.createDataFrame([(1, "zinc north 5")], "query_id long, query string").withColumn("_asked", search.trigrams(F.col("query")))
    first = index.rarest(asked, "query_id", 0.8)
    assert first.count() == 3
    opened = {f.split("folder=")[1].split("/")[0] for f in files_of(index.posted(spark, first))}
    assert len(opened) <= 3 and len(before) > 12


def test_closed_days_are_compacted(spark, tmp_path):
    path = str(tmp_path / "events")
    fields = {f.name: f.dataType for f in tables.S.EVENT_SCHEMA}
    for part in range(3):
        rows = spark.range(part * 10, part * 10 + 10).select(
            *[
                (F.col("id").cast(kind) if name == "event_id" else F.make_timestamp_ntz(F.lit(2024), F.lit(5), 1 + (F.col("id") % 2).cast("int"), F.lit(1), F.lit(0), F.lit(0)) if name == "event_ts" else F.lit(None).cast(kind)).alias(name)
                for name, kind in fields.items()
            ]
        )
        tables.write_events(rows, path)
    events = rows_of(tables.read_events(spark, path))
    first = {f for f in files_of(tables.read_events(spark, path)) if "2024-05-02" in f}
    assert len(files_of(tables.read_events(spark, path))) == 6
    assert tables.compact_days(spark, path, F.lit(date(2024, 5, 2))) == [date(2024, 5, 1)]
    left = files_of(tables.read_events(spark, path))
    assert len(left) == 4 and first <= left and rows_of(tables.read_events(spark, path)) == events
    assert tables.compact_days(spark, path, F.lit(date(2024, 5, 2))) == []


def test_interleaved_files_are_narrow_in_each_column(spark, tmp_path):
    rows = spark.range(4096).select(
        F.concat(F.lit("issuer-"), F.lpad((F.col("id") % 64).cast("string"), 4, "0")).alias("issuer"),
        F.pmod(F.xxhash64("id"), F.lit(64)).alias("day"),
        F.when(F.col("id") % 50 > 0, F.lit(1.5)).alias("flat"),
    )
    path = str(tmp_path / "z")
    tables.write_interleaved(rows, path, ["issuer", "day"], files=16)
    back = spark.read.parquet(path)
    assert rows_of(back) == rows_of(rows)

    def touched(column, value):
        """Files whose range of the column has the value: those that statistics can't leave out."""
        ranges = back.groupBy("_metadata.file_path").agg(F.min(column).alias("a"), F.max(column).alias("b"))
        return ranges.where((F.col("a") <= value) & (F.col("b") >= value)).count()

    assert len(files_of(back)) == 16
    assert touched("issuer", "issuer-0021") <= 8 and touched("day", 21) <= 8
    assert rows_of(tables.interleaved(rows, ["flat"]).drop("_place")) == rows_of(rows)
    assert tables.interleaved(rows.limit(0), ["issuer", "day"]).count() == 0


def test_profiles_merge_from_days(spark):
    rows = spark.range(6000).select(
        F.date_add(F.lit(date(2024, 5, 1)), (F.col("id") % 5).cast("int")).alias("day"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("s"), F.floor(F.sqrt("id")).cast("string"))).alias("few"),
        F.col("id").cast("string").alias("many"),
    )
    sketches = profile.day_sketches(rows, F.col("day"), ["few", "many"])
    assert sketches.count() == 10
    merged = {r.column_name: r for r in profile.merged_profile(sketches).collect()}
    exact = rows.agg(F.count_distinct("few"), F.count_if(F.col("few").isNull())).first()
    assert (merged["few"].rows, merged["few"].nulls) == (6000, exact[1])
    assert abs(merged["few"].distinct_values - exact[0]) <= 0.05 * exact[0]
    assert abs(merged["many"].distinct_values - 6000) <= 300
    found = profile.frequent_values(profile.merged_profile(sketches.where("column_name = 'few'")), 5)
    want = profile.sample_values(rows, ["few"], 5)
    assert rows_of(found.select("column_name", "value", "count", "rank")) == rows_of(want.select("column_name", "value", "count", "rank"))


def test_rows_are_numbered_over_days(spark):
    rows = [(k % 2 or None, NOW + timedelta(hours=(k * 17) % 90), k) for k in range(60)] + [(1, None, 99), (1, None, 98)]
    df = spark.createDataFrame(rows, "session long, event_ts timestamp_ntz, event_id long")
    got = {(r.session, r.seq): r.event_id for r in numbered(df, ["session"]).collect()}
    for session in (None, 1):
        own = sorted((r for r in rows if r[0] == session), key=lambda r: (r[1] is not None, r[1] or NOW, r[2]))
        assert [got[session, k + 1] for k in range(len(own))] == [r[2] for r in own]
    assert len(got) == len(rows)
    assert latency.numbered is numbered
