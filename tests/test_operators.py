import datetime as dt

import pytest
from pyspark.sql import functions as F

from lectern import queries
from lectern.functions import alignment, morphology
from lectern.functions import text as tx
from lectern.operators import activity, changes, layout, ranges, study

D = dt.date


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_id_runs_interleaved(spark):
    df = spark.createDataFrame([("A", 1, 1), ("A", 1, 2), ("A", 1, 3), ("A", 2, 4), ("A", 2, 5), ("B", 1, 6), ("B", 1, 7), ("A", 1, 8), ("A", 1, 9), ("B", 1, 10)], "t string, b int, id long")
    assert rows(ranges.id_runs(df, ["t", "b"], "id"), "t", "b", "first") == [("A", 1, 1, 3, 3), ("A", 1, 8, 9, 2), ("A", 2, 4, 5, 2), ("B", 1, 6, 7, 2), ("B", 1, 10, 10, 1)]


def test_run_tally_and_condition(spark):
    runs = spark.createDataFrame([(1, 1, 10), (1, 11, 20), (3, 31, 40)], "book int, first long, last long")
    points = spark.createDataFrame([(1,), (2,), (15,), (33,), (25,)], "id long")
    assert rows(ranges.run_tally(points, "id", runs, "book", 8), "book") == [(1, 3), (3, 1)]
    hit = points.where(ranges.in_any_run(F.col("id"), [(1, 10), (11, 20), (31, 40)]))
    assert sorted(r.id for r in hit.collect()) == [1, 2, 15, 33]


def test_divide_evenly(spark):
    df = spark.range(17).toDF("day")
    got = [p for _, p in rows(ranges.divide_evenly(df, ["day"], 7, 17).select("day", "part"), "day")]
    assert got == [i * 7 // 17 for i in range(17)]


def test_sm2(spark):
    log = spark.createDataFrame([(1, "2026-01-01 00:00:00", 1, 5), (1, "2026-01-02 00:00:00", 2, 5), (1, "2026-01-08 00:00:00", 3, 4), (2, "2026-01-01 00:00:00", 4, 1)], "card long, ts string, event_id long, q int").withColumn("ts", F.to_timestamp("ts"))
    got = rows(activity.memory_state(log, "card", "ts", "q"), "card")
    assert got == [(1, 2.7, 16, 3, D(2026, 1, 24)), (2, 1.96, 1, 0, D(2026, 1, 2))]


def test_passage_parts():
    assert activity.passage_parts(1, 6, 2) == [(1, 2), (3, 4), (5, 6)]
    assert activity.passage_parts(1, 7, 2) == [(1, 2), (3, 4), (5, 7)]
    parts = [(1, 2), (3, 4)]
    assert activity.next_part(parts, [2, 0]) == (3, 4)
    assert activity.next_part(parts, [2, 2]) == (1, 4)
    assert activity.next_part(parts, [2, 2, 2]) is None


def test_weekdays_and_spread(spark):
    one = spark.range(1).select(activity.weekday_schedule(F.to_date(F.lit("2026-09-10")), F.lit(6), [0, 1, 2, 3, 4]).alias("d"))
    assert [x.day for x in one.first().d] == [10, 11, 14, 15, 16, 17]
    late = spark.range(1).select(activity.weekday_schedule(F.to_date(F.lit("2026-09-12")), F.lit(1), [0, 1, 2, 3, 4]).alias("d"))
    assert late.first().d[0].day == 14
    days = F.array(*(F.lit(D(2026, 9, 11 + i)) for i in range(7)))
    spread = rows(activity.spread(spark.range(17), F.col("id"), F.lit(17), days), "id")
    assert spread[0][1] == D(2026, 9, 11) and spread[-1][1] == D(2026, 9, 17)


def test_streaks_heatmap(spark):
    log = spark.createDataFrame([("a", "2026-09-11"), ("a", "2026-09-11"), ("a", "2026-09-10"), ("a", "2025-01-01")], "k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert rows(activity.streaks(log, "k", "ts"), "k") == [("a", 3, 2, 2)]
    assert rows(activity.heatmap(log, "ts", "2026-09-11"), "day") == [(D(2026, 9, 10), 1), (D(2026, 9, 11), 2)]


def test_speaking_rate(spark):
    """Two rehearsals at 120 and a preaching at 140 make 130; a run at 50 is mis-timed; one event is no measurement; only the latest ten count."""
    e = [(1, 1, 100, 1200, 600, "r"), (1, 2, 200, 1200, 600, "r"), (1, 3, 300, 1400, 600, "p"), (1, 4, 400, 500, 600, "r"), (1, 5, 500, 900, 0, "p"), (2, 6, 100, 100, 60, "r"), (3, 7, 100, 10, 60, "r")]
    e += [(4, 10 + i, i, 200 if i == 0 else 100, 60, "p") for i in range(11)]
    df = spark.createDataFrame(e, "k long, event_id long, ts long, words long, secs int, kind string")
    got = {r.k: (r.rate, r.preachings, r.rehearsals) for r in activity.speaking_rate(df, "k", "ts", "words", "secs", F.col("kind") == "p").collect()}
    assert got == {1: (130, 1, 2), 2: (None, 0, 1), 4: (100, 10, 0)}


def test_open_ends(spark):
    points = spark.createDataFrame([(i,) for i in (-7, 0, 5, 10, 300)] + [(None,)], "p long")
    spans = spark.createDataFrame([(1, None, 5), (2, 5, None), (3, None, None), (4, 11, 20), (5, -10**12, 10**12), (6, 9, 8)], "k long, a long, b long")
    got = sorted((r.k, r.p) for r in ranges.point_join(points, "p", spans, "a", "b", 4).collect())
    assert got == sorted([(1, -7), (1, 0), (1, 5), (2, 5), (2, 10), (2, 300), *((k, p) for k in (3, 5) for p in (-7, 0, 5, 10, 300))])
    assert ranges.point_join(points.limit(0), "p", spans, "a", "b", 4).collect() == []


def test_point_pairs(spark, monkeypatch):
    """The rows of point_join, copies of rows and open ends included, whatever the cells; one bin is dealt out over tasks by its pairs."""
    points = spark.createDataFrame([(i % 97, i % 7 / 2) for i in range(600)] + [(600, None), (601, 40.5), (602, -3.0), (603, -3.0)], "id long, p double")
    spans = spark.createDataFrame([(i % 50, None if i % 11 == 0 else i % 5 - 1.0, None if i % 13 == 0 else i % 4 + 0.5) for i in range(400)] + [(400, 41.0, 50.0), (401, 2.0, 1.0)], "k long, a double, b double")
    want = rows(ranges.point_join(points, "p", spans, "a", "b", 4), "id", "p", "k", "a", "b")
    assert len(want) > 100_000
    for cell, run, most in ((1 << 13, 168, 1 << 13), (64, 168, 3), (64, 16, 1 << 13)):
        monkeypatch.setattr(ranges, "CELL", cell)
        monkeypatch.setattr(ranges, "TASK", 4096)
        monkeypatch.setattr(ranges, "RUN", run)
        monkeypatch.setattr(ranges, "MOST", most)
        got = ranges.point_pairs(points, "p", spans, "a", "b", 4)
        assert got.columns == ["id", "p", "k", "a", "b"]
        assert rows(got, "id", "p", "k", "a", "b") == want
    made = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(made) > 10
    assert max(made) < 0.3 * len(want)
    assert ranges.point_pairs(points.limit(0), "p", spans, "a", "b", 4).collect() == []
    assert ranges.point_pairs(points, "p", spans.limit(0), "a", "b", 4).collect() == []


def test_range_point_join_stays_small(spark, tmp_path):
    """A day with 5,000 events and 3,000 orders' spans: 15 million pairs take a fifth of a byte each at most."""
    day = F.to_timestamp(F.lit("2024-01-10"))
    spark.range(5000).select(F.col("id").alias("event_id"), day.alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(3000).select(((F.xxhash64("id") % 1_000_000) * 10).alias("o_orderkey"), F.date_sub(day, 9001).cast("timestamp").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    queries.QUERIES["range_point_join"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 15_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 3_000_000


def test_changes(spark):
    log = spark.createDataFrame([(1, 1, "U", "a"), (1, 2, "U", "b"), (2, 1, "U", "c"), (2, 3, "D", None)], "k long, ts long, op string, v string")
    assert rows(changes.latest(log, ["k"]), "k") == [(1, 2, "b")]
    current = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y")], "k long, v string")
    assert rows(changes.upsert(current, new, ["k"]), "k") == [(1, "a"), (2, "x"), (3, "y")]
    assert rows(changes.insert_or_ignore(current, new, ["k"]), "k") == [(1, "a"), (2, "b"), (3, "y")]


def test_sync(spark):
    own = spark.createDataFrame([("a", "1", "fa"), ("b", "2", "fb"), ("c", "3", "fc"), ("d", "4", "fd"), (None, "9", "fe")], "key string, path string, name string")
    ship = spark.createDataFrame([("a", "1", "fa"), ("b", "5", "fb"), ("e", "6", "fe"), ("f", "7", "ff")], "key string, path string, name string")
    used = spark.createDataFrame([("c",)], "key string")
    assert rows(changes.sync_actions(own, ship, used), "key") == [("a", "keep"), ("b", "repoint"), ("c", "retire"), ("d", "drop"), ("e", "adopt"), ("f", "add")]


def test_html_and_words(spark):
    cases = [("sw<em>orn</em>", "sworn"), ("<h2>One</h2><p>three more words</p>", "One three more words"), ("a &amp; b<br>c", "a & b c"), ("<script>x<y</script>t<style>p{}</style>", "t"), ("", ""), (None, None)]
    df = spark.createDataFrame(list(enumerate(c[0] for c in cases)), "i int, h string")
    got = rows(df.select("i", tx.html_text(F.col("h")), tx.word_count(F.col("h"))), "i")
    assert [g[1] for g in got] == [c[1] for c in cases] and got[1][2] == 4


def test_glosses_and_numbers(spark):
    df = spark.createDataFrame([(0, "the Word,"), (1, "in the beginning"), (2, "the"), (3, "his speech"), (4, "into heaven"), (5, "Only-begotten")], "i int, g string")
    assert [r[1] for r in rows(df.select("i", tx.normalize_gloss(F.col("g"))), "i")] == ["word", "beginning", "the", "his speech", "heaven", "only-begotten"]
    df = spark.createDataFrame([(0, "g0026"), (1, "H2617"), (2, "G0"), (3, "x")], "i int, s string")
    assert [r[1] for r in rows(df.select("i", tx.strongs_number(F.col("s"))), "i")] == ["G26", "H2617", None, None]


def test_alignment():
    assert alignment.common_pairs(list("abcd"), list("xbxd")) == [(1, 1), (3, 3)]
    assert alignment.common_size("a b c d".split(), "b x d".split()) == 2
    assert alignment.edition_diff("the old king", "the new king came") == [("same", "the"), ("removed", "old"), ("added", "new"), ("same", "king"), ("added", "came")]
    assert alignment.edit_distance("kitten", "sitting", 3) == 3 and alignment.edit_distance("kitten", "sitting", 2) is None
    base, other = "the heaven is high", "the heavens are high"
    assert alignment.project_spans(base, [(4, 10, "PL")], other) == [(4, 11, "PL")]
    assert alignment.project_spans("Holy Ghost came", [(0, 10, "HS")], "Holy Spirit came") == [(0, 11, "HS")]
    assert alignment.first_letters("In the beginning, God") == "I t b, G"
    assert alignment.recall("in the beginning", "in beginning")[1] == pytest.approx(2 / 3)


def test_morphology():
    verb = morphology.decode("V-PAI-3S")
    assert (verb["tense"], verb["voice"], verb["mood"], verb["person"], verb["number"]) == ("present", "active", "indicative", "third", "singular")
    noun = morphology.decode("N-NSM")
    assert (noun["part"], noun["gramcase"], noun["gender"]) == ("noun", "nominative", "masculine")
    hebrew = morphology.decode("HC/Vqp3ms")
    assert (hebrew["language"], hebrew["stem"], hebrew["tense"], hebrew["gender"]) == ("Hebrew", "qal", "perfect", "masculine")
    assert morphology.decode("ADV")["part"] == "adverb" and morphology.decode(None)["part"] == ""


def test_layout(spark):
    events = spark.createDataFrame([("g", 1, 0.0, 10.0, 5), ("g", 2, 5.0, 8.0, 9), ("g", 3, 20.0, 30.0, 1), ("g", 4, 6.0, 7.0, 1)], "g string, id long, start double, end double, priority int")
    assert rows(layout.pack_rows(events, "g", 2), "id") == [("g", 1, 1), ("g", 2, 0), ("g", 3, 0), ("g", 4, -1)]
    places = {1: (0.0, 0.0), 2: (0.0, 1.0), 3: (0.0, 2.0)}
    assert layout.route(places, [(1, 2), (2, 3)], 1, 3) == [1, 2, 3]
    km = spark.range(1).select(layout.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), layout.bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()
    assert km[0] == pytest.approx(111.195, abs=0.01) and km[1] == "east"


def test_study(spark):
    words = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "b"), ("k", "a"), ("m", "z")], "key string, form string")
    assert rows(study.modal_form(words, "key", "form"), "key") == [("k", "a", 2), ("m", "z", 1)]
    names = spark.createDataFrame([("Noah", "noah"), ("Abram", "abrom")], "name string, fold string")
    entities = spark.createDataFrame([(1, "noah"), (2, "noah"), (3, "abram")], "entity int, fold string")
    shared = spark.createDataFrame([("Noah", 2, 7)], "name string, entity int, n long")
    assert rows(study.resolve_names(names, entities, shared), "name") == [("Abram", 3), ("Noah", 2)]


def test_queries_over_whole_tables(spark, tmp_path):
    """Orders of every customer are packed, and references are sought in the documents' own texts."""
    from lectern import queries

    orders = [(1, 3, "1996-01-01", 10.0), (2, 3, "1996-02-01", 20.0), (3, 3, "1996-03-01", 30.0), (4, 3, "1996-03-02", 5.0), (5, 10, "1996-01-01", 1.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, "as Paul says (Rom. 8:28), and more"), (8, "no reference"), (9, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in queries.interval_packing(spark, str(tmp_path)).collect()} == {(3, 3, 0), (3, 2, 1), (3, 1, 2), (3, 4, -1), (10, 5, 0)}
    assert [(r.doc_id, r.chapter, r.verse_start) for r in queries.find_references(spark, str(tmp_path)).collect()] == [(7, 8, 28)]
