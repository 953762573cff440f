import pytest
from pyspark.sql import functions as F

from lectern.catalog import Catalog
from lectern.plans import search as ft
from lectern.plans.querylang import parse
from lectern.sources import loading, readers
from lectern.streaming import jobs

ZEFANIA = '<XMLBIBLE><BIBLEBOOK bnumber="1"><CHAPTER cnumber="1"><VERS vnumber="1">In the <STYLE>beginning</STYLE><NOTE>n</NOTE></VERS><VERS vnumber="2">And</VERS></CHAPTER></BIBLEBOOK></XMLBIBLE>'
USFM = "\\id GEN test\n\\c 1\n\\s Heading\n\\p\n\\v 1 In the \\w beginning|strong=\"H1\"\\w*\\f + \\ft note\\f* God\n\\q made\n\\v 2 And"


def test_formats(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/z.xml").write_text(ZEFANIA)
    (tmp_path / "u.usfm").write_text(USFM)
    (tmp_path / "bad.xml").write_text("<XMLBIBLE><open>")
    (tmp_path / "t.xml").write_text('<ThML><div><scripCom osisRef="Bible:Gen.1.1"/><p>On the start.</p></div></ThML>')
    (tmp_path / "r.txt").write_text("$==PERSON\tx\nAaron\tH1\tf\n# no\n$==PLACE\nAi\tH2\n")
    found = readers.files(spark, str(tmp_path))
    formats = {r.file.rsplit("/", 1)[1]: r.format for r in readers.detect(found).collect()}
    assert formats == {"z.xml": "zefania", "u.usfm": "usfm", "bad.xml": "zefania", "t.xml": "thml", "r.txt": "records"}
    verses = sorted(tuple(r)[1:] for r in readers.read(found, "zefania").collect())
    assert verses == [(1, 1, 1, "In the beginning"), (1, 1, 2, "And")]
    assert sorted(tuple(r)[1:] for r in readers.read(found, "usfm").collect()) == [(1, 1, 1, "In the beginning God made"), (1, 1, 2, "And")]
    assert [tuple(r)[1:] for r in readers.read(found, "thml").collect()] == [("Gen.1.1", "On the start.")]
    assert sorted(tuple(r)[1:4] for r in readers.read(found, "records").collect()) == [(1, "PERSON", "Aaron"), (2, "PLACE", "Ai")]
    manifest = found.where(F.col("file").endswith(".usfm")).select("file", "sha256")
    plan = loading.plan_load(found, manifest)
    done = loading.outcomes(plan, readers.read(found, "zefania").select("file").union(readers.read(found, "thml").select("file")).union(readers.read(found, "records").select("file")))
    assert {r.file.rsplit("/", 1)[1]: r.outcome for r in done.collect()} == {"z.xml": "added", "u.usfm": "skipped", "bad.xml": "failed", "t.xml": "added", "r.txt": "added"}


def test_tables(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("# c\nGen.1.1\tJohn.1.1-John.1.3\t5\nbad\trow\tx\n")
    got = [(r["from"].chapter, r.to_first.verse, r.to_last.verse, r.votes) for r in readers.cross_references(spark, str(tmp_path / "x.tsv")).collect()]
    assert got == [(1, 1, 3, 5)]
    (tmp_path / "k.json").write_text('{"ark": {"body": "a box", "n": 2}, "bread": {"body": "food", "n": 1}}')
    got = sorted(tuple(r) for r in readers.keyed_json(spark, str(tmp_path / "k.json"), "struct<body:string,n:int>").collect())
    assert got == [("ark", "a box", 2), ("bread", "food", 1)]
    html = spark.createDataFrame([(1, '<a data-osis="Gen.1.1-Gen.1.2"></a><a data-osis="Gen.1.1"></a>')], "id int, h string")
    assert sorted(tuple(r)[3:] for r in readers.link_weights(html, "id", "h").collect()) == [(1, 1500), (2, 500)]


def test_gates_and_publishing(spark, tmp_path):
    df = spark.range(3)
    with pytest.raises(loading.ValidationError, match="odd: {'id': 1}"):
        loading.require({"odd": df.where("id % 2 = 1"), "none": df.where("id > 9")})
    path = str(tmp_path / "t")
    assert loading.only_if_empty(df, path) and not loading.only_if_empty(df, path)
    loading.publish(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    loading.export_markdown(spark.createDataFrame([("T", "<p>a <b>b</b></p>")], "title string, body string"), str(tmp_path / "md"))
    assert "# T" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "md")).collect())


def test_catalog(spark):
    c = Catalog(spark)
    c.attach("content", {"notes": spark.range(1), "books": spark.range(2)})
    c.attach("user", {"notes": spark.range(3)})
    c.attach("shelf_a", {"entries": spark.range(4)})
    assert c.table("notes").count() == 3 and c.table("content.notes").count() == 1 and c.has("entries")
    assert list(c.shelves("entries")) == ["shelf_a"]
    c.detach("shelf_a")
    assert not c.has("entries")
    with pytest.raises(KeyError):
        c.table("nothing")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "In the beginning God created the heaven"), (2, "Love thy neighbour; the LORD loves"), (3, "the lord of hosts"), (4, "love and joy and peace"), (5, ""), (6, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize(
    ("text", "prefix", "expected"),
    [
        ("love", True, [2, 4]), ("love", False, [2, 4]), ("lov", True, [2, 4]), ("lov", False, []), ('"in the beginning"', True, [1]), ("love -joy", False, [2]),
        ("heaven OR hosts", False, [1, 3]), ("love ~2 peace", False, []), ("love ~3 peace", False, [4]), ("+LORD", False, [2]), ("+lord", False, [2, 3]), ("(heaven OR hosts) the", False, [1, 3]), ('the -"the lord"', False, [1]),
    ],
)
def test_matching(docs, text, prefix, expected):
    q, index = parse(text, prefix), ft.Index.over(docs)
    got = ft.checked(ft.matching(index, q.tree), q, docs)
    assert sorted(r.doc_id for r in got.collect()) == expected


def test_ranking(spark, docs, tmp_path):
    built = ft.Index.build(docs, str(tmp_path / "ix"))
    for text in ("love", "the -love", "the lord"):
        a, b = ([tuple(r) for r in ft.search(i, text, 10).collect()] for i in (built, ft.Index.over(docs)))
        assert a == b
    assert ft.total(built, "the").first().total == 3
    q = parse("love", False)
    shown = docs.where("doc_id = 4").select(ft.highlight(F.col("text"), q), ft.snippet(F.col("text"), q, 3)).first()
    assert shown[0].startswith("[love]") and shown[1].endswith("…")
    assert [r.token for r in ft.did_you_mean(built.vocabulary(), "lova").collect()] == ["love"]


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "see Rom. 8:28"), (2, "nothing")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(jobs.append_postings(str(tmp_path / "ix"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ix")).where("token = 'rom'").count() == 1
    assert [(r.doc_id, r.label) for r in jobs.cited(spark.read.parquet(str(tmp_path / "in"))).collect()] == [(1, "Romans 8:28")]
