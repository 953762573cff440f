"""The operators on documents against brute force, with nulls, empty and very long texts, ties, repeats, empty tables and extra columns."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import common, components, jaccard_join, language_id, quality_rules, substring_dedup
from lectern.llm.decontamination import contaminated, smith_waterman


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    base = [prose(i, 60) for i in range(12)]
    out = [" ".join(b) for b in base]
    for i in range(12):
        near = list(base[i % 4])
        near[(i * 7) % 60] = "changed"
        out.append(" ".join(near))
    shared = " ".join(prose(99, 55))
    out += [f"{' '.join(prose(200 + i, 40))} {shared} {' '.join(prose(300 + i, 30))}" for i in range(6)]
    out += [out[0], out[0], out[0].upper(), "", None, "  \n\t ", "one", "one two", "ONE TWO", "a b c", " ".join(prose(7, 30_000, 9000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, hash string, key string")


def words(t):
    return (t or "").encode().split()


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = [x.lower() for x in words(t)]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard(docs, texts, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, k, percent).collect()}
    assert got == brute_components(texts, k, percent)


def test_jaccard_blocks_and_contraction(spark, docs, texts, monkeypatch):
    """Large buckets in blocks, and components found by rounds of contraction, give the same."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(components.components, "__defaults__", (0,))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, 3, 90).collect()}
    assert got == brute_components(texts, 3, 90)


def test_jaccard_rounds_of_anchors(spark, monkeypatch):
    """A group of copies, each with its own edits, of which many are not near any one of them."""
    r, base = random.Random(3), [f"w{i}" for i in range(120)]
    texts = []
    for i in range(90):
        w = list(base)
        for at in r.sample(range(120), r.choice([1, 2, 3])):
            w[at] = f"x{r.randrange(4)}"
        texts.append(" ".join(w))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "IN_PROPORTION", 0)
    for k, percent in ((5, 80), (3, 90)):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(rows, k, percent).collect()}
        assert got == brute_components(texts, k, percent)


def test_jaccard_pairs_in_turns(spark, docs, texts, monkeypatch):
    """Pairs in many bounded turns and rounds for all but the smallest buckets give the same."""
    for name, value in (("SKETCHED", 40), ("BROADCAST", 40), ("LARGE", 20)):
        monkeypatch.setattr(jaccard_join, name, value, raising=True)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, 5, 80).collect()}
    assert got == brute_components(texts, 5, 80)


def test_sketches_tell_large_sets_apart():
    """Two unrelated texts of 6,000 words go by their sketches, two with a few edits stay; folded, a sketch is that of the smaller size."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(30_000)]
    one = r.choices(words, k=6000)
    edited = [w if r.random() > 0.01 else "x" for w in one]
    (x,) = jaccard_join.sets_of([" ".join(w).encode() for w in (one, r.choices(words, k=6000), edited)], 5)
    sizes, (a, b, c) = list(map(len, x.places)), jaccard_join.sketches(x)
    far = lambda s, t: int(np.bitwise_count(s ^ t).sum())
    assert far(a, b) * 180 > (sizes[0] + sizes[1]) * 20 >= far(a, c) * 180
    while len(a) > 16:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    assert a.tobytes() == jaccard_join.parities(x)[0]


def test_jaccard_null_ids_and_empty(spark, docs):
    odd = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, None), (5, "a b c d")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd).collect()), key=str)
    assert got == sorted([(None, 2, 5), (5, 2, 5), (None, 0, None), (5, 2, 5)], key=str)
    assert jaccard_join.jaccard_components(docs.limit(0)).collect() == []


def test_jaccard_repeated_ids_with_different_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(5, a), (5, b), (7, b + " more"), (8, a + " more"), (None, a + " end"), (None, "c c c"), (None, "c c c d"), (None, "c c c")]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (7, 5), (8, 5), (None, 5), (None, None), (None, None), (None, None)], key=str)


def test_components(spark):
    tables = common.Tables(spark, "t")
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 80)] + [(r.randrange(3000, 3300), r.randrange(3000, 3300)) for _ in range(140)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "u long, v long")
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = top(u), top(v)
            up[max(a, b)] = min(a, b)
    for finish in (0, 100_000):
        got = {}
        for row in components.components(df, tables, f"c{finish}", finish).collect():
            got.setdefault(row.comp, set()).add(row.node)
        want = {}
        for x in up:
            want.setdefault(top(x), set()).add(x)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def brute_dedup(texts, w):
    first = {}
    split = [words(t) for t in texts]
    for i, ws in enumerate(split):
        for a in range(len(ws) - w + 1):
            first.setdefault(tuple(ws[a : a + w]), i)
    out = {}
    for i, ws in enumerate(split):
        gone = set()
        for a in range(len(ws) - w + 1):
            if first[tuple(ws[a : a + w])] < i:
                gone.update(range(a, a + w))
        kept = b" ".join(x for j, x in enumerate(ws) if j not in gone)
        out[i] = (len(ws), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("window", [13, 4])
def test_substrings(docs, texts, window):
    # Buckets of a few texts each, so that all of them answer one another.
    rows = substring_dedup.substring_dedup(docs, window, bucket_bytes=3000).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == brute_dedup(texts, window)
    for r in rows:
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.removed) == r.n_removed
    if window == 13:
        longest = {r.doc_id: r.longest_repeat for r in rows}
        assert longest[len(texts) - 1] is None and longest[24] >= 13 and {x for x in longest.values() if x} <= {13, 26, 52, 104}


def test_longest_repeat(spark, docs, texts):
    """The longest level by brute force, for passages of exactly a level's length and one word less among them."""
    size = [26, 52, 104, 25, 13, 26, 30, 12, 208]
    extra = [f"{' '.join(prose(5000 + 2 * i + j, 20, 10**6))} {' '.join(prose(6000 + i, n, 10**6))} {' '.join(prose(7000 + 2 * i + j, 9, 10**6))}" for i, n in enumerate(size) for j in range(2)]
    every = texts[:-1] + extra
    want = {}
    for level in (13, 26, 52, 104, 208, 416):
        held = {}
        for i, t in enumerate(every):
            w = words(t)
            for a in range(len(w) - level + 1):
                held.setdefault(tuple(w[a : a + level]), set()).add(i)
        want |= {i: level for ids in held.values() if len(ids) > 1 for i in ids}
    rows = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    got = {r.doc_id: r.longest_repeat for r in substring_dedup.substring_dedup(rows, 13).collect()}
    assert got == {i: want.get(i) for i in range(len(every))} and {26, 52, 104, 208} <= set(want.values())


def test_substrings_ids(spark, docs):
    t = " ".join(prose(1, 20))
    odd = spark.createDataFrame([(None, t), (3, t), (3, t), (9, t)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed) for r in substring_dedup.substring_dedup(odd).collect()), key=str)
    assert got == sorted([(None, 0), (3, 0), (3, 0), (9, 20)], key=str)
    assert substring_dedup.substring_dedup(docs.limit(0)).collect() == []


def test_quality_base(docs, texts):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        ws = (t or "").split()
        grams = [tuple(ws[a : a + 3]) for a in range(len(ws) - 2)]
        cover = {a + d for a, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)} if len(ws) < 500 else None
        lines = [x for x in (t or "").split("\n") if x.strip()]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(ws), sum(map(len, ws)), len(lines) - len(set(lines)))
        if cover is not None:
            assert r.n_repeat_words == len(cover)
            assert r.base_failed == (len(ws) < 50 or 100 * len(cover) > 50 * len(ws))
        assert not (r.base_failed and r.kept)


def test_quality_thresholds(spark):
    """Fences follow each group's own quartiles; junk beyond them goes, and small groups borrow those of their language."""
    rows = [(i, " ".join(prose(i, 80)), "en", "a") for i in range(60)]
    rows += [(100 + i, " ".join(f"{w}|" for w in prose(i, 80)), "en", "b") for i in range(60)]
    rows += [(900, " ".join(f"{w}***" for w in prose(5, 80)), "en", "a"), (901, " ".join(f"{w}|" for w in prose(6, 80)), "en", "b"), (902, " ".join(prose(8, 80)), None, "c"), (903, "ä#" * 3, None, None), (904, None, None, None)]
    got = {r.doc_id: (r.kept, r.failed) for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[900][0] and "symbols" in got[900][1] and got[901] == (True, []) and got[902][0] and not got[903][0] and not got[904][0]
    assert all(got[i][0] for i in [*range(60), *range(100, 160)])
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality_rules.quality_rules(empty).collect() == []


def test_measure_symbols():
    assert quality_rules.measure("a#b *\n\x1f ü\nü".encode())[1:3] == (7, 2)


def test_smith_waterman():
    item = b"a b c d e f".split()
    assert smith_waterman(item, b"x a b c d e f y".split()) == (12, 1, 7)
    score, start, end = smith_waterman(item, b"x a b q d e f y".split())
    assert (score, start, end) == (9, 1, 7)
    assert smith_waterman(item, b"x a b d e f".split()) == (9, 1, 6)
    assert smith_waterman(item, b"z z".split())[0] == 0 and smith_waterman(item, [])[0] == 0
    r = random.Random(3)
    for _ in range(60):
        a, b = [[r.choice("abcd").encode() for _ in range(r.randrange(1, 12))] for _ in range(2)]
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        assert smith_waterman(a, b)[0] == max(map(max, h))


def test_contaminated(spark):
    items = {i: prose(1000 + i, 30, 5000) for i in range(5)}
    edited = list(items[1])
    for at in (4, 11, 19, 26):
        edited[at] = "other"
    rows = [(1, " ".join(prose(1, 50, 5000) + items[0] + prose(2, 50, 5000))), (2, " ".join(prose(3, 20, 5000) + edited)), (3, " ".join(items[2][:6] + prose(4, 90, 5000))), (4, None), (5, ""), (6, " ".join(prose(5, 9000, 5000))), (None, " ".join(items[0])), (7, "Hi There!"), (8, ", ".join(w.upper() for w in items[3]) + ".")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(50, None), (51, " ?! "), (52, "hi there"), (None, "x")], "item_id long, text string").withColumn("seed", F.lit(1))
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs, bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (7, 52), (8, 3)}
    assert (got[1, 0].score, got[1, 0].start, got[1, 0].end) == (1.0, 50, 80) and 0.6 <= got[2, 1].score < 1
    assert contaminated(docs.limit(0), bench).collect() == [] and contaminated(docs, bench.limit(0)).collect() == []


def test_contaminated_recall_by_edit_rate(spark):
    """Random substitutions, insertions and deletions of up to a fifth of an item's words; case by Unicode; nothing else is found."""
    items = {i: prose(2000 + i, 24 + i, 4000) for i in range(40)}
    items[100] = "ÉTÉ ÀPRÈS ÖLÜNÜ ÑANDÚ ÇÉLÈBRE".split()
    items[101] = prose(2500, 4000, 4000)
    rows, want = [(9000, "été après ölünü ñandú çélèbre", 100), (9001, " ".join(prose(8, 30, 4000) + items[101]), 101), (9002, " ".join(items[3] + prose(4, 99, 4000) + items[3]), 3)], {}
    for rate in (0.05, 0.1, 0.2):
        for i in range(40):
            r, out = random.Random(1000 * rate + i), []
            for w in items[i]:
                kind = r.choice(["change", "drop", "add"]) if r.random() < rate else ""
                out += {"": [w], "change": ["another"], "drop": [], "add": [w, "another"]}[kind]
            rows.append((int(rate * 100) * 100 + i, " ".join(prose(i, 40, 4000) + out + prose(i + 50, 40, 4000)), i))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in contaminated(docs, spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()}
    want = {(d, i) for d, _, i in rows}
    assert not set(found) - want
    for rate, least in ((5, 1.0), (10, 0.97), (20, 0.9)):
        of = {x for x in want if x[0] // 100 == rate}
        assert len(of & set(found)) >= least * len(of), rate
    # Of two equal copies in a document the first is told.
    assert {(9000, 100), (9001, 101)} <= set(found) and found[9002, 3].start == 0


def test_contaminated_frequent_seeds(spark):
    """What copies share is frequent because of them: edited copies are found beside exact ones, few or many."""
    item, hot = prose(2000, 20, 5000), prose(2001, 20, 5000)
    edit = lambda w, at: ["other" if i % 5 == at else x for i, x in enumerate(w)]
    rows = [(1, " ".join(prose(1, 40, 5000) + item)), (2, " ".join(prose(2, 40, 5000) + edit(item, 4) + prose(3, 20, 5000))), (3, " ".join(item[:3] + prose(4, 60, 5000)))]
    rows += [(10, " ".join(hot)), *((11 + i, " ".join(prose(50 + i, 15, 5000) + edit(hot, 4))) for i in range(40))]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(hot))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) == {(1, 7), (2, 7), *((10 + i, 8) for i in range(41))}
    assert got[2, 7].score == 29 / 40 and (got[2, 7].start, got[2, 7].end) == (40, 59)


def test_contaminated_many_seeds(spark, monkeypatch):
    """Without the broadcast of seeds the result is the same."""
    from lectern.llm import decontamination

    item = prose(77, 25, 3000)
    docs = spark.createDataFrame([(1, " ".join(prose(1, 30, 3000) + item)), (2, " ".join(prose(2, 60, 3000)))], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    want = contaminated(docs, bench).collect()
    monkeypatch.setattr(decontamination, "SEEDS", 0)
    assert contaminated(docs, bench).collect() == want and len(want) == 1


def test_language_id(spark):
    sounds = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["shr", "ond", "eth", "ing"], "cc": ["çé", "eau", "oui", "ier"]}

    def text(lang, seed):
        r = random.Random(seed)
        return " ".join("".join(r.choice(sounds[lang]) for _ in range(r.randrange(1, 4))) for _ in range(25))

    rows = [(i, text(lang, i), lang) for i, lang in enumerate(list(sounds) * 60)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "bb"), (None, text("aa", 5), "aa"), (1003, text("cc", 9), None), (1004, "x" * 100_000, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = language_id.identify(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    held = [(i, lang) for i, _, lang in rows[:180] if by[i].held_out]
    assert 20 < len(held) < 60 and all(by[i].lang_pred == lang for i, lang in held)
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "cc"] and by[None].lang_pred == "aa" and not by[None].held_out
    assert all(0 <= r.score <= 1 for r in got)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert [r.lang_pred for r in language_id.identify(docs.limit(3).withColumn("lang", F.lit(None).cast("string"))).collect()] == ["und"] * 3
    assert language_id.identify(docs.limit(0)).collect() == []


def test_letters_and_bounded_sample(spark, monkeypatch):
    """Numbers of any kind are no letters; a sample of the labelled rows changes no prediction of clear texts."""
    rows = [(i, f"{w} " * 9, lang) for i, (lang, w) in enumerate([("en", "the house of"), ("de", "das haus und")] * 40)]
    odd = ["½ ²", "Ⅷ", "①", "१२३", "_ __", "Ⅷ house"]
    docs = spark.createDataFrame(rows + [(100 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    want = {i: lang for i, _, lang in rows} | {100 + i: "und" for i in range(5)} | {105: "en"}
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()} == want
    monkeypatch.setattr(language_id, "LABELLED", 8)
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()} == want
    # Two languages with the same words tie: the first is told. Repeated rows.
    tied = spark.createDataFrame([(i, "one two", lang) for i in range(30) for lang in ("y", "x")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(tied).collect()} == {"x"}


def test_backoff():
    m = language_id.Model(["a", "b"], {("a", 0): 10, ("b", 0): 10, ("a", 2): 20, ("b", 2): 20, ("a", 1): 20, ("b", 1): 20}, [("a", 0, "cat", 5), ("b", 0, "dog", 5), ("a", 2, "ca", 4), ("b", 1, "z", 9)])
    assert m.predict("cat")[0] == "a" and m.predict("dog")[0] == "b"
    assert m.predict("cab")[0] == "a" and m.predict("zzz")[0] == "b"


def test_results_do_not_depend_on_batch_size(spark, texts):
    """Batches of a few hundred bytes, which cut every group and bucket into many, give the rows of whole ones; the bound only ever goes down."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    told = {}
    try:
        for bound in ("64m", "600b"):
            spark.conf.set(key, bound)
            joined = jaccard_join.jaccard_components(rows, k=5, percent=80)
            removed = substring_dedup.substring_dedup(rows)
            told[bound] = [sorted(map(tuple, d.collect()), key=repr) for d in (joined, removed)]
            assert spark.conf.get(key) == (str(common.BATCH_BYTES) if bound == "64m" else bound)
    finally:
        spark.conf.set(key, before)
    assert told["64m"] == told["600b"]


def test_stages_begin_with_small_heaps(spark, monkeypatch):
    """Executors collect their garbage, and every stage of the pipeline has them do so before anything else."""
    import corpus_pipeline
    from lectern.llm.common import release_executors

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory
    count = lambda: sum(b.getCollectionCount() for b in beans.getGarbageCollectorMXBeans())
    before = count()
    release_executors(spark)
    assert count() >= before + spark.sparkContext.defaultParallelism

    class Begun(Exception):
        pass

    def begun(_):
        raise Begun

    monkeypatch.setattr(corpus_pipeline, "release_executors", begun)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Begun):
            stage(spark, None, "")


def test_release_gives_native_memory_back(spark):
    """What the driver's JVM has freed outside its heap goes back to the system after each table and on release, so that trimming again finds little."""
    import re

    if common.trim_driver(spark) is None:
        pytest.skip("this JVM cannot trim")

    def trimmed():
        """The MB that trimming frees."""
        change, unit = re.search(r"\(([-+]?\d+)([BKMG])\)", common.trim_driver(spark)).groups()
        return -int(change) * 1024.0 ** ("BKMG".index(unit) - 2)

    data = bytearray(random.Random(1).randbytes(200_000))
    tables = common.Tables(spark, "native")
    left = []
    for given_back in (lambda: None, lambda: common.release(spark), lambda: tables.keep(spark.range(1), "one")):
        made = [spark.sparkContext._jvm.java.util.zip.Deflater(1) for _ in range(300)]
        for d in made:
            d.setInput(data)
            d.deflate(data)
        # Some stay, so that what is freed between them is at no end.
        for d in (d for i, d in enumerate(made) if i % 10):
            d.end()
        given_back()
        left.append(trimmed())
        for d in made[::10]:
            d.end()
    tables.drop_all()
    assert left[0] > 25 and max(left[1:]) < 10, left
