"""Secrets, licences, pieces and the pipeline."""

import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from lectern.llm import license_scan, secret_scan, sentencepiece_lattice
from lectern.llm.queries import MODEL_FILE

HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


@pytest.fixture(scope="module")
def forest(spark):
    words = secret_scan.dictionary(spark.createDataFrame([("the order of these words is a text one and then",), (None,)], "text string"))
    assert words[:2] == ["and", "one"] or "the" in words
    return secret_scan.train(secret_scan.labelled_findings(spark), words)


def test_forest_on_held_out_findings(spark, forest):
    rows = secret_scan.labelled_findings(spark, 5000).where("pmod(xxhash64(word), 5) = 0")
    f = F.struct(*(c.alias(k) for k, c in secret_scan.features(F.col("word"), F.col("before"), F.col("after"), F.col("path"), forest.words).items()))
    # Bound once, as the scan does.
    scored = rows.select("label", F.transform(F.array(f), lambda x: secret_scan._share(forest, x))[0].alias("p"))
    right = scored.select(F.avg(F.expr("if((p >= 0.5) = (label = 1), 1.0, 0.0)"))).first()[0]
    assert right > 0.97


def test_secrets_of_all_shapes_go(spark, forest):
    """Names in capitals, two keys in a word, keys without digits, passwords, addresses with a login; repeated and equal secrets."""
    other, letters = "9f8e7d6c5b4a39281706f5e4d3c2b1a098765432", "kQzXwJvYqGpRtLmNbVcDfGhJkLqWeRtYuIoPaSdF"
    texts = [f"MY_SERVICE_ACCESS_TOKEN={HEX}", f'token="{HEX}";secret="{other}"', f'api_key = "{letters}"', 'password = "hunter2x9!"', f"https://user:{HEX[:20]}@host.example.com/x", f'token="{HEX}" and token="{HEX}"']
    secrets = [[HEX], [HEX, other], [letters], ["hunter2x9!"], [HEX[:20]], [HEX, HEX]]
    docs = spark.createDataFrame([(i, t, "src1") for i, t in enumerate(texts)] + [(3, texts[3], "src1"), (None, texts[0], None)], "doc_id long, text string, source string")
    found = {}
    for r in secret_scan.findings(docs, forest).collect():
        t = texts[r.doc_id or 0]
        found.setdefault(r.doc_id, []).append(t[r.start - 1 : r.start - 1 + r.length])
    assert {k: sorted(v) for k, v in found.items()} == {**{i: sorted(x) for i, x in enumerate(secrets)}, 3: secrets[3] * 2, None: [HEX]}
    for r in secret_scan.redact(docs, forest).collect():
        assert not any(x in r.text for x in secrets[r.doc_id or 0])
    words = ["Donaudampfschifffahrtsgesellschaft kapitän", "internationalization-and-localization of texts", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "the/order/of/these/words/index.html", "see https://example.com/en/some-long-page-name-here"]
    assert secret_scan.findings(spark.createDataFrame([(i, t, "src1") for i, t in enumerate(words)], docs.schema), forest).collect() == []
    assert secret_scan.findings(docs.limit(0), forest).collect() == []


def test_secrets(spark, forest):
    texts = [
        f'some words token = "{HEX}" and more', f"commit {HEX} fixes it", f'TOKEN = "{HEX.upper()}"!! SO!!', "call 4111111111111111 now", "mail 34@mail7.example.com to us", f'api_key="{HEX[:32]}",',
        'password = "your_secret_token_here_1234"', "see https://ththre.example.com/en/8251234 here", None, "", "ererheitheitheitheitheit" * 4000 + "1", f'{HEX} token = "{HEX}" token = "{HEX}"', "Authorization: Bearer " + HEX,
    ]
    docs = spark.createDataFrame([(i, t, "src1", "clash") for i, t in enumerate(texts)], "doc_id long, text string, source string, secret string")
    found = {}
    for r in secret_scan.findings(docs, forest).collect():
        found.setdefault(r.doc_id, []).append((r.word, r.start, r.length))
    assert set(found) == {0, 2, 5, 11, 12}
    assert found[0] == [(4, texts[0].index(HEX) + 1, 40)] and len(found[11]) >= 2
    clean = {r.doc_id: r for r in secret_scan.redact(docs, forest).collect()}
    assert clean[0].text == 'some words token = "[SECRET]" and more' and HEX not in clean[11].text and clean[8].text is None
    assert all(clean[i].text == texts[i] for i in (1, 3, 4, 6, 7, 9, 10)) and clean[0].secret == "clash"
    assert secret_scan.findings(docs.limit(0), forest).collect() == []


def test_every_run_of_a_word(spark, forest):
    """Keys behind a long name, in a URL and in minified JSON, several in one word, and short passwords."""
    aws, ghp, other = "wJalrXUtnFEMIK7MDENGbPxRfiCYzR8aQ4tLk2vN", "ghp_x7Kq2mZp9Lw4Rt8Vb3Nc6Yd1Hf5Js0Ga2QeU", "9f3c77ab01d25e4468bb0c9de1f7a2350c6d8e91"
    texts = [
        f"export AWS_SECRET_ACCESS_KEY={aws} now", f"get https://api.example.com/v1/x?token={ghp} now", f'{{"id":"0123456789abcdef01","api_key":"{HEX}"}}',
        f'{{"api_key":"{HEX}","token":"{other}"}}', "the login password=hunter2Xy9! is", 'and password = "pQ7rT2zK9w" here', "see https://ththre.example.com/en/8251234?page=1234567890123456 here",
        "password=changeme123 here", "an order of 12345678 or hunter2Xy9 here",
    ]
    docs = spark.createDataFrame([(i, t, "src1") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs, forest).collect()}
    assert clean[0] == "export AWS_SECRET_ACCESS_KEY=[SECRET] now"
    assert clean[1] == "get https://api.example.com/v1/x?token=[SECRET] now"
    assert clean[2] == '{"id":"0123456789abcdef01","api_key":"[SECRET]"}' and clean[3] == '{"api_key":"[SECRET]","token":"[SECRET]"}'
    assert clean[4] == "the login password=[SECRET] is" and clean[5] == 'and password = "[SECRET]" here'
    assert all(clean[i] == texts[i] for i in (6, 7, 8))


@pytest.fixture(scope="module")
def classifier(spark):
    return license_scan.train(license_scan.training_rows(spark))


def test_licences(spark, classifier):
    lines = [
        "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
        "His fishing licence was renewed by mail.", "This work is made available under the terms of the GNU General Public Licence version 3", "All rights reserved. No part of this may be reproduced without permission.", "SPDX-License-Identifier: BSD-3-Clause",
    ]
    docs = spark.createDataFrame([(1, "Plain words.\n" + "\n".join(lines), "x"), (2, None, "x"), (3, "", "x"), (4, "Mit und.\nGeiever | vererbe", "x"), (5, "word " * 30_000 + "\n" + lines[0], "x"), (5, lines[0], "x")], "doc_id long, text string, family string")
    got = {}
    for r in license_scan.license_scan(docs, classifier).collect():
        got.setdefault(r.doc_id, []).append((r.paragraph, r.family, r.confirmed))
    assert sorted(got) == [1, 5] and sorted(got[5]) == [(0, "MIT", True), (1, "MIT", True)]
    one = {p: (f, c) for p, f, c in got[1]}
    assert [one[i][0] for i in (1, 2, 3, 4, 5, 6, 7, 8)] == ["MIT", "Apache-2.0", "GPL", "CC-BY-NC", "unknown", "GPL", "Proprietary", "BSD"]
    assert all(one[i][1] for i in (1, 2, 3, 4, 6, 8)) and not one[5][1]
    assert license_scan.license_scan(docs.limit(0), classifier).collect() == []


def test_every_paragraph_is_judged(spark, classifier):
    """Notices without a licence word and wrapped ones are found; the gate lets go of none that the model knows."""
    wrapped = license_scan.TEMPLATES["MIT"][3].replace("any person", "any\nperson").replace("to deal", "to\ndeal")
    texts = ["Plain words.\nThis software is proprietary and confidential.\nMore words.", f"First line.\n{wrapped}\nThis software is proprietary and confidential.", "Wir gehen mit\nund kommen wieder.\nSa maison."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.paragraph, r.family, r.text) for r in license_scan.license_scan(docs, classifier).collect())
    assert got == [(0, 1, "Proprietary", "This software is proprietary and confidential."), (1, 1, "MIT", wrapped), (1, 4, "Proprietary", "This software is proprietary and confidential.")]

    words = license_scan.gate(classifier)
    rows = license_scan.training_rows(spark, 8).select(F.array_join("words", " ").alias("text")).distinct().withColumn("doc_id", F.xxhash64("text"))
    every = {}
    for gate in (lambda c: words, lambda c: None):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(license_scan, "gate", gate)
            every[gate] = sorted(r[:3] for r in license_scan.license_scan(rows, classifier).collect())
    a, b = every.values()
    assert a == b and len(a) > 300


def test_paragraphs_are_scored_once(spark, classifier):
    """The plan that scores holds the scores once, with no filter above them that repeats them; stems hold for all that ANCHOR finds."""
    plans, keep = [], license_scan.Tables.keep
    docs = spark.createDataFrame([(1, "Plain words.\nReleased under the MIT License.\n" * 40)], "doc_id long, text string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(license_scan.Tables, "keep", lambda self, df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(self, df, name))
        found = license_scan.license_scan(docs, classifier).collect()
    assert sorted(r.paragraph for r in found) == list(range(1, 80, 2)) and {r.family for r in found} == {"MIT"}
    assert [p.count("array_intersect") for p in plans] == [1]

    texts = ["Licence", "a license", "licensee", "licen", "COPYRIGHT", "spdx", "Creative Commons", "CC BY", "cc-by", "cc_by", "CC0", "GNU x", "gnus", "GPL", "agpl3", "warranty", "Redistributed", "Public domain", "public\ndomain", "all rights reserved", "Permission is hereby", "permission to use", "permission", "no"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(license_scan.anchored(F.col("t")), F.col("t").rlike(license_scan.ANCHOR)).collect()
    assert all(a == b for a, b in rows) and sum(b for _, b in rows) == 18


def test_licence_calibration(spark, classifier):
    assert 0.2 <= classifier.least <= 0.5 and len({g for g, _, _ in classifier.weights}) < 2000


TEXTS = [
    "Hello  world.\nÉçeau   aianre", "", None, " ", "a ", "   lead", "tab\tand\r\nline", "日本語 and 😀 é ﬁ ½ \u0301x", "hello_world(x) = {\"a\": [1,2,3]};\r\n  return -1 ...!!",
    "▁x <s> </s> <0x0A> <unk>", "a" * 300 + " " + "zqx" * 60, "9" * 200, "don't can't I'll " * 3, "Straße ÄÖÜ ñandú", "\u00a0nbsp\u2028sep",
]


@pytest.fixture(scope="module")
def pieces(spark):
    r = random.Random(1)
    more = ["".join(r.choice("abc dé.,é1-▁\n") for _ in range(r.randrange(1, 60))) for _ in range(60)]
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS + more)], "doc_id long, text string, ids string")


@pytest.fixture(scope="module")
def unigram_file(tmp_path_factory):
    """The same pieces as a unigram model, with scores that do not tie."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(MODEL_FILE, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    r = random.Random(2)
    for p in m.pieces:
        if p.type == 1:
            p.score = -4 - 8 * r.random() - 0.3 * len(p.piece)
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_encoding_as_the_library(spark, pieces, unigram_file, kind):
    path = MODEL_FILE if kind == "bpe" else unigram_file
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in sentencepiece_lattice.encode(pieces, path, bucket_bytes=500).collect()}
    rows = {r.doc_id: r.text for r in pieces.collect()}
    assert len(got) == len(rows)
    for i, t in rows.items():
        want = [] if t is None else library.encode(t)
        assert list(got[i].ids) == want, (t, [library.id_to_piece(x) for x in got[i].ids], library.encode(t, out_type=str))
        assert got[i].round_trip == (t is not None) and got[i].n_tokens == len(want)


def test_decoding(spark, pieces):
    encoded = sentencepiece_lattice.encode(pieces, MODEL_FILE)
    got = {r.doc_id: r.text for r in sentencepiece_lattice.decode(encoded, MODEL_FILE).collect()}
    assert all(got[r.doc_id] == (r.text or "").replace("▁", " ") for r in pieces.collect())
    assert sentencepiece_lattice.encode(pieces.limit(0), MODEL_FILE).collect() == []


def test_pipeline(spark, tmp_path):
    """Stages on a planted corpus: what goes, what stays, and what is changed."""
    import corpus_pipeline

    def prose(seed):
        r = random.Random(seed)
        return " ".join("".join(r.choice(["an", "the", "re", "on", "ti"]) for _ in range(r.randrange(1, 4))) for _ in range(60))

    item = " ".join(prose(999).split()[:30])
    rows = [(i, prose(i), "en", "s", 0) for i in range(20)]
    rows += [(100, rows[0][1], "en", "s", 0), (101, rows[1][1] + " extra", "en", "s", 0), (102, prose(50) + " " + item, "en", "s", 0), (103, "12 !! 34", "en", "s", 0), (104, None, None, None, None), (105, prose(60) + f' token = "{HEX}" end', "en", "s", 0)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(out) == {*range(20), 105}
    text = {r.doc_id: r.text for r in sentencepiece_lattice.decode(corpus_pipeline.run(spark, path), MODEL_FILE).collect()}
    assert text[3] == rows[3][1] and text[105].endswith('token = "[SECRET]" end')
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "secrets", "tokens"]


def planted(spark, tmp_path, rows, items=()):
    import corpus_pipeline

    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return corpus_pipeline, docs, str(tmp_path)


def distinct_words(seed, n):
    return [f"w{seed}x{i}" for i in range(n)]


def test_pipeline_near_copies_by_five_words(spark, tmp_path):
    """53 words with one changed in the middle: 44 of 54 shingles of five words are shared (0.81), 48 of 54 of three (0.89)."""
    one = distinct_words(1, 53)
    other = [*one[:26], "changed", *one[27:]]
    pipeline, docs, path = planted(spark, tmp_path, [(1, " ".join(one), "en", "s"), (2, " ".join(other), "en", "s"), (3, " ".join(distinct_words(2, 53)), "en", "s")])
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, docs, path).collect()) == [1, 3]


def test_pipeline_rows_without_or_with_equal_ids(spark, tmp_path):
    """Rows are judged one by one, whatever their ids."""
    t = [" ".join(distinct_words(i, 40)) for i in range(8)]
    rows = [(None, t[0], "en", "a"), (None, t[1], "en", "b"), (5, t[2], "en", "c"), (5, t[3], "en", "d"), (None, t[2], "en", "e"), (9, t[2], "en", "f"), (None, t[4], "en", "g"), (5, t[4], "en", "h"), (None, t[5], "en", "i"), (7, None, "en", "j"), (7, None, "en", "k"), (None, t[6], "en", "l"), (None, t[6], "en", "m")]
    pipeline, docs, path = planted(spark, tmp_path, rows, [(1, t[5]), (2, t[3])])
    kept = pipeline.near_duplicates(spark, docs, path)
    got = [r.source for r in kept.collect()]
    assert sorted(set(got) - {"l", "m"}) == ["a", "b", "c", "d", "h", "i", "j", "k"] and len({"l", "m"} & set(got)) == 1 and len(got) == 9
    clean = {r.source for r in pipeline.decontaminate(spark, kept, path).collect()}
    assert clean == set(got) - {"d", "i"}


def test_pipeline_empty_table_and_foreign_columns(spark, tmp_path):
    """No rows give no rows at every stage; columns with the names that stages use inside travel along."""
    pipeline, docs, path = planted(spark, tmp_path, [(1, "the house is on the hill " * 4, "en", "s"), (2, "ein haus steht auf dem hügel " * 4, "de", "s")], [(1, "nothing of this is there at all")])
    docs = docs.withColumns({c: F.lit(c) for c in ("key", "n", "score", "lang_pred", "secrets", "component_id", "seed", "bucket")})
    empty = docs.limit(0)
    for name, stage in pipeline.STAGES[:4]:
        assert stage(spark, empty, path).collect() == []
        docs = stage(spark, docs, path)
        assert len(docs.columns) == 12 and sorted((r.doc_id, r.key, r.seed) for r in docs.collect()) == [(1, "key", "seed"), (2, "key", "seed")], name
    assert pipeline.tokens(spark, empty, path).collect() == [] and pipeline.tokens(spark, docs, path).count() == 2
