"""Operator 8: language identification by words first, backing off to shorter character n-grams.

A word that the model knows adds its log frequency in each language. A word that no language knows is
scored by its character n-grams (with marks for its start and end): by the longest order of which the
model knows any, then the next shorter one. N-grams are counted once for each distinct word, since
they stand for words not seen.

The model is learned from a bounded sample of the labelled rows: about ``LABELLED`` of them for each language, those of least
hash, all of them in a small corpus. Every word and n-gram of the sample stays in the model. Counting combines in each task,
in dictionaries that are emptied when they reach ``FLUSH`` entries, and again before each shuffle. Predictions cover
all rows and whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, batch, bounded_batches, small

#: Labelled rows of a language that the model learns from (the expected number, if there are more), and the longest n-grams.
LABELLED, ORDER = 1_500, 4
FLUSH = 300_000
#: Unseen words whose scores a task remembers.
BACKED = 50_000
#: Beyond so many words the posterior grows no further; it keeps scores of long texts off 1.
STEADY = 20
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]+")
#: Marks of a word's start and end, which no word contains.
_START, _END = "<", ">"


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters (categories L*)."""
    words = _LETTERS.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    # The pattern also takes numbers that are no digits, such as fractions.
    return [x for w in words for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def grams(word: str, n: int) -> list[str]:
    w = f"{_START}{word}{_END}"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


_COUNTS = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("gram", pa.string()), ("n", pa.int64())])


def _flush(counts: dict[tuple[str, int], Counter]) -> Iterator[pa.RecordBatch]:
    for (lang, size), c in counts.items():
        if c:
            yield batch(_COUNTS, [lang] * len(c), [size] * len(c), list(c), list(c.values()))
    counts.clear()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, int], Counter] = {}
    for b in small(batches):
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            counts.setdefault((lang, 0), Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > FLUSH:
                yield from _flush(counts)
    yield from _flush(counts)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, int], Counter] = {}
    for b in batches:
        for lang, word in zip(b.column("lang").to_pylist(), b.column("gram").to_pylist(), strict=True):
            for n in range(1, ORDER + 1):
                counts.setdefault((lang, n), Counter()).update(grams(word, n))
        if sum(map(len, counts.values())) > FLUSH:
            yield from _flush(counts)
    yield from _flush(counts)


class Model:
    """Log frequencies by language of the words and n-grams that stayed; what a language lacks counts as half an occurrence."""

    def __init__(self, langs: list[str], totals: dict[tuple[str, int], int], rows: list[tuple[str, int, str, int]]):
        self.langs = langs
        self.tables: list[dict[str, int]] = [{} for _ in range(ORDER + 1)]
        at = {lang: i for i, lang in enumerate(langs)}
        floor = np.array([[np.log(0.5 / max(totals.get((lang, n), 1), 1)) for lang in langs] for n in range(ORDER + 1)]).reshape(ORDER + 1, len(langs))
        for _, size, gram, _ in rows:
            self.tables[size].setdefault(gram, len(self.tables[size]))
        self.logs = [np.repeat(floor[n : n + 1], len(t), 0) for n, t in enumerate(self.tables)]
        for lang, size, gram, n in rows:
            self.logs[size][self.tables[size][gram], at[lang]] = np.log(n / totals[lang, size])
        self.backed: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"backed": {}}

    def unseen(self, word: str) -> np.ndarray:
        """The mean over the known n-grams of the longest order that has any; zeros if there is none."""
        if (found := self.backed.get(word)) is None:
            found = np.zeros(len(self.langs))
            for n in range(ORDER, 0, -1):
                known = [i for g in grams(word, n) if (i := self.tables[n].get(g)) is not None]
                if known:
                    found = self.logs[n][known].mean(axis=0)
                    break
            if len(self.backed) >= BACKED:
                self.backed.clear()
            self.backed[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.langs:
            return UNKNOWN, 0.0
        table = self.tables[0]
        at = [table.get(w, -1) for w in words]
        known = [i for i in at if i >= 0]
        total = self.logs[0][known].sum(axis=0) if known else np.zeros(len(self.langs))
        if len(known) < len(words):
            total = total + np.sum([self.unseen(w) for w, i in zip(words, at, strict=True) if i < 0], axis=0)
        mean = total / len(words) * min(len(words), STEADY)
        p = np.exp(mean - mean.max())
        best = int(np.argmax(mean))
        return self.langs[best], float(p[best] / p.sum())


def train(labelled: DataFrame, tables: Tables) -> Model:
    """The model of texts with a language (lang, text). Rows without either are left out; no rows give a model that knows nothing."""
    rows = labelled.where("lang is not null and text is not null").withColumn("row", F.xxhash64(*labelled.columns)).select("lang", "text", "row")
    # One row for each language; the rows whose hash lies in the lowest LABELLED / n part of all hashes stay.
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    low = (F.col("row") / F.lit(2.0**64) + 0.5) * F.col("n") <= LABELLED
    rows = rows.join(F.broadcast(sizes), "lang").where(low).select("lang", "text")
    counted = rows.mapInArrow(_count_words, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    words = tables.keep(counted, "words")
    counted = words.select("lang", "gram").mapInArrow(_count_grams, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    parts = tables.keep(counted, "grams")
    # One row for each language and size.
    every = words.unionByName(parts)
    totals = {(r["lang"], r["size"]): r["n"] for r in every.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({lang for lang, _ in totals})
    # Bounded by the sample.
    found = every.orderBy("size", "gram", "lang").toArrow()
    return Model(langs, totals, list(zip(*(found.column(c).to_pylist() for c in ("lang", "size", "gram", "n")), strict=True)))


def _predict(model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in small(batches):
            out = [m.predict(t) for t in b.column(at).to_pylist()]
            schema = pa.schema([*b.schema, pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())])
            yield batch(schema, *b.columns, [x for x, _ in out], [s for _, s in out])

    return run


def learn(docs: DataFrame) -> Model:
    """The model of the rows of docs (doc_id, text, lang) whose crc32 of the doc_id is not 0 modulo 5."""
    tables = Tables(docs.sparkSession, "language")
    model = train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", F.col("lang").cast("string"), F.col("text").cast("string")), tables)
    tables.drop(["words", "grams"])
    return model


def annotate(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score (which replace columns of these names); all other columns and rows stay, in place."""
    bounded_batches(docs.sparkSession)
    rest = docs.drop("lang_pred", "score")
    schema = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rest.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), rest.columns.index("text")), schema)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text, lang; other columns are ignored).

    The model learns from rows with a text and a lang whose crc32 of the doc_id is not 0 modulo 5;
    predictions use the text alone. A text that is null or has no letter is ``und`` with score 0, as is
    every text if there is nothing to learn from. A null doc_id is not held out, but nothing is learned
    from its row either. score is the posterior of the predicted language, steadied for long texts.
    Of languages with the same score the first in alphabetical order is told. A text of any length is judged whole; other
    columns, of any name, are ignored. Repeated rows give repeated rows, and no rows none. Training runs jobs at once and keeps its counts
    in spark.checkpoint.dir.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    asked = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("string"))
    return annotate(asked, learn(docs)).drop("text")
