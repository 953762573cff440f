"""Operator 10: quality rules whose thresholds adapt to each language and source.

Four measures of a text become whole numbers (bins): symbols and repeated lines and words per mille,
mean word length in tenths. A sketch is the count of documents in each bin: of fixed size (at most
1,001 bins a measure), mergeable by adding, and exact to one bin. Sketches are made for each (language, source),
merged into one for each language and one for all, and give quartiles; a document fails a measure
beyond the quartile by three interquartile ranges and a tolerance. Groups of under ``least`` documents
use the sketch of their language, or of all, so that no threshold rests on a handful of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, batch

#: Measure -> (bin as SQL, tolerance above the upper quartile, tolerance below the lower one or None), all in bins.
MEASURES = {
    "symbols": ("1000 * n_symbols div word_chars", 50, None),
    "lines": ("1000 * n_dup_lines div n_lines", 400, None),
    "repeats": ("1000 * n_repeat_words div n_words", 300, None),
    "length": ("least(10 * word_chars div n_words, 1000)", 10, 10),
}
SPREAD = 3
LEAST = 30
LONGEST_LIST = 2**21

_CHARS = np.array([0 if b in b" \t\n\r\x0b\x0c" or b & 0xC0 == 0x80 else 1 for b in range(256)])
_SYMBOLS = np.array([b in b"#*$%&|<>" for b in range(256)]).astype(np.int64)
_BASE = pa.schema([(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")])


def repeated_words(words: list[bytes]) -> int:
    """The words that lie in a window of three found twice or more. Windows are numbered, not hashed."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    pair = ids[:-1] * len(seen) + ids[1:]
    if len(seen) >= LONGEST_LIST:
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, n = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    twice = n[at] > 1
    cover = np.zeros(len(words), bool)
    for i in range(3):
        cover[i : len(words) - 2 + i] |= twice
    return int(cover.sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    if not text:
        return (0,) * 6
    chars = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), int(chars @ _CHARS), int(chars @ _SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = np.array([measure(t) for t in b.column("text").to_pylist()], np.int64).reshape(-1, 6)
        schema = pa.schema([*(b.schema.field(i) for i in range(3)), *_BASE])
        yield batch(schema, *b.columns[:3], *(np.ascontiguousarray(rows[:, i]) for i in range(6)))


def quality_rules(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per row of docs (doc_id, text, lang, source; other columns are ignored): the base counts and the verdict.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (under 50
    words, or more than half of them in repeated windows of three), kept, n_lines (those with a word) and
    failed: the adaptive rules that a document breaks. Documents that fail the base are not in the
    sketches. A null text has no words and fails the base; null languages and sources are groups like
    any other. Rows are judged one by one, so repeated rows give repeated rows. No rows give no rows.
    Runs a job at once: the counts are kept in spark.checkpoint.dir and read twice.
    """
    tables = Tables(docs.sparkSession, "quality")
    source = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("binary").alias("text"))
    base = source.mapInArrow(_measures, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    base = tables.keep(base.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")), "base")
    bins = base.withColumns({k: F.expr(f"if(base_failed, null, {sql})") for k, (sql, *_) in MEASURES.items()})

    # The sketches; bins that are merged again and again stay small.
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), F.col(k).alias("bin")) for k in MEASURES)))
    counts = bins.where("not base_failed").select("lang", "source", each.alias("m")).groupBy("lang", "source", "m.measure", "m.bin").agg(F.count("*").alias("n"))
    counts = tables.keep(counts, "sketches")
    by_lang = counts.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n"))
    overall = counts.groupBy("measure", "bin").agg(F.sum("n").alias("n"))

    def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
        """A row for each group with its size and an array of limits, by lower quartiles: the least bin with at least a quarter (three quarters) of the rows."""
        w = Window.partitionBy(*keys, "measure")
        q = sketch.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "size": F.sum("n").over(w)})
        q = q.groupBy(*keys, "measure").agg(F.max("size").alias("size"), F.min(F.expr("if(4 * upto >= size, bin, null)")).alias("q1"), F.min(F.expr("if(4 * upto >= 3 * size, bin, null)")).alias("q3"))
        most = F.coalesce(*(F.when(F.col("measure") == k, F.expr(f"q3 + {SPREAD} * (q3 - q1) + {hi}")) for k, (_, hi, _) in MEASURES.items()))
        low = F.coalesce(*(F.when(F.col("measure") == k, F.expr(f"q1 - {SPREAD} * (q3 - q1) - {lo}")) for k, (_, _, lo) in MEASURES.items() if lo is not None), F.lit(-1))
        q = q.withColumns({"most": most, "low": low})
        return q.groupBy(*keys).agg(F.max("size").alias("size"), *(F.max(F.expr(f"if(measure = '{k}', {c}, null)")).alias(f"{c}_{k}") for k in MEASURES for c in ("most", "low")))

    def pick(df: DataFrame, level: int) -> DataFrame:
        cols = [f"{c}_{k}" for k in MEASURES for c in ("most", "low")]
        return df.select(*[c for c in df.columns if c not in cols and c != "size"], F.struct("size", *cols).alias(f"f{level}"))

    same = lambda a, b, keys: [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    groups = pick(fences(counts, ["lang", "source"]), 0).alias("a")
    groups = groups.join(pick(fences(by_lang, ["lang"]), 1).alias("b"), same("a", "b", ["lang"])).select("a.*", "b.f1")
    groups = groups.withColumn("every", F.lit(0)).join(pick(fences(overall.withColumn("every", F.lit(0)), ["every"]), 2), "every")
    groups = groups.select("lang", "source", F.when(F.col("f0.size") >= least, F.col("f0")).when(F.col("f1.size") >= least, F.col("f1")).otherwise(F.col("f2")).alias("f"))
    groups = tables.keep(groups, "fences")

    judged = bins.alias("a").join(groups.alias("b"), same("a", "b", ["lang", "source"]), "left").select("a.*", "b.f")
    broken = F.array(*(F.when((F.col(k) > F.col(f"f.most_{k}")) | (F.col(k) < F.col(f"f.low_{k}")), F.lit(k)) for k in MEASURES))
    judged = judged.withColumn("failed", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.filter(broken, lambda x: x.isNotNull())))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "n_lines", "failed")
