"""Operator 7: benchmark decontamination by n-gram seeds and Smith-Waterman alignment.

Seeds are the word n-grams of the benchmark's items. One pass over the corpus finds every occurrence,
and all of them join documents to items: a frequent seed may be frequent because of the copies, so none
is left out. Each stretch of a document with hits, with a margin of the item's length, is aligned with
the item if the two have enough words in common to reach the score at all, whatever their order. Words
are compared by Unicode's case folding, without ASCII punctuation.

The test for seeds inside the pass uses a broadcast array while there are at most ``SEEDS`` of them
(checked); beyond that every n-gram goes to the join. The joins on seeds and ids are equi-joins.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, batch, signed, small, text_bytes, window_hashes, word_hashes

SEEDS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1

_PLAIN = bytes.maketrans(string.ascii_uppercase.encode() + string.punctuation.encode(), string.ascii_lowercase.encode() + b" " * len(string.punctuation))


def words_of(text: bytes | None) -> list[bytes]:
    """Words in lower case by Unicode's case folding, ASCII punctuation taken for white space."""
    if not text:
        return []
    if not text.isascii():
        text = text.decode("utf-8", "replace").casefold().encode()
    return text.translate(_PLAIN).split()


def smith_waterman(item: list[bytes], passage: list[bytes]) -> tuple[int, int, int]:
    """The best local alignment: its score, and its first and last word (not included) in the passage.

    Rows are whole arrays. A gap inside a row is a running maximum; the start of each cell's path
    travels with its score.
    """
    n = len(passage)
    if not item or not n:
        return 0, 0, 0
    number: dict[bytes, int] = {}
    b = np.array([number.setdefault(w, len(number)) for w in passage])
    cols = np.arange(n + 1)
    # Score and start packed in one integer: the greater score wins, then the later start.
    base = np.int64(n + 2)
    row = cols.astype(np.int64)
    best, end = 0, 0
    for w in item:
        step = np.where(b == number.get(w, -1), MATCH, MISMATCH)
        new = np.maximum(row + GAP * base, cols)
        np.maximum(new[1:], row[:-1] + step * base, out=new[1:])
        # A gap in the passage: H[j] = max over i <= j of H[i] + GAP * (j - i).
        slope = -GAP * base * cols
        new = np.maximum(np.maximum.accumulate(new + slope) - slope, cols)
        # A cell without score starts where it is.
        row = np.where(new < base, cols, new)
        j = int(row.argmax())
        if row[j] // base > best // base:
            best, end = int(row[j]), j
    return best // int(base), best % int(base), end


_HITS = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("seed", pa.int64())])
_SEEDS = pa.schema([("item_id", pa.int64()), ("m", pa.int32()), ("item_pos", pa.int32()), ("size", pa.int32()), ("seed", pa.int64())])


def _item_seeds(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                h = word_hashes(words_of(text))
                if len(h):
                    size = min(k, len(h))
                    s = window_hashes(h, size, size)
                    yield batch(_SEEDS, [item] * len(s), [len(h)] * len(s), np.arange(len(s), dtype=np.int32), [size] * len(s), signed(s))

    return run


def _hits(known, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if known is not None:
            seeds = known.value
            low = np.zeros(1 << 20, bool)
            low[(seeds & np.uint64(0xFFFFF)).astype(np.int64)] = True
        for b in small(batches):
            ids, at, found = [], [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                h = word_hashes(words_of(text))
                for size in sizes:
                    s = window_hashes(h, size, size)
                    if known is None:
                        p = np.arange(len(s))
                    else:
                        p = np.flatnonzero(low[(s & np.uint64(0xFFFFF)).astype(np.int64)])
                        p = p[seeds[np.minimum(np.searchsorted(seeds, s[p]), len(seeds) - 1)] == s[p]] if len(p) else p
                    if len(p):
                        ids.append(np.full(len(p), doc))
                        at.append(p.astype(np.int32))
                        found.append(s[p])
            if ids:
                yield batch(_HITS, np.concatenate(ids), np.concatenate(at), signed(np.concatenate(found)))

    return run


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])


def _align(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            out = []
            last, words, known = None, [], {}
            for doc, item, text, item_text, spots in zip(*(b.column(c).to_pylist() for c in ("doc_id", "item_id", "text", "item_text", "spots")), strict=True):
                if text != last:
                    last, words = text, words_of(text)
                if item_text not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[item_text] = words_of(item_text)
                own = known[item_text]
                m, best = len(own), (0, 0, 0)
                spots = sorted(spots)
                i = 0
                while i < len(spots):
                    j = i
                    while j + 1 < len(spots) and spots[j + 1] - spots[j] <= 2 * m:
                        j += 1
                    lo = max(0, spots[i] - m)
                    passage = words[lo : spots[j] + 2 * m]
                    i = j + 1
                    # No alignment matches more words than the passage has of the item's.
                    if sum(map(set(passage).__contains__, own)) / m < least:
                        continue
                    score, start, end = smith_waterman(own, passage)
                    best = max(best, (score, lo + start, lo + end), key=lambda x: x[0])
                out.append((doc, item, best[0] / (MATCH * m), best[1], best[2]))
            if out:
                yield batch(_FOUND, *map(list, zip(*out, strict=True)))

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 3, least: float = 0.6) -> DataFrame:
    """(doc_id, item_id, score, start, end): the documents that hold a copy, perhaps edited, of a benchmark item.

    docs has doc_id and text, benchmark item_id and text; other columns are ignored. score is the
    alignment's share of a perfect one, ``least`` or more; start and end are word numbers in the
    document (end not included). One row for each pair of ids, of the best alignment, the first on
    ties. Null ids and texts and texts without words match nothing; items of fewer than k words are
    sought as they are. Rows that share an id count as one document (or item) of several texts, of which the best alignment is
    told. Texts and items of any length are aligned whole, stretch by stretch. Empty tables give no rows. A copy without k
    unchanged words in a row anywhere has no seed and is not found: by substitutions alone, that takes more than a quarter
    of an item's words. Runs jobs at once and keeps intermediate tables in
    spark.checkpoint.dir.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "contaminated")
    source = text_bytes(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id").where("doc_id is not null and text is not null")
    items = text_bytes(benchmark.select(F.col("item_id").cast("long"), "text"), "item_id").where("item_id is not null and text is not null")
    seeds = tables.keep(items.mapInArrow(_item_seeds(k), "item_id long, m int, item_pos int, size int, seed long"), "seeds")
    distinct = seeds.select("seed").distinct()
    sizes = sorted(r[0] for r in seeds.select("size").distinct().collect())  # k at most
    few = distinct.count() <= SEEDS
    known = spark.sparkContext.broadcast(np.sort(distinct.toPandas()["seed"].to_numpy().astype(np.int64).view(np.uint64))) if few else None
    hits = source.mapInArrow(_hits(known, sizes), "doc_id long, pos int, seed long")
    hits = tables.keep(hits if few else hits.join(distinct, "seed", "left_semi"), "hits")

    spots = hits.join(seeds.select("item_id", "seed").distinct(), "seed").groupBy("doc_id", "item_id").agg(F.collect_set("pos").alias("spots"))
    asked = spots.join(source, "doc_id").join(items.toDF("item_id", "item_text"), "item_id")
    found = asked.mapInArrow(_align(least), "doc_id long, item_id long, score double, start int, end int").where(F.col("score") >= least)
    best = F.max_by(F.struct("score", "start", "end"), F.struct("score", -F.col("start"), -F.col("end")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
