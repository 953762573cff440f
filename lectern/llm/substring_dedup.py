"""Operator 2: removal of passages that repeat across documents, by level-wise doubling.

A window of ``w`` words can only repeat if the windows of half its length inside it repeat. Level one
therefore looks at windows of ceil(w / 2) words, and only at one of those inside each long window: the
one of least hash, which equal long windows share. Distinct that occur in two documents survive; only
they are extended to the full length, which settles what is removed. Distinct that repeat at that
length are extended to twice, four times ... the length until no candidate survives: at each level every
start both of whose halves repeat, from the hashes of the level before, without the texts.

Documents are dealt into buckets of bounded size by a hash, their texts compressed. A bucket knows its distinct windows
in the order of their hashes, which are ranges of parts; a part hears of each window from each bucket once, so a
passage in a third of all documents costs a row for each bucket, and answers with bits in the same
order. Distinct are packed into arrays for each bucket and part, and compared by 64-bit hashes (level one, a
filter, by 40 bits within a part).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, WordHashes, compressed, text_bytes, uncompressed, window_hashes
from .repeats import ANSWER_TYPES, SENT, SENT_TYPES, Distinct, bits, compared, seen_twice, sent

BUCKET_BYTES = 16 << 20
_HASHES = WordHashes()


def anchors(h: np.ndarray, window: int) -> np.ndarray:
    """For each window of words, the least hash among the half-length windows inside it."""
    half = -(-window // 2)
    small = window_hashes(h, half, 1)
    n = len(h) - window + 1
    if n <= 0:
        return small[:0]
    out = small[:n].copy()
    for i in range(1, window - half + 1):
        np.minimum(out, small[i : i + n], out=out)
    return out


class Bucket:
    """The words of a bucket's documents, those without an id left out, in order of the ids."""

    def __init__(self, docs: pa.Table, window: int):
        self.ids, self.texts = docs.column("doc_id").to_pylist(), uncompressed(docs.column("text"))
        self.rows = sorted((i for i, d in enumerate(self.ids) if d is not None), key=lambda i: self.ids[i])
        self.h, self.counts = _HASHES.of([self.texts[i] for i in self.rows])
        self.first = np.cumsum(self.counts) - self.counts
        starts = np.maximum(self.counts - window + 1, 0)
        #: Where windows start, and the row (in order) of each.
        self.row = np.repeat(np.arange(len(starts)), starts)
        self.at = np.arange(len(self.row)) - np.repeat(np.cumsum(starts) - starts, starts) + self.first[self.row]
        self.doc = np.array([self.ids[i] for i in self.rows], np.int64)[self.row] if self.rows else np.zeros(0, np.int64)
        self.window = window

    def anchors(self) -> tuple[np.ndarray, Distinct]:
        """The anchor of each window, and their distinct ones."""
        a = anchors(self.h, self.window)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        # Distinct side by side mostly share theirs.
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (self.row[1:] != self.row[:-1])
        return a, Distinct(a[new], self.doc[new])

    def candidates(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, Distinct]:
        """The windows whose anchor repeats: which they are, their hashes, and the distinct ones."""
        a, distinct = self.anchors()
        (again,) = bits(answers, 1)
        twice = distinct.hashes[again]
        which = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, a), len(twice) - 1)] == a) if len(twice) else np.zeros(0, np.int64)
        h = window_hashes(self.h, self.window, 2)[self.at[which]]
        return which, h, Distinct(h, self.doc[which])


def _level_one(window: int, parts: int):
    def run(docs: pa.Table) -> pa.Table:
        return sent(Bucket(docs, window).anchors()[1], docs.column("bucket")[0].as_py(), parts, False)

    return run


def _level_two(window: int, parts: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return SENT.empty_table()
        return sent(Bucket(docs, window).candidates(answers)[2], docs.column("bucket")[0].as_py(), parts, True)

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("bucket", pa.int64()), ("held", pa.binary())])
_RESULT_TYPES = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary, removed array<struct<start:int,end:int>>, bucket long, held binary"


def _packed(docs: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.diff(docs, prepend=0).astype("<i8").tobytes() + np.diff(at, prepend=0).astype("<i8").tobytes() + hashes.tobytes())


def _unpacked(held: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(held)
    n = len(raw) // 24
    return np.frombuffer(raw, "<i8", n).cumsum(), np.frombuffer(raw, "<i8", n, 8 * n).cumsum(), np.frombuffer(raw, np.uint64, n, 16 * n)


def _apply(window: int, full: bool):
    def run(docs: pa.Table, anchored: pa.Table, answers: pa.Table) -> pa.Table:
        """Rows of documents (bucket null), and a row with the bucket's repeated windows."""
        b = Bucket(docs, window)
        which, h, distinct = b.candidates(anchored)
        elsewhere, again = bits(answers, 2)
        number = np.searchsorted(distinct.hashes, h)
        gone = elsewhere[number] | (distinct.least[number] < b.doc[which])
        depth = np.zeros(len(b.h) + 1, np.int64)
        np.add.at(depth, b.at[which[gone]], 1)
        np.subtract.at(depth, b.at[which[gone]] + window, 1)
        out = depth[:-1].cumsum() > 0
        place = {i: k for k, i in enumerate(b.rows)}
        rows = []
        for i, (doc, text) in enumerate(zip(b.ids, b.texts, strict=True)):
            words, spans, n_gone = (text or b"").split(), [], 0
            n, k = len(words), place.get(i)
            if k is not None and (own := out[b.first[k] : b.first[k] + n]).any():
                n_gone = int(own.sum())
                edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))).reshape(-1, 2)
                spans = [{"start": int(x), "end": int(y)} for x, y in edges] if full else []
                words = list(compress(words, (~own).tolist()))
            kept = b" ".join(words)
            rows.append((doc, n, n_gone, hashlib.sha256(kept).hexdigest(), kept if full else None, spans if full else None, None, None))
        stay = again[number]
        if stay.any():
            # A step between texts, so that no window reaches from one into the next of the same id.
            held = _packed(b.doc[which[stay]], (b.at + b.row)[which[stay]], h[stay])
            rows.append((None, None, None, None, None, None, docs.column("bucket")[0].as_py(), held))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RESULT, strict=True)], schema=_RESULT)

    return run


def _twice(docs: np.ndarray, at: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of twice the size both of whose halves are given; starts are numbers of words in the bucket and rise."""
    i = np.searchsorted(at, at + size)
    good = np.flatnonzero((i < len(at)) & (at[np.minimum(i, len(at) - 1)] == at + size))
    good = good[docs[good] == docs[i[good]]]
    both = np.stack([hashes[good], hashes[i[good]]], 1).ravel()
    return docs[good], at[good], window_hashes(both, 2, 3)[::2] if len(good) else hashes[:0]


def _grown(size: int, parts: int):
    def run(held: pa.Table) -> pa.Table:
        docs, _, h = _twice(*_unpacked(held.column("held")[0].as_py()), size)
        return sent(Distinct(h, docs), held.column("bucket")[0].as_py(), parts, True)

    return run


_HELD = pa.schema([("bucket", pa.int64()), ("held", pa.binary()), ("docs", pa.list_(pa.int64()))])


def _kept(size: int):
    def run(held: pa.Table, answers: pa.Table) -> pa.Table:
        """Of the windows of twice the size those that repeat, and the documents that hold any."""
        if not held.num_rows or not answers.num_rows:
            return _HELD.empty_table()
        docs, at, h = _twice(*_unpacked(held.column("held")[0].as_py()), size)
        stay = bits(answers, 2)[1][np.searchsorted(Distinct(h, docs).hashes, h)]
        if not stay.any():
            return _HELD.empty_table()
        return pa.table([held.column("bucket"), pa.array([_packed(docs[stay], at[stay], h[stay])], pa.binary()), pa.array([np.unique(docs[stay])], pa.list_(pa.int64()))], schema=_HELD)

    return run


def substring_dedup(docs: DataFrame, window: int = 13, full: bool = True, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row of docs (doc_id, text; other columns, of any name, are ignored): what is left once repeated passages go.

    Words are runs of other than ASCII white space, unchanged. A word goes if a window of ``window``
    words over it also starts in a document with a smaller doc_id; windows are judged on the input.
    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by spaces), if full the
    kept words as bytes and the removed spans (word numbers, the end not included), otherwise nulls
    there, and longest_repeat: the longest level (window, twice, four times ...) of which the document
    holds a window that occurs in another one (null: none).

    A null or empty text has no words. A null doc_id is smaller and greater than none: nothing goes from such a
    row, and nothing because of it. Rows that share a doc_id do not make one another's windows go, but
    each loses what any of them loses to smaller ids. A text of any length is hashed in slices, but held whole by one
    task. No rows give no rows. Runs jobs at once and keeps intermediate tables in spark.checkpoint.dir.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "substrings")
    rows = text_bytes(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = parts = max(1, -(-size // bucket_bytes))
    rows = rows.select("doc_id", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).alias("bucket"), "text")

    def dealt() -> DataFrame:
        return rows.mapInArrow(compressed, "doc_id long, bucket long, text binary").repartition(buckets, "bucket")

    def asked(rows: DataFrame, answer: Callable, name: str) -> DataFrame:
        out = tables.keep(rows.repartition(parts, "part").groupBy("part").applyInArrow(answer, ANSWER_TYPES), name)
        tables.release()
        return out

    ones = asked(dealt().groupBy("bucket").applyInArrow(_level_one(window, parts), SENT_TYPES), seen_twice, "answers-half")
    full_length = dealt().groupBy("bucket").cogroup(ones.groupBy("bucket")).applyInArrow(_level_two(window, parts), SENT_TYPES)
    twos = asked(full_length, compared, "answers-0")

    both = ones.withColumn("level", F.lit(1)).unionByName(twos.withColumn("level", F.lit(2)))
    apply = _apply(window, full)

    def applied(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _RESULT.empty_table()
        level = answers.column("level").to_numpy()
        return apply(docs, answers.filter(pa.array(level == 1)), answers.filter(pa.array(level == 2)))

    result = tables.keep(dealt().groupBy("bucket").cogroup(both.groupBy("bucket")).applyInArrow(applied, _RESULT_TYPES), "result")
    tables.drop(["answers-half", "answers-0"])
    tables.release()

    longest = None
    held, level = result.where("bucket is not null").select("bucket", "held"), 0
    while not held.isEmpty():
        length = window << level
        # Level 0 lists its documents by the arrays themselves.
        docs_of = held.select(F.explode("docs").alias("doc_id")) if level else held.mapInArrow(_docs_of, "doc_id long")
        reached = docs_of.select("doc_id", F.lit(length).cast("long").alias("longest_repeat"))
        longest = reached if longest is None else longest.unionByName(reached)
        answers = asked(held.select("bucket", "held").groupBy("bucket").applyInArrow(_grown(length, parts), SENT_TYPES), compared, f"answers-{level + 1}")
        grown = held.select("bucket", "held").groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_kept(length), "bucket long, held binary, docs array<long>")
        held = tables.keep(grown, f"held-{level + 1}")
        tables.drop([f"answers-{level + 1}"])
        tables.release()
        level += 1
    told = result.where("bucket is null").select("doc_id", "n_words", "n_removed", "kept_sha256", "kept", "removed")
    if longest is None:
        return told.withColumn("longest_repeat", F.lit(None).cast("long"))
    marks = tables.keep(longest.groupBy("doc_id").agg(F.max("longest_repeat").alias("longest_repeat")), "marks")
    tables.drop(f"held-{i}" for i in range(1, level + 1))
    return told.join(marks, "doc_id", "left")


def _docs_of(batches):
    for b in batches:
        for held in b.column("held").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_unpacked(held)[0]))], names=["doc_id"])
