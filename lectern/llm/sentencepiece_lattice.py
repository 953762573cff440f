"""Operator 9: SentencePiece encoding and decoding by a relational lattice.

A text is cut into chunks between characters that stand side by side in no piece of the vocabulary, so no piece
spans a cut. The lattice is built once for each distinct chunk: its substrings of bounded length are exploded and
equi-joined to the piece table, the matches (edges) are grouped by chunk, and a higher-order aggregate folds
them into ids:

* unigram models: Viterbi, the path of greatest summed score;
* BPE models: the adjacent pair whose union is the best-scored edge merges, until none is left. Scores of
  BPE pieces are ranks of merges, so Viterbi over them would give other ids than the model defines.

A chunk of more than ``LONG`` characters does not fit the fold's bit mask; it is folded in Python by the same rule.

Texts travel compressed, and once: they are dealt into buckets of bounded size by a hash. A bucket numbers its distinct
chunks in the order of their hashes and sends them, packed, to the parts of its group of up to ``TOGETHER`` buckets; a part
finds the distinct chunks of its share of the hashes. So a lattice is built once for each chunk and group, however common the
chunk, and no list grows with the corpus. What comes back to a bucket is the ids of its chunks by number, packed as
well, and its texts are put together by array look-ups.

The vocabulary file is read by the driver from a path; the piece table (its rows) is what is broadcast.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, compressed, let, mix, tidy, uncompressed

SPACE = "▁"
LONG = 60
BUCKET_BYTES = 16 << 20
TOGETHER = 1024
#: Characters that are cut and hashed at once.
SLICE = 1 << 20


@dataclass
class Vocabulary:
    """Pieces with their scores."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
    bpe: bool
    dummy_prefix: bool
    byte_ids: list[int]
    unknown: int
    longest: int = field(default=1)

    def __post_init__(self) -> None:
        self.longest = max((len(p) for p, _, _ in self.usable()), default=1)
        if self.bpe and (len(self.pieces) >= 1 << 20 or self.longest >= 64):
            raise ValueError("BPE vocabularies of a million pieces or more, or with pieces of 64 characters or more, are not supported")

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix or m.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models that leave text as it is are supported")
        kinds = [p.type for p in m.pieces]
        at = {p.piece: i for i, p in enumerate(m.pieces)}
        byte_ids = [at[f"<0x{b:02X}>"] for b in range(256)] if m.trainer_spec.byte_fallback else []
        return cls([p.piece for p in m.pieces], [p.score for p in m.pieces], kinds, m.trainer_spec.model_type == 2, m.normalizer_spec.add_dummy_prefix, byte_ids, kinds.index(2))

    def usable(self) -> list[tuple[str, int, float]]:
        return [(p, i, s) for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds, strict=True)) if k in (1, 4)]

    def table(self, spark: SparkSession) -> DataFrame:
        """The piece table: piece, id, score, and rank (0 for the best score; equal scores share one)."""
        rank = {s: r for r, s in enumerate(sorted({s for _, _, s in self.usable()}, reverse=True))}
        return spark.createDataFrame([(*row, rank[row[2]]) for row in self.usable()], "piece string, id int, score double, rank long")

    @cached_property
    def cutter(self) -> Cutter:
        return Cutter(self)

    def as_bytes(self) -> list[bytes]:
        """What each id stands for, white space written as SPACE; control ids for nothing."""
        out = [p.encode() if k in (1, 4, 5) else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]
        out[self.unknown] = " ⁇ ".encode()
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        return out


def escaped(text: str, vocabulary: Vocabulary) -> str:
    return (SPACE if vocabulary.dummy_prefix and text else "") + text.replace(" ", SPACE)


class Cutter:
    """Cuts texts into chunks and gives each a 64-bit hash (multilinear, with fixed random coefficients)."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        pairs = {(a, b) for p, _, _ in vocabulary.usable() for a, b in zip(p, p[1:], strict=False)}
        kinds = {c: i for i, c in enumerate(sorted({c for pair in pairs for c in pair}), 1)}
        self.kind, self.n = np.zeros(0x110000, np.int32), len(kinds) + 1
        for c, i in kinds.items():
            self.kind[ord(c)] = i
        joined = np.zeros((self.n, self.n), bool)
        for a, b in pairs:
            joined[kinds[a], kinds[b]] = True
        self.joined = joined.ravel()
        self.value, self.odd = mix(np.arange(0x110000, dtype=np.uint64), 21), np.zeros(0, np.uint64)

    def blocks(self, texts: list[str | None]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """The escaped texts in blocks of about SLICE characters: the block, where its chunks start, their hashes, and the number of each chunk's text."""
        waiting: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            rest = escaped(text, self.vocabulary) if text else ""
            while rest:
                end = self._safe(rest) if len(rest) > SLICE else len(rest)
                waiting.append((i, rest[:end]))
                size += end
                rest = rest[end:]
                if size >= SLICE:
                    yield self._cut(waiting)
                    waiting, size = [], 0
        if waiting:
            yield self._cut(waiting)

    def _safe(self, text: str) -> int:
        """A place after SLICE where a chunk ends; the end if there is none."""
        for start in range(SLICE, len(text), SLICE):
            k = self.kind[np.frombuffer(text[start - 1 : start + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)]
            ends = np.flatnonzero(~self.joined[k[:-1] * self.n + k[1:]])
            if len(ends):
                return start + int(ends[0])
        return len(text)

    def _cut(self, parts: list[tuple[int, str]]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        block = "".join(t for _, t in parts)
        codes = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[codes]
        begins = np.ones(len(codes), bool)
        begins[1:] = ~self.joined[kind[:-1] * self.n + kind[1:]]
        first = np.concatenate([[0], np.cumsum([len(t) for _, t in parts])]).astype(np.int64)
        begins[first[:-1]] = True
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, len(codes)))
        at = np.arange(len(codes)) - np.repeat(starts, sizes)
        if (most := int(sizes.max())) > len(self.odd):
            self.odd = mix(np.arange(2 * most, dtype=np.uint64), 22) | np.uint64(1)
        with np.errstate(over="ignore"):
            hashes = mix(np.add.reduceat(self.value[codes] * self.odd[at], starts) + sizes.astype(np.uint64), 23)
        owner = np.repeat(np.array([i for i, _ in parts], np.int32), np.diff(np.searchsorted(starts, first)))
        return block, starts.astype(np.int32), hashes, owner


def _left(x: Column, by: Column | int) -> Column:
    return F.call_function("shiftleft", x, by if isinstance(by, Column) else F.lit(by))


def _right(x: Column, by: Column | int) -> Column:
    return F.call_function("shiftright", x, by if isinstance(by, Column) else F.lit(by))


# An edge of a BPE lattice is one long: rank, start, size and id, so that the least one merges first.
_ID, _SIZE, _START = 20, 26, 32
#: What the folds give for a character that no edge covers: this plus its code point.
CHAR = 1 << 21


def _pack() -> Column:
    return _left(F.col("rank"), _START) + _left(F.col("start").cast("long"), _SIZE) + _left(F.col("size").cast("long"), _ID) + F.col("id")


def _start(z: Column) -> Column:
    return _right(z, _SIZE).bitwiseAND(63).cast("int")


def _size(z: Column) -> Column:
    return _right(z, _ID).bitwiseAND(63).cast("int")


def _bit(at: Column) -> Column:
    return _left(F.lit(1).cast("long"), at)


def _char(word: Column, start: Column) -> Column:
    return F.ascii(F.substring(word, start + 1, F.lit(1))) + CHAR


def _bpe_fold(word: Column, edges: Column, vocabulary: Vocabulary) -> Column:
    """Merges the adjacent symbols whose union has the best score, the leftmost first, until no union is a piece.

    The places where symbols start, and the end of the last, are the bits of a long; edges (of two characters at
    least) come best first. Open is an edge while its ends are cuts and there are cuts inside.
    """
    n = F.length(word)
    edge_type = "struct<ends:bigint,inside:bigint>"
    state_type = f"struct<cuts:bigint,open:array<{edge_type}>>"

    def mask(z: Column) -> Column:
        ends = _bit(_start(z)) + _bit(_start(z) + _size(z))
        return F.struct(ends.alias("ends"), _left(_bit(_size(z) - 1) - 1, _start(z) + 1).alias("inside")).cast(edge_type)

    def merge(state: Column, _: Column) -> Column:
        cuts, open_ = state["cuts"], state["open"]
        best = F.get(F.filter(open_, lambda z: F.bit_count(cuts.bitwiseAND(z["inside"])) == 1), F.lit(0))

        def merged(cuts: Column) -> Column:
            still = F.filter(open_, lambda z: (cuts.bitwiseAND(z["inside"]) != 0) & (cuts.bitwiseAND(z["ends"]) == z["ends"]))
            return F.struct(cuts.alias("cuts"), still.alias("open")).cast(state_type)

        done = F.struct(cuts.alias("cuts"), F.array().cast(f"array<{edge_type}>").alias("open")).cast(state_type)
        next_ = let(best, lambda z: F.when(z.isNull(), done).otherwise(let(cuts - cuts.bitwiseAND(z["inside"]), merged)))
        return F.when(F.size(open_) == 0, state).otherwise(next_)

    start = F.struct((_bit(n + 1) - 1).alias("cuts"), F.transform(edges, mask).alias("open")).cast(state_type)
    cuts = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, merge)["cuts"]

    def spelled(cuts: Column) -> Column:
        # Symbols: edges with cuts at their ends only, and characters with a cut on either side.
        whole = lambda z: _right(cuts, _start(z)).bitwiseAND(_bit(_size(z) + 1) - 1) == _bit(_size(z)) + 1
        alone = F.filter(F.sequence(F.lit(0), n - 1), lambda s: _right(cuts, s).bitwiseAND(3) == 3)
        pieces = F.transform(F.filter(edges, whole), lambda z: _left(_start(z).cast("long"), 24) + z.bitwiseAND((1 << _ID) - 1))
        chars = F.transform(alone, lambda s: _left(s.cast("long"), 24) + _char(word, s))
        return F.transform(F.sort_array(F.concat(pieces, chars)), lambda x: x.bitwiseAND((1 << 24) - 1).cast("int"))

    return let(cuts, spelled)


#: Key of an edge of a unigram lattice: its start (from 0) times this, plus its length.
_WIDE = 256


def _key(start: Column, length: Column) -> Column:
    return start * _WIDE + length


def _viterbi_fold(word: Column, edges: Column, vocabulary: Vocabulary) -> Column:
    """The path of greatest summed score; a character that is no piece costs the least score less 10. Ties go to the longer last piece."""
    n = F.length(word)
    lost = min((s for _, _, s in vocabulary.usable()), default=0.0) - 10
    cell = "struct<score:double,start:int>"
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start")).cast(cell))

    def step(cells: Column, j: Column) -> Column:
        def path(length: Column) -> Column:
            own = F.try_element_at(edges, _key(j - length, length))["score"]
            score = F.get(cells, j - length)["score"] + F.coalesce(own, F.when(length == 1, F.lit(float(lost))))
            return F.struct(score.alias("score"), (-(j - length)).alias("back"))

        paths = F.filter(F.transform(F.sequence(F.lit(1), F.least(j, F.lit(vocabulary.longest))), path), lambda p: p["score"].isNotNull())
        return F.concat(cells, F.array(let(F.array_max(paths), lambda best: F.struct(best["score"].alias("score"), (-best["back"]).alias("start")).cast(cell))))

    cells = F.aggregate(F.sequence(F.lit(1), n), first, step)

    def back(c: Column) -> Column:
        def walk(acc: Column, _: Column) -> Column:
            return F.when(acc[0] == 0, acc).otherwise(F.concat(F.array(F.get(c, acc[0])["start"]), acc))

        return F.aggregate(F.sequence(F.lit(1), n), F.array(n), walk)

    def ids(start: Column, end: Column) -> Column:
        return let(F.try_element_at(edges, _key(start, end - start))["id"], lambda i: F.when(i.isNotNull(), F.array(i)).otherwise(F.array(_char(word, start))))

    def spelled(starts: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts) - 2), lambda k: ids(F.get(starts, k), F.get(starts, k + 1))))

    return let(let(cells, back), spelled)


def merge_long(word: str, ranks: dict[str, tuple[int, float]], vocabulary: Vocabulary) -> list[int]:
    """The BPE rule for one long chunk, with a heap."""
    left, right, text = list(range(-1, len(word) - 1)), [*range(1, len(word)), -1], list(word)
    heap: list[tuple[float, int, int, int]] = []

    def push(i: int) -> None:
        j = right[i] if i >= 0 else -1
        if i >= 0 and j >= 0 and (found := ranks.get(text[i] + text[j])):
            heapq.heappush(heap, (-found[1], i, len(text[i]), len(text[j])))

    for i in range(len(word) - 1):
        push(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if j < 0 or len(text[i]) != a or len(text[j]) != b:
            continue
        text[i] += text[j]
        text[j] = ""
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        right[j] = -1
        push(left[i])
        push(i)
    return [x for t in text if t for x in _plain_ids(t, ranks, vocabulary)]


def viterbi_long(word: str, ranks: dict[str, tuple[int, float]], vocabulary: Vocabulary) -> list[int]:
    lost = min((s for _, s in ranks.values()), default=0.0) - 10
    best: list[tuple[float, int]] = [(0.0, 0)]
    for j in range(1, len(word) + 1):
        paths = [(best[i][0] + (ranks[word[i:j]][1] if word[i:j] in ranks else lost), -i) for i in range(max(0, j - vocabulary.longest), j) if word[i:j] in ranks or i == j - 1]
        score, i = max(paths)
        best.append((score, -i))
    out, j = [], len(word)
    while j:
        out.append(word[best[j][1] : j])
        j = best[j][1]
    return [x for t in reversed(out) for x in _plain_ids(t, ranks, vocabulary)]


def _plain_ids(piece: str, ranks: dict[str, tuple[int, float]], vocabulary: Vocabulary) -> list[int]:
    if found := ranks.get(piece):
        return [found[0]]
    return [vocabulary.byte_ids[b] for b in piece.encode()] if vocabulary.byte_ids else [vocabulary.unknown]


def _unpacked(docs: pa.Table) -> list[str | None]:
    return [None if t is None else t.decode() for t in uncompressed(docs.column("text"))]


def _sealed(*columns: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(1).compress(b"".join(c if isinstance(c, bytes) else c.astype("<u4").tobytes() for c in columns))


def _opened(blob: bytes) -> tuple[int, np.ndarray, np.ndarray, bytes]:
    """What _sealed packed: a bucket, numbers (as steps), sizes, and the bytes or integers that these measure."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    bucket, n = np.frombuffer(raw, "<u4", 2).tolist()
    return bucket, np.frombuffer(raw, "<u4", n, 8).cumsum(dtype=np.int64), np.frombuffer(raw, "<u4", n, 8 + 4 * n).astype(np.int64), raw[8 + 8 * n :]


def _steps(sorted_numbers: np.ndarray) -> np.ndarray:
    return np.diff(sorted_numbers, prepend=0)


_SENT = pa.schema([("group", pa.int32()), ("part", pa.int32()), ("chunks", pa.binary())])


def _chunks(vocabulary, parts: int):
    def run(bucket: pa.Table) -> pa.Table:
        """The distinct chunks of a bucket with their numbers, for each part of its group."""
        tidy()
        cutter, known, words = vocabulary.value.cutter, np.zeros(0, np.uint64), []
        for block, starts, hashes, _ in cutter.blocks(_unpacked(bucket)):
            own, first = np.unique(hashes, return_index=True)
            new = ~np.isin(own, known, assume_unique=True)
            ends = np.append(starts, len(block))[first[new] + 1]
            words.append((own[new], [block[i:j].encode() for i, j in zip(starts[first[new]].tolist(), ends.tolist(), strict=True)]))
            known = np.union1d(known, own)
        number = bucket.column("bucket")[0].as_py()
        order = np.argsort(np.concatenate([h for h, _ in words])) if words else np.zeros(0, np.int64)
        texts = [w for _, ws in words for w in ws]
        part = (known >> np.uint64(32)).astype(np.int64) % parts
        rows: list[list] = [[], [], []]
        for p in np.unique(part).tolist():
            at = np.flatnonzero(part == p)
            own = [texts[i] for i in order[at].tolist()]
            rows[1].append(p)
            rows[2].append(_sealed(np.array([number, len(at)]), _steps(at), np.fromiter(map(len, own), np.int64, len(own)), b"".join(own)))
        rows[0] = [number // TOGETHER] * len(rows[1])
        return pa.table([pa.array(c, f.type) for c, f in zip(rows, _SENT, strict=True)], schema=_SENT)

    return run


_DISTINCT = pa.schema([("chunk", pa.string()), ("group", pa.int32()), ("places", pa.list_(pa.int64()))])


def _distinct(sent: pa.Table) -> pa.Table:
    """The distinct chunks of one part of a group; places are the buckets and the numbers there."""
    places, sizes, letters = [], [], []
    for blob in sent.column("chunks").to_pylist():
        bucket, numbers, lengths, raw = _opened(blob)
        places.append((bucket << 32) + numbers)
        sizes.append(lengths)
        letters.append(raw)
    ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(b"".join(letters))])
    coded = chunks.dictionary_encode()
    which = coded.indices.to_numpy()
    order = np.argsort(which, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(coded.dictionary)))])
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(places)[order], pa.int64()))
    group = np.full(len(lists), sent.column("group")[0].as_py(), np.int32)
    return pa.table([coded.dictionary.cast(pa.large_string()).cast(pa.string()), pa.array(group), lists], schema=_DISTINCT)


def lattice_ids(chunks: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """chunks (chunk: string, not empty; group: int; places; one row for each chunk and group) with a column ids.

    A character that no edge covers stands as CHAR plus its code point. Nothing is shuffled if chunks is dealt by chunk
    and group. ids is null for chunks of more than LONG characters.
    """
    spark = chunks.sparkSession
    n, short = F.length("chunk"), F.length("chunk") <= LONG
    # Characters are symbols without an edge in BPE, so their edges are of two characters or more; the row of the first character keeps every chunk.
    least = F.when((F.col("start") == 0) | ~F.lit(vocabulary.bpe), 1).otherwise(2)
    starts = chunks.select("*", F.explode(F.sequence(F.lit(0), F.when(short, F.greatest(n - (2 if vocabulary.bpe else 1), F.lit(0))).otherwise(0))).alias("start"))
    most = F.when(short, F.least(n - F.col("start"), F.lit(vocabulary.longest))).otherwise(1)
    spans = starts.select("*", F.explode(F.sequence(least, most)).alias("size"))
    edges = spans.withColumn("piece", F.substring("chunk", F.col("start") + 1, F.col("size")))
    # The piece table is bounded by the vocabulary file.
    matched = edges.join(F.broadcast(vocabulary.table(spark)), "piece", "left").where("id is not null or (start = 0 and size = 1)")
    edge = _pack() if vocabulary.bpe else F.struct(_key(F.col("start"), F.col("size")), F.struct("id", "score"))
    wanted = F.col("id").isNotNull() & (F.col("size") >= (2 if vocabulary.bpe else 1))
    grouped = matched.groupBy("chunk", "group").agg(F.first("places").alias("places"), F.collect_list(F.when(wanted, edge)).alias("e"))
    in_order, fold = (F.sort_array("e"), _bpe_fold) if vocabulary.bpe else (F.map_from_entries("e"), _viterbi_fold)
    return grouped.withColumn("edges", in_order).select("chunk", "group", "places", F.when(short, let(F.col("edges"), lambda e: fold(F.col("chunk"), e, vocabulary))).alias("ids"))


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at starts, one after the other."""
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The elements of lists, one after the other, and the sizes; nulls have none."""
    return lists.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


_TOLD = pa.schema([("bucket", pa.int32()), ("told", pa.binary())])
#: Ids of chunks that a task holds at a time before it sends them.
HELD = 1 << 21


def _tell(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each bucket the ids of its chunks, by number; long chunks are folded here."""
        tidy()
        v = vocabulary.value
        ranks, fold = {p: (i, s) for p, i, s in v.usable()}, merge_long if v.bpe else viterbi_long
        chars = {ord(p): i for p, (i, _) in ranks.items() if len(p) == 1}
        char_ids = np.full(0x110000, -1, np.int32)
        char_ids[list(chars)] = list(chars.values())
        waiting, size = [], 0

        def resolved(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The ids with characters replaced by theirs, or by their bytes'."""
            at = np.flatnonzero(flat >= CHAR)
            ids = flat.astype(np.int32)
            ids[at] = char_ids[flat[at] - CHAR]
            lost = at[ids[at] < 0]
            if not len(lost):
                return ids, sizes
            spelled = [_plain_ids(chr(c), ranks, v) for c in (flat[lost] - CHAR).tolist()]
            times = np.ones(len(ids), np.int64)
            times[lost] = [len(x) for x in spelled]
            out = np.repeat(ids, times)
            out[np.repeat(ids < 0, times)] = [i for x in spelled for i in x]
            return out, np.bincount(np.repeat(np.arange(len(sizes)), sizes), times, minlength=len(sizes)).astype(np.int64)

        def send() -> Iterator[pa.RecordBatch]:
            places = np.concatenate([p for p, _, _ in waiting])
            flat, sizes = np.concatenate([f for _, f, _ in waiting]), np.concatenate([s for _, _, s in waiting])
            begins, order = np.cumsum(sizes) - sizes, np.argsort(places)
            buckets = places[order] >> 32
            edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(order)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                at = order[i:j]
                told = _sealed(np.array([buckets[i], len(at)]), _steps(places[at] & 0xFFFFFFFF), sizes[at], _gather(flat, begins[at], sizes[at]))
                yield pa.RecordBatch.from_arrays([pa.array([buckets[i]], pa.int32()), pa.array([told], pa.binary())], schema=_TOLD)

        for b in batches:
            ids = b.column("ids")
            if ids.null_count:
                ids = pa.array([fold(c, ranks, v) if x is None else x for c, x in zip(b.column("chunk").to_pylist(), ids.to_pylist(), strict=True)], ids.type)
            (flat, sizes), (places, times) = resolved(*_flat(ids)), _flat(b.column("places"))
            begins = np.cumsum(sizes) - sizes
            waiting.append((places, _gather(flat, np.repeat(begins, times), np.repeat(sizes, times)), np.repeat(sizes, times)))
            size += len(waiting[-1][1])
            if size >= HELD:
                yield from send()
                waiting, size = [], 0
        if waiting:
            yield from send()

    return run


def _by_number(told: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a bucket's chunks in the order of their numbers, one after the other, and how many each has."""
    if not told:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    _, numbers, sizes, raws = zip(*map(_opened, told), strict=True)
    flat, lengths, order = np.concatenate([np.frombuffer(r, "<u4") for r in raws]).astype(np.int32), np.concatenate(sizes), np.argsort(np.concatenate(numbers))
    return _gather(flat, (np.cumsum(lengths) - lengths)[order], lengths[order]), lengths[order]


def _assemble(vocabulary, keys: list[str], full: bool):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        tidy()
        v, texts = vocabulary.value, _unpacked(docs)
        n, same = len(texts), [t is not None for t in texts]
        flat, sizes = _by_number(told.column("told").to_pylist())
        begins = np.cumsum(sizes) - sizes
        spelled = v.as_bytes()
        letters, lengths = np.frombuffer(b"".join(spelled), np.uint8), np.array([len(x) for x in spelled], np.int64)
        offsets = np.cumsum(lengths) - lengths
        # A bucket's chunks are numbered in the order of their hashes.
        blocks = list(v.cutter.blocks(texts))
        del texts
        known = np.unique(np.concatenate([np.unique(h) for _, _, h, _ in blocks])) if blocks else np.zeros(0, np.uint64)
        if len(known) != len(sizes):
            raise RuntimeError(f"{len(known)} chunks in the texts, {len(sizes)} in the list")
        counts, parts = np.zeros(n, np.int64), []
        for block, starts, hashes, owner in blocks:
            at = np.searchsorted(known, hashes)
            ids = _gather(flat, begins[at], sizes[at])
            parts.append(ids)
            counts += np.bincount(owner, sizes[at], minlength=n).astype(np.int64)
            # The bytes that all ids stand for, one after the other, are the block's if every text in it decodes to itself.
            if _gather(letters, offsets[ids], lengths[ids]).tobytes() != block.encode():
                first, last = np.cumsum(sizes[at]) - sizes[at], np.cumsum(sizes[at])
                edges = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)]
                for i, j in zip(edges[:-1], edges[1:], strict=True):
                    text = block[starts[i] : starts[j] if j < len(starts) else None]
                    same[owner[i]] &= b"".join(spelled[x] for x in ids[first[i] : last[j - 1]].tolist()) == text.encode()
        all_ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        ends = np.concatenate([[0], np.cumsum(counts)])
        raw = memoryview(all_ids.astype("<i4").tobytes())
        digests = [hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(all_ids, pa.int32())) if full else pa.nulls(n, pa.list_(pa.int32()))
        return pa.table([*(docs.column(k) for k in keys), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_()), lists], names=[*keys, "n_tokens", "ids_sha256", "round_trip", "ids"])

    return run


def encode(docs: DataFrame, model_file: str, keys: tuple[str, ...] = ("doc_id",), full: bool = True, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The ids of every row of docs (keys and text; other columns are ignored), and whether they decode to the text.

    Returns the keys, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), round_trip
    and, if full, ids (else null). A null text has no ids and no round trip (false), an empty one no ids. Text is
    taken as it is, white space of every kind included; U+2581 in a text decodes to a space, as the
    encoding defines. Rows are encoded one by one, so repeated rows give repeated rows, and no rows
    none. Of two unions with the same score the leftmost merges first; of two paths with the same sum the one with the
    longer last piece is taken. A text of any length is cut and hashed in slices, but held whole by one task.
    Extra columns may have any names: only keys and text are read. Measures the input's size at once, to choose the
    number of buckets.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    vocabulary = Vocabulary.load(model_file)
    shared = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select(*keys, F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    rows = rows.select(*keys, F.pmod(F.xxhash64(*keys, "text"), F.lit(buckets)).cast("int").alias("bucket"), F.col("text").cast("binary").alias("text"))
    key_types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keys).schema)
    dealt = rows.mapInArrow(compressed, f"{key_types}bucket int, text binary").repartition(buckets, "bucket")
    parts = 2 * min(buckets, TOGETHER)
    sent = dealt.groupBy("bucket").applyInArrow(_chunks(shared, parts), "group int, part int, chunks binary")
    by_chunk = sent.groupBy("group", "part").applyInArrow(_distinct, "chunk string, group int, places array<bigint>")
    # Each row stands for a lattice, so there are as many partitions as the buckets are worth.
    ids = lattice_ids(by_chunk.repartition(max(2 * buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), "chunk", "group"), vocabulary)
    told = ids.select("chunk", "places", "ids").mapInArrow(_tell(shared), "bucket int, told binary")
    out = f"{key_types}n_tokens long, ids_sha256 string, round_trip boolean, ids array<int>"
    return dealt.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(_assemble(shared, list(keys), full), out)


def decode(rows: DataFrame, model_file: str) -> DataFrame:
    """rows with a column text made from their ids (array<int>); null ids give a null text, ids out of range nothing."""
    v = Vocabulary.load(model_file)
    pieces = rows.sparkSession.sparkContext.broadcast(v.as_bytes())
    prefix = SPACE.encode() if v.dummy_prefix else b""

    @F.pandas_udf("string")
    def of(ids):
        known = pieces.value
        join = lambda x: b"".join(known[i] for i in x if 0 <= i < len(known)).removeprefix(prefix).replace(SPACE.encode(), b" ").decode("utf-8", "replace")
        return ids.map(lambda x: None if x is None else join(x))

    return rows.withColumn("text", of("ids"))
