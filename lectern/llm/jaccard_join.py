"""Operator 3: exact Jaccard join over word shingles by multiple-global-order filtering.

If two sets have a Jaccard similarity of at least t, then under *any* total order of all shingles the
first ``n - ceil(t n) + 1`` shingles of the two (their prefixes) share one. Candidates must share a
prefix token under three different orders before two sets are compared:

1. least expected frequency first (the product of the frequencies of its words),
2. most unlisted words first, ties by one hash,
3. shingles found to be frequent last, all others by another hash.

The orders use two bounded lists, of frequent words (at most 1/``WORD_SHARE`` by the pigeonhole
principle) and of frequent shingles (``HEAVY`` at most). The lists steer cost alone: any order gives
the same result.

Equal sets are one class, found by a combining aggregate, so copies are never paired. Inside a
bucket (the classes with one prefix token of order 1) every class is first tried against the bucket's
least class only: the one it meets most often, then the others that are still apart, which is linear and joins most near copies.
While large buckets hold several components, each round draws another class of each for the rest to meet. Then only pairs that lie in *different*
components are still of interest; they are enumerated block by block inside tasks, pruned by size and
by parity sketches (their Hamming distance never exceeds the symmetric difference), and go
through the filters and the exact comparison. No link between different components is lost; links
inside a component change nothing.

Shingles are compared by 64-bit hashes; classes by a 64-bit hash of the whole set.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import Tables, WordHashes, batch, compressed, mix, signed, small, text_bytes, uncompressed, window_hashes
from .components import components

WORD_SHARE = 1e-5
HEAVY = 20_000
#: Classes of a bucket that one task compares with one another; larger buckets are dealt out in blocks of this size.
BLOCK = 1024


_WORDS = WordHashes(lower=True)


def words_of(texts: list[bytes | None]) -> list[np.ndarray]:
    """The hashes of the words of each text, A-Z in lower case."""
    h, counts = _WORDS.of(texts)
    return np.split(h, np.cumsum(counts)[:-1]) if texts else []


def shingles(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k-word shingles, sorted, and a place where each starts; fewer words than k make one shingle."""
    if not len(h):
        return h, np.zeros(0, np.int64)
    w = window_hashes(h, min(k, len(h)), k if len(h) >= k else len(h))
    # Equal shingles have equal words, so any of their starts does.
    at = np.argsort(w)
    w = w[at]
    new = np.ones(len(w), bool)
    np.not_equal(w[1:], w[:-1], out=new[1:])
    return w[new], at[new]


def class_keys(sums: list[int], sizes: list[int]) -> list[int]:
    """A hash of each set, from the sum of its elements' hashes (mix with seed 11) and its size; 0 for an empty one."""
    n = np.array(sizes, np.uint64)
    return np.where(n > 0, signed(mix(np.array(sums, np.uint64) ^ n, 12)), 0).tolist()


#: Bytes of texts whose words are hashed at once.
AT_ONCE = 1 << 20


@dataclass
class Sets:
    """The shingle sets of some texts: all windows of all texts, one after the other, and for each text its distinct ones."""

    words: np.ndarray
    #: The windows, and how many words each has (fewer than k only where it is a whole text).
    windows: np.ndarray
    sizes: np.ndarray
    #: The first word of each window.
    starts: np.ndarray
    #: For each text the places of its distinct windows, in order of their hashes.
    places: list[np.ndarray]

    def sets(self) -> Iterator[np.ndarray]:
        return (self.windows[at] for at in self.places)

    def class_keys(self) -> list[int]:
        m = mix(self.windows, 11)
        return class_keys([m[at].sum(dtype=np.uint64) for at in self.places], list(map(len, self.places)))


def sets_of(texts: list[bytes | None], k: int) -> Iterator[Sets]:
    """The shingle sets of the texts, so many at once as AT_ONCE holds, as shingles() has them."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= AT_ONCE or i == len(texts) - 1:
            yield _sets(texts[first : i + 1], k)
            first, size = i + 1, 0


def _sets(texts: list[bytes | None], k: int) -> Sets:
    h, counts = _WORDS.of(texts)
    ends = counts.cumsum()
    # Of all windows of k words those count that no text's end cuts, and one for each text that is shorter.
    own = np.maximum(counts - k + 1, 0)
    whole = np.ones(max(len(h) - k + 1, 0), bool)
    for d in range(1, k):
        cut = ends - d
        whole[cut[(cut >= 0) & (cut < len(whole))]] = False
    starts = np.flatnonzero(whole)
    windows, sizes = window_hashes(h, k, k)[starts], np.full(len(starts), k)
    if len(short := np.flatnonzero((counts > 0) & (counts < k))):
        at = np.searchsorted(starts, ends[short] - counts[short])
        windows = np.insert(windows, at, np.concatenate([window_hashes(h[ends[i] - counts[i] : ends[i]], int(counts[i]), int(counts[i])) for i in short]))
        sizes, starts = np.insert(sizes, at, counts[short]), np.insert(starts, at, ends[short] - counts[short])
        own[short] = 1
    places, end = [], 0
    for n in own.tolist():
        w = windows[end : end + n]
        # Equal shingles have equal words, so any of their places does.
        at = np.argsort(w)
        w = w[at]
        new = np.ones(n, bool)
        np.not_equal(w[1:], w[:-1], out=new[1:])
        places.append(at[new] + end)
        end += n
    return Sets(h, windows, sizes, starts, places)


class _Lookup:
    """Places of values in a sorted table of hashes; most are found by their first bits."""

    def __init__(self, table: np.ndarray, bits: int):
        self.table, self.shift = table, np.uint64(64 - bits)
        edges = np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.several = np.diff(edges, append=len(table)) > 1
        self.first = np.minimum(edges, max(len(table) - 1, 0))

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each x stands, and whether it does."""
        if not len(self.table):
            return np.zeros(len(x), np.int32), np.zeros(len(x), bool)
        slot = (x >> self.shift).astype(np.int32)
        at = self.first[slot]
        known = self.table[at] == x
        if len(rest := np.flatnonzero(~known & self.several[slot])):
            at[rest] = np.minimum(np.searchsorted(self.table, x[rest]), len(self.table) - 1)
            known[rest] = self.table[at[rest]] == x[rest]
        return at, known


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


class Orders:
    """The global orders; holds only the two bounded lists."""

    def __init__(self, k: int, words: np.ndarray, word_counts: np.ndarray, total: int, heavy: np.ndarray, heavy_counts: np.ndarray):
        i, j = np.argsort(words), np.argsort(heavy)
        self._lookups: tuple[_Lookup, _Lookup] | None = None
        self.k, self.words, self.heavy, self.heavy_counts = k, words[i], heavy[j], heavy_counts[j].astype(np.uint64)
        # Steps of an eighth of a factor of two below a frequency of 1.
        self.rare = np.round(-8 * np.log2(np.maximum(word_counts[i], 1) / max(total, 1))).astype(np.int64)
        self.unlisted = int(np.ceil(-8 * np.log2(WORD_SHARE))) + 8

    def lookups(self) -> tuple[_Lookup, _Lookup]:
        """Made by each worker, once."""
        if self._lookups is None:
            self._lookups = _Lookup(self.words, 20), _Lookup(self.heavy, 18)
        return self._lookups

    def keys(self, x: Sets, orders: tuple[int, ...]) -> list[np.ndarray]:
        """For each of the orders, an integer by which it sorts the windows."""
        words, heavies = self.lookups()
        at, known = words.find(x.words)
        rare = np.where(known, self.rare[at], self.unlisted) if len(self.rare) else np.full(len(x.words), self.unlisted)

        def summed(values: np.ndarray) -> np.ndarray:
            out = np.zeros(len(x.starts), np.int64)
            for i in range(self.k):
                # Only the shorter windows end before k words.
                out += values[np.minimum(x.starts + i, len(values) - 1)] * (x.sizes > i)
            return out

        last = np.zeros(len(x.windows), np.uint64)
        at, heavy = heavies.find(x.windows)
        last[heavy] = np.minimum(self.heavy_counts[at[heavy]], np.uint64(2**20 - 1)) << np.uint64(44)
        out = []
        for o in orders:
            key = last | mix(x.windows, 100 + o) >> np.uint64(32)
            if o == 1:
                key |= (4095 - np.minimum(summed(rare), 4095)).astype(np.uint64) << np.uint64(32)
            elif o == 2:
                key |= (15 - np.minimum(summed((~known).astype(np.int64)), 15)).astype(np.uint64) << np.uint64(32)
            out.append(key)
        return out

    def prefixes(self, x: Sets, percent: int, orders: tuple[int, ...]) -> list[list[np.ndarray]]:
        """For each of the orders, each text's prefix. Ties of the sort key are broken by the shingle's hash."""
        out = []
        for keys in self.keys(x, orders):
            out.append([])
            for at, s in zip(x.places, x.sets(), strict=True):
                p = prefix_size(len(s), percent)
                if p < len(s):
                    key = keys[at]
                    edge = np.partition(key, p - 1)[p - 1]
                    # s is sorted, so flatnonzero takes ties in order of the hash.
                    below = np.flatnonzero(key < edge)
                    s = s[np.concatenate([below, np.flatnonzero(key == edge)[: p - len(below)]])]
                out[-1].append(s)
        return out


def parities(x: Sets) -> list[bytes]:
    """For each text 1024 bits: for each, whether an odd number of elements falls on it."""
    bit = (mix(x.windows, 7) & np.uint64(1023)).astype(np.int64)
    return [np.packbits((np.bincount(bit[at], minlength=1024) & 1).astype(np.uint8)).tobytes() for at in x.places]


def sketches(x: Sets) -> list[np.ndarray]:
    """For each text parity bits as longs: 1024, or for larger sets about as many as elements, a power of two.

    The upper half of a sketch, folded onto the lower one by xor, gives the sketch of half the size.
    """
    hashes, out = mix(x.windows, 7).astype(np.int64), []
    for at in x.places:
        most = 1 << max(10, len(at).bit_length())
        out.append(np.packbits((np.bincount(hashes[at] & (most - 1), minlength=most) & 1).astype(np.uint8)).view(np.int64))
    return out


class _Counts:
    """Counts of 64-bit values over one task; keeps what has a good share, bounded by ``most``."""

    def __init__(self, least: int, most: int, step: int = 1 << 21):
        self.least, self.most, self.step = least, most, step
        self.waiting: list[np.ndarray] = []
        self.size, self.values, self.counts = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, x: np.ndarray) -> None:
        self.waiting.append(x)
        self.size += len(x)
        if self.size >= self.step:
            self.fold()

    def fold(self) -> None:
        if self.waiting:
            v, c = np.unique(np.concatenate(self.waiting), return_counts=True)
            good = c >= self.least
            self.values, inv = np.unique(np.concatenate([self.values, v[good]]), return_inverse=True)
            self.counts = np.bincount(inv, np.concatenate([self.counts, c[good]])).astype(np.int64)
            if len(self.values) > self.most:
                top = np.argsort(-self.counts, kind="stable")[: self.most]
                self.values, self.counts = self.values[top], self.counts[top]
        self.waiting, self.size = [], 0


_SCAN = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("row", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])


def _scan(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass over the text: kind 0 a document's class and set size, 1 a frequent shingle, 2 a frequent word, 3 the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle_counts, word_counts, total = _Counts(3, HEAVY // 4), _Counts(8, int(1 / WORD_SHARE)), 0
        for b in small(batches):
            keys, sizes = [], []
            for x in sets_of(b.column("text").to_pylist(), k):
                total += len(x.words)
                keys += x.class_keys()
                sizes += map(len, x.places)
                for s in x.sets():
                    shingle_counts.add(s)
                word_counts.add(x.words)
            yield batch(_SCAN, pa.array(np.zeros(len(keys), np.int8)), b.column("doc_id"), b.column("row"), keys, sizes)
        for kind, c in ((1, shingle_counts), (2, word_counts)):
            c.fold()
            none = pa.nulls(len(c.values), pa.int64())
            yield batch(_SCAN, pa.array(np.full(len(c.values), kind, np.int8)), none, none, signed(c.values), c.counts)
        yield batch(_SCAN, pa.array([3], pa.int8()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), [0], [total])

    return run


_TOKENS = pa.schema([("token", pa.int64()), ("key", pa.int64()), ("n", pa.int32())])
_CHUNKS = pa.schema([("chunk", pa.int64()), ("classes", pa.binary()), ("tokens", pa.binary())])
#: Prefix tokens that one row holds, about.
CHUNK = 1 << 20


def _tokens(orders, k: int, percent: int):
    """The prefixes of order 1, in chunks: classes (key, n, size of the prefix) and their tokens, sorted by key; a random number for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o, found, size = orders.value, [], 0

        def chunk() -> pa.RecordBatch:
            found.sort(key=lambda x: x[0])
            classes = np.array([(key, n, len(t)) for key, n, t in found], np.int64)
            return batch(_CHUNKS, [uuid.uuid4().int >> 65], [classes.tobytes()], [np.concatenate([t for _, _, t in found]).tobytes()])

        for b in small(batches):
            for x in sets_of(b.column("text").to_pylist(), k):
                (prefixes,) = o.prefixes(x, percent, (1,))
                for key, at, t in zip(x.class_keys(), x.places, prefixes, strict=True):
                    if len(t):
                        found.append((key, len(at), t))
                        size += len(t)
                        if size >= CHUNK:
                            yield chunk()
                            found, size = [], 0
        if found:
            yield chunk()

    return run


def _opened(classes: bytes, tokens: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The key and n of each token's class, and the tokens."""
    c, t = np.frombuffer(classes, np.int64).reshape(-1, 3), np.frombuffer(tokens, np.uint64)
    return np.repeat(c[:, 0], c[:, 2]), np.repeat(c[:, 1], c[:, 2]), t


def _asked(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, classes, tokens in zip(*(b.column(c).to_pylist() for c in ("chunk", "classes", "tokens")), strict=True):
                keys, _, t = _opened(classes, tokens)
                yield from repeats.sent(repeats.Distinct(t, keys), number, parts, False).to_batches()

    return run


def _shared(chunks: pa.Table, answers: pa.Table) -> pa.Table:
    """The tokens of a chunk that another chunk has as well, or another class of it."""
    if not chunks.num_rows:
        return _TOKENS.empty_table()
    keys, n, t = _opened(chunks.column("classes")[0].as_py(), chunks.column("tokens")[0].as_py())
    (again,) = repeats.bits(answers, 1)
    distinct = repeats.Distinct(t, keys).hashes
    stay = again[np.searchsorted(distinct, t)]
    return pa.table([pa.array(signed(t[stay])), pa.array(keys[stay]), pa.array(n[stay].astype(np.int32))], schema=_TOKENS)


_TEXTS = pa.schema([("key", pa.int64()), ("size", pa.int32()), ("bits", pa.binary()), ("sketch", pa.list_(pa.int64())), ("second", pa.list_(pa.int32())), ("third", pa.list_(pa.int32())), ("text", pa.binary())])


def _sketch(orders, k: int, percent: int):
    """For each class its size, its parity bits, its sketch, its prefixes under orders 2 and 3 (cut to 32 bits), and its text, compressed as it came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = orders.value
        for b in small(batches):
            sizes, bits, longs, second, third = [], [], [], [], []
            for x in sets_of(uncompressed(b.column("text")), k):
                sizes += map(len, x.places)
                bits += parities(x)
                longs += sketches(x)
                for out, prefixes in zip((second, third), o.prefixes(x, percent, (2, 3)), strict=True):
                    out += (signed(p).astype(np.int32) for p in prefixes)
            yield batch(_TEXTS, b.column("key"), sizes, bits, longs, second, third, b.column("text"))

    return run


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that are sorted by their group, in tables of whole groups, with the number of each row's group."""
    rest: pa.Table | None = None

    def numbered(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for c in names:
            x = t.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return new.cumsum()

    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        if t.num_rows:
            g = numbered(t)
            last = int(np.searchsorted(g, g[-1]))
            if last:
                yield t.slice(0, last), g[:last]
            rest = t.slice(last)
    if rest is not None and rest.num_rows:
        yield rest, numbered(rest)


#: Classes in more buckets than this do not list them; their pairs may come more than once, which changes nothing.
LISTED = 64
#: Groups up to this size are compared all at once, by shifts of the whole table.
SMALL = 24


def _cross(percent: int):
    """Candidate pairs of a bucket, or of two of its blocks, that lie in different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, g in _whole_groups(batches, ["token", "x", "y"]):
            key, n, comp, block, x, y, token = (t.column(c).to_numpy() for c in ("key", "n", "comp", "block", "x", "y", "token"))
            own: dict[int, frozenset] = {}
            n = n.astype(np.int64)
            bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(-1, 16)
            folded = np.bitwise_xor.reduce(bits.reshape(-1, 4, 4), axis=1)  # the same for 256 bits

            def least_shared(i: int, j: int) -> bool:
                """Whether this bucket is the first of those that both rows lie in; unknown counts as yes."""
                a, b = (own[k] if k in own else own.setdefault(k, frozenset(t.column("own")[k].as_py() or ())) for k in (i, j))
                return not a or not b or min(a & b) == token[i]

            def near(i: np.ndarray, j: np.ndarray, large: bool) -> Iterator[pa.RecordBatch]:
                # Of two blocks, only pairs across; of one, each pair once.
                ok = (comp[i] != comp[j]) & (key[i] != key[j]) & ((x[i] == y[i]) | (block[i] != block[j]))
                ok &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
                i, j = i[ok], j[ok]
                # With n1 + n2 = m, |A & B| >= t m / (1 + t), so the symmetric difference is m (1 - t) / (1 + t) at most.
                for sketch in (folded, bits):
                    far = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
                    ok = far * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
                    i, j = i[ok], j[ok]
                if large:
                    ok = np.fromiter(map(least_shared, i.tolist(), j.tolist()), bool, len(i))
                    i, j = i[ok], j[ok]
                if len(i):
                    yield batch(_PAIRS, np.minimum(key[i], key[j]), np.maximum(key[i], key[j]))

            sizes = np.bincount(g)
            small = sizes[g] <= SMALL
            rows = np.arange(len(g))
            for shift in range(1, min(SMALL, len(g))):
                i = rows[:-shift][(g[:-shift] == g[shift:]) & small[:-shift]]
                if not len(i):
                    break
                yield from near(i, i + shift, False)
            ends = sizes.cumsum()
            for k in np.flatnonzero(sizes > SMALL):
                group = rows[ends[k] - sizes[k] : ends[k]]
                for start in range(0, len(group), 256):
                    i, j = np.broadcast_arrays(group[start : start + 256, None], group[None, :])
                    later = i < j
                    yield from near(i[later], j[later], True)

    return run


def _verify(k: int, percent: int):
    """Of candidate pairs with their texts, those that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()
        z = zstandard.ZstdDecompressor()

        def of(key: int, text: bytes) -> np.ndarray:
            if key in known:
                known.move_to_end(key)
            else:
                known[key] = shingles(words_of([z.decompress(text)])[0], k)[0]
                if len(known) > 64:
                    known.popitem(last=False)
            return known[key]

        for b in small(batches):
            out = []
            for x, y, tx, ty in zip(*(b.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                s, r = of(x, tx), of(y, ty)
                both = len(np.intersect1d(s, r, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(r) - both):
                    out.append((x, y))
            if out:
                yield batch(_PAIRS, *map(list, zip(*out, strict=True)))

    return run


#: Rounds of anchors at most, and how many pairs for each row are left to enumeration.
ROUNDS, IN_PROPORTION = 32, 8
#: Buckets of more classes than this get rounds of anchors; enumerating the others is linear, with this factor.
LARGE = 128
#: Pairs at most whose classes are broadcast at once.
BROADCAST = 200_000
#: Pairs at most that meet their sketches at once.
SKETCHED = 500_000


def _named(buckets: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows of buckets with the component of their class."""
    return buckets.select("token", "key", "n").join(comp.toDF("key", "comp"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))


def _mixed(named: DataFrame) -> DataFrame:
    """The rows of buckets of more than LARGE classes that lie in two components at least."""
    tokens = named.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size"))
    return named.join(tokens.where((F.col("c0") != F.col("c1")) & (F.col("size") > LARGE)).select("token"), "token", "left_semi")


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text; other columns are ignored).

    A-Z are lower-cased, words are runs of other than ASCII white space. Two documents are linked if
    their shingle sets have a Jaccard similarity of at least percent / 100; component_id is the least
    doc_id that links reach. A null, empty or blank text has no shingles and is linked with nothing;
    equal texts are linked (their similarity is 1). Rows with a null doc_id are kept and linked like others,
    but are never a component_id unless no row with an id is linked with them (then null). Repeated rows give repeated
    rows; rows that share a doc_id but not the text are linked each by its own text. Ties are no matter: a pair at
    exactly percent / 100 is linked. A text of any length is hashed in slices, but held whole by one task. No rows
    give no rows. Runs jobs at once and keeps intermediate tables in spark.checkpoint.dir.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "jaccard")
    source = text_bytes(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row")), "doc_id", "row")
    scan = tables.keep(source.mapInArrow(_scan(k), "kind byte, doc_id long, row long, key long, n long"), "scan")
    classes = scan.where("kind = 0").select("doc_id", "row", "key", "n")

    # Both lists are bounded: at most 1 / WORD_SHARE words, HEAVY shingles.
    total = scan.where("kind = 3").agg(F.sum("n")).first()[0] or 0
    often = scan.where("kind > 0").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    words = often.where((F.col("kind") == 2) & (F.col("n") >= WORD_SHARE * total)).select("key", "n").orderBy(F.desc("n"), "key").limit(int(1 / WORD_SHARE)).toPandas()
    heavy = often.where("kind = 1").select("key", "n").orderBy(F.desc("n"), "key").limit(HEAVY).toPandas()
    orders = spark.sparkContext.broadcast(Orders(k, words["key"].to_numpy().astype(np.int64).view(np.uint64), words["n"].to_numpy(), total, heavy["key"].to_numpy().astype(np.int64).view(np.uint64), heavy["n"].to_numpy()))

    # A filter first: most tokens are of one class only, and go before they become rows.
    chunks = tables.keep(source.mapInArrow(_tokens(orders, k, percent), "chunk long, classes binary, tokens binary"), "chunks")
    parts = max(1, chunks.select("chunk").count())
    asked = chunks.mapInArrow(_asked(parts), repeats.SENT_TYPES).repartition(parts, "part").groupBy("part")
    answers = tables.keep(asked.applyInArrow(repeats.seen_twice, repeats.ANSWER_TYPES), "answers")
    tables.release()
    tokens = tables.keep(chunks.groupBy("chunk").cogroup(answers.groupBy("bucket")).applyInArrow(_shared, "token long, key long, n int"), "tokens")
    tables.drop(["chunks", "answers"])
    tables.release()
    # The buckets with two classes at least, and the least class of each; both aggregates combine before the shuffle.
    shared = tokens.groupBy("token").agg(F.min(F.struct("key", "n")).alias("m"), F.max("key").alias("last")).where("m.key <> last").select("token", F.col("m.key").alias("anchor"), F.col("m.n").alias("anchor_n"))
    buckets = tables.keep(tokens.join(shared, "token").distinct(), "buckets")
    del tokens, shared
    tables.release()

    # A class's text is that of one of its rows; rows of one id may be of different classes, so they are told apart by a hash of id and text.
    members = classes.join(buckets.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("row").alias("row"))
    packed = source.select("row", "text").mapInArrow(compressed, "row long, text binary")
    texts = packed.join(members, "row").dropDuplicates(["row"]).select("key", "text")
    texts = tables.keep(texts.mapInArrow(_sketch(orders, k, percent), "key long, size int, bits binary, sketch array<long>, second array<int>, third array<int>, text binary"), "texts")
    tables.release()

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = tables.keep(pairs.distinct(), f"{name}-pairs")
        # Sizes and sketches meet first, so many pairs at once: n1 + n2 = m, so the symmetric difference, which the sketches' distance never exceeds, is m (1 - t) / (1 + t) at most.
        bits = lambda x: texts.select(F.col("key").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"))
        # The longer sketch is folded to the size of the other.
        least = F.least(F.size("sketch_a"), F.size("sketch_b"))
        part = lambda c, i: F.slice(c, i * least + 1, least)
        xor = lambda c, d: F.zip_with(c, d, lambda x, y: x.bitwiseXOR(y))
        folded = lambda c: F.when(F.size(c) > least, F.aggregate(F.sequence(F.lit(1), F.try_divide(F.size(c), least).cast("int") - 1), part(c, F.lit(0)), lambda sum_, i: xor(sum_, part(c, i)))).otherwise(F.col(c))
        far = F.aggregate(F.zip_with(folded("sketch_a"), folded("sketch_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
        fits = f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)"
        turns = max(1, -(-pairs.count() // SKETCHED))
        for i in range(turns):
            some = pairs.where(F.pmod(F.xxhash64("b", "a"), F.lit(turns)) == i).join(bits("a"), "a").join(bits("b"), "b")
            # How sketches are folded is read only where the sizes fit.
            fit = F.when(F.expr(fits), far * (100 + percent) <= (F.col("size_a") + F.col("size_b")) * (100 - percent))
            some.where(fit).select("a", "b").write.mode("append" if i else "overwrite").parquet(tables.path(f"{name}-near"))
            del some
            tables.release()
        near = spark.read.schema("a long, b long").parquet(tables.path(f"{name}-near"))
        # Only the classes of the pairs travel: a bounded number of pairs at once picks them by a broadcast.
        turns = max(1, -(-near.count() // BROADCAST))
        for i in range(turns):
            some = near.where(F.pmod(F.xxhash64("a", "b"), F.lit(turns)) == i)
            own = texts.join(F.broadcast(some.select(F.explode(F.array("a", "b")).alias("key")).distinct()), "key", "left_semi")
            side = lambda x, own=own: own.select(F.col("key").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("second", "third", "text")))
            small = [side(x).drop(f"text_{x}") for x in "ab"]
            # The filters of the orders meet before any text is fetched.
            left = some.join(small[0], "a").join(small[1], "b").where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")).select("a", "b")
            whole = left.join(side("a").select("a", "text_a"), "a").join(side("b").select("b", "text_b"), "b")
            whole.mapInArrow(_verify(k, percent), "a long, b long").write.mode("append" if i else "overwrite").parquet(tables.path(name))
            del some, own, side, small, left, whole
            tables.release()
        tables.drop([f"{name}-pairs", f"{name}-near"])
        return spark.read.schema("a long, b long").parquet(tables.path(name))

    size = f"100 * least(n, anchor_n) >= {percent} * greatest(n, anchor_n)"
    tried = tables.keep(buckets.where(f"key <> anchor and {size}").groupBy("key", "anchor").agg(F.count("*").alias("shared")), "tried")
    # Each class first meets the one anchor with which it shares most buckets, which joins most near copies; then the others that are still in another component.
    best = tried.groupBy("key").agg(F.max_by("anchor", F.struct("shared", "anchor")).alias("anchor"))
    links = verified(best.select(F.col("key").alias("a"), F.col("anchor").alias("b")), "links-0").toDF("u", "v")
    comp = tables.keep(components(links, tables, "nearest"), "comp-0")
    apart = tried.join(comp.toDF("key", "c"), "key", "left").join(comp.toDF("anchor", "d"), "anchor", "left").where(F.coalesce("c", "key") != F.coalesce("d", "anchor"))
    links = links.unionByName(verified(apart.select(F.col("key").alias("a"), F.col("anchor").alias("b")), "links-1").toDF("u", "v"))
    comp = tables.keep(components(links, tables, "first"), "comp-1")
    tables.release()

    # Large buckets of several components: each round draws another anchor for each, until what is left to enumerate is in proportion to the rows.
    open_ = tables.keep(_mixed(_named(buckets, comp)), "open-0")
    idle, before = 0, 0
    for turn in range(ROUNDS):
        sizes = open_.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
        told = sizes.agg(F.sum("s").alias("rows"), F.sum((F.col("s") * F.col("s") - F.col("q")) / 2).alias("pairs")).first()
        # Rounds that leave nine tenths of the pairs do not help: what is left is not linked.
        idle, before = (idle + 1 if turn and told["pairs"] and told["pairs"] > 0.9 * before else 0), told["pairs"]
        if (told["pairs"] or 0) <= IN_PROPORTION * (told["rows"] or 0) or idle == 3:
            break
        drawn = open_.groupBy("token").agg(F.min_by(F.struct(F.col("key").alias("anchor"), F.col("n").alias("anchor_n"), F.col("comp").alias("anchor_comp")), F.xxhash64("key", F.lit(turn))).alias("d")).select("token", "d.*")
        met = open_.join(drawn, "token").where(f"comp <> anchor_comp and {size}").groupBy("key", "anchor").agg(F.count("*").alias("shared"))
        best = met.groupBy("key").agg(F.max_by("anchor", F.struct("shared", "anchor")).alias("anchor"))
        new = verified(best.select(F.col("key").alias("a"), F.col("anchor").alias("b")), f"links-r{turn}").toDF("u", "v")
        if new.isEmpty():
            continue
        links = links.unionByName(new)
        comp = tables.keep(components(links, tables, f"round-{turn}"), f"comp-r{turn}")
        open_ = tables.keep(_mixed(_named(open_.select("token", "key", "n"), comp)), f"open-{turn + 1}")
        tables.drop([f"open-{turn}"])
        tables.release()
    tables.drop(["tried"])
    tables.release()

    # What is left: buckets with two components at least, dealt out in blocks if they are large.
    named = tables.keep(_named(buckets, comp), "named")
    mixed = named.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size")).where("c0 <> c1").select("token", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), "size")
    rows = named.join(mixed, "token").join(texts.select("key", "bits"), "key")
    # Classes of large buckets know all their buckets, so that a pair comes from one of the large ones only.
    in_large = named.join(mixed.where(F.col("size") > SMALL).select("token"), "token", "left_semi").select("key").distinct()
    lists = named.join(in_large, "key", "left_semi").groupBy("key").agg(F.collect_list("token").alias("own")).where(F.size("own") <= LISTED)
    rows = rows.join(lists, "key", "left").withColumn("own", F.when(F.col("size") > SMALL, F.col("own")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("token", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "key", "n", "comp", "bits", "own")
    pairs = rows.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y").mapInArrow(_cross(percent), "a long, b long")
    pairs = tables.keep(pairs.distinct(), "pairs")
    del rows, lists, in_large, mixed, named
    tables.drop(["buckets", "named"])
    tables.release()
    second = verified(pairs, "links-2")
    tables.drop(["texts", "pairs"])
    comp = components(links.unionByName(second.toDF("u", "v")), tables, "all")

    # Each component's least document; classes outside any link are their own component.
    by_class = classes.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least")).join(comp.toDF("key", "comp"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    by_class = tables.keep(by_class, "classes")
    least = by_class.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = tables.keep(by_class.join(least, "comp").select("key", "component_id"), "ids")
    tables.release()
    out = classes.join(ids, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
