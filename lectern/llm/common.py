"""Helpers that the corpus operators share: words, hashes, tables in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

# Words are runs of anything but the six ASCII white-space characters; bytes.split() cuts at exactly those.
WORD = r"[^\x20\x09-\x0D]+"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word; the same on every executor."""
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finalizer of splitmix64: spreads 64-bit values; each seed gives another permutation."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
        x = (x ^ (x >> _S30)) * _M1
        x = (x ^ (x >> _S27)) * _M2
        return x ^ (x >> _S31)


def window_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each k consecutive values, made from two (perhaps overlapping) windows of half the length; empty if there are fewer."""
    if len(h) < k:
        return h[:0]
    out, size = mix(h, seed), 1
    while size < k:
        step = min(size, k - size)
        with np.errstate(over="ignore"):
            out = mix(out[:-step] * np.uint64(0x100000001B3) ^ out[step:], seed)
        size += step
    return out


#: Bytes that are hashed at once.
SLICE = 1 << 17
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_IS_GAP = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


class WordHashes:
    """64-bit hashes of the words of many texts at once (multilinear, with fixed random coefficients); the same on every executor."""

    def __init__(self, lower: bool = False):
        self.value = mix(np.arange(256, dtype=np.uint64), 31)
        if lower:
            self.value[ord("A") : ord("Z") + 1] = self.value[ord("a") : ord("z") + 1]
        self.value[_IS_GAP] = 0
        self.odd = np.zeros(0, np.uint64)

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the words of all texts, one after the other, and the number of words of each (null: none)."""
        counts, out, waiting, size = np.zeros(len(texts), np.int64), [], [], 0
        for i, t in enumerate(texts):
            at = 0
            while t and at < len(t):
                # Long texts are cut between words.
                gap = _GAP.search(t, at + SLICE) if at + SLICE < len(t) else None
                end = gap.start() if gap else len(t)
                waiting.append((i, t[at:end]))
                size += end - at + 1
                at = end
                if size >= SLICE:
                    out.append(self._block(waiting, counts))
                    waiting, size = [], 0
        if waiting:
            out.append(self._block(waiting, counts))
        return np.concatenate(out) if out else np.zeros(0, np.uint64), counts

    def _block(self, parts: list[tuple[int, bytes]], counts: np.ndarray) -> np.ndarray:
        codes = np.frombuffer(b" ".join(t for _, t in parts) + b" ", np.uint8)
        gap = _IS_GAP[codes]
        starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        if not gap[0]:
            starts = np.concatenate([[0], starts])
        if not len(starts):
            return np.zeros(0, np.uint64)
        # A word and the gap after it make a span; the gap's values are 0.
        spans = np.diff(np.append(starts, len(codes)))
        if (most := int(spans.max())) > len(self.odd):
            self.odd = mix(np.arange(2 * most, dtype=np.uint64), 32) | np.uint64(1)
        at = np.arange(starts[0], len(codes), dtype=np.int32) - np.repeat(starts.astype(np.int32), spans)
        offsets = np.cumsum([0, *(len(t) + 1 for _, t in parts)])
        np.add.at(counts, [i for i, _ in parts], np.diff(np.searchsorted(starts, offsets)))
        with np.errstate(over="ignore"):
            return mix(np.add.reduceat(self.value[codes[starts[0] :]] * self.odd[at], starts - starts[0]), 33)


def tidy() -> None:
    """Gives what earlier tasks of this worker have freed back to the system, which C libraries otherwise keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a worker holds few texts as Python objects at a time; it starts and ends tidy."""
    tidy()
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    tidy()


def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, their last column (text as bytes) compressed."""
    z = zstandard.ZstdCompressor(1)
    for b in small(batches):
        packed = pa.array([None if t is None else z.compress(t) for t in b.columns[-1].to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], packed], names=b.schema.names)


def uncompressed(packed: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    z = zstandard.ZstdDecompressor()
    return [None if t is None else z.decompress(t) for t in packed.to_pylist()]


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def text_bytes(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """The keys and the text as UTF-8 bytes, so that Python workers need not decode it."""
    return df.select(*keys, F.col(text).cast("binary").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only a local master, where there is one machine, gets a folder of its own if none is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Bytes of an Arrow batch between the JVM and a Python worker; the JVM holds about three of a task's batches, the worker one.
BATCH_BYTES = 2 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches to BATCH_BYTES, so that rows of long texts need no more memory than short ones.

    A lower bound of the session's own stays. Batches end at the first row beyond it: one text is never cut.
    """
    own = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_BYTES))
    if own <= 0 or own > BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, BATCH_BYTES)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished steps, which otherwise stay until the driver's memory runs low, and of the garbage of the driver's Python and JVM."""
    tidy()
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)


def trim_driver(spark: SparkSession) -> str | None:
    """Gives what the driver's JVM has freed outside its heap (its compilers' memory and the like) back to the system, as tidy() does for Python.

    The JVM's report; None if it has no such command (before 17.0.9, or not on Linux with glibc), and then nothing is done.
    """
    sc = spark.sparkContext
    java = sc._jvm.java.lang
    # Called by the interface's method: the server's own class is not open to reflection.
    kinds, args = sc._gateway.new_array(java.Class, 4), sc._gateway.new_array(java.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = java.Class.forName(name)
    args[0], args[1] = sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        return java.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(java.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        return None


def release_executors(spark: SparkSession) -> None:
    """Collects the executors' garbage, after which their heaps shrink; else a heap keeps the size that the busiest step so far gave it.

    One short task for each core, all of which idle executors begin at once.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc")).alias("gc")).write.format("noop").mode("overwrite").save()


#: Bytes of the driver's heap beyond which garbage is collected after a table; the heap then shrinks again, which it doesn't by itself.
HEAP = 500 << 20


class Tables:
    """Intermediate tables in the shared folder: they cut lineage and outlive lost executors.

    drop() deletes those that nothing lazy reads any more.
    """

    #: Those made so far and not yet dropped as a whole, for who runs several operators one after the other.
    made: list[Tables] = []

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        self.spark, self.top = spark, f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"
        self.made.append(self)

    def path(self, name: str) -> str:
        return f"{self.top}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        if self.spark.sparkContext._jvm.Runtime.getRuntime().totalMemory() > HEAP:
            release(self.spark)
        else:
            trim_driver(self.spark)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self) -> None:
        release(self.spark)

    def drop(self, names: Iterable[str]) -> None:
        for name in names:
            self._delete(self.path(name))

    def drop_all(self) -> None:
        self._delete(self.top)
        if self in self.made:
            self.made.remove(self)

    def _delete(self, path: str) -> None:
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)
