"""Which hashes occur more than once, over all buckets of a table.

A bucket sorts its distinct hashes, which are then ranges of parts; each part hears of every hash once from each bucket that has
it, so a hash in a third of all rows costs a row for each bucket. A part answers each bucket with bits in the same
order, which the bucket matches with its own sorted hashes. Hashes travel as arrays, one for each bucket and part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard


class Distinct:
    """The distinct hashes of a bucket, in their order, with the least and greatest owner of each; owners must not fall."""

    def __init__(self, hashes: np.ndarray, owners: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        h = hashes[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        first = np.flatnonzero(new)
        self.hashes = h[first]
        self.least = owners[order[first]]
        self.greatest = owners[order[np.append(first[1:], len(h)) - 1]] if len(h) else self.least

    def parts(self, parts: int) -> list[tuple[int, int, int]]:
        """(part, from, to): ranges of the hashes, by part."""
        part = (self.hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        edges = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        return [(p, i, j) for p, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if i < j]


SENT = pa.schema([("part", pa.int32()), ("bucket", pa.int64()), ("n", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary())])
SENT_TYPES = "part int, bucket long, n int, hashes binary, docs binary"
ANSWER_TYPES = "bucket long, part int, n int, bits binary"


def sent(distinct: Distinct, bucket: int, parts: int, exact: bool) -> pa.Table:
    """The hashes for each part: whole with their owners, or 40 bits with a bit for those that two owners in the bucket hold."""
    z, rows = zstandard.ZstdCompressor(1), []
    for p, i, j in distinct.parts(parts):
        h, least, greatest = distinct.hashes[i:j], distinct.least[i:j], distinct.greatest[i:j]
        if exact:
            rows.append((p, bucket, j - i, h.tobytes(), z.compress(least.tobytes() + (greatest - least).tobytes())))
        else:
            rows.append((p, bucket, j - i, h.view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), np.packbits(least != greatest).tobytes()))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, SENT, strict=True)], schema=SENT)


def _answers(asked: pa.Table, found: list[np.ndarray], ends: np.ndarray) -> pa.Table:
    """For each row of asked the bits of its hashes, one array of bits after the other."""
    packed = [b"".join(np.packbits(f[i:j]).tobytes() for f in found) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return pa.table([asked.column("bucket"), asked.column("part"), asked.column("n"), pa.array(packed, pa.binary())], names=["bucket", "part", "n", "bits"])


def _ends(asked: pa.Table) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(asked.column("n").to_numpy())])


def seen_twice(asked: pa.Table) -> pa.Table:
    """A filter: whether a hash occurs in two buckets, or with two owners in one."""
    ends = _ends(asked)
    raw = np.frombuffer(b"".join(asked.column("hashes").to_pylist()), np.uint8).reshape(-1, 5)
    h = np.zeros((len(raw), 8), np.uint8)
    h[:, :5] = raw
    _, which, times = np.unique(h.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
    own = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(asked.column("docs").to_pylist(), asked.column("n").to_pylist(), strict=True)]
    return _answers(asked, [(times[which] > 1) | np.concatenate(own).astype(bool)], ends)


def compared(asked: pa.Table) -> pa.Table:
    """Whether an owner outside the bucket that is smaller than any inside holds the hash, and whether two owners hold it at all."""
    ends, z = _ends(asked), zstandard.ZstdDecompressor()
    h = np.frombuffer(b"".join(asked.column("hashes").to_pylist()), np.uint64)
    docs = [np.frombuffer(z.decompress(b), np.int64) for b in asked.column("docs").to_pylist()]
    least = np.concatenate([d[: len(d) // 2] for d in docs])
    greatest = least + np.concatenate([d[len(d) // 2 :] for d in docs])
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    low, high = np.minimum.reduceat(least[order], first), np.maximum.reduceat(greatest[order], first)
    return _answers(asked, [low[which] < least, (low < high)[which]], ends)


def bits(answers: pa.Table, kinds: int) -> list[np.ndarray]:
    """The answers to all hashes of a bucket, in order, for each kind."""
    answers = answers.sort_by("part")
    out: list[list[np.ndarray]] = [[] for _ in range(kinds)]
    for n, raw in zip(answers.column("n").to_pylist(), answers.column("bits").to_pylist(), strict=True):
        size = len(raw) // kinds
        for k in range(kinds):
            out[k].append(np.unpackbits(np.frombuffer(raw, np.uint8, size, k * size), count=n).astype(bool))
    return [np.concatenate(x) if x else np.zeros(0, bool) for x in out]
