"""SimHash near-duplicates with pigeonring candidate filtering.

Fingerprints: words are runs of bytes other than ASCII white space, A-Z lower-cased; every 4-word shingle (repeats
count; a shorter text is one shingle) is hashed with XXH64, seed 42; a bit is set if over half of the hashes have it.

Candidates, for a distance of t bits: the 64 bits form a ring of t + 1 segments. If two fingerprints differ in at most
t bits, some segment starts a chain in which the first segment has no difference, the first two have at most 1, the
first three at most 2, and so on (the share t / (t + 1) a segment, rounded down). So a fingerprint is filed under every
chain of the fewest segments with ``KEY_BITS`` bits, and under what it becomes when 0 bits of the chain within these
budgets turn to 1: the two of a pair meet where both have what either has, however they are dealt. The longer chains
and the full distance are checked where they meet.

Keys meet in sorted partitions, read as a stream. A large group is walked breadth first and gives the edges of a
spanning forest, never its pairs. Groups that could pass ``GROUP`` members are split into blocks, every two of which
meet, so no task holds an unbounded group and no link is lost.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; a null doc_id gets a
fingerprint and the least non-null doc_id of its component.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import durable, table
from tideline.llm.graph import components

SHINGLE = 4
DISTANCE = 4
KEY_BITS = 24
GROUP = 50_000
#: Runs up to this long are compared pair by pair in numpy, longer ones are walked.
SHORT = 12
_KEY = 60  # bits of a key; its upper 5 are the chain's start


class Ring:
    """Segments of 64 bits for one distance."""

    def __init__(self, distance: int) -> None:
        self.distance, m = distance, distance + 1
        self.widths = [64 // m + (i < 64 % m) for i in range(m)]
        self.lows = [sum(self.widths[:i]) for i in range(m)]
        self.long = next(n for n in range(1, m + 1) if n * (64 // m) >= min(KEY_BITS, m * (64 // m)))
        #: bits of the first n segments from each start
        self.spans = np.array([[sum(self.widths[(i + k) % m] for k in range(n)) for n in range(1, m + 1)] for i in range(m)], np.uint64)
        self.masks = [self._masks(i) for i in range(m)]

    def _masks(self, start: int) -> list[int]:
        """Sets of bits of the chain's later segments that keep the budgets, as masks of a key."""
        out = [((), 0)]
        low = sum(self.widths[(start + k) % len(self.widths)] for k in range(self.long))
        for n in range(1, self.long):
            w = self.widths[(start + n - 1) % len(self.widths)]
            low -= w
            w = self.widths[(start + n) % len(self.widths)]
            bits = [low - w + j for j in range(w)]
            out = [(f, sum(1 << b for b in f)) for held, _ in out for k in range(n - len(held) + 1) for f in (held + c for c in combinations(bits, k))]
        return [m for _, m in out]


def shingle_hashes(data: bytes, size: int = SHINGLE) -> list[int]:
    words = data.lower().split()
    if not words:
        return []
    text = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(text, 42)]
    return [digest(text[s : e - 1], 42) for s, e in zip([0, *ends], ends[size - 1 :])]  # noqa: B905


def fingerprints(texts: list[bytes | None], size: int = SHINGLE, batch: int = 1 << 16) -> np.ndarray:
    """Signed 64-bit fingerprints; a text of any length is summed up in pieces of ``batch`` hashes."""
    return of_hashes((np.array(shingle_hashes(t, size) if t else [], np.uint64) for t in texts), len(texts), batch)


def of_hashes(hashes: Iterable[np.ndarray], count: int, batch: int = 1 << 16) -> np.ndarray:
    """Signed 64-bit fingerprints of the shingle hashes of ``count`` texts, one array a text."""
    sums, n = np.zeros((count, 64), np.int64), np.zeros(count, np.int64)
    who: list[int] = []
    starts: list[int] = []
    parts: list[np.ndarray] = []
    held = 0

    def add() -> None:
        if parts:
            bits = np.unpackbits(np.concatenate(parts).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            np.add.at(sums, who, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
            who.clear(), starts.clear(), parts.clear()

    for k, got in enumerate(hashes):
        n[k] = len(got)
        for p in range(0, len(got), batch):
            who.append(k)
            starts.append(held)
            parts.append(got[p : p + batch])
            held += len(parts[-1])
            if held >= batch:
                add()
                held = 0
    add()
    set_ = (sums * 2 > n[:, None]).astype(np.uint8)
    return np.packbits(set_, axis=1, bitorder="little").view(np.int64).ravel()


def simhash(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1).to_pylist(), size))], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def chain(fp: np.ndarray, ring: Ring, start: int) -> np.ndarray:
    """The first segment of each fingerprint's chain from ``start`` in the upper bits, the last in the lower."""
    out = np.zeros(len(fp), np.uint64)
    for k in range(ring.long):
        i = (start + k) % len(ring.widths)
        out = (out << np.uint64(ring.widths[i])) | ((fp >> np.uint64(ring.lows[i])) & np.uint64((1 << ring.widths[i]) - 1))
    return out


def keys(fp: np.ndarray, ring: Ring, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The keys that fingerprints are filed under, and the fingerprint of each; exact: without turned bits."""
    fp = fp.view(np.uint64)
    ks, fs = [], []
    for i, masks in enumerate(ring.masks):
        base = chain(fp, ring, i)
        for m in masks[:1] if exact else masks:
            off = base & np.uint64(m) == 0
            ks.append(base[off] | np.uint64(m | i << _KEY - 5))
            fs.append(fp[off])
    return np.concatenate(ks).view(np.int64), np.concatenate(fs).view(np.int64)


def linked(x: np.ndarray, y: np.ndarray, ring: Ring, start: np.ndarray) -> np.ndarray:
    """Whether the chain from segment ``start`` stays within its budgets and the whole distance is within the ring's."""
    d = x.view(np.uint64) ^ y.view(np.uint64)
    low = np.asarray(ring.lows, np.uint64)[start]
    turned = np.where(low == 0, d, (d >> low) | (d << ((np.uint64(64) - low) & np.uint64(63))))
    ok = np.bitwise_count(d) <= ring.distance
    for n in range(ring.distance):
        ok &= np.bitwise_count(turned & ((np.uint64(1) << ring.spans[start, n]) - np.uint64(1))) <= n
    return ok


def forest(m: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links of a forest: they connect all that links of at most ``distance`` bits connect among ``m``, by a walk over unvisited members."""
    m = m.view(np.uint64)
    rest = np.ones(len(m), bool)
    left, right = [], []
    for start in range(len(m)):
        if not rest[start]:
            continue
        rest[start] = False
        queue = [start]
        open_ = np.flatnonzero(rest)
        while queue and len(open_):
            here = queue.pop()
            near = np.bitwise_count(m[open_] ^ m[here]) <= distance
            found = open_[near]
            if len(found):
                open_ = open_[~near]
                rest[found] = False
                queue.extend(found.tolist())
                left += [here] * len(found)
                right += found.tolist()
    return left, right


def _meet(batches: Iterator[pa.RecordBatch], ring: Ring) -> Iterator[pa.RecordBatch]:
    """Sorted (key, block, fp) rows in, edges (a, b) out; a run that goes on in the next batch is carried over."""
    held: list[np.ndarray] = []  # key, block and fingerprint of the run at the end of what was read

    def edges(k: np.ndarray, block: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero((k[1:] != k[:-1]) | (block[1:] != block[:-1])) + 1
        starts, sizes = np.concatenate(([0], cut)), np.diff(np.concatenate(([0], cut, [len(k)])))
        run = np.repeat(np.arange(len(sizes)), sizes)
        small = np.where(sizes <= SHORT, sizes, 0)[run]
        a, b = [], []
        for d in range(1, min(SHORT, int(sizes.max()))):
            i = np.flatnonzero((small[:-d] > d) & (run[:-d] == run[d:]))
            ok = linked(f[i], f[i + d], ring, (k[i] >> _KEY - 5) & 31)
            a.append(f[i[ok]])
            b.append(f[i[ok] + d])
        for s, n in zip(starts[sizes > SHORT], sizes[sizes > SHORT], strict=True):
            m = f[s : s + n]
            l, r = forest(m, ring.distance)
            a.append(m[l])
            b.append(m[r])
        x, y = np.concatenate(a or [f[:0]]), np.concatenate(b or [f[:0]])
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        got = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(got[0]):
            continue
        rows = [np.concatenate(x) for x in zip(held, got, strict=True)] if held else got
        change = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        last = int(change[-1]) + 1 if len(change) else 0
        if last:
            yield edges(*(x[:last] for x in rows))
        held = [x[last:] for x in rows]
    if held:
        yield edges(*held)


def _spread(filed: DataFrame, exact: DataFrame, ring: Ring, group: int) -> DataFrame:
    """``filed`` with the rows of keys that could pass ``group`` members dealt to pairs of blocks of that key."""
    widest = max(map(len, ring.masks))
    heavy = exact.groupBy("key").count().where(F.col("count") > group // widest)
    if heavy.isEmpty():
        return filed.withColumn("block", F.lit(0))

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = [k | m for m in ring.masks[k >> _KEY - 5 & 31] if not k & m]
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array([n] * len(got), pa.int64())], ["key", "count"])

    hot = heavy.mapInArrow(up, "key long, count long").groupBy("key").agg(F.max(F.ceil(F.col("count") * widest / group)).cast("int").alias("n"))
    mine = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.least(mine, j) * F.col("n") + F.greatest(mine, j))
    return filed.join(hot, "key", "left").select("key", "fp", F.explode(F.when(F.col("n") > 1, pair).otherwise(F.array(F.lit(0)))).alias("block"))


def links(fps: DataFrame, group: int = GROUP, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints (column fp) just as all pairs within ``distance`` bits do."""
    ring = Ring(distance)

    def file(exact: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                k, f = keys(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), ring, exact)
                for p in range(0, len(k), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(k[p : p + (1 << 17)]), pa.array(f[p : p + (1 << 17)])], ["key", "fp"])

        return run

    filed = fps.select("fp").mapInArrow(file(False), "key long, fp long")
    exact = fps.select("fp").mapInArrow(file(True), "key long, fp long")
    met = _spread(filed, exact, ring, group).select("key", "block", "fp")
    return met.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(lambda b: _meet(b, ring), "a long, b long").distinct()


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, group: int = GROUP, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of every document; component_id is the least doc_id that links reach."""
    marked = durable(simhash(docs, key, text, size), "simhash")
    fps = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = components(links(fps, group, distance))
    joined = roots.join(fps, roots["node"] == fps["fp"]).select("fp", "root", "least")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = durable(joined.select("fp", "root").join(least, "root").select("fp", "component_id"), "moved")
    of = fps.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return marked.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    hex_ = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return cluster(table(spark, sf_dir, "documents")).select("doc_id", hex_.alias("fingerprint"), "component_id")
