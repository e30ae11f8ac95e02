"""Groups of near-duplicates: documents joined by pairs whose exact five-word similarity is ``LEAST`` or more.

The similarity is the Jaccard index of the sets of ``SIZE``-word shingles (words and hashes as in ``simhash``; a shorter
text is one shingle). Texts of one set are one node, so copies cost nothing further.

Candidates come from SimHash (at most ``DISTANCE`` of 64 bits apart) and from minima of the set under ``BANDS`` times
``ROWS`` permutations: two nodes meet where all minima of a band agree. A pair of similarity s is met by no band with
probability (1 - s ** ROWS) ** BANDS: 3 in 100,000 at 0.8, less above.

A link holds only if the two texts, joined back, have the similarity. Buckets of up to ``SMALL`` nodes give all their
pairs; larger ones are walked breadth first over the texts themselves, which gives a forest of links that hold and
connects all that such links connect. Buckets of much text are split into blocks, every two of which meet.

Defined results: null, empty and blank texts are one node; a null doc_id ranks last in its group; columns other than
``doc_id`` and ``text`` are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import bounded, durable, frugal
from tideline.llm.graph import components
from tideline.llm.simhash import links, of_hashes, shingle_hashes

SIZE = 5
LEAST = 0.8
DISTANCE = 4
BANDS = 20
ROWS = 4
SMALL = 32
#: Characters and nodes of a block of a large bucket.
BLOCK_CHARS = 4 << 20
BLOCK_NODES = 1000

_random = np.random.default_rng(42)
_TURN = _random.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)
_TIMES = _random.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)


def bands(hashes: np.ndarray) -> list[int]:
    """A signed key for each band of the minima of a set of hashes; an empty set has none."""
    if not len(hashes):
        return []
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for p in range(0, len(h), 2048):
        np.minimum(least, ((h[p : p + 2048] ^ _TURN) * _TIMES).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(BANDS, ROWS))]


def near(x: frozenset[int] | set[int], y: frozenset[int] | set[int]) -> bool:
    """Whether two sets have a Jaccard index of ``LEAST`` or more; empty sets are the same."""
    if min(len(x), len(y)) < LEAST * max(len(x), len(y)):
        return False
    common = len(x & y)
    return common >= LEAST * (len(x) + len(y) - common)


def shingles(text: str | None) -> frozenset[int]:
    return frozenset(shingle_hashes((text or "").encode("utf-8", "surrogatepass"), SIZE))


def _mark(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp, node, keys) of each row; h is the XXH64 of the text, node that of its set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            nodes, keys = [], []

            def hashes(texts=texts, nodes=nodes, keys=keys) -> Iterator[np.ndarray]:  # noqa: ANN001
                for t in texts:
                    h = np.array(shingle_hashes(t or b"", SIZE), np.uint64)
                    u = np.unique(h)
                    nodes.append(xxhash.xxh3_64_intdigest(u.tobytes()) - (1 << 63))
                    keys.append(bands(u))
                    yield h

            fps = of_hashes(hashes(), len(texts))
            cols = [b.column(0), b.column(1), pa.array(fps), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "fp", "node", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(frugal(run), "doc_id long, h long, fp long, node long, keys array<long>")


def _by_simhash(nodes: DataFrame) -> DataFrame:
    """Pairs (x, y) of nodes of one fingerprint, and of the first nodes of linked ones."""
    fps = durable(nodes.groupBy("fp").agg(F.min("node").alias("head")), "fps")
    same = nodes.join(fps, "fp").select(F.col("head").alias("x"), F.col("node").alias("y"))
    far = links(fps.select("fp"), distance=DISTANCE)
    far = far.join(fps.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(fps.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    return same.unionByName(far.select("x", "y"))


def _holding(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (x, y) whose texts are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [near(shingles(s), shingles(t)) for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], ["a", "b"])

    sides = [texts.select(F.col("node").alias(c), F.col("text").alias(c + "t")) for c in "xy"]
    return pairs.join(sides[0], "x").join(sides[1], "y").select("x", "y", "xt", "yt").mapInArrow(frugal(run), "a long, b long")


def walk(nodes: list[int], sets: list[frozenset[int]]) -> tuple[list[int], list[int]]:
    """Links of a forest over near sets: they connect all that pairs of near sets connect."""
    rest, left, right = list(range(len(nodes))), [], []
    while rest:
        queue = [rest.pop(0)]
        while queue and rest:
            here = queue.pop()
            still = []
            for k in rest:
                if near(sets[here], sets[k]):
                    left.append(nodes[here])
                    right.append(nodes[k])
                    queue.append(k)
                else:
                    still.append(k)
            rest = still
    return left, right


def _walked(hot: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of the large buckets (key, node)."""
    filed = hot.join(texts, "node")
    n = F.greatest(F.ceil(F.sum(F.length("text")) / BLOCK_CHARS), F.ceil(F.count("*") / BLOCK_NODES), F.lit(1)).cast("int")
    blocks = hot.join(texts.select("node", "text"), "node").groupBy("key").agg(n.alias("n"))
    mine = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.least(mine, j) * F.col("n") + F.greatest(mine, j))
    dealt = filed.join(blocks, "key").select("key", F.explode(pair).alias("block"), "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for _, group in groupby(rows, lambda r: r[:2]):
            nodes, sets = [], []
            for _, _, node, t in group:
                nodes.append(node)
                sets.append(shingles(t))
            a, b = walk(nodes, sets)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(frugal(run), "a long, b long")


def cluster(docs: DataFrame) -> DataFrame:
    """(doc_id, h, component_id, kept) of every row; h is the XXH64 of its text, component_id the least doc_id that links
    which hold reach. ``kept``: the row is the first of its component by doc_id, then h; rows equal in both are kept alike.
    """
    bounded(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    marked = durable(_mark(docs), "marked")
    row = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "h", "fp", "keys")).alias("r")
    nodes = durable(marked.groupBy("node").agg(row).select("node", "r.doc_id", "r.h", "r.fp", "r.keys"), "nodes")

    filed = nodes.select("node", F.explode("keys").alias("key"))
    sizes = filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = durable(filed.join(sizes, "key").select("key", "node", "n"), "met")
    bucket = met.where(F.col("n") <= SMALL).groupBy("key").agg(F.collect_list("node").alias("m"))
    banded = bucket.select("m", F.explode("m").alias("x")).select("x", F.explode("m").alias("y"))
    both = banded.unionByName(_by_simhash(nodes)).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    pairs = durable(both.where("x < y").distinct(), "pairs")
    hot = met.where(F.col("n") > SMALL).select("key", "node")

    wanted = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).unionByName(hot.select("node")).distinct()
    rows = nodes.join(wanted, "node").select("node", F.col("doc_id").alias("_k"), F.col("h").alias("_h"))
    found = docs.join(rows, F.col("doc_id").cast("long").eqNullSafe(F.col("_k")) & (F.xxhash64("text") == F.col("_h")))
    texts = durable(found.select("node", "text").dropDuplicates(["node"]), "texts")

    held = _holding(pairs, texts)
    if not hot.isEmpty():
        held = held.unionByName(_walked(hot, texts))
    roots = components(held)
    joined = durable(roots.join(nodes.select("node", F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "h").alias("row")), "node").select("node", "root", "row"), "joined")
    least = joined.groupBy("root").agg(F.min("row").alias("least"))
    moved = joined.select("node", "root").join(least, "root").select("node", "least")
    own = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "h")
    of = nodes.select("node", own.alias("own")).join(moved, "node", "left").select("node", F.coalesce("least", "own").alias("least"))
    rows = marked.select("doc_id", "h", "node").join(of, "node")
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("h") == F.col("least.h"))
    return rows.select("doc_id", "h", F.col("least.doc_id").alias("component_id"), kept.alias("kept"))
