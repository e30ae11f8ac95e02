"""Hard negatives from embeddings: bit-sliced integer products with score intervals.

A vector's components become integers, floor(256 * x). A row's score is its integer inner product with an anchor. An
anchor's positives are its ``POSITIVES`` best other rows of its label; a positive's negatives are the ``NEGATIVES`` best
rows of other labels that score from 0.8 to 1 times the positive.

Anchors and rows meet in cells, a block of anchors by a slice of rows, so that every task has two inputs of bounded
size, whatever the number of either, and nothing is broadcast. In a cell the rows' components are taken apart into
bit-planes (two's complement, the most significant has a negative weight). Adding plane after plane, what the planes
still to come can add lies between two numbers known for each anchor, so that every candidate has a score interval that
halves with each plane. A candidate goes as soon as its interval cannot qualify: below the k-th best lower end so far,
or outside the score band of every positive. While many candidates are left the planes are multiplied as matrices,
then only for the pairs that are left. What has had all planes has its exact score.

Cells give their k best of each anchor; the k best of all cells are the result. Work is rows times anchors, as the
task states; memory and the size of a cell don't grow.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part; an empty
vector scores 0, a shorter one as if zeros followed; repeated rows are candidates of their own, but an anchor id has one
anchor (the least label, then the least vector) and no row of an anchor's own id is its positive. Components have to
be below 2 ** 53 / 256 in size and scores to fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import durable, table

POSITIVES = 5
NEGATIVES = 5
SCALE = 256
#: Bytes of integer components of a block of anchors or a slice of rows at most, and rows of a slice at least.
CELL_BYTES = 16 << 20
LEAST_ROWS = 1024
#: Anchors and rows whose scores are in memory at once.
TILE_ANCHORS = 256
TILE_ROWS = 4096
#: Share of a tile's candidates below which only pairs that are left are multiplied.
SPARSE = 0.05


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, c): integer components of the rows that take part."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & F.coalesce(good, F.lit(False)))
    return rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(x, lambda v: F.floor(v * SCALE)).alias("c"))


def _sides(rows: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their ``slice`` and anchors with their ``block``, and on each side how many parts the other has."""
    n, wide = rows.agg(F.count("*"), F.max(F.size("c"))).first()
    m = anchors.count()
    most = max(1, CELL_BYTES // (8 * max(1, wide or 1)))
    wanted = 2 * rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-m // most))
    slices = max(1, -(-n // most), min(-(-n // LEAST_ROWS), -(-wanted // blocks)))
    nth = F.monotonically_increasing_id()  # of rows read from a table, so the same at every try
    even = lambda parts: F.pmod(nth + F.shiftrightunsigned(nth, 33), F.lit(parts)).cast("int")
    dealt = rows.withColumn("slice", even(slices)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = anchors.withColumn("block", even(blocks)).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return dealt, asked


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists as rows of a matrix of integers, with zeros after the shorter ones."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), max(1, int(sizes.max(initial=0)))), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _wide(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.hstack([a, np.zeros((len(a), width - a.shape[1]), a.dtype)])


class Planes:
    """Bit-planes of rows, the most significant first; ``weights[k]`` is what a bit of plane k counts."""

    def __init__(self, rows: np.ndarray) -> None:
        bits = max(1, int(max(rows.max(initial=0), -1 - rows.min(initial=0))).bit_length()) + 1
        self.weights = [-(1 << bits - 1), *(1 << k for k in range(bits - 2, -1, -1))]
        self.bits = [(rows >> k & 1).astype(np.int8) for k in range(bits - 1, -1, -1)]


def kth(values: np.ndarray, k: int, least: float) -> np.ndarray:
    """The k-th greatest of each row, or ``least`` where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), least, values.dtype)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def scored(anchors: np.ndarray, planes: Planes, part: slice, alive: np.ndarray, qualify) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
    """(anchor, row, score) of the candidates that are left when all planes are in.

    ``alive`` says which pairs are candidates; ``qualify(low, high, alive)`` gives those whose score interval still can
    qualify. It is asked after each plane, and the pairs it leaves out are not multiplied again once they are few.
    """
    largest = np.abs(anchors).sum(axis=1).max(initial=0)
    kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64  # of exact sums
    a = anchors.astype(kind)
    up, down = np.maximum(anchors, 0).sum(axis=1), np.minimum(anchors, 0).sum(axis=1)
    score = np.zeros(alive.shape, np.int64)
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    for weight, bits in zip(planes.weights, planes.bits, strict=True):
        rest = abs(weight) - 1
        here = bits[part]
        if pairs is None:
            score += weight * (a @ here.astype(kind).T).astype(np.int64)
            alive = qualify(score + (rest * down)[:, None], score + (rest * up)[:, None], alive)
            if alive.sum() <= SPARSE * alive.size:
                pairs = np.nonzero(alive)
                score = score[pairs]
        else:
            i, j = pairs
            for p in range(0, len(i), 1 << 16):
                at = slice(p, p + (1 << 16))
                score[at] += weight * np.einsum("nd,nd->n", anchors[i[at]], here[j[at]].astype(np.int64))
    if pairs is None:
        pairs = np.nonzero(alive)
        score = score[pairs]
    return pairs[0], pairs[1], score


def best(of: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best (score descending, id ascending) of each value of ``of``."""
    order = np.lexsort((ids, -score, of))
    group = of[order]
    starts = np.r_[0, np.nonzero(np.diff(group))[0] + 1] if len(group) else np.zeros(0, np.int64)
    rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
    return order[rank < k]


_LOW = np.iinfo(np.int64).min // 4


def _tiles(n: int, m: int) -> Iterator[tuple[slice, slice]]:
    for i in range(0, n, TILE_ANCHORS):
        for j in range(0, m, TILE_ROWS):
            yield slice(i, i + TILE_ANCHORS), slice(j, j + TILE_ROWS)


def _read(left: pa.Table, right: pa.Table) -> tuple:
    rows, anchors = _matrix(left["c"]), _matrix(right["c"])
    width = max(rows.shape[1], anchors.shape[1])
    number = lambda t, c: t[c].to_numpy().astype(np.int64)
    return number(left, "id"), number(left, "label"), Planes(_wide(rows, width)), number(right, "id"), number(right, "label"), _wide(anchors, width)


def _positive_cell(k: int):  # noqa: ANN202
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            ids, labels, planes, asked, wanted, anchors = _read(left, right)
            floor = np.full((len(asked), k), _LOW)  # the k best scores of each anchor in the tiles before
            for i, j in _tiles(len(asked), len(ids)):
                can = (wanted[i, None] == labels[None, j]) & (asked[i, None] != ids[None, j])

                def qualify(low: np.ndarray, high: np.ndarray, alive: np.ndarray, i=i) -> np.ndarray:  # noqa: ANN001
                    least = np.maximum(kth(np.where(alive, low, _LOW), k, _LOW), floor[i, -1])
                    return alive & (high >= least[:, None])

                a, r, score = scored(anchors[i], planes, j, can, qualify)
                at = best(a, score, ids[j][r], k)
                a, r, score = a[at], r[at], score[at]
                out.append((asked[i][a], ids[j][r], score))
                rank = np.arange(len(a)) - np.searchsorted(a, a)
                here = np.full((len(floor[i]), k), _LOW)
                here[a, rank] = score
                floor[i] = -np.sort(-np.hstack([floor[i], here]), axis=1)[:, :k]
        cols = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3)]
        return pa.table({"anchor_id": cols[0], "positive_id": cols[1], "positive_score": cols[2]})

    return run


def _negative_cell(k: int, least: int, of: int):  # noqa: ANN202
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            ids, labels, planes, asked, wanted, anchors = _read(left, right)
            scores = _matrix(right["scores"])
            n_pos = right["scores"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            there = np.arange(scores.shape[1])[None, :] < n_pos[:, None]
            lo = np.where(there, -(-scores * least // of), 1)
            hi = np.where(there, scores, 0)  # lo over hi: no band
            floor = np.full((*scores.shape, k), _LOW)
            for i, j in _tiles(len(asked), len(ids)):
                can = wanted[i, None] != labels[None, j]

                def qualify(low: np.ndarray, high: np.ndarray, alive: np.ndarray, i=i) -> np.ndarray:  # noqa: ANN001
                    still = np.zeros_like(alive)
                    for p in range(scores.shape[1]):
                        l, h = lo[i, p, None], hi[i, p, None]
                        sure = np.where(alive & (low >= l) & (high <= h), low, _LOW)
                        cut = np.maximum(np.maximum(kth(sure, k, _LOW), floor[i, p, -1])[:, None], l)
                        still |= (high >= cut) & (low <= h) & (l <= h)
                    return alive & still

                a, r, score = scored(anchors[i], planes, j, can, qualify)
                for p in range(scores.shape[1]):
                    own = np.nonzero((score >= lo[i][a, p]) & (score <= hi[i][a, p]))[0]
                    own = own[best(a[own], score[own], ids[j][r[own]], k)]
                    b = a[own]
                    out.append((asked[i][b], np.full(len(b), p), ids[j][r[own]], score[own]))
                    here = np.full((len(anchors[i]), k), _LOW)
                    here[b, np.arange(len(b)) - np.searchsorted(b, b)] = score[own]
                    floor[i, p] = -np.sort(-np.hstack([floor[i, p], here]), axis=1)[:, :k]
        cols = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(4)]
        return pa.table({"anchor_id": cols[0], "nth": cols[1], "negative_id": cols[2], "negative_score": cols[3]})

    return run


def _cells(rows: DataFrame, anchors: DataFrame, run, schema: str) -> DataFrame:  # noqa: ANN001
    dealt, asked = _sides(rows, anchors)
    return dealt.groupBy("block", "slice").cogroup(asked.groupBy("block", "slice")).applyInArrow(run, schema)


def positives(rows: DataFrame, anchors: DataFrame, k: int = POSITIVES) -> DataFrame:
    """(anchor_id, nth, positive_id, positive_score): the k best other rows of each anchor's label."""
    found = _cells(rows, anchors, _positive_cell(k), "anchor_id long, positive_id long, positive_score long")
    nth = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, k: int = NEGATIVES, of_positives: int = POSITIVES, least: int = 80, of: int = 100) -> DataFrame:
    """Hard negatives of each anchor and positive: the k best rows of other labels with ``least`` * positive <= ``of`` * negative <= ``of`` * positive.

    ``is_anchor`` and ``label`` (in place of the column) are written over ``id`` and ``label``.
    """
    rows = quantised(vectors)
    rows = durable(rows.withColumn("label", label) if label is not None else rows, "vectors")
    anchors = durable(rows.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "c")).alias("v")).select("id", "v.*"), "anchors")
    found = durable(positives(rows, anchors, of_positives), "positives")
    bands = found.groupBy("anchor_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    asked = durable(anchors.join(bands, F.col("id") == F.col("anchor_id")).select("id", "label", "c", "scores"), "bands")
    near = _cells(rows, asked, _negative_cell(k, least, of), "anchor_id long, nth long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "nth").orderBy(F.col("negative_score").desc(), "negative_id"))
    kept = near.withColumn("nth", (F.col("nth") + 1).cast("int")).withColumn("rank", rank).where(F.col("rank") <= k)
    return kept.join(found, ["anchor_id", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    noisy = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, noisy)


OP12_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(CAST(256 AS DOUBLE) * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.id AS anchor_id, v.id, a.label = v.label AS same, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score FROM v a JOIN v ON v.id <> a.id WHERE a.id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER w <= 5"""
