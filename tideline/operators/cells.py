"""Nearest neighbours by an inverted file: rows filed in the cells of a k-means, of which a query searches the nearest.

The cells are fitted on at most ``SAMPLE`` rows, chosen by a hash of their id; every row is filed. Centroids are at most
``MOST_CELLS``, so they can be broadcast. How many cells a query searches is measured, not guessed: among the rows of the
sample, the least number whose cells hold ``RECALL`` of the true neighbours of some of them. Queries go to their nearest
cells and meet the rows there in slices of bounded size, so a cell that holds a third of all rows is many tasks.
``cosine_topk`` is the exact way beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.operators.vectors import K
from tideline.registry import load, query
from tideline.session import written

SAMPLE = 20_000
MOST_CELLS = 1024
SLICE_ROWS = 20_000
RECALL = 0.95
#: Rows of the sample whose neighbours in the sample are looked up to measure recall.
TRIED = 400


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)


def _sample(corpus: DataFrame, sample: int) -> tuple[int, DataFrame]:
    """How many rows have a vector, and at most about ``sample`` of them."""
    rows = corpus.where("embedding IS NOT NULL")
    n = rows.count()
    return n, rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // sample)))) == 0).select("embedding")


def fit(corpus: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Centroids of unit vectors, about the root of the number of rows."""
    n, part = _sample(corpus, sample)
    k = min(MOST_CELLS, max(1, round(n**0.5) if cells is None else cells))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    unit = part.select(array_to_vector(F.transform("embedding", lambda v: F.when(norm > 0, v.cast("double") / norm).otherwise(0.0))).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=15).fit(unit)
    return _unit(np.array(model.clusterCenters()))


def probes(corpus: DataFrame, centres: np.ndarray, k: int = K, recall: float = RECALL, sample: int = SAMPLE) -> int:
    """The cells to search for ``recall`` of the k nearest, measured within the sample, which is brought to the driver."""
    held = _sample(corpus, sample)[1].limit(2 * sample).collect()
    if len(held) < 2:
        return 1
    x = _unit(np.array([r.embedding for r in held], np.float64))
    cell = (x @ centres.T).argmax(axis=1)
    seen = np.zeros(len(centres), np.int64)
    for q in range(0, len(x), max(1, len(x) // TRIED)):
        sim = x @ x[q]
        sim[q] = -np.inf
        near = np.argpartition(-sim, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)]
        place = np.empty(len(centres), np.int64)
        place[np.argsort(-(centres @ x[q]))] = np.arange(len(centres))
        np.add.at(seen, place[cell[near]], 1)
    return int(np.searchsorted(np.cumsum(seen), recall * seen.sum())) + 1


def _nearest(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(vec_id, embedding, cell) with the ``probes`` nearest cells of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for pdf in frames:
            if not len(pdf):
                continue
            sim = _unit(np.stack(pdf.embedding.to_numpy()).astype(np.float64)) @ c.T
            m = min(probes, len(c))
            best = np.argpartition(-sim, m - 1, axis=1)[:, :m]
            at = np.repeat(np.arange(len(pdf)), m)
            yield pd.DataFrame({"vec_id": pdf.vec_id.to_numpy()[at], "embedding": pdf.embedding.to_numpy()[at], "cell": best.ravel().astype(np.int32)})

    return rows.where("embedding IS NOT NULL").select("vec_id", "embedding").mapInPandas(run, "vec_id long, embedding array<float>, cell int")


def file(corpus: DataFrame, centres: np.ndarray) -> DataFrame:
    """Every row with its cell, as a table sorted by cell."""
    return written(_nearest(corpus, centres, 1).repartition("cell").sortWithinPartitions("cell"), "cells")


def search(queries: DataFrame, filed: DataFrame, centres: np.ndarray, k: int = K, searched: int = 1) -> DataFrame:
    """(q, vec_id, sim): the k nearest other rows among the ``searched`` nearest cells; ties go to the lower id."""
    sizes = filed.groupBy("cell").agg(F.ceil(F.count("*") / SLICE_ROWS).cast("int").alias("slices"))
    rows = filed.join(F.broadcast(sizes), "cell").withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int")).drop("slices")
    parts = sizes.select("cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    asked = _nearest(queries, centres, searched).join(F.broadcast(parts), "cell")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "vec_id": [], "sim": []})
        ids, x = left.vec_id.to_numpy(), _unit(np.stack(left.embedding.to_numpy()).astype(np.float64))
        out = []
        for at in range(0, len(right), 512):
            part = right.iloc[at : at + 512]
            sim = np.round(_unit(np.stack(part.embedding.to_numpy()).astype(np.float64)) @ x.T, 9)
            sim[part.vec_id.to_numpy()[:, None] == ids[None, :]] = -np.inf
            m = min(k, len(ids))
            cut = np.partition(sim, len(ids) - m, axis=1)[:, len(ids) - m]
            i, j = np.nonzero((sim >= cut[:, None]) & (sim > -np.inf))  # ties with the k-th stay, so that ids can decide
            out.append(pd.DataFrame({"q": part.vec_id.to_numpy()[i], "vec_id": ids[j], "sim": sim[i, j]}))
        return pd.concat(out).sort_values(["q", "sim", "vec_id"], ascending=[True, False, True]).groupby("q").head(k)

    found = rows.groupBy("cell", "slice").cogroup(asked.groupBy("cell", "slice")).applyInPandas(run, "q long, vec_id long, sim double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("sim").desc(), "vec_id"))
    return found.withColumn("rk", rank).where(F.col("rk") <= k).drop("rk")


@query("knn_inverted_file")
def q_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-186, O-117: the ten nearest by the inverted file (recall against brute force is measured in the tests)."""
    v = load(spark, sf_dir, "embeddings")
    centres = fit(v)
    return search(v.where("vec_id % 100 = 0"), file(v, centres), centres, searched=probes(v, centres)).select("q", "vec_id", F.round("sim", 6).alias("sim"))
