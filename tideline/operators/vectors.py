"""Cosine search over embeddings, its confidence, and learnt models over vectors.

Queries are a stated set (every vector whose id is divisible by 100) against all rows: the query side is collected into
blocks of bounded size that are broadcast, each block scans the corpus once, and every task keeps only its own k best
of each query before the k best of all are taken. So the shuffle carries k rows a query and task, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.registry import load, query, sql_query

K = 10
#: Queries of one block; a block of 4096 queries of 1024 doubles is 32 MB.
BLOCK = 4096


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int = K, block: int = BLOCK, same: str | None = None, prior: str | None = None) -> DataFrame:
    """(q, vec_id, sim): the k nearest other vectors of each query; ties go to the lower id. Null vectors match nothing.

    ``same`` names a column in which a neighbour has to equal its query (O-41; a query without a value takes any), ``prior``
    one in which it has to be strictly less (O-188). Both are gates before the k best are taken.
    """
    spark = corpus.sparkSession
    gates = [c for c in (same, prior) if c is not None]
    n = queries.count()
    parts = []
    for b in range(max(1, -(-n // block))):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // block)))) == b).select("vec_id", "embedding", *[c for c in dict.fromkeys(gates) if c != "vec_id"]).collect()
        if not rows:
            continue
        q = np.array([r.embedding for r in rows], np.float64)
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        wanted = {c: np.array([r[c] for r in rows], object) for c in gates}
        shared = spark.sparkContext.broadcast((np.array([r.vec_id for r in rows]), q / np.where(norm > 0, norm, 1), wanted))

        def near(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            ids, q, wanted = shared.value
            best: pd.DataFrame | None = None
            for pdf in batches:
                pdf = pdf[pdf.embedding.notna()]
                if not len(pdf):
                    continue
                x = np.stack(pdf.embedding.to_numpy()).astype(np.float64)
                x /= np.where((s := np.linalg.norm(x, axis=1, keepdims=True)) > 0, s, 1)
                sim = np.round(q @ x.T, 9)
                if same is not None:
                    unasked = np.array([w is None for w in wanted[same]])
                    sim[(wanted[same][:, None] != pdf[same].to_numpy(object)[None, :]) & ~unasked[:, None]] = -np.inf
                if prior is not None:
                    at = pd.to_numeric(pdf[prior]).to_numpy(np.float64)
                    sim[~(at[None, :] < wanted[prior].astype(np.float64)[:, None])] = -np.inf  # unknown times are not prior
                own = pdf.vec_id.to_numpy()
                m = min(k + 1, len(own))  # one more than asked for, as a query may meet itself
                cut = np.partition(sim, len(own) - m, axis=1)[:, len(own) - m]
                i, j = np.nonzero((sim >= cut[:, None]) & (sim > -np.inf))  # ties with the last stay, so that ids can decide
                new = pd.DataFrame({"q": ids[i], "vec_id": own[j], "sim": sim[i, j]})
                new = new[(new.q != new.vec_id) & (new.sim > -np.inf)]
                best = new if best is None else pd.concat([best, new])
                best = best.sort_values(["q", "sim", "vec_id"], ascending=[True, False, True]).groupby("q").head(k)
            if best is not None:
                yield best

        parts.append(corpus.select("vec_id", "embedding", *[c for c in dict.fromkeys(gates) if c != "vec_id"]).mapInPandas(near, "q long, vec_id long, sim double"))
    if not parts:
        return spark.createDataFrame([], "q long, vec_id long, sim double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("sim").desc(), "vec_id"))
    return found.withColumn("rk", rank).where(F.col("rk") <= k).drop("rk")


_NEAR = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT q.vec_id AS q, v.vec_id, v.label, round(list_cosine_similarity(q.e, v.e), 9) AS sim FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS rk FROM p),
t AS (SELECT * FROM r WHERE rk <= 10)"""


def _queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = load(spark, sf_dir, "embeddings")
    return v.where("vec_id % 100 = 0"), v


@query("knn_topk", _NEAR + " SELECT q, vec_id, round(sim, 6) AS sim FROM t")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-117, O-140, O-186: cosine top-k with tie-break by id."""
    return cosine_topk(*_queries(spark, sf_dir)).select("q", "vec_id", F.round("sim", 6).alias("sim"))


@query("knn_shared_factors", _NEAR + """,
f AS (SELECT t.q, t.vec_id, unnest(range(1, len(a.e) + 1)) AS dim, a.e AS x, b.e AS y FROM t JOIN v a ON a.vec_id = t.q JOIN v b ON b.vec_id = t.vec_id),
g AS (SELECT q, vec_id, dim, round(x[dim] * y[dim] / sqrt(list_sum(list_transform(x, lambda z: z * z)) * list_sum(list_transform(y, lambda z: z * z))), 9) AS part FROM f)
SELECT q, vec_id, CAST(dim - 1 AS INTEGER) AS factor, round(part, 6) AS part FROM g WHERE part > 0 QUALIFY row_number() OVER (PARTITION BY q, vec_id ORDER BY part DESC, dim) <= 3""")
def knn_shared_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-118: the nearest with the three factors (dimensions) that add most to each likeness."""
    queries, v = _queries(spark, sf_dir)
    unit = lambda name: F.transform(name, lambda x: x.cast("double") / F.sqrt(F.aggregate(name, F.lit(0.0), lambda acc, z: acc + z.cast("double") * z.cast("double"))))
    near = cosine_topk(queries, v).join(queries.select(F.col("vec_id").alias("q"), F.col("embedding").alias("a")), "q").join(v.select("vec_id", F.col("embedding").alias("b")), "vec_id")
    parts = F.zip_with(unit("a"), unit("b"), lambda x, y: F.round(x * y, 9))
    ranked = F.array_sort(F.filter(F.transform(parts, lambda x, i: F.struct((-x).alias("less"), i.alias("factor"))), lambda s: s["less"] < 0))
    return near.select("q", "vec_id", F.explode(F.slice(ranked, 1, 3)).alias("f")).select("q", "vec_id", F.col("f.factor").alias("factor"), F.round(-F.col("f.less"), 6).alias("part"))


@query("knn_neighbour_distributions", _NEAR + """,
w AS (SELECT t.q, unnest([{'kind': 'trend', 'value': CAST(label AS VARCHAR)}, {'kind': 'regime', 'value': CAST(vec_id % 3 AS VARCHAR)}], recursive := true) FROM t)
SELECT q, kind, value, CAST(count(*) AS BIGINT) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY q, kind) AS DOUBLE), 6) AS share FROM w GROUP BY q, kind, value""")
def knn_neighbour_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-98: how trends (labels) and regimes are distributed among the neighbours of each query."""
    queries, v = _queries(spark, sf_dir)
    t = cosine_topk(queries, v).join(v.select("vec_id", "label"), "vec_id")
    named = F.explode(F.array(F.struct(F.lit("trend").alias("kind"), F.col("label").cast("string").alias("value")), F.struct(F.lit("regime").alias("kind"), (F.col("vec_id") % 3).cast("string").alias("value"))))
    c = t.select("q", named.alias("x")).groupBy("q", "x.kind", "x.value").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("q", "kind")), 6))


@query("knn_regime_insight", """
WITH v AS (SELECT vec_id, label, vec_id % 3 AS regime, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT q.vec_id AS q, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS sim FROM v q JOIN v ON v.vec_id < q.vec_id AND v.regime = q.regime AND v.label = q.label WHERE q.vec_id % 100 = 0)
SELECT q, vec_id, round(sim, 6) AS sim FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) <= 25""")
def knn_regime_insight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-188, O-41: the 25 nearest that are strictly prior and of the query's own kind and regime."""
    v = load(spark, sf_dir, "embeddings").withColumn("gate", F.concat_ws(":", F.col("label").cast("string"), (F.col("vec_id") % 3).cast("string")))
    return cosine_topk(v.where("vec_id % 100 = 0"), v, k=25, same="gate", prior="vec_id").select("q", "vec_id", F.round("sim", 6).alias("sim"))


@query("knn_confidence", _NEAR + """, a AS (SELECT q, max(sim) AS best, avg(sim) AS mean, max(sim) - min(sim) AS spread, avg(1 - sim) AS distance, count(*) / 10e0 AS coverage FROM t GROUP BY q)
SELECT q, round(best, 6) AS best, round(mean, 6) AS mean, round(1 - least(1.0, spread / distance), 6) AS agreement, round(least(0.99, (0.6 * best + 0.4 * mean) * (0.5 + 0.25 * (1 - least(1.0, spread / distance)) + 0.25 * coverage)), 6) AS confidence FROM a""")
def knn_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-99, O-187: best and mean similarity, agreement and confidence of the neighbours."""
    t = cosine_topk(*_queries(spark, sf_dir))
    a = t.groupBy("q").agg(F.max("sim").alias("best"), F.avg("sim").alias("mean"), (F.max("sim") - F.min("sim")).alias("spread"), F.avg(1 - F.col("sim")).alias("distance"), (F.count("*") / 10.0).alias("coverage"))
    agree = 1 - F.least(F.lit(1.0), F.col("spread") / F.col("distance"))
    sure = F.least(F.lit(0.99), (0.6 * F.col("best") + 0.4 * F.col("mean")) * (0.5 + 0.25 * agree + 0.25 * F.col("coverage")))
    return a.select("q", F.round("best", 6).alias("best"), F.round("mean", 6).alias("mean"), F.round(agree, 6).alias("agreement"), F.round(sure, 6).alias("confidence"))


@query("knn_compatible_labels", _NEAR + ", w AS (SELECT vec_id AS q, label AS wanted FROM v) SELECT t.q, CAST(count(*) FILTER (WHERE label = wanted) AS BIGINT) AS same, CAST(count(DISTINCT label) AS BIGINT) AS labels FROM t JOIN w ON w.q = t.q GROUP BY t.q")
def knn_compatible_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-41, O-172, O-188: neighbours of the query's own label, and how many labels there are among them."""
    q, v = _queries(spark, sf_dir)
    t = cosine_topk(q, v).join(v.select("vec_id", "label"), "vec_id").join(q.select(F.col("vec_id").alias("q"), F.col("label").alias("wanted")), "q")
    return t.groupBy("q").agg(F.count(F.when(F.col("label") == F.col("wanted"), 1)).alias("same"), F.count_distinct("label").alias("labels"))


@query("knn_neighbour_outcomes", _NEAR + " SELECT q, label, CAST(count(*) AS BIGINT) AS n, round(min(sim), 6) AS low, round(avg(sim), 6) AS mean, round(max(sim), 6) AS high FROM t GROUP BY q, label")
def knn_neighbour_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-98, O-99: outcome counts and the spread of similarity over the neighbours of each query."""
    q, v = _queries(spark, sf_dir)
    t = cosine_topk(q, v).join(v.select("vec_id", "label"), "vec_id")
    return t.groupBy("q", "label").agg(F.count("*").alias("n"), F.round(F.min("sim"), 6).alias("low"), F.round(F.avg("sim"), 6).alias("mean"), F.round(F.max("sim"), 6).alias("high"))


@query("knn_prior_insight", """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT q.vec_id AS q, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS sim FROM v q JOIN v ON v.vec_id < q.vec_id AND v.label = q.label WHERE q.vec_id % 100 = 0),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS rk FROM p) WHERE rk <= 25)
SELECT q, CAST(count(*) AS BIGINT) AS prior, CAST(count(*) FILTER (WHERE sim >= 0.72) AS BIGINT) AS n, round(max(sim), 6) AS best, round(avg(sim), 6) AS mean FROM t GROUP BY q""")
def knn_prior_insight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-188, O-41: the 25 nearest strictly earlier vectors of the query's own kind (ids grow with time); ``n`` of them have 0.72 or more."""
    q, v = _queries(spark, sf_dir)
    t = cosine_topk(q, v, 25, same="label", prior="vec_id")
    return t.groupBy("q").agg(F.count("*").alias("prior"), F.count(F.when(F.col("sim") >= 0.72, 1)).alias("n"), F.round(F.max("sim"), 6).alias("best"), F.round(F.avg("sim"), 6).alias("mean"))


def similarity_trends(t: DataFrame, least: float = 0.72, n: int = 1, agreement: float = 0.40, pattern_n: int = 5, pattern_agreement: float = 0.60) -> DataFrame:
    """O-172: (q, trend) of neighbours (q, outcome, sim): the best is near enough, and so many share the commonest outcome."""
    c = t.groupBy("q", "outcome").agg(F.count("*").alias("c"), F.max("sim").alias("best"))
    a = c.groupBy("q").agg(F.sum("c").alias("n"), F.max("best").alias("best"), F.max("c").alias("most")).withColumn("agreement", F.col("most") / F.col("n"))
    near = (F.col("best") >= least) & (F.col("n") >= n) & (F.col("agreement") >= agreement)
    pattern = near & (F.col("n") >= pattern_n) & (F.col("agreement") >= pattern_agreement)
    names = F.array_compact(F.array(F.when(near, "historical_similarity"), F.when(pattern, "historical_pattern")))
    return a.select("q", F.explode(names).alias("trend"), "n", F.round("agreement", 6).alias("agreement"))


@query("knn_similarity_trends", _NEAR + """,
c AS (SELECT q, CAST(vec_id % 3 AS BIGINT) AS outcome, count(*) AS c, max(sim) AS best FROM t GROUP BY 1, 2), a AS (SELECT q, sum(c) AS n, max(best) AS best, max(c) / sum(c) AS agreement FROM c GROUP BY q)
SELECT q, 'historical_similarity' AS trend, CAST(n AS BIGINT) AS n, round(agreement, 6) AS agreement FROM a WHERE best >= 0.2 AND agreement >= 0.4
UNION ALL SELECT q, 'historical_pattern', CAST(n AS BIGINT), round(agreement, 6) FROM a WHERE best >= 0.2 AND agreement >= 0.6 AND n >= 5""")
def knn_similarity_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-172: trends of the neighbours' outcomes; the table's vectors are less alike than a history's, so the threshold is 0.2 here."""
    t = cosine_topk(*_queries(spark, sf_dir)).withColumn("outcome", F.col("vec_id") % 3)
    return similarity_trends(t, least=0.2)


@query("knn_profile_similarity", """
WITH s AS (SELECT l_suppkey, avg(l_discount) AS d, avg(l_tax) AS t, avg(l_quantity) / 50 AS q, CAST(l_suppkey % 5 AS INT) AS c FROM lineitem GROUP BY l_suppkey),
p AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, 0.5 * (1 - abs(a.d - b.d)) + 0.3 * (1 - abs(a.t - b.t)) + 0.2 * (1 - abs(a.q - b.q)) + CASE WHEN a.c = b.c THEN 0.05 ELSE -0.08 END AS s FROM s a JOIN s b ON b.l_suppkey <> a.l_suppkey WHERE a.l_suppkey % 100 = 0)
SELECT a, b, round(s, 6) AS similarity FROM p WHERE s >= 0.97""")
def knn_profile_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-190: weighted closeness of profiles, a bonus for the same competition and a malus otherwise, above a threshold."""
    s = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), (F.avg("l_quantity") / 50).alias("q"))
    s = s.withColumn("c", (F.col("l_suppkey") % 5).cast("int"))
    return profile_pairs(s.where("l_suppkey % 100 = 0"), s, 0.97)


def profile_pairs(queries: DataFrame, profiles: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """Pairs above ``least``; the query set goes out in blocks of bounded size, each of which meets every profile in one pass."""
    n = max(1, -(-queries.count() // block))
    measures, weights = ["d", "t", "q"], np.array([0.5, 0.3, 0.2])
    out = None
    for b in range(n):
        rows = queries.where(F.pmod(F.xxhash64("l_suppkey"), F.lit(n)) == b).select("l_suppkey", *measures, "c").collect()
        shared = profiles.sparkSession.sparkContext.broadcast((np.array([r.l_suppkey for r in rows], np.int64), np.array([[r[m] for m in measures] for r in rows], np.float64).reshape(-1, 3), np.array([r.c for r in rows], np.float64)))

        def meet(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            ids, x, c = shared.value
            for pdf in batches:
                own, y, kind = pdf.l_suppkey.to_numpy(), pdf[measures].to_numpy(np.float64), pdf.c.to_numpy()
                score = np.where(c[:, None] == kind[None, :], 0.05, -0.08)
                for j, w in enumerate(weights):
                    score = score + w * (1 - np.abs(x[:, None, j] - y[None, :, j]))
                i, k = np.nonzero((score >= least) & (ids[:, None] != own[None, :]))
                yield pd.DataFrame({"a": ids[i], "b": own[k], "similarity": score[i, k].round(6)})

        met = profiles.mapInPandas(meet, "a long, b long, similarity double")
        out = met if out is None else out.unionByName(met)
    return out


sql_query("knn_encoder", "O-189: deterministic unit vector of a match's measures, at least three of them known.", """
WITH m AS (SELECT user_id, avg(CASE WHEN event_type = 'click' THEN value END) AS a, avg(CASE WHEN event_type = 'view' THEN value END) AS b, avg(CASE WHEN event_type = 'error' THEN value END) AS c, avg(CASE WHEN event_type = 'signup' THEN value END) AS d FROM {events} GROUP BY user_id),
n AS (SELECT *, sqrt(coalesce(a * a, 0) + coalesce(b * b, 0) + coalesce(c * c, 0) + coalesce(d * d, 0)) AS norm, CASE WHEN a IS NULL THEN 0 ELSE 1 END + CASE WHEN b IS NULL THEN 0 ELSE 1 END + CASE WHEN c IS NULL THEN 0 ELSE 1 END + CASE WHEN d IS NULL THEN 0 ELSE 1 END AS known FROM m)
SELECT user_id, round(coalesce(a, 0) / norm, 6) AS x0, round(coalesce(b, 0) / norm, 6) AS x1, round(coalesce(c, 0) / norm, 6) AS x2, round(coalesce(d, 0) / norm, 6) AS x3 FROM n WHERE known >= 3""")


@query("ml_kmeans_sizes")
def ml_kmeans_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-231: k-means clusters of the embeddings (pyspark.ml), their sizes and commonest label."""
    v = load(spark, sf_dir, "embeddings").where("embedding is not null").withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    fitted = KMeans(k=8, seed=7, maxIter=20).fit(v).transform(v)
    return fitted.groupBy("prediction").agg(F.count("*").alias("n"), F.mode("label", deterministic=True).alias("label"))


sql_query("ml_anomaly_zscore", "O-231: rows more than three deviations from their type's mean.", """
WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS d FROM {events} GROUP BY event_type)
SELECT event_id, round((value - m) / d, 6) AS z FROM {events} e JOIN s ON e.event_type = s.event_type WHERE abs((value - m) / d) > 3""")
sql_query("ml_bootstrap_labels", "O-232: rule labels and clamped relevance grades.", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.07 THEN 'strong' WHEN l_discount >= 0.03 THEN 'fair' ELSE 'weak' END AS label, CAST(greatest(0, least(4, [[bround||round_even]](l_tax * 50, 0))) AS INT) AS relevance FROM {lineitem}""")
