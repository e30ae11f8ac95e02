"""Reasoning over facts: rules as tables, conclusions that feed later rules, contradictions settled by confidence.

A fact is (scope, fact, value, confidence). A rule has premises, each a fact with a bound on its value; it holds in a
scope where all of them do. Finding the rules that hold is one join of facts to the table of premises and one count a
scope and rule: no rule is code. Rules come in layers: what a layer concludes are facts for the next. Of facts that
contradict each other the surer stays, before the next layer sees them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.registry import query, run_sql
from tideline.session import written

# Fixed values: (layer, rule, conclusion, how confidence comes from the counting premises, most of it, effect on confidence, on uncertainty)
RULES = [
    (1, "few-goals", "low_scoring", "mean", 1.0, 0.0, 0.0),
    (1, "many-goals", "high_scoring", "mean", 1.0, 0.0, 0.0),
    (1, "frequent-draws", "draw_tendency", "mean", 1.0, 0.0, 0.0),
    (1, "rare-draws", "draw_resistance", "mean", 1.0, 0.0, 0.0),
    (1, "calm-goals", "stable", "mean", 1.0, 0.0, 0.0),
    (1, "wild-goals", "volatile", "mean", 1.0, 0.0, 0.0),
    (2, "low-scoring-draw-stability", "low_volatility_match", "mean", 1.0, 0.12, -0.08),
    (2, "draw-memory-convergence", "draws_converge", "mean", 0.95, 0.16, -0.10),
    (2, "market-pressure-thin-memory", "pressure_uncorroborated", "mean", 1.0, -0.12, 0.20),
    (2, "deep-hierarchical-memory", "deep_memory", "mean", 1.0, 0.18, -0.12),
    (2, "sparse-similarity-neighborhood", "few_analogues", "mean", 1.0, -0.15, 0.18),
    (2, "draw-signal-behavior-link", "draws_explained", "mean", 1.0, 0.08, -0.04),
    (3, "settled-draw-outlook", "draw_outlook", "min", 1.0, 0.05, -0.05),
]
# Fixed values: (rule, fact, least, below, whether its confidence counts)
PREMISES = [
    ("few-goals", "goal_mean", None, 2.5, 1),
    ("many-goals", "goal_mean", 3.0, None, 1),
    ("frequent-draws", "draw_signal", 0.25, None, 1),
    ("rare-draws", "h2h_draw_rate", None, 0.25, 1),
    ("calm-goals", "volatility", None, 0.6, 1),
    ("wild-goals", "volatility", 0.6, None, 1),
    ("low-scoring-draw-stability", "low_scoring", None, None, 1),
    ("low-scoring-draw-stability", "draw_tendency", None, None, 1),
    ("low-scoring-draw-stability", "stable", None, None, 1),
    ("draw-memory-convergence", "h2h_draw_rate", 0.30, None, 0),
    ("draw-memory-convergence", "home_draw_rate", 0.28, None, 0),
    ("draw-memory-convergence", "away_draw_rate", 0.28, None, 0),
    ("draw-memory-convergence", "competition_draw_rate", 0.24, None, 0),
    ("draw-memory-convergence", "memory", None, None, 1),
    ("market-pressure-thin-memory", "disagreement", 0.20, None, 1),
    ("market-pressure-thin-memory", "favorite_pressure", 0.50, None, 1),
    ("market-pressure-thin-memory", "memory", None, 0.75, 0),
    ("deep-hierarchical-memory", "memory", 0.75, None, 1),
    ("sparse-similarity-neighborhood", "neighbors", None, 5.0, 1),
    ("draw-signal-behavior-link", "draw_signal", None, None, 1),
    ("draw-signal-behavior-link", "draw_tendency", None, None, 1),
    ("settled-draw-outlook", "draws_explained", None, None, 1),
    ("settled-draw-outlook", "draws_converge", None, None, 1),
]
# Facts that exclude each other.
CONTRADICTIONS = [("low_scoring", "high_scoring"), ("draw_tendency", "draw_resistance"), ("stable", "volatile")]
# Fixed values: (conflict, fact, least, below, fact, least, below, how their values make the severity)
CONFLICTS = [
    ("market-pressure-disagreement", "favorite_pressure", 0.5, None, "disagreement", 0.2, None, "mean"),
    ("scoring-signal-low-scoring-behavior", "scoring_signal", 0.6, None, "low_scoring", None, None, "max"),
    ("dual-strong-form", "home_form", 0.6, None, "away_form", 0.6, None, "min"),
    ("draw-signal-h2h-resistance", "draw_signal", 0.3, None, "h2h_draw_rate", None, 0.2, "first"),
]
_WITHIN = "(least IS NULL OR value >= least) AND (below IS NULL OR value < below)"


def settle(facts: DataFrame, contradictions: list[tuple[str, str]]) -> DataFrame:
    """Of each pair of facts that exclude each other in a scope, the surer (then the greater, then the first by name)."""
    spark = facts.sparkSession
    pairs = spark.createDataFrame([(f, i) for i, pair in enumerate(contradictions) for f in pair], "fact string, pair int")
    best = Window.partitionBy("scope", "pair").orderBy(F.col("confidence").desc(), F.col("value").desc(), "fact")
    named = facts.join(F.broadcast(pairs), "fact", "left")
    opposed = named.where("pair IS NOT NULL").withColumn("_rk", F.row_number().over(best)).where("_rk = 1").drop("_rk")
    return named.where("pair IS NULL").unionByName(opposed).select("scope", "fact", "value", "confidence")


def conclude(facts: DataFrame, rules: list[tuple] = RULES, premises: list[tuple] = PREMISES, contradictions: list[tuple[str, str]] = CONTRADICTIONS) -> tuple[DataFrame, DataFrame]:
    """(facts with all that follows from them, evidence): evidence has a row for each premise of each rule that holds."""
    spark = facts.sparkSession
    needed = {r[1]: sum(p[0] == r[1] for p in premises) for r in rules}
    table = spark.createDataFrame([(*r, needed[r[1]]) for r in rules], "layer int, rule string, conclusion string, by string, most double, confidence_effect double, uncertainty_effect double, needed int")
    known = settle(written(facts.select("scope", "fact", "value", "confidence"), "facts"), contradictions)
    evidence = []
    for layer in sorted({r[0] for r in rules}):
        own = {r[1] for r in rules if r[0] == layer}
        asked = spark.createDataFrame([p for p in premises if p[0] in own], "rule string, fact string, least double, below double, counts int")
        met = known.join(F.broadcast(asked), "fact").where(_WITHIN)
        sure = F.when(F.col("counts") == 1, F.col("confidence"))
        held = met.groupBy("scope", "rule").agg(F.count("*").alias("n"), F.avg(sure).alias("mean"), F.min(sure).alias("min"), F.avg("value").alias("value"))
        held = written(held.join(F.broadcast(table), "rule").where("n = needed"), "held")
        confidence = F.least("most", F.when(F.col("by") == "mean", F.col("mean")).otherwise(F.col("min")))
        new = held.select("scope", F.col("conclusion").alias("fact"), "value", F.round(confidence, 9).alias("confidence"))
        evidence.append(met.join(held.select("scope", "rule", "conclusion", "layer", "confidence_effect", "uncertainty_effect"), ["scope", "rule"]).select("scope", "layer", "rule", "conclusion", F.col("fact").alias("premise"), "value", "confidence", "confidence_effect", "uncertainty_effect"))
        new = new.groupBy("scope", "fact").agg(F.max(F.struct("confidence", "value")).alias("b")).select("scope", "fact", "b.value", "b.confidence")
        known = known.unionByName(settle(new, contradictions))
    out = evidence[0]
    for e in evidence[1:]:
        out = out.unionByName(e)
    return known, out


def conflicts(known: DataFrame, rules: list[tuple] = CONFLICTS) -> DataFrame:
    """(scope, conflict, severity) of pairs of facts that are both in force."""
    spark = known.sparkSession
    sides = spark.createDataFrame([(r[0], r[7], i, *r[1 + 3 * i : 4 + 3 * i]) for r in rules for i in (0, 1)], "conflict string, by string, side int, fact string, least double, below double")
    met = known.join(F.broadcast(sides), "fact").where(_WITHIN)
    both = met.groupBy("scope", "conflict", "by").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"), F.max(F.when(F.col("side") == 0, F.col("value"))).alias("first"))
    severity = F.when(F.col("by") == "mean", F.col("mean")).when(F.col("by") == "max", F.col("max")).when(F.col("by") == "min", F.col("min")).otherwise(F.col("first"))
    return both.where("n = 2").select("scope", "conflict", F.round(F.least(F.lit(1.0), severity), 6).alias("severity"))


def confidence(known: DataFrame, evidence: DataFrame, found: DataFrame) -> DataFrame:
    """(scope, score, level, uncertainty_effect): how sure the report of a scope is, less by its conflicts."""
    value = lambda fact, default: F.coalesce(F.max(F.when(F.col("fact") == fact, F.col("value"))), F.lit(default))
    behaviours = [f for pair in CONTRADICTIONS for f in pair]
    own = known.groupBy("scope").agg(
        F.coalesce(F.avg(F.when(F.col("fact").isin(behaviours), F.col("confidence"))), F.lit(0.4)).alias("behaviour"),
        F.count("*").alias("facts"),
        value("memory", 0.0).alias("memory"),
        value("market_confidence", 0.0).alias("market"),
        value("sources", 1.0).alias("sources"),
        F.coalesce(F.avg(F.when(F.col("fact").endswith("_signal") | F.col("fact").endswith("_form"), F.col("confidence"))), F.lit(0.5)).alias("state"),
    )
    against = found.groupBy("scope").agg(F.least(F.lit(0.25), F.sum("severity") * 0.08).alias("penalty"))
    effects = evidence.select("scope", "rule", "uncertainty_effect").distinct().groupBy("scope").agg(F.round(F.sum("uncertainty_effect"), 6).alias("uncertainty_effect"))
    score = 0.25 * F.col("behaviour") + 0.18 * F.least(F.lit(1.0), F.col("facts") / 20) + 0.20 * F.col("memory") + 0.15 * F.col("market") + 0.12 * F.least(F.lit(1.0), F.col("sources") / 2) + 0.10 * F.col("state")
    out = own.join(against, "scope", "left").join(effects, "scope", "left").withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score - F.coalesce("penalty", F.lit(0.0)))) + 1e-10, 6))
    return out.select("scope", "score", F.when(F.col("score") >= 0.75, "high").when(F.col("score") >= 0.45, "medium").otherwise("low").alias("level"), F.coalesce("uncertainty_effect", F.lit(0.0)).alias("uncertainty_effect"))


#: What is known of a match before its kickoff, as facts; matches of the same instant are not seen.
_BEFORE = "ORDER BY kickoff_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '1' SECOND PRECEDING"
_DRAW = "avg(CASE WHEN home_goals = away_goals THEN 1e0 ELSE 0e0 END)"
FACTS = f"""
WITH m AS (SELECT *, least(home, away) AS a, greatest(home, away) AS b FROM {{matches}}),
s AS (SELECT uid, kickoff_at, home AS team, home_goals, away_goals, CASE WHEN home_goals > away_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END AS points, 0 AS side FROM m UNION ALL SELECT uid, kickoff_at, away, home_goals, away_goals, CASE WHEN away_goals > home_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END, 1 FROM m),
t AS (SELECT uid, side, {_DRAW} OVER w AS draws, avg(points / 3e0) OVER w AS form, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY team {_BEFORE})),
p AS (SELECT uid, {_DRAW} OVER h AS h2h, count(*) OVER h AS met, {_DRAW} OVER c AS draws, avg(CAST(home_goals + away_goals AS DOUBLE)) OVER c AS goals, stddev_pop(CAST(home_goals + away_goals AS DOUBLE)) OVER c AS swing, count(*) OVER c AS n FROM m WINDOW h AS (PARTITION BY a, b {_BEFORE}), c AS (PARTITION BY competition {_BEFORE})),
j AS (SELECT p.uid, p.met, p.n, round(coalesce(h2h, 0e0), 9) AS h2h, round(coalesce(p.draws, 0e0), 9) AS draws, round(coalesce(goals, 0e0), 9) AS goals, round(least(1e0, coalesce(swing, 0e0) / 2.5e0), 9) AS swing, round(coalesce(x.draws, 0e0), 9) AS hd, round(coalesce(y.draws, 0e0), 9) AS ad, round(coalesce(x.form, 0e0), 9) AS hf, round(coalesce(y.form, 0e0), 9) AS af, x.n AS hn, y.n AS an FROM p JOIN t x ON x.uid = p.uid AND x.side = 0 JOIN t y ON y.uid = p.uid AND y.side = 1),
g AS (SELECT *, round(0.35e0 * least(1e0, met / 10e0) + 0.2e0 * least(1e0, hn / 40e0) + 0.2e0 * least(1e0, an / 40e0) + 0.25e0 * least(1e0, n / 500e0), 9) AS memory, round(0.4e0 + 0.4e0 * least(1e0, n / 100e0) + 0.1e0 * (uid % 2), 9) AS sure FROM j),
f AS (SELECT uid AS scope, [[stack(14, {{rows}}) AS (fact, value, confidence)||unnest([{{structs}}], recursive := true)]] FROM g)
SELECT scope, fact, CAST(value AS DOUBLE) AS value, CAST(confidence AS DOUBLE) AS confidence FROM f"""
_FACTS = [("goal_mean", "goals", "sure"), ("scoring_signal", "round(least(1e0, goals / 4e0), 9)", "sure"), ("draw_signal", "draws", "sure"), ("competition_draw_rate", "draws", "sure"), ("h2h_draw_rate", "h2h", "round(0.4e0 + 0.5e0 * least(1e0, met / 10e0), 9)"), ("home_draw_rate", "hd", "sure"), ("away_draw_rate", "ad", "sure"), ("volatility", "swing", "sure"), ("home_form", "hf", "sure"), ("away_form", "af", "sure"), ("memory", "memory", "memory"), ("neighbors", "CAST(least(met, 30) AS DOUBLE)", "0.9e0"), ("favorite_pressure", "(uid % 100) / 100e0", "0.8e0"), ("disagreement", "(uid % 37) / 60e0", "0.8e0")]
FACTS = FACTS.replace("{rows}", ", ".join(f"'{a}', {b}, {c}" for a, b, c in _FACTS)).replace("{structs}", ", ".join(f"{{'fact': '{a}', 'value': {b}, 'confidence': {c}}}" for a, b, c in _FACTS))
# the same rules one by one over a wide row a match, as an oracle
_V = lambda f: f"max(value) FILTER (WHERE fact = '{f}')"
_C = lambda f: f"max(confidence) FILTER (WHERE fact = '{f}')"
_WIDE_ROW = f"""
WITH facts AS MATERIALIZED ({{facts}}),
w AS (SELECT scope, {", ".join(f"{_V(f)} AS {f}, {_C(f)} AS c_{f}" for f, _, _ in _FACTS)} FROM facts GROUP BY scope),
b0 AS (SELECT *, CASE WHEN goal_mean < 2.5 THEN c_goal_mean END AS low, CASE WHEN goal_mean >= 3 THEN c_goal_mean END AS high, CASE WHEN draw_signal >= 0.25 THEN c_draw_signal END AS tend, CASE WHEN h2h_draw_rate < 0.25 THEN c_h2h_draw_rate END AS resist, CASE WHEN volatility < 0.6 THEN c_volatility END AS calm, CASE WHEN volatility >= 0.6 THEN c_volatility END AS wild FROM w),
b AS (SELECT * REPLACE (CASE WHEN resist IS NOT NULL AND (resist, h2h_draw_rate) > (tend, draw_signal) THEN NULL ELSE tend END AS tend, CASE WHEN tend IS NOT NULL AND (resist, h2h_draw_rate) <= (tend, draw_signal) THEN NULL ELSE resist END AS resist) FROM b0),
r AS (SELECT *, CASE WHEN low IS NOT NULL AND tend IS NOT NULL AND calm IS NOT NULL THEN (low + tend + calm) / 3 END AS r1, CASE WHEN h2h_draw_rate >= 0.30 AND home_draw_rate >= 0.28 AND away_draw_rate >= 0.28 AND competition_draw_rate >= 0.24 THEN least(0.95, c_memory) END AS r2,
  CASE WHEN disagreement >= 0.2 AND favorite_pressure >= 0.5 AND memory < 0.75 THEN 0.8 END AS r3, CASE WHEN memory >= 0.75 THEN c_memory END AS r4, CASE WHEN neighbors < 5 THEN 0.9 END AS r5, CASE WHEN tend IS NOT NULL THEN (c_draw_signal + tend) / 2 END AS r6 FROM b),
q AS (SELECT *, CASE WHEN r6 IS NOT NULL AND r2 IS NOT NULL THEN least(r6, r2) END AS r7,
  CASE WHEN favorite_pressure >= 0.5 AND disagreement >= 0.2 THEN round(least(1, (favorite_pressure + disagreement) / 2), 6) END AS k1, CASE WHEN scoring_signal >= 0.6 AND low IS NOT NULL THEN round(least(1, greatest(scoring_signal, goal_mean)), 6) END AS k2, CASE WHEN home_form >= 0.6 AND away_form >= 0.6 THEN round(least(home_form, away_form), 6) END AS k3, CASE WHEN draw_signal >= 0.3 AND h2h_draw_rate < 0.2 THEN round(draw_signal, 6) END AS k4 FROM r)""".replace("{facts}", FACTS)
_STATEMENTS = [("low-scoring-draw-stability", "r1"), ("draw-memory-convergence", "r2"), ("market-pressure-thin-memory", "r3"), ("deep-hierarchical-memory", "r4"), ("sparse-similarity-neighborhood", "r5"), ("draw-signal-behavior-link", "r6"), ("settled-draw-outlook", "r7")]
_EFFECT = {r[1]: r[6] for r in RULES}


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, FACTS)


@query("reasoning_statements", _WIDE_ROW + " " + " UNION ALL ".join(f"SELECT scope, '{r}' AS rule, round({c} + 1e-10, 6) AS confidence FROM q WHERE {c} IS NOT NULL" for r, c in _STATEMENTS))
def q_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-196: the statements that hold for each match, from behaviours that follow from its facts, with their confidence."""
    known, evidence = conclude(_facts(spark, sf_dir))
    rules = spark.createDataFrame([(r[1], r[2]) for r in RULES if r[0] > 1], "rule string, fact string")
    return known.join(F.broadcast(rules), "fact").select("scope", "rule", F.round(F.col("confidence") + 1e-10, 6).alias("confidence"))


@query("reasoning_evidence", _WIDE_ROW + f""",
x AS ({" UNION ALL ".join(f"SELECT scope, '{r}' AS rule FROM q WHERE {c} IS NOT NULL" for r, c in _STATEMENTS)}),
n AS (SELECT * FROM (VALUES {", ".join(f"('{p[0]}', '{p[1]}')" for p in PREMISES)}) AS p(rule, premise))
SELECT rule, premise, count(*) AS n FROM x JOIN n USING (rule) GROUP BY rule, premise""")
def q_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-196: edges from premises to the statements they carry, by how many matches."""
    evidence = conclude(_facts(spark, sf_dir))[1].where("layer > 1")
    return evidence.groupBy("rule", "premise").agg(F.count("*").alias("n"))


@query("reasoning_conflicts", _WIDE_ROW + " " + " UNION ALL ".join(f"SELECT scope, '{r[0]}' AS conflict, k{i + 1} AS severity FROM q WHERE k{i + 1} IS NOT NULL" for i, r in enumerate(CONFLICTS)))
def q_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-196: facts of a match that stand against each other, and how severely."""
    return conflicts(conclude(_facts(spark, sf_dir))[0])


@query("reasoning_confidence", _WIDE_ROW + f""",
z AS (SELECT *, coalesce(list_avg(list_filter([low, high, tend, resist, calm, wild], lambda x: x IS NOT NULL)), 0.4) AS behaviour, len(list_filter([low, high, tend, resist, calm, wild, r1, r2, r3, r4, r5, r6, r7], lambda x: x IS NOT NULL)) + {len(_FACTS)} AS facts, (c_scoring_signal + c_draw_signal + c_home_form + c_away_form) / 4 AS state, least(0.25, (coalesce(k1, 0) + coalesce(k2, 0) + coalesce(k3, 0) + coalesce(k4, 0)) * 0.08) AS penalty FROM q),
y AS (SELECT scope, round(greatest(0e0, least(1e0, 0.25e0 * behaviour + 0.18e0 * least(1e0, facts / 20e0) + 0.2e0 * memory + 0.12e0 * 0.5e0 + 0.1e0 * state - penalty)) + 1e-10, 6) AS score, round({" + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {_EFFECT[r]} END" for r, c in _STATEMENTS)}, 6) AS uncertainty_effect FROM z)
SELECT scope, score, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS level, uncertainty_effect FROM y""")
def q_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-196: confidence of each match's report by its parts, less by its conflicts; what its statements do to uncertainty."""
    known, evidence = conclude(_facts(spark, sf_dir))
    return confidence(known, evidence, conflicts(known))
