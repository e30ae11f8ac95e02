"""History as it was known at a time: profiles as versions, and as-of joins of rows to the version before them.

A log of closed outcomes becomes versions of each key's running measures: a version holds from the instant of the
outcome that made it until the next. A row is joined to the last version strictly before its own instant, so no trend
sees its own outcome or one of the same moment.

The join is one sort instead of a range join: rows and versions of a key go through one window in the order of time.
A hot key is split by days: of each day only the version that it left behind is needed by later days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.registry import query, run_sql

#: The most samples that a profile of a competition has to lack before that of all competitions stands in.
MIN_SAMPLE = 5


def as_of(rows: DataFrame, versions: DataFrame, keys: list[str], at: str, valid_from: str, name: str) -> DataFrame:
    """``rows`` with a struct ``name``: the other columns of the last version of the keys strictly before ``at``, or null.

    Null keys and null times have no version. Of versions of one instant the greatest counts.
    """
    measures = [c for c in versions.columns if c not in (*keys, valid_from)]
    v = versions.dropna(subset=[*keys, valid_from]).groupBy(*keys, valid_from).agg(F.max(F.struct(*measures)).alias("_v")).withColumn("_day", F.to_date(valid_from))
    left = rows.withColumn("_day", F.to_date(at))
    left_by = v.groupBy(*keys, "_day").agg(F.max_by("_v", valid_from).alias("_last"))
    days = left.select(*keys, "_day").distinct().join(left_by, [*keys, "_day"], "full")
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).select(*keys, "_day", "_carry")
    both = left.select(*keys, "_day", F.col(at).alias("_at"), F.lit(0).alias("_order"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(v.schema["_v"].dataType).alias("_v"))
    both = both.unionByName(v.select(*keys, "_day", F.col(valid_from).alias("_at"), F.lit(1).alias("_order"), F.lit(None).cast(rows.select(F.struct(*rows.columns).alias("r")).schema["r"].dataType).alias("_row"), "_v"))
    within = Window.partitionBy(*keys, "_day").orderBy("_at", "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_here", F.last("_v", ignorenulls=True).over(within)).where(F.col("_row").isNotNull())
    return found.join(carried, [*keys, "_day"], "left").select("_row.*", F.coalesce("_here", "_carry").alias(name))


def outcome_versions(log: DataFrame, keys: list[str], closed_at: str = "closed_at") -> DataFrame:
    """Running counts of outcomes, their durations, confidence and strength by key, valid from each closing on."""
    one = lambda kind: F.sum(F.when(F.col("outcome") == kind, 1).otherwise(0))
    per = log.groupBy(*keys, closed_at).agg(F.count("*").alias("n"), *[one(k).alias(k) for k in ("confirmed", "failed", "expired")], F.sum("duration_seconds").alias("duration"), F.sum("confidence").alias("confidence"), F.sum("strength").alias("strength"))
    so_far = Window.partitionBy(*keys).orderBy(closed_at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.select(*keys, closed_at, *[F.sum(c).over(so_far).alias(c) for c in ("n", "confirmed", "failed", "expired", "duration", "confidence", "strength")])


def regime_versions(log: DataFrame, closed_at: str = "closed_at") -> DataFrame:
    """(competition, known_at, regime): the regime that a month's outcomes show, known from the next month on; only changes."""
    month = F.date_trunc("MONTH", closed_at)
    per = log.groupBy("competition", month.alias("month")).agg(F.avg(F.when(F.col("outcome") == "failed", 1.0).otherwise(0.0)).alias("failed"), F.avg("confidence").alias("sure"))
    regime = F.when(F.round("failed", 9) >= 0.3, "VOLATILE").when(F.round("sure", 9) >= 0.52, "HIGH_CONFIDENCE").otherwise("STABLE")
    named = per.select("competition", (F.col("month") + F.expr("INTERVAL '1' MONTH")).cast(log.schema[closed_at].dataType).alias("known_at"), regime.alias("regime"))
    before = F.lag("regime").over(Window.partitionBy("competition").orderBy("known_at"))
    return named.withColumn("_b", before).where(~F.col("regime").eqNullSafe(F.col("_b"))).drop("_b")


def enriched(trends: DataFrame, log: DataFrame) -> DataFrame:
    """Trends with five profiles, each as it was known when the trend was found: outcomes of the type in its competition,
    or of all competitions below ``MIN_SAMPLE``; pattern memory; how long such trends lasted; the competition; its regime."""
    typed = as_of(trends, outcome_versions(log, ["trend_type", "competition"]), ["trend_type", "competition"], "detected_at", "closed_at", "own")
    typed = as_of(typed, outcome_versions(log, ["trend_type"]), ["trend_type"], "detected_at", "closed_at", "every")
    typed = as_of(typed, outcome_versions(log, ["competition"]), ["competition"], "detected_at", "closed_at", "place")
    typed = as_of(typed, regime_versions(log), ["competition"], "detected_at", "known_at", "mood")
    scoped = F.coalesce(F.col("own.n") >= MIN_SAMPLE, F.lit(False))
    profile = F.when(scoped, F.col("own")).when(F.col("every.n") >= MIN_SAMPLE, F.col("every"))
    out = typed.withColumn("scope", F.when(scoped, "competition").when(F.col("every.n") >= MIN_SAMPLE, "global")).withColumn("profile", profile)
    rate = lambda c, n="profile.n": F.round(F.col(c) / F.col(n), 4)
    return out.select(
        *trends.columns,
        "scope",
        F.col("profile.n").alias("sample"),
        rate("profile.confirmed").alias("confirmed_rate"),
        rate("profile.failed").alias("failed_rate"),
        rate("profile.expired").alias("expired_rate"),
        F.coalesce("own.n", F.lit(0)).alias("occurrences"),
        F.round(F.col("own.strength") / F.col("own.n") + 1e-9, 4).alias("memory_strength"),
        F.round(F.col("profile.duration") / F.col("profile.n") + 1e-9, 2).alias("mean_seconds"),
        F.coalesce("place.n", F.lit(0)).alias("competition_trends"),
        F.round(F.col("place.confidence") / F.col("place.n") + 1e-9, 4).alias("competition_confidence"),
        F.col("mood.regime").alias("regime"),
    )


# Single-member fusions, the trend they take and what has to hold of its history.
ALIGNMENT = ("strong_historical_alignment", "market_conviction", 0.7)
VOLATILITY = ("structural_volatility", "recurring_volatility", "VOLATILE")
COOLDOWN_SECONDS = 600


def fusions(found: DataFrame) -> DataFrame:
    """Single-member fusions of enriched trends, one of a kind at an instant of a match and none within the cooldown of another.

    A match's trends of one kind lie behind each other; a fusion fires if the last that *fired* is far enough away. With
    gaps below the cooldown that is a chain, which a window cannot follow: it is folded over the match's few rows.
    """
    kind = F.when((F.col("trend_type") == ALIGNMENT[1]) & (F.col("confirmed_rate") > ALIGNMENT[2]), ALIGNMENT[0]).when((F.col("trend_type") == VOLATILITY[1]) & (F.col("regime") == VOLATILITY[2]), VOLATILITY[0])
    can = found.withColumn("fusion", kind).where(F.col("fusion").isNotNull())
    firsts = can.groupBy("match_id", "fusion", "detected_at").agg(F.min(F.struct("trend_id", F.least(F.lit(1.0), F.col("confidence") + 0.1).alias("confidence"), F.col("strength").alias("strength"))).alias("t"))
    second = F.unix_micros(F.col("detected_at").cast("timestamp")) / 1e6
    entry = F.struct(second.alias("s"), F.col("t.trend_id").alias("trend_id"), F.col("t.confidence").alias("confidence"), F.col("t.strength").alias("strength"))
    rows = firsts.groupBy("match_id", "fusion").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    step = lambda acc, r: F.when((F.size(acc) == 0) | (r["s"] - F.try_element_at(acc, F.lit(-1))["s"] >= COOLDOWN_SECONDS), F.concat(acc, F.array(r))).otherwise(acc)
    fired = rows.withColumn("fired", F.aggregate("rows", F.slice("rows", 1, 0), step))
    return fired.select("match_id", "fusion", F.explode("fired").alias("f")).select("match_id", "fusion", "f.trend_id", F.round("f.confidence", 6).alias("confidence"), F.round("f.strength", 6).alias("strength"))


#: Order lines as trends that were found some minutes to days before they closed; how often they are confirmed differs by competition.
INSTANCES = """(SELECT l_orderkey * 10 + l_linenumber AS trend_id, l_orderkey % 2000 AS match_id, l_suppkey % 20 AS competition,
  CASE WHEN l_linenumber <= 2 THEN 'market_conviction' WHEN l_linenumber = 3 THEN 'recurring_volatility' WHEN l_linenumber = 4 THEN 'pressure_building' WHEN l_linenumber = 5 THEN 'momentum_shift' ELSE 'tempo_change' END AS trend_type,
  CASE WHEN (l_partkey + l_linenumber) % 10 < 3 + l_suppkey % 6 THEN 'confirmed' WHEN (l_partkey + l_linenumber) % 10 < 9 THEN 'failed' ELSE 'expired' END AS outcome,
  l_quantity * 3600 AS duration_seconds, l_discount * 10 AS confidence, l_tax * 12 AS strength, l_shipdate AS closed_at, l_shipdate - CAST(l_quantity AS INT) * INTERVAL '1' HOUR AS detected_at
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount, min(l_tax) AS l_tax, min(l_shipdate) AS l_shipdate FROM {lineitem} GROUP BY l_orderkey, l_linenumber) l)"""

_KNOWN = f"""
WITH t AS MATERIALIZED (SELECT * FROM {INSTANCES}),
h AS (SELECT competition, date_trunc('month', closed_at) + INTERVAL 1 MONTH AS known_at, CASE WHEN round(avg(CASE WHEN outcome = 'failed' THEN 1e0 ELSE 0 END), 9) >= 0.3 THEN 'VOLATILE' WHEN round(avg(confidence), 9) >= 0.52 THEN 'HIGH_CONFIDENCE' ELSE 'STABLE' END AS regime FROM t GROUP BY 1, 2),
own AS (SELECT a.trend_id, count(b.outcome) AS n, count(*) FILTER (WHERE b.outcome = 'confirmed') AS c, count(*) FILTER (WHERE b.outcome = 'failed') AS f, count(*) FILTER (WHERE b.outcome = 'expired') AS x, sum(b.duration_seconds) AS d, sum(b.strength) AS s FROM t a LEFT JOIN t b ON b.trend_type = a.trend_type AND b.competition = a.competition AND b.closed_at < a.detected_at GROUP BY a.trend_id),
k AS (SELECT t.*, own.n AS on_, own.c AS oc, own.f AS of_, own.x AS ox, own.d AS od, own.s AS os,
  (SELECT struct_pack(n := count(*), c := count(*) FILTER (WHERE b.outcome = 'confirmed'), f := count(*) FILTER (WHERE b.outcome = 'failed'), x := count(*) FILTER (WHERE b.outcome = 'expired'), d := sum(b.duration_seconds)) FROM t b WHERE b.trend_type = t.trend_type AND b.closed_at < t.detected_at) AS e,
  (SELECT struct_pack(n := count(*), s := sum(b.confidence)) FROM t b WHERE b.competition = t.competition AND b.closed_at < t.detected_at) AS p,
  (SELECT max_by(regime, known_at) FROM h WHERE h.competition = t.competition AND h.known_at < t.detected_at) AS regime FROM t JOIN own USING (trend_id)),
z AS (SELECT *, CASE WHEN on_ >= {MIN_SAMPLE} THEN 'competition' WHEN e.n >= {MIN_SAMPLE} THEN 'global' END AS scope FROM k),
w AS (SELECT trend_id, match_id, trend_type, detected_at, confidence, strength, scope, CASE scope WHEN 'competition' THEN on_ WHEN 'global' THEN e.n END AS sample, round(CASE scope WHEN 'competition' THEN oc / on_ WHEN 'global' THEN e.c / e.n END, 4) AS confirmed_rate, round(CASE scope WHEN 'competition' THEN of_ / on_ WHEN 'global' THEN e.f / e.n END, 4) AS failed_rate,
  round(CASE scope WHEN 'competition' THEN ox / on_ WHEN 'global' THEN e.x / e.n END, 4) AS expired_rate, on_ AS occurrences, CASE WHEN on_ > 0 THEN round(os / on_ + 1e-9, 4) END AS memory_strength, round(CASE scope WHEN 'competition' THEN od / on_ WHEN 'global' THEN e.d / e.n END + 1e-9, 2) AS mean_seconds, p.n AS competition_trends, CASE WHEN p.n > 0 THEN round(p.s / p.n + 1e-9, 4) END AS competition_confidence, regime FROM z)"""
_PROFILE = ("trend_id", "scope", "sample", "confirmed_rate", "failed_rate", "expired_rate", "occurrences", "memory_strength", "mean_seconds", "competition_trends", "competition_confidence", "regime")


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = run_sql(spark, sf_dir, f"SELECT * FROM {INSTANCES} i")
    return enriched(t.select("trend_id", "match_id", "competition", "trend_type", "confidence", "strength", "detected_at"), t)


@query("trend_known_profiles", _KNOWN + f" SELECT {', '.join(_PROFILE)} FROM w")
def q_known_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-182, O-68, O-69: five profiles of each trend as they were known when it was found."""
    return _enriched(spark, sf_dir).select(*_PROFILE)


@query("trend_history_fusions", _KNOWN.replace("WITH t AS", "WITH RECURSIVE t AS", 1) + f""",
c AS (SELECT match_id, CASE WHEN trend_type = '{ALIGNMENT[1]}' AND confirmed_rate > {ALIGNMENT[2]} THEN '{ALIGNMENT[0]}' WHEN trend_type = '{VOLATILITY[1]}' AND regime = '{VOLATILITY[2]}' THEN '{VOLATILITY[0]}' END AS fusion, detected_at, trend_id, confidence, strength FROM w),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY match_id, fusion ORDER BY detected_at, trend_id) AS i FROM c WHERE fusion IS NOT NULL),
r AS (SELECT match_id, fusion, i, trend_id, confidence, strength, detected_at AS fired, true AS fires FROM o WHERE i = 1 UNION ALL
  SELECT o.match_id, o.fusion, o.i, o.trend_id, o.confidence, o.strength, CASE WHEN o.detected_at - r.fired >= INTERVAL {COOLDOWN_SECONDS} SECOND THEN o.detected_at ELSE r.fired END, o.detected_at - r.fired >= INTERVAL {COOLDOWN_SECONDS} SECOND FROM r JOIN o ON o.match_id = r.match_id AND o.fusion = r.fusion AND o.i = r.i + 1)
SELECT match_id, fusion, trend_id, round(least(1.0, confidence + 0.1), 6) AS confidence, round(strength, 6) AS strength FROM r WHERE fires""")
def q_history_fusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-177: fusions of one trend with its history: a confirmed rate above 0.7, or a volatile regime; with the cooldown of a match."""
    return fusions(_enriched(spark, sf_dir))
