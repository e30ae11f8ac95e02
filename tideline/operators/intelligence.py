"""Intelligence of a scope (a competition's year) from its finished matches: market, uncertainty, signals, trends, regime, behaviours.

All that the engines need of a scope are sums over its matches, some over its last five or ten only. One window ranks
the matches from the latest, one aggregation makes a row a scope; every engine is an expression over that row, so no
engine reads the matches again. Signals pass through the stages of ``signals``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.operators.projection import _FEATURES, _ORACLE_FRAMED, _ORACLE_TABLE, _X, FRAMED, ODDS, market
from tideline.operators.signals import clamp, signal_states, summary
from tideline.registry import query, run_sql
from tideline.session import written

# Fixed values: (trend, change that counts)
TRENDS = [("draw_trend", 0.06), ("goal_trend", 0.25), ("volatility_trend", 0.20), ("favorite_trend", 0.04), ("market_trend", 0.01)]
# The signals of a scope and their types; those of the market only where there are odds.
SIGNALS = [("home_form", "form"), ("away_form", "form"), ("momentum", "momentum"), ("streak", "form"), ("favorite_pressure", "market"), ("market_consensus", "market"), ("market_disagreement", "market"), ("competition_volatility", "volatility"), ("draw_tendency", "behavior"), ("scoring_tendency", "behavior"), ("defensive_instability", "behavior"), ("goal_distribution", "behavior")]
RECENT = 10


def _spread(x: Column, cond: Column | None = None) -> Column:
    """Population standard deviation of the values where ``cond`` holds, 0 of fewer than two."""
    return F.coalesce(F.stddev_pop(x if cond is None else F.when(cond, x)), F.lit(0.0))


def scopes(rows: DataFrame) -> DataFrame:
    """One row a scope. Columns of ``rows``: scope, kickoff_at, uid, label, goals, sources, five features, odds of two phases."""
    latest = rows.withColumn("rn", F.row_number().over(Window.partitionBy("scope").orderBy(F.col("kickoff_at").desc(), F.col("uid").desc())))
    odds = F.col("closing_home").isNotNull()
    sides = ("home", "draw", "away")
    whole = lambda p: sum((1 / F.col(f"{p}_{c}") for c in sides[1:]), 1 / F.col(f"{p}_home"))
    opened, closed = ([1 / F.col(f"{p}_{c}") / whole(p) for c in sides] for p in ("opening", "closing"))
    moved = [b - a for a, b in zip(opened, closed, strict=True)]
    most = F.greatest(*opened)
    latest = latest.withColumns({"shift": F.when(opened[0] == most, moved[0]).when(opened[1] == most, moved[1]).otherwise(moved[2]), "fav": F.greatest(*closed), "home_move": 1 / F.col("closing_home") - 1 / F.col("opening_home"), "m0": moved[0], "m1": moved[1], "m2": moved[2]})
    mean = sum((F.col(c) for c in ("m1", "m2")), F.col("m0")) / 3
    latest = latest.withColumn("dispersion", F.sqrt(sum(((F.col(c) - mean) ** 2 for c in ("m1", "m2")), (F.col("m0") - mean) ** 2) / 3))
    last = lambda n: F.col("rn") <= n
    recent = lambda c: F.coalesce(F.avg(F.when(last(RECENT), F.col(c))), F.lit(0.0)).alias(c)
    draw = F.when(F.col("label") == "DRAW", 1.0).otherwise(0.0)
    out = [F.count("*").alias("n"), F.avg(draw).alias("draw_rate"), F.avg("goals").alias("goal_mean"), _spread(F.col("goals")).alias("goal_spread"), F.count("closing_home").alias("with_odds"), F.size(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources")]
    out += [recent(c) for c in ("home_points_5", "away_points_5", "form_strength_gap", "home_goals_against_5", "away_goals_against_5")]
    out += [F.coalesce(F.avg("shift"), F.lit(0.0)).alias("shift"), _spread(F.col("shift")).alias("shift_spread"), F.coalesce(F.avg(F.abs("shift")), F.lit(0.0)).alias("shift_size"), F.avg("dispersion").alias("dispersion"), F.avg("fav").alias("favourite")]
    for n in (5, 10, None):
        here = F.lit(True) if n is None else last(n)
        over = lambda x, here=here: F.coalesce(F.avg(F.when(here, x)), F.lit(0.0))
        tag = n or "all"
        out += [over(draw).alias(f"draw_trend_{tag}"), over(F.col("goals")).alias(f"goal_trend_{tag}"), _spread(F.col("goals"), here).alias(f"volatility_trend_{tag}"), over(F.when(odds, F.col("fav"))).alias(f"favorite_trend_{tag}"), over(F.when(odds, F.col("home_move"))).alias(f"market_trend_{tag}")]
    out.append(F.sort_array(F.collect_list(F.when(last(RECENT), F.struct((-F.col("rn")).alias("o"), "label")))).alias("labels"))
    one = latest.groupBy("scope").agg(*out)
    # the longest run of one label among the last ten
    run = F.aggregate("labels", F.struct(F.lit("").alias("label"), F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, x: F.struct(x["label"].alias("label"), F.when(a["label"] == x["label"], a["now"] + 1).otherwise(1).alias("now"), F.greatest(a["most"], F.when(a["label"] == x["label"], a["now"] + 1).otherwise(1)).alias("most")))
    coverage = F.col("with_odds") / F.col("n")
    has = F.col("with_odds") > 0
    one = one.withColumns({
        "streak": run["most"] / F.greatest(F.size("labels"), F.lit(1)),
        "odds_coverage": coverage,
        "pressure": F.when(has, F.round(F.least(F.lit(1.0), F.col("favourite")), 6)).otherwise(0.0),
        "disagreement": F.when(has, F.round(F.least(F.lit(1.0), F.col("dispersion") / 0.08), 6)).otherwise(0.0),
        "market_confidence": F.when(has, F.round(F.least(F.lit(0.95), 0.45 + 0.4 * coverage + 0.15 * F.least(F.lit(1.0), F.col("with_odds") / 100)), 6)),
        "sure": F.least(F.lit(0.95), 0.4 + 0.4 * F.least(F.lit(1.0), F.col("n") / 100) + 0.15 * F.least(F.lit(1.0), F.col("sources") / 2)),
    })
    return one.drop("labels")


def uncertainty(one: DataFrame, unavailable: int = 1, conflicts: Column | None = None) -> Column:
    """The mean of what is missing: odds, sample, a second source, agreement, conflicts, inputs that are not there."""
    n, c = F.col("n"), F.col("odds_coverage")
    conflicts = F.when((F.col("pressure") >= 0.65) & (F.col("disagreement") >= 0.5), 1).otherwise(0) if conflicts is None else conflicts
    parts = F.array(
        F.when(c <= 0, 1.0).when(c < 0.5, 1.0 - c).otherwise(F.greatest(F.lit(0.0), 0.5 - c)),
        F.when(n < 25, 1.0 - n / 25.0).when(n < 100, (100 - n) / 150.0),
        F.when(F.col("sources") < 2, 0.5),
        F.when(F.col("disagreement") > 0.55, F.least(F.lit(1.0), F.col("disagreement"))),
        F.when(conflicts > 0, F.least(F.lit(1.0), 0.2 * conflicts)),
        *[F.lit(0.35)] * unavailable,
    )
    held = F.filter(parts, lambda x: x.isNotNull())
    return F.round(F.least(F.lit(1.0), F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(held), F.lit(1))), 6)


def signals(one: DataFrame) -> DataFrame:
    """(scope, name, signal_type, strength, confidence): twelve signals, nine where no match has odds."""
    sure, odds = F.col("sure"), F.col("sure") * F.col("odds_coverage")
    strength = {"home_form": F.col("home_points_5"), "away_form": F.col("away_points_5"), "momentum": F.abs("form_strength_gap"), "streak": F.col("streak"), "favorite_pressure": F.col("pressure"), "market_consensus": 1 - F.col("disagreement"), "market_disagreement": F.col("disagreement"), "competition_volatility": F.col("goal_spread") / 2.5, "draw_tendency": F.col("draw_rate"), "scoring_tendency": F.col("goal_mean") / 4, "defensive_instability": (F.col("home_goals_against_5") + F.col("away_goals_against_5")) / 5, "goal_distribution": F.col("goal_spread") / 2.5}
    entry = lambda n, t: F.struct(F.lit(n).alias("name"), F.lit(t).alias("signal_type"), F.round(clamp(strength[n]), 6).alias("strength"), F.round(clamp(odds if t == "market" else sure), 6).alias("confidence"))
    each = one.select("scope", "with_odds", "sources", F.explode(F.array(*[entry(n, t) for n, t in SIGNALS])).alias("s"))
    return each.where("s.signal_type <> 'market' OR with_odds > 0").select("scope", "sources", "s.*")


def trends(one: DataFrame) -> DataFrame:
    """(scope, trend, direction, strength, confidence): the last five or ten against all, whichever differs more."""
    def entry(name: str, least: float) -> Column:
        all_ = F.col(f"{name}_all")
        five, ten = F.col(f"{name}_5") - all_, F.col(f"{name}_10") - all_
        wide = (F.col("n") >= 10) & (F.abs(ten) >= F.abs(five))
        delta = F.when(wide, ten).otherwise(five)
        size = F.when(wide, 10).otherwise(5)
        direction = F.when(F.round(delta, 9) > least, "rising").when(F.round(delta, 9) < -least, "falling").otherwise("stable")
        confidence = F.least(F.lit(0.95), 0.5 + 0.025 * size + 0.2 * F.least(F.lit(1.0), F.col("n") / 100))
        return F.struct(F.lit(name).alias("trend"), direction.alias("direction"), F.round(F.least(F.lit(1.0), F.abs(delta) / (least * 3)), 6).alias("strength"), F.round(confidence, 6).alias("confidence"))

    each = one.where("n >= 5").select("scope", "with_odds", F.explode(F.array(*[entry(*t) for t in TRENDS])).alias("t"))
    return each.where("t.trend NOT IN ('favorite_trend', 'market_trend') OR with_odds >= 5").select("scope", "t.*")


def behaviours(one: DataFrame, states: DataFrame, moves: DataFrame, similar: DataFrame) -> DataFrame:
    """(scope, behaviour, strength, occurrences, confidence, uncertainty). ``similar`` has of each scope's analogues: sample,
    average_goals, under (at most two goals), draws, wild and calm (contexts of high and low volatility), pressed, likeness."""
    own = states.where("state.active").groupBy("scope").agg(*[F.max(F.when(F.col("signal_key") == k, F.col("state.strength"))).alias(f"s_{k}") for k in ("draw_tendency", "competition_volatility")])
    move = lambda t, d: F.max(F.when((F.col("trend") == t) & (F.col("direction") == d), F.col("strength") * 0.8)).alias(t)
    turned = moves.groupBy("scope").agg(move("goal_trend", "falling"), move("draw_trend", "rising"), move("volatility_trend", "rising"))
    doubt = one.select("scope", "pressure", "disagreement", "market_confidence", uncertainty(one).alias("doubt"))
    all_ = doubt.join(own, "scope", "left").join(turned, "scope", "left").join(similar, "scope", "left").na.fill(0)
    sample = F.col("sample")
    share = lambda c: F.when(sample > 0, F.col(c) / sample).otherwise(0.0)
    low = F.greatest(share("under"), (3.0 - F.col("average_goals")) / 1.5, F.col("goal_trend"))
    draws = F.greatest(share("draws"), F.col("s_draw_tendency"), F.col("draw_trend"))
    wild = F.greatest(F.col("s_competition_volatility"), F.col("volatility_trend"))
    other = F.when(F.col("market_confidence") > 0, F.col("market_confidence")).otherwise(0.4)
    entry = lambda name, when, strength, n, support=other: F.when(when, F.struct(F.lit(name).alias("behaviour"), F.round(clamp(strength), 6).alias("strength"), n.cast("long").alias("occurrences"), support.alias("support")))
    found = F.array(
        entry("low_scoring", (F.col("average_goals") <= 2.5) | (share("under") >= 0.55), low, F.col("under")),
        entry("draw_tendency", draws >= 0.25, draws, F.col("draws")),
        entry("draw_resistance", (draws < 0.25) & (sample > 0), 1 - draws, sample - F.col("draws")),
        entry("favorite_pressure", F.col("pressure") >= 0.5, F.col("pressure"), F.col("pressed"), F.col("market_confidence")),
        entry("chaotic", wild >= 0.8, wild, F.col("wild")),
        entry("volatile", (wild >= 0.6) & (wild < 0.8), wild, F.col("wild")),
        entry("stable", wild < 0.6, 1 - wild, F.col("calm")),
        entry("market_disagreement", F.col("disagreement") >= 0.2, F.col("disagreement"), F.col("pressed"), F.col("market_confidence")),
    )
    each = all_.select("scope", "sample", "likeness", "doubt", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("b")).select("*", "b.*")
    sure = clamp(0.4 * F.col("likeness") + 0.25 * F.least(F.lit(1.0), sample / 25.0) + 0.2 * F.col("support") + 0.15 * (1 - F.col("doubt")))
    each = each.withColumn("confidence", sure)
    return each.select("scope", "behaviour", "strength", "occurrences", F.round("confidence", 6).alias("confidence"), F.round(clamp(0.55 * (1 - F.col("confidence")) + 0.45 * F.col("doubt")), 6).alias("uncertainty"))


def regime(one: DataFrame) -> DataFrame:
    """(scope, what is expected, risks, confidence) of a scope's structure."""
    c, n = F.col("odds_coverage"), F.col("n")
    expected = F.array(F.when(F.col("draw_rate") >= 0.28, "higher draw behavior").otherwise("lower draw behavior"), F.when(F.col("goal_spread") >= 1.8, "higher volatility").otherwise("more stable scoring"), F.when(c >= 0.75, "higher market efficiency").otherwise("market efficiency cannot be established"), F.when((c >= 0.5) & (n >= 100), "higher confidence").otherwise("lower confidence"))
    risks = F.filter(F.array(F.when(c < 0.5, "low market coverage"), F.when(n < 100, "limited regime sample")), lambda x: x.isNotNull())
    return one.select("scope", F.array_join(expected, "; ").alias("expected"), F.array_join(risks, "; ").alias("risks"), F.round(F.least(F.lit(0.95), 0.45 + 0.35 * F.least(F.lit(1.0), n / 100) + 0.2 * c), 6).alias("regime_confidence"))


_BASE = ("uid", "scope", "kickoff_at", "label", "goals", "season", "competition")
_MATCH_SQL = "SELECT uid, concat(CAST(competition AS [[STRING||VARCHAR]]), ':', CAST(year(kickoff_at) AS [[STRING||VARCHAR]])) AS scope, kickoff_at, CASE WHEN home_goals > away_goals THEN 'HOME_WIN' WHEN home_goals = away_goals THEN 'DRAW' ELSE 'AWAY_WIN' END AS label, CAST(home_goals + away_goals AS DOUBLE) AS goals, year(kickoff_at) AS season, competition, uid % 2 AS second_source FROM {matches}"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = run_sql(spark, sf_dir, FRAMED + _X + f" SELECT uid, {', '.join(f for f in _FEATURES if f.split(' AS ')[1] in ('home_points_5', 'away_points_5', 'form_strength_gap', 'home_goals_against_5', 'away_goals_against_5'))} FROM x")
    m = run_sql(spark, sf_dir, _MATCH_SQL).withColumn("sources", F.when(F.col("second_source") == 1, F.array(F.lit("alpha"), F.lit("beta"))).otherwise(F.array(F.lit("alpha"))))
    return m.join(framed, "uid").join(market(run_sql(spark, sf_dir, f"SELECT * FROM {ODDS} o")), "uid", "left")


def _scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(scopes(_rows(spark, sf_dir)), "scopes")


def _states(one: DataFrame) -> DataFrame:
    s = signals(one).select("scope", F.col("name").alias("signal_id"), "name", "signal_type", "strength", "confidence", F.col("strength").alias("weight"), F.lit(None).cast("timestamp").alias("generated_at"), F.lit(None).cast("timestamp").alias("expires_at"), (F.col("sources") / F.greatest(F.lit(2), F.col("sources"))).alias("coverage"), "sources")
    return signal_states(s, F.current_timestamp())


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scope's analogues: the matches of its competition in the two years before."""
    m = run_sql(spark, sf_dir, _MATCH_SQL)
    ahead = m.withColumn("year", F.explode(F.array(F.col("season") + 1, F.col("season") + 2)))
    n = lambda cond: F.count(F.when(cond, 1))
    g = F.col("goals")
    return ahead.groupBy(F.concat(F.col("competition").cast("string"), F.lit(":"), F.col("year").cast("string")).alias("scope")).agg(F.count("*").alias("sample"), F.avg("goals").alias("average_goals"), n(g <= 2).alias("under"), n(F.col("label") == "DRAW").alias("draws"), n(g >= 5).alias("wild"), n(g <= 4).alias("calm"), n(g == 0).alias("pressed"), F.round(F.least(F.lit(0.9), 0.4 + F.count("*") / 2000), 6).alias("likeness"))


_AL = _ORACLE_FRAMED + _X + _ORACLE_TABLE + f""",
al AS (SELECT x.uid, {', '.join(_FEATURES)} FROM x),
mm AS ({_MATCH_SQL}),
im AS (SELECT *, 1 / opening_home + 1 / opening_draw + 1 / opening_away AS wo FROM mk),
mv AS (SELECT *, [1 / opening_home / wo, 1 / opening_draw / wo, 1 / opening_away / wo] AS op, [1 / closing_home / w, 1 / closing_draw / w, 1 / closing_away / w] AS cl FROM im),
dd AS (SELECT *, [cl[1] - op[1], cl[2] - op[2], cl[3] - op[3]] AS mvs FROM mv),
rr AS (SELECT mm.*, al.* EXCLUDE (uid), mvs[list_position(op, list_max(op))] AS shift, list_max(cl) AS fav, 1 / closing_home - 1 / opening_home AS hm, list_stddev_pop(mvs) AS disp, closing_home IS NOT NULL AS odds, row_number() OVER (PARTITION BY scope ORDER BY mm.kickoff_at DESC, mm.uid DESC) AS rn FROM mm JOIN al USING (uid) LEFT JOIN dd USING (uid)),
lb AS (SELECT scope, label, rn - row_number() OVER (PARTITION BY scope, label ORDER BY rn) AS grp FROM rr WHERE rn <= 10),
st AS (SELECT scope, max(c) AS run FROM (SELECT scope, count(*) AS c FROM lb GROUP BY scope, label, grp) GROUP BY scope),
sc AS (SELECT scope, count(*) AS n, avg(CASE WHEN label = 'DRAW' THEN 1e0 ELSE 0 END) AS dr, avg(goals) AS gm, stddev_pop(goals) AS gs, count(*) FILTER (WHERE odds) AS wo, 1 + max(second_source) AS src, avg(home_points_5) FILTER (WHERE rn <= 10) AS hp, avg(away_points_5) FILTER (WHERE rn <= 10) AS ap, abs(avg(form_strength_gap) FILTER (WHERE rn <= 10)) AS gap, avg(home_goals_against_5 + away_goals_against_5) FILTER (WHERE rn <= 10) AS against, avg(fav) AS favm, avg(disp) AS dm, least(10, count(*)) AS few,
  {', '.join(f"avg(CASE WHEN label = 'DRAW' THEN 1e0 ELSE 0 END) FILTER (WHERE rn <= {k}) AS draw_trend_{k}, avg(goals) FILTER (WHERE rn <= {k}) AS goal_trend_{k}, stddev_pop(goals) FILTER (WHERE rn <= {k}) AS volatility_trend_{k}, coalesce(avg(fav) FILTER (WHERE rn <= {k}), 0) AS favorite_trend_{k}, coalesce(avg(hm) FILTER (WHERE rn <= {k}), 0) AS market_trend_{k}" for k in (5, 10, 1000000000))} FROM rr GROUP BY scope),
tt AS (SELECT sc.*, run / CAST(few AS DOUBLE) AS streak, wo / CAST(n AS DOUBLE) AS cov, CASE WHEN wo > 0 THEN round(least(1, favm), 6) ELSE 0 END AS pressure, CASE WHEN wo > 0 THEN round(least(1, dm / 0.08), 6) ELSE 0 END AS dis, least(0.95, 0.4 + 0.4 * least(1, n / 100e0) + 0.15 * least(1, src / 2e0)) AS sure FROM sc JOIN st USING (scope))"""
_STRENGTHS = {"home_form": "hp", "away_form": "ap", "momentum": "gap", "streak": "streak", "favorite_pressure": "pressure", "market_consensus": "1 - dis", "market_disagreement": "dis", "competition_volatility": "gs / 2.5", "draw_tendency": "dr", "scoring_tendency": "gm / 4", "defensive_instability": "against / 5", "goal_distribution": "gs / 2.5"}


@query("intelligence_signals", _AL + " " + " UNION ALL ".join(f"SELECT scope, '{n}' AS name, '{t}' AS signal_type, round(round(greatest(0e0, least(1e0, {_STRENGTHS[n]})), 6) + 1e-9, 5) AS strength, round(round(sure{' * cov' if t == 'market' else ''}, 6) + 1e-9, 5) AS confidence FROM tt" + (" WHERE wo > 0" if t == "market" else "") for n, t in SIGNALS))
def q_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-192: twelve signals of each competition's year, with strength and confidence."""
    s = signals(_scopes(spark, sf_dir))
    return s.select("scope", "name", "signal_type", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("strength", "confidence")])


def _trend_oracle(name: str, least: float) -> str:
    return f"SELECT scope, '{name}' AS trend, CASE WHEN round(d, 9) > {least} THEN 'rising' WHEN round(d, 9) < -{least} THEN 'falling' ELSE 'stable' END AS direction, round(round(least(1, abs(d) / {least * 3}), 6) + 1e-9, 5) AS strength FROM (SELECT *, CASE WHEN n >= 10 AND abs({name}_10 - {name}_1000000000) >= abs({name}_5 - {name}_1000000000) THEN {name}_10 ELSE {name}_5 END - {name}_1000000000 AS d FROM tt WHERE n >= 5" + (" AND wo >= 5)" if name in ("favorite_trend", "market_trend") else ")")


@query("intelligence_trends", _AL + " " + " UNION ALL ".join(_trend_oracle(*t) for t in TRENDS))
def q_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-111, O-197: the last five or ten matches of a scope against all of them, by five measures."""
    return trends(_scopes(spark, sf_dir)).select("scope", "trend", "direction", F.round(F.col("strength") + 1e-9, 5).alias("strength"))


@query("intelligence_regime", _AL + """
SELECT scope, concat(CASE WHEN dr >= 0.28 THEN 'higher draw behavior' ELSE 'lower draw behavior' END, '; ', CASE WHEN gs >= 1.8 THEN 'higher volatility' ELSE 'more stable scoring' END, '; ', CASE WHEN cov >= 0.75 THEN 'higher market efficiency' ELSE 'market efficiency cannot be established' END, '; ', CASE WHEN cov >= 0.5 AND n >= 100 THEN 'higher confidence' ELSE 'lower confidence' END) AS expected,
  array_to_string(list_filter([CASE WHEN cov < 0.5 THEN 'low market coverage' END, CASE WHEN n < 100 THEN 'limited regime sample' END], lambda z: z IS NOT NULL), '; ') AS risks, round(least(0.95, 0.45 + 0.35 * least(1, n / 100e0) + 0.2 * cov), 6) AS regime_confidence,
  round(least(1, list_sum(u) / len(u)), 6) AS uncertainty FROM (SELECT *, list_filter([CASE WHEN cov <= 0 THEN 1 WHEN cov < 0.5 THEN 1 - cov ELSE greatest(0, 0.5 - cov) END, CASE WHEN n < 25 THEN 1 - n / 25e0 WHEN n < 100 THEN (100 - n) / 150e0 END, CASE WHEN src < 2 THEN 0.5 END, CASE WHEN dis > 0.55 THEN dis END, CASE WHEN pressure >= 0.65 AND dis >= 0.5 THEN 0.2 END, 0.35], lambda z: z IS NOT NULL) AS u FROM tt)""")
def q_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-195: structural regime with its risks, and the uncertainty of a report on the scope."""
    one = _scopes(spark, sf_dir)
    return regime(one).join(one.select("scope", uncertainty(one).alias("uncertainty")), "scope")


@query("intelligence_behaviours", _AL + """,
sm AS (SELECT concat(CAST(competition AS VARCHAR), ':', CAST(season + k AS VARCHAR)) AS scope, count(*) AS sample, avg(goals) AS ag, count(*) FILTER (WHERE goals <= 2) AS under, count(*) FILTER (WHERE label = 'DRAW') AS draws, count(*) FILTER (WHERE goals >= 5) AS wild, count(*) FILTER (WHERE goals <= 4) AS calm, count(*) FILTER (WHERE goals = 0) AS pressed FROM mm CROSS JOIN (SELECT unnest([1, 2]) AS k) GROUP BY 1),
tr AS (""" + " UNION ALL ".join(_trend_oracle(*t).replace(" + 1e-9, 5) AS strength", ", 6) AS strength") for t in TRENDS[:3]) + """),
bb AS (SELECT tt.*, coalesce(sample, 0) AS sample, coalesce(ag, 0) AS ag, coalesce(under, 0) AS under, coalesce(draws, 0) AS draws, coalesce(wild, 0) AS nw, coalesce(calm, 0) AS nc, coalesce(pressed, 0) AS np, coalesce((SELECT strength * 0.8 FROM tr WHERE tr.scope = tt.scope AND trend = 'draw_trend' AND direction = 'rising'), 0) AS dt, coalesce((SELECT strength * 0.8 FROM tr WHERE tr.scope = tt.scope AND trend = 'volatility_trend' AND direction = 'rising'), 0) AS vt, coalesce((SELECT strength * 0.8 FROM tr WHERE tr.scope = tt.scope AND trend = 'goal_trend' AND direction = 'falling'), 0) AS gt FROM tt LEFT JOIN sm USING (scope)),
bs AS (SELECT *, greatest(CASE WHEN sample > 0 THEN draws / CAST(sample AS DOUBLE) ELSE 0 END, round(dr, 6), dt) AS d, greatest(round(least(1, gs / 2.5), 6), vt) AS v, CASE WHEN sample > 0 THEN under / CAST(sample AS DOUBLE) ELSE 0 END AS ur FROM bb),
bf AS (SELECT scope, unnest([struct_pack(b := CASE WHEN ag <= 2.5 OR ur >= 0.55 THEN 'low_scoring' END, s := least(1, greatest(0, ur, (3.0 - ag) / 1.5, gt)), o := under), struct_pack(b := CASE WHEN d >= 0.25 THEN 'draw_tendency' END, s := least(1, d), o := draws), struct_pack(b := CASE WHEN d < 0.25 AND sample > 0 THEN 'draw_resistance' END, s := 1 - d, o := sample - draws), struct_pack(b := CASE WHEN pressure >= 0.5 THEN 'favorite_pressure' END, s := pressure, o := np),
  struct_pack(b := CASE WHEN v >= 0.8 THEN 'chaotic' END, s := v, o := nw), struct_pack(b := CASE WHEN v >= 0.6 AND v < 0.8 THEN 'volatile' END, s := v, o := nw), struct_pack(b := CASE WHEN v < 0.6 THEN 'stable' END, s := 1 - v, o := nc), struct_pack(b := CASE WHEN dis >= 0.2 THEN 'market_disagreement' END, s := dis, o := np)]) AS e FROM bs)
SELECT scope, e.b AS behaviour, round(round(e.s, 6) + 1e-9, 5) AS strength, CAST(e.o AS BIGINT) AS occurrences FROM bf WHERE e.b IS NOT NULL""")
def q_behaviours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-194: behaviours of each scope by its active signals, trends, market and analogues."""
    one = _scopes(spark, sf_dir)
    b = behaviours(one, _states(one), trends(one), _similar(spark, sf_dir))
    return b.select("scope", "behaviour", F.round(F.col("strength") + 1e-9, 5).alias("strength"), "occurrences")


@query("intelligence_report")
def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-197: one report a scope, its stages in their order: market, uncertainty, signals, their states, trends, analogues, behaviours, the uncertainty that is left."""
    one = _scopes(spark, sf_dir)
    states = written(_states(one), "states")
    told, moves = summary(states), trends(one)
    shown = behaviours(one, states, moves, _similar(spark, sf_dir)).groupBy("scope").agg(F.array_sort(F.collect_list("behaviour")).alias("behaviours"), F.round(F.avg("confidence"), 6).alias("behaviour_confidence"))
    moved = moves.where("direction <> 'stable'").groupBy("scope").agg(F.array_sort(F.collect_list(F.concat_ws(" ", "trend", "direction"))).alias("trends"))
    both = one.join(told, "scope").join(regime(one), "scope").join(moved, "scope", "left").join(shown, "scope", "left")
    conflicts = F.size("conflicting") + F.when((F.col("pressure") >= 0.65) & (F.col("disagreement") >= 0.5), 1).otherwise(0)
    left = uncertainty(both, 1, conflicts)
    return both.select("scope", "n", "pressure", "disagreement", "market_confidence", "strongest", "weakest", "conflicting", "reinforced", "stability", "trends", "expected", "risks", "regime_confidence", "behaviours", "behaviour_confidence", uncertainty(one).alias("uncertainty_before"), left.alias("uncertainty"))
