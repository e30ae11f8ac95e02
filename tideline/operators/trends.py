"""Trend detectors and the stages after them.

A detector is a filtered select over one wide tick frame (``WIDE``): each row holds a match's scores now and at its
previous tick. Detectors of one frame are unpivoted in one pass over it.
"""

from __future__ import annotations

from tideline.registry import sql_query


def clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


K = "CAST([[get_json_object(props, '$.k')||json_extract_string(props, '$.k')]] AS DOUBLE)"
#: The driver's events stand for ticks; every score is bound to a column that moves between 0 and 1.
WIDE = f"""
WITH e AS (SELECT user_id AS match_id, event_id, ts, event_type AS book, value, {K} AS k, CAST(event_id % 95 AS INT) AS minute FROM {{events}}),
s AS (SELECT *, {clamp("1 - value / 200")} AS consensus, k / 100 AS divergence, CAST(event_id % 100 AS DOUBLE) / 100 AS confidence, CAST(event_id % 37 AS DOUBLE) / 37 AS volatility,
  CAST(event_id % 21 - 10 AS DOUBLE) / 10 AS momentum, CAST(event_id % 41 - 20 AS DOUBLE) / 20 AS sentiment, {clamp("value / 150")} AS pressure, CAST(event_id % 11 AS DOUBLE) / 11 AS density,
  1 / (1 + value / 100) AS p, CASE WHEN event_id % 95 < 30 THEN 'early' WHEN event_id % 95 < 70 THEN 'middle' ELSE 'late' END AS state FROM e),
x AS (SELECT *, lag(consensus) OVER o AS consensus0, lag(divergence) OVER o AS divergence0, lag(confidence) OVER o AS confidence0, lag(volatility) OVER o AS volatility0, lag(momentum) OVER o AS momentum0,
  lag(sentiment) OVER o AS sentiment0, lag(pressure) OVER o AS pressure0, lag(density) OVER o AS density0, lag(p) OVER o AS p0, lag(state) OVER o AS state0, row_number() OVER o AS i FROM s
  WINDOW o AS (PARTITION BY match_id ORDER BY ts, event_id))"""


def branch(kind: str, where: str, direction: str, strength: str, confidence: str, source: str = "x") -> tuple[str, ...]:
    """A detector: its type, when it fires, and the direction, strength and confidence of what it finds."""
    return kind, where, f"coalesce({direction}, 0)", f"CAST({clamp(strength)} AS DOUBLE)", f"CAST({clamp(confidence)} AS DOUBLE)", source


def detect(branches: list[tuple[str, ...]]) -> str:
    """The frame ``d`` of what the detectors find: detectors of one source read it once, and a row is repeated only for those that fire."""
    parts = []
    for source in dict.fromkeys(b[5] for b in branches):
        own = [b for b in branches if b[5] == source]
        kinds = ", ".join(f"CASE WHEN {b[1]} THEN '{b[0]}' END" for b in own)
        pick = lambda i, own=own: "CASE kind " + " ".join(f"WHEN '{b[0]}' THEN {b[i]}" for b in own) + " END"
        each = f"SELECT * FROM {source} [[LATERAL VIEW explode(array_compact(array({kinds}))) k0 AS kind||CROSS JOIN LATERAL (SELECT unnest(list_filter([{kinds}], lambda z: z IS NOT NULL)) AS kind) k0]]"
        parts.append(f"SELECT match_id, event_id, ts, kind AS trend_type, CAST({pick(2)} AS INT) AS direction, {pick(3)} AS strength, {pick(4)} AS confidence FROM ({each}) f")
    return ",\nd AS (" + "\nUNION ALL ".join(parts) + ")"


def finish(branches: list[tuple[str, ...]]) -> str:
    """Detections with the severity of each strength (O-143)."""
    return detect(branches) + "\nSELECT match_id, event_id, trend_type, direction, round(strength, 6) AS strength, round(confidence, 6) AS confidence, CASE WHEN strength < 0.35 THEN 'low' WHEN strength < 0.6 THEN 'medium' WHEN strength < 0.85 THEN 'high' ELSE 'critical' END AS severity FROM d"


INTELLIGENCE = [
    branch("market_consensus_growing", "consensus - consensus0 >= 0.10", "0", "(consensus - consensus0) / 0.4", "0.5 + 0.06 * 5"),
    branch("market_consensus_weakening", "consensus - consensus0 <= -0.10", "0", "(consensus0 - consensus) / 0.4", "0.5 + 0.06 * 5"),
    branch("market_divergence", "divergence >= 0.5 AND divergence - divergence0 >= 0.10", "0", "divergence", "0.6"),
    branch("market_fragmentation", "divergence >= 0.6 AND consensus <= 0.35", "0", "divergence", "0.6 + 0.2 * (1 - consensus)"),
    branch("confidence_acceleration", "confidence - confidence0 >= 0.08", "sign(momentum)", "(confidence - confidence0) / 0.25", "0.6"),
    branch("confidence_decay", "confidence - confidence0 <= -0.08", "sign(momentum)", "(confidence0 - confidence) / 0.25", "0.6"),
    branch("volatility_increase", "volatility - volatility0 >= 0.15", "0", "(volatility - volatility0) / 0.5", "0.6"),
    branch("volatility_decrease", "volatility - volatility0 <= -0.15", "0", "(volatility0 - volatility) / 0.5", "0.6"),
    branch("sharp_market_move", "0.45 * least(1.0, abs(p - p0) / 0.06) + 0.55 * confidence >= 0.6", "sign(p - p0)", "0.45 * least(1.0, abs(p - p0) / 0.06) + 0.55 * confidence", "0.6"),
]
sql_query("trend_market_intelligence", "O-162, O-163, O-164, O-165, O-166: consensus, divergence, confidence, volatility and sharp-move trends.", WIDE + finish(INTELLIGENCE))

PULSE = [
    branch("momentum_shift", "abs(momentum - momentum0) >= 0.3 OR (momentum * momentum0 < 0)", "sign(momentum - momentum0)", "abs(momentum - momentum0)", "CASE WHEN momentum * momentum0 < 0 THEN 0.8 ELSE 0.65 END"),
    branch("pressure_building", "pressure - pressure0 >= 0.1 AND pressure >= 0.5", "0", "pressure", "0.55 + pressure - pressure0"),
    branch("tempo_change", "abs(density - density0) >= 0.3", "sign(density - density0)", "abs(density - density0)", "0.6"),
    branch("dominance_pattern", "abs(coalesce((value - k) / nullif(value + k, 0), momentum)) >= 0.4", "sign(coalesce((value - k) / nullif(value + k, 0), momentum))", "abs(coalesce((value - k) / nullif(value + k, 0), momentum))", "CASE WHEN value + k <> 0 THEN 0.75 ELSE 0.65 END"),
]
sql_query("trend_pulse", "O-167, O-168, O-169, O-170: momentum, pressure, tempo, dominance.", WIDE + finish(PULSE))

IMPACT = "CASE book WHEN 'error' THEN 0.95 WHEN 'purchase' THEN 0.7 WHEN 'signup' THEN 0.4 ELSE 0.1 END"
SENTINEL = [
    branch("impact_assessment", f"{IMPACT} >= 0.7", "0", IMPACT, "0.85"),
    branch("game_state_change", "state <> state0", "0", "0.5", "0.9"),
    branch("risk_increase", "minute >= 60 AND pressure >= 0.6 AND pressure - pressure0 >= 0.05 AND abs(p - k / 100) <= 0.3", "0", "pressure * least(minute / CAST(90 AS DOUBLE), 1.2)", "0.7"),
]
sql_query("trend_sentinel", "O-173a, O-173b, O-173c, O-183: impact, game state, risk.", WIDE + finish(SENTINEL))

ECHO = [
    branch("sentiment_shift", "abs(sentiment - sentiment0) >= 0.35", "sign(sentiment - sentiment0)", "abs(sentiment - sentiment0)", "0.6"),
    branch("narrative_conflict", "abs(sentiment) >= 0.25 AND p <> p0 AND sign(sentiment) <> sign(p - p0)", "sign(sentiment)", "abs(sentiment)", "0.65"),
    branch("community_signal", "confidence >= 0.75", "0", "confidence", "confidence * 0.8"),
]
sql_query("trend_echo", "O-174a, O-174b, O-174c: sentiment, narrative conflict, community signal.", WIDE + finish(ECHO))

NINJA = WIDE + """,
steps AS (SELECT *, abs(p - p0) AS step, count(*) OVER (PARTITION BY match_id) AS n FROM x),
base AS (SELECT match_id, max(n) AS points, avg(CASE WHEN i < n THEN step END) AS earlier, max(CASE WHEN i = n THEN step END) AS last_step, max(CASE WHEN i = n THEN p - p0 END) AS delta, max(CASE WHEN i = n THEN event_id END) AS event_id, max(ts) AS ts,
  max(CASE WHEN i = n THEN p END) - max(CASE WHEN i = 1 THEN p END) AS since_open FROM steps GROUP BY match_id),
latest AS (SELECT match_id, book, max_by(p, (ts, event_id)) AS p, max(event_id) AS event_id, max(ts) AS ts FROM x GROUP BY match_id, book),
med AS (SELECT match_id, median(p) AS m, max(p) - min(p) AS spread, CAST(count(*) AS INT) AS books, max(event_id) AS event_id, max(ts) AS ts FROM latest GROUP BY match_id),
per AS (SELECT l.match_id, l.event_id, l.ts, l.p - m.m AS dev, m.books FROM latest l JOIN med m ON l.match_id = m.match_id)"""
MARKET = [
    branch("market_shift", "abs(delta) >= 0.03", "sign(delta)", "abs(delta) / 0.15", "0.5 + 0.1 * 5", "base"),
    branch("market_acceleration", "points >= 4 AND last_step >= 0.02 AND last_step >= 2 * earlier", "sign(delta)", "last_step / (2 * earlier) / 3", "0.6", "base"),
    branch("market_disagreement", "books >= 2 AND spread >= 0.08", "0", "spread / 0.25", "0.6", "med"),
    branch("market_anomaly", "books >= 3 AND abs(dev) >= 0.10", "sign(dev)", "abs(dev) / 0.30", "0.5 + 0.1 * (books - 1)", "per"),
    branch("historical_deviation", "points >= 3 AND abs(since_open) >= 0.07", "sign(since_open)", "abs(since_open) / 0.25", "0.55 + 0.03 * points", "base"),
]
sql_query("trend_ninja", "O-158, O-159, O-160, O-161, O-171: shift, acceleration, disagreement, one row per anomalous book, deviation since the opening.", NINJA + finish(MARKET))

DETECTED = WIDE + detect(INTELLIGENCE + PULSE + SENTINEL + ECHO)
#: With the market's own detectors, and books whose moves towards a side kept being confirmed by the next tick.
FUSIBLE = NINJA + """,
nx AS (SELECT *, lead(p) OVER (PARTITION BY match_id ORDER BY ts, event_id) - p AS after FROM x),
und AS (SELECT match_id, book, max(event_id) AS event_id, max(ts) AS ts, CAST(count(*) AS INT) AS n, avg(CASE WHEN after > 0 THEN 1e0 ELSE 0e0 END) AS rate FROM nx WHERE momentum > 0 AND after IS NOT NULL GROUP BY match_id, book)""" + detect([*INTELLIGENCE, *PULSE, *SENTINEL, *ECHO, *MARKET[:2], branch("market_underestimation", "n >= 3 AND rate >= 0.7", "1", "rate", "0.4 + 0.1 * n", "und")])

# The pairs of trend types that fuse, and whether their directions must agree.
RULES = [
    ("market_conviction", "market_shift", "market_acceleration", 1),
    ("imminent_breakthrough", "pressure_building", "dominance_pattern", 0),
    ("risk_escalation", "risk_increase", "game_state_change", 0),
    ("narrative_divergence", "narrative_conflict", "market_shift", 0),
    ("market_conviction", "market_consensus_growing", "confidence_acceleration", 0),
    ("market_uncertainty", "market_fragmentation", "volatility_increase", 0),
    ("market_reaction", "sharp_market_move", "pressure_building", 0),
    ("market_correction", "market_underestimation", "sharp_market_move", 0),
]
# Fixed value: the window within which two trends of a match fuse.
FUSION_SECONDS = 600


def correlation(seconds: int = FUSION_SECONDS) -> str:
    """Each trend looks back for the latest partner of its rule within the window; so either of a pair can come first."""
    values = ", ".join(f"({k}, '{f}', '{a}', '{b}', {same})" for k, (f, a, b, same) in enumerate(RULES))
    return FUSIBLE + f""",
rules AS (SELECT * FROM (VALUES {values}) AS r(rule, fusion, a_type, b_type, same)),
sides AS (SELECT rule, fusion, a_type AS late_type, b_type AS early_type, same, 0 AS swapped FROM rules UNION ALL SELECT rule, fusion, b_type, a_type, same, 1 FROM rules),
pairs AS (SELECT a.match_id, a.event_id AS late_id, b.event_id AS early_id, fusion, swapped, a.strength AS sa, b.strength AS sb, a.confidence AS ca, b.confidence AS cb, row_number() OVER (PARTITION BY rule, swapped, a.match_id, a.event_id ORDER BY b.ts DESC, b.event_id DESC) AS rk
  FROM sides JOIN d a ON a.trend_type = late_type JOIN d b ON b.trend_type = early_type AND b.match_id = a.match_id AND b.ts BETWEEN a.ts - INTERVAL '{seconds}' SECOND AND a.ts
  WHERE (swapped = 0 OR b.ts < a.ts) AND (same = 0 OR (a.direction <> 0 AND a.direction = b.direction)))
SELECT match_id, fusion, CASE WHEN swapped = 1 THEN early_id ELSE late_id END AS a_id, CASE WHEN swapped = 1 THEN late_id ELSE early_id END AS b_id, round((sa + sb) / 2, 8) AS strength, round(least(1.0, least(ca, cb) + 0.1), 6) AS confidence FROM pairs WHERE rk = 1"""


sql_query("trend_correlation", "O-61, O-176: pairs of trends of one match within ten minutes, latest partner of each; an interval self-join on match and rule.", correlation())
sql_query("trend_correlation_hours", "O-61, O-176: the same over ten hours, as the test events of a match lie far apart.", correlation(36_000))

sql_query("trend_enriched_rules", "Strong trends of a type that mostly points one way; fusions with history (O-177) are in trend_history_fusions.", DETECTED + """,
r AS (SELECT trend_type, avg(CASE WHEN direction >= 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS rate FROM d GROUP BY trend_type)
SELECT d.match_id, d.event_id, d.trend_type, round(rate, 6) AS rate FROM d JOIN r ON d.trend_type = r.trend_type WHERE rate > 0.7 AND d.strength >= 0.85""")

SCORE = "0.45 * strength + 0.30 * confidence + CASE WHEN strength < 0.35 THEN 0.0 WHEN strength < 0.6 THEN 0.05 WHEN strength < 0.85 THEN 0.10 ELSE 0.15 END + CASE WHEN trend_type LIKE 'market%' THEN 0.05 ELSE 0.0 END"
sql_query("trend_publish_score", "O-178, O-143: sum of factors, clamped, and the tier of the score.", DETECTED + f""",
p AS (SELECT match_id, event_id, trend_type, round({clamp(SCORE)}, 6) AS score FROM d)
SELECT trend_type, CASE WHEN score < 0.30 THEN 'internal' WHEN score < 0.60 THEN 'agent' WHEN score < 0.80 THEN 'public' ELSE 'headline' END AS tier, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS score FROM p GROUP BY 1, 2""")

sql_query("trend_publication_threshold", "O-37, O-23: publish from a confidence and an impact on, with the reason of a refusal; priority by tier.", DETECTED + """,
t AS (SELECT *, CASE WHEN strength >= 0.85 THEN 3 WHEN strength >= 0.6 THEN 2 WHEN strength >= 0.35 THEN 1 ELSE 0 END AS impact FROM d)
SELECT CASE WHEN confidence < 0.7 THEN 'low_confidence' WHEN impact < 2 THEN 'low_impact' ELSE 'publish' END AS decision, trend_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN impact = 3 THEN 1 ELSE 0 END) AS BIGINT) AS priority FROM t GROUP BY 1, 2""")

sql_query("trend_coherence", "O-179: signed strength by dimension, pairwise sign agreement times coverage.", DETECTED + """,
c AS (SELECT match_id, round(sum(CASE WHEN trend_type LIKE 'market%' OR trend_type LIKE 'sharp%' OR trend_type LIKE 'confidence%' THEN direction * strength ELSE 0 END), 6) AS market, round(sum(CASE WHEN trend_type IN ('momentum_shift', 'dominance_pattern') THEN direction * strength ELSE 0 END), 6) AS game,
  round(sum(CASE WHEN trend_type = 'tempo_change' THEN direction * strength ELSE 0 END), 6) AS risk, round(sum(CASE WHEN trend_type IN ('sentiment_shift', 'narrative_conflict') THEN direction * strength ELSE 0 END), 6) AS narrative FROM d GROUP BY match_id),
z AS (SELECT match_id, CASE WHEN market <> 0 THEN 1 ELSE 0 END + CASE WHEN game <> 0 THEN 1 ELSE 0 END + CASE WHEN risk <> 0 THEN 1 ELSE 0 END + CASE WHEN narrative <> 0 THEN 1 ELSE 0 END AS n,
  CASE WHEN market > 0 THEN 1 ELSE 0 END + CASE WHEN game > 0 THEN 1 ELSE 0 END + CASE WHEN risk > 0 THEN 1 ELSE 0 END + CASE WHEN narrative > 0 THEN 1 ELSE 0 END AS up FROM c)
SELECT match_id, CASE WHEN n < 2 THEN 0.5e0 ELSE round((up * (up - 1) + (n - up) * (n - up - 1)) / CAST(n * (n - 1) AS DOUBLE) * (0.5 + 0.5 * n / CAST(4 AS DOUBLE)), 6) END AS coherence FROM z""")

# Cut-offs of the regimes.
REGIME = {"fragmented": 0.30, "volatile": 0.30, "event": 0.40, "momentum": 0.40, "high_confidence": 0.75, "low_confidence": 0.45}


def regimes(**cuts: float) -> str:
    """The first regime of a competition and day that matches."""
    cut = REGIME | cuts
    return WIDE + f""",
c AS (SELECT book AS competition, CAST([[date_trunc('DAY', ts)||date_trunc('day', ts)]] AS TIMESTAMP[[_NTZ||]]) AS day, round(avg(divergence), 9) AS fragmentation, round(avg(volatility), 9) AS volatility, round(avg(CASE WHEN state <> state0 THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS event_share, round(avg(abs(momentum)), 9) AS momentum_share, round(avg(confidence), 9) AS confidence FROM x GROUP BY 1, 2),
r AS (SELECT competition, day, CASE WHEN fragmentation >= {cut['fragmented']} THEN 'FRAGMENTED' WHEN volatility >= {cut['volatile']} THEN 'VOLATILE' WHEN event_share >= {cut['event']} THEN 'EVENT_DRIVEN' WHEN momentum_share >= {cut['momentum']} THEN 'MOMENTUM_DRIVEN' WHEN confidence >= {cut['high_confidence']} THEN 'HIGH_CONFIDENCE' WHEN confidence <= {cut['low_confidence']} THEN 'LOW_CONFIDENCE' ELSE 'STABLE' END AS regime FROM c)"""


#: Cut-offs near the medians of the test events, so that their days fall into several regimes.
SPREAD = regimes(fragmented=0.54, volatile=0.52, event=0.7, momentum=0.55, high_confidence=0.52, low_confidence=0.46)
sql_query("trend_regime", "O-180: first regime that matches.", regimes() + " SELECT competition, day, regime FROM r")
sql_query("trend_regime_spread", "O-180: the same with given cut-offs.", SPREAD + " SELECT competition, day, regime FROM r")
sql_query("trend_regime_changes", "O-181, O-185: rows are appended only where the regime changes.", SPREAD + ",\nl AS (SELECT *, lag(regime) OVER (PARTITION BY competition ORDER BY day) AS before FROM r)\nSELECT competition, day, before, regime FROM l WHERE before IS NULL OR before <> regime")

sql_query("trend_enrichment", "O-145: two aggregates of the trends at hand joined to each, and its meaning from a table; profiles of history (O-182) are in trend_known_profiles.", DETECTED + """,
h AS (SELECT trend_type, count(*) AS seen, avg(strength) AS mean FROM d GROUP BY trend_type),
m AS (SELECT match_id, count(DISTINCT trend_type) AS kinds FROM d GROUP BY match_id),
meaning AS (SELECT * FROM (VALUES ('pressure_building', 'sustained attack'), ('tempo_change', 'pace moves'), ('sentiment_shift', 'crowd turns')) AS v(trend_type, meaning))
SELECT d.match_id, d.event_id, d.trend_type, CAST(h.seen AS BIGINT) AS seen, round(h.mean, 6) AS mean_strength, CAST(m.kinds AS BIGINT) AS kinds, coalesce(meaning, 'unlisted') AS meaning
FROM d LEFT JOIN h ON d.trend_type = h.trend_type LEFT JOIN m ON d.match_id = m.match_id LEFT JOIN meaning g ON d.trend_type = g.trend_type WHERE d.strength >= 0.6""")

sql_query("trend_text_template", "O-144: evidence to a sentence by the template of the type.", DETECTED + """
SELECT match_id, event_id, trend_type, CASE trend_type WHEN 'pressure_building' THEN concat('Pressure builds in match ', CAST(match_id AS [[STRING||VARCHAR]])) WHEN 'momentum_shift' THEN concat('Momentum turns ', CASE WHEN direction > 0 THEN 'home' ELSE 'away' END) ELSE concat([[initcap||]](replace(trend_type, '_', ' ')), '.') END AS title
FROM d WHERE trend_type IN ('pressure_building', 'momentum_shift')""")

# A mean of 0.2 is decided by the order in which its sentiments are added: Spark adds them by event, as the SQL does where one
# thread reads the table, however the files are split. The SQL passes over prices and measures that are null; so do the filters.
sql_query("trend_watchers", "O-184, O-229: market drift, weighted risk, growth and narrative over half-hour grids of the last days.", WIDE + """,
m AS (SELECT max(ts) AS latest FROM x),
[[t AS (SELECT *, avg(sentiment) OVER (PARTITION BY match_id ORDER BY event_id) AS mean FROM x CROSS JOIN m WHERE ts >= latest - INTERVAL '72' HOUR),
||]]w AS (SELECT match_id, max_by(p, (ts, event_id))[[ FILTER (WHERE p IS NOT NULL)||]] - min_by(p, (ts, event_id))[[ FILTER (WHERE p IS NOT NULL)||]] AS drift, sum(CASE WHEN book = 'error' THEN 3 WHEN book = 'purchase' THEN 1 ELSE 0 END) + 0.25 * max(value) / 100 + 2 * max(CASE WHEN minute >= 75 THEN 1 ELSE 0 END) AS risk, max_by(k, (ts, event_id))[[ FILTER (WHERE k IS NOT NULL)||]] - min_by(k, (ts, event_id))[[ FILTER (WHERE k IS NOT NULL)||]] AS growth, [[max_by(mean, event_id)||avg(sentiment)]] AS narrative FROM [[t||x CROSS JOIN m WHERE ts >= latest - INTERVAL '72' HOUR]] GROUP BY match_id)
SELECT match_id, abs(drift) >= 0.03 AS market_drift, risk >= 4 AS risk_watch, growth >= 10 AS possession_growth, abs(narrative) >= 0.2 AS narrative_watch FROM w""")

sql_query("trend_meta", "O-72: rates by team and type of closed trends; the recurrences of O-175 are in trend_meta_recurrences.", """
WITH o AS (SELECT * FROM {outcomes}),
t AS (SELECT team, trend_type, count(*) AS n, avg(CASE WHEN outcome = 'confirmed' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS confirmed, avg(CASE WHEN outcome = 'failed' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS failed, count(DISTINCT match_id) AS matches FROM o GROUP BY team, trend_type)
SELECT team, trend_type, 'underestimation' AS meta, round(confirmed, 6) AS rate FROM t WHERE n >= 3 AND confirmed >= 0.7
UNION ALL SELECT team, trend_type, 'confidence_failure', round(failed, 6) FROM t WHERE n >= 3 AND failed >= 0.6
UNION ALL SELECT team, trend_type, 'recurring', round(CAST(matches AS DOUBLE) / n, 6) FROM t WHERE n >= 3 AND matches >= 2 AND trend_type LIKE 'O-7'""")
