"""Composite plans: the historical report in its fixed order of stages, replay, reasoning rules and their graph."""

from __future__ import annotations

from tideline.operators.history import SIDES
from tideline.operators.trends import DETECTED
from tideline.registry import sql_query

sql_query("plan_report", "O-263, in part: evidence, regime, signals and confidence of each team in one plan; the report of a scope (O-197) is intelligence_report.", SIDES + """,
g AS (SELECT team, count(*) AS n, avg(CAST(points AS DOUBLE)) / 3 AS dominance, avg(CASE WHEN gf = ga THEN 1e0 ELSE 0 END) AS draws, stddev_pop(CAST(gf - ga AS DOUBLE)) / 3 AS swing, avg(CAST(gf + ga AS DOUBLE)) / 6 AS tempo FROM p GROUP BY team),
sig AS (SELECT team, 'dominance' AS signal, dominance AS v, 1 AS dir FROM g UNION ALL SELECT team, 'draws', draws, 0 FROM g UNION ALL SELECT team, 'swing', swing, -1 FROM g UNION ALL SELECT team, 'tempo', tempo, 1 FROM g),
kept AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY v DESC, signal) AS rk FROM sig WHERE v >= 0.2),
r AS (SELECT team, count(*) AS signals, sum(CASE WHEN dir > 0 THEN 1 ELSE 0 END) AS pro, sum(CASE WHEN dir < 0 THEN 1 ELSE 0 END) AS con, avg(v) AS strength, max(CASE WHEN rk = 1 THEN signal END) AS lead_signal FROM kept GROUP BY team)
SELECT g.team, CASE WHEN swing >= 0.65 THEN 'VOLATILE' WHEN draws >= 0.22 THEN 'TIGHT' ELSE 'STABLE' END AS regime, CAST(coalesce(signals, 0) AS BIGINT) AS signals, lead_signal, round(least(1.0, coalesce(strength, 0) + least(0.18, 0.04 * coalesce(pro, 0))), 6) AS reinforced, coalesce(pro, 0) > 0 AND coalesce(con, 0) > 0 AS conflict, round(least(1.0, log10(CAST(n AS DOUBLE)) / 3) * (1 - least(1.0, swing) * 0.3), 6) AS confidence
FROM g LEFT JOIN r ON r.team = g.team""")

sql_query("plan_reasoning_graph", "Edges between the trends of a match by sign: supports, contradicts, with weights; rules (O-196) are in reasoning.", DETECTED + """,
n AS (SELECT match_id, trend_type, round(sum(direction * strength), 9) AS pull, count(*) AS seen FROM d GROUP BY match_id, trend_type)
SELECT a.match_id, a.trend_type AS src, b.trend_type AS dst, CASE WHEN a.pull * b.pull < 0 THEN 'contradicts' WHEN a.pull * b.pull > 0 THEN 'supports' ELSE 'beside' END AS relation, round(least(abs(a.pull), abs(b.pull)), 6) AS weight FROM n a JOIN n b ON a.match_id = b.match_id AND a.trend_type < b.trend_type WHERE a.seen >= 3 AND b.seen >= 3""")

sql_query("plan_replay_gate", "O-96: detections by day, their unrest, and a label from both; the gate on two versions and outcomes (O-201) is in replay.", DETECTED + """,
daily AS (SELECT CAST(CAST(ts AS DATE) AS [[STRING||VARCHAR]]) AS day, trend_type, count(*) AS fired, avg(strength) AS strength FROM d GROUP BY 1, 2),
totals AS (SELECT trend_type, count(*) AS days, sum(fired) AS fired, avg(strength) AS strength, stddev_pop(CAST(fired AS DOUBLE)) / avg(CAST(fired AS DOUBLE)) AS unrest FROM daily GROUP BY trend_type)
SELECT trend_type, CAST(days AS BIGINT) AS days, CAST(fired AS BIGINT) AS fired, round(strength, 6) AS strength, round(unrest, 6) AS unrest, CASE WHEN days < 25 THEN 'insufficient' WHEN unrest > 0.5 THEN 'hold' ELSE 'promote' END AS verdict FROM totals""")

sql_query("plan_projection_report", "O-198, O-67, O-233: share of each label by band of the home side's edge before the match.", SIDES + """,
q AS (SELECT uid, venue, team, kickoff_at, avg(CAST(points AS DOUBLE)) OVER (PARTITION BY team ORDER BY kickoff_at, uid ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS form FROM p),
f AS (SELECT uid, venue, coalesce(first_value(form) OVER (PARTITION BY team, kickoff_at ORDER BY uid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1e0) AS form FROM q),
j AS (SELECT m.uid, h.form - a.form AS edge, CASE WHEN m.home_goals > m.away_goals THEN 'home' WHEN m.home_goals = m.away_goals THEN 'draw' ELSE 'away' END AS label FROM m JOIN f h ON h.uid = m.uid AND h.venue = 'home' JOIN f a ON a.uid = m.uid AND a.venue = 'away')
SELECT CAST(floor(edge * 2 + 0.0000001) AS INT) AS band, label, CAST(count(*) AS BIGINT) AS n FROM j GROUP BY 1, 2""")
