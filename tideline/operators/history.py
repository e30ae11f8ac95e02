"""Leakage-safe history: frames over strictly earlier matches, standings, rest, labels and splits."""

from __future__ import annotations

from tideline.registry import sql_query

SIDES = """
WITH m AS (SELECT * FROM {matches}),
s AS (SELECT uid, competition, kickoff_at, home AS team, away AS rival, 'home' AS venue, home_goals AS gf, away_goals AS ga FROM m UNION ALL SELECT uid, competition, kickoff_at, away, home, 'away', away_goals, home_goals FROM m),
p AS (SELECT *, CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS points FROM s)"""

sql_query("hist_form_frames", "O-105: points and goals over the matches before each kickoff; matches of the same instant are not seen.", SIDES + """
SELECT uid, team, CAST(coalesce(sum(points) OVER w, 0) AS BIGINT) AS points_before, CAST(count(*) OVER w AS BIGINT) AS played, round(coalesce(avg(CAST(gf AS DOUBLE)) OVER w30, 1.2), 6) AS goals_month FROM p
WINDOW w AS (PARTITION BY team ORDER BY kickoff_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '1' SECOND PRECEDING), w30 AS (PARTITION BY team ORDER BY kickoff_at RANGE BETWEEN INTERVAL '2592000' SECOND PRECEDING AND INTERVAL '1' SECOND PRECEDING)""")

def before(column: str, partition: str, n: int, what: str = "avg") -> str:
    """``what`` of the last ``n`` rows before each kickoff, by kickoff and id.

    The frame of the first row of a kickoff has nothing of that kickoff in it, and all rows of the kickoff take its value.
    """
    return f"{what}({column}) OVER (PARTITION BY {partition} ORDER BY kickoff_at, uid ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def at_kickoff(column: str, partition: str) -> str:
    """The value of the first row of a kickoff, for all its rows."""
    return f"first_value({column}) OVER (PARTITION BY {partition}, kickoff_at ORDER BY uid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def earlier(partition: str, n: int, values: str, key: str = "a.uid, a.team", extra: str = "") -> str:
    """For oracles: every row joined to all strictly earlier ones of its partition, of which the last ``n`` are taken."""
    same = " AND ".join(f"b.{c} = a.{c}" for c in partition.split(", "))
    return f"""e AS (SELECT {key}{extra}, b.* EXCLUDE (uid, {partition}), row_number() OVER (PARTITION BY {key} ORDER BY b.kickoff_at DESC, b.uid DESC) AS back FROM p a LEFT JOIN p b ON {same} AND b.kickoff_at < a.kickoff_at),
v AS (SELECT {', '.join(c.strip()[2:] for c in key.split(','))}, {values} FROM e WHERE back <= {n} GROUP BY ALL)"""


sql_query("hist_last_n", "O-105: points of the last three, five and ten matches before each kickoff.", SIDES + f""",
f AS (SELECT uid, team, kickoff_at, {before('points', 'team', 3, 'sum')} AS p3, {before('points', 'team', 5, 'sum')} AS p5, {before('points', 'team', 10, 'sum')} AS p10 FROM p)
SELECT uid, team, CAST(coalesce({at_kickoff('p3', 'team')}, 0) AS BIGINT) AS form3, CAST(coalesce({at_kickoff('p5', 'team')}, 0) AS BIGINT) AS form5, CAST(coalesce({at_kickoff('p10', 'team')}, 0) AS BIGINT) AS form10 FROM f""",
SIDES + ", " + earlier("team", 10, "sum(points) FILTER (WHERE back <= 3) AS p3, sum(points) FILTER (WHERE back <= 5) AS p5, sum(points) AS p10") + """
SELECT uid, team, CAST(coalesce(p3, 0) AS BIGINT) AS form3, CAST(coalesce(p5, 0) AS BIGINT) AS form5, CAST(coalesce(p10, 0) AS BIGINT) AS form10 FROM v""")
sql_query("hist_venue_frame", "O-106: the last ten at the same venue before each kickoff.", SIDES + f""",
f AS (SELECT uid, team, venue, kickoff_at, {before('CAST(points AS DOUBLE)', 'team, venue', 10)} AS v FROM p)
SELECT uid, team, venue, round(coalesce({at_kickoff('v', 'team, venue')}, 0e0), 6) AS venue_points FROM f""",
SIDES + ", " + earlier("team, venue", 10, "avg(points) AS v", "a.uid, a.team, a.venue") + " SELECT uid, team, venue, round(coalesce(v, 0e0), 6) AS venue_points FROM v")
sql_query("hist_head_to_head_frame", "O-107, O-57: the last ten meetings before each kickoff, seen from the home side.", f"""
WITH m AS (SELECT *, least(home, away) AS a, greatest(home, away) AS b, CASE WHEN home < away THEN home_goals - away_goals ELSE away_goals - home_goals END AS a_diff FROM {{matches}}),
f AS (SELECT uid, home, away, a, b, kickoff_at, {before('*', 'a, b', 10, 'count')} AS n, {before('CAST(a_diff AS DOUBLE)', 'a, b', 10)} AS edge FROM m)
SELECT uid, CAST({at_kickoff('n', 'a, b')} AS BIGINT) AS met, round(coalesce({at_kickoff('edge', 'a, b')}, 0e0) * CASE WHEN home < away THEN 1 ELSE -1 END, 6) + 0e0 AS home_edge FROM f""", """
WITH m AS (SELECT * FROM {matches}),
e AS (SELECT x.uid, CASE WHEN y.home = x.home THEN y.home_goals - y.away_goals ELSE y.away_goals - y.home_goals END AS diff, row_number() OVER (PARTITION BY x.uid ORDER BY y.kickoff_at DESC, y.uid DESC) AS back FROM m x LEFT JOIN m y ON y.kickoff_at < x.kickoff_at AND ((y.home = x.home AND y.away = x.away) OR (y.home = x.away AND y.away = x.home)))
SELECT uid, CAST(count(diff) AS BIGINT) AS met, round(coalesce(avg(CAST(diff AS DOUBLE)), 0e0), 6) + 0e0 AS home_edge FROM e WHERE back <= 10 GROUP BY uid""")
SEASONS = SIDES + """,
d AS (SELECT competition, CAST(year(kickoff_at) AS INT) AS season, team, kickoff_at, sum(points) AS pts, sum(gf - ga) AS gd, sum(gf) AS gf FROM p GROUP BY 1, 2, 3, 4),
k AS (SELECT DISTINCT competition, season, kickoff_at FROM d), n AS (SELECT DISTINCT competition, season, team FROM d)"""
STANDINGS = SEASONS + """,
g AS (SELECT k.competition, k.season, k.kickoff_at, n.team, d.team IS NOT NULL AS plays, coalesce(d.pts, 0) AS pts, coalesce(d.gd, 0) AS gd, coalesce(d.gf, 0) AS gf FROM k JOIN n ON n.competition = k.competition AND n.season = k.season LEFT JOIN d ON d.competition = k.competition AND d.season = k.season AND d.team = n.team AND d.kickoff_at = k.kickoff_at),
c AS (SELECT competition, season, kickoff_at, team, plays, coalesce(sum(pts) OVER w, 0) AS pts, coalesce(sum(gd) OVER w, 0) AS gd, coalesce(sum(gf) OVER w, 0) AS gf FROM g WINDOW w AS (PARTITION BY competition, season, team ORDER BY kickoff_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT competition, season, kickoff_at, team, plays, pts, row_number() OVER (PARTITION BY competition, season, kickoff_at ORDER BY pts DESC, gd DESC, gf DESC, team) AS place, count(*) OVER (PARTITION BY competition, season, kickoff_at) AS n FROM c),
s1 AS (SELECT * FROM r WHERE plays)"""
# counts the teams that stand before a team, from sums over strictly earlier matches of the season
STANDINGS_ORACLE = SEASONS + """,
z AS (SELECT k.competition, k.season, k.kickoff_at, n.team, coalesce(sum(d.pts), 0) AS pts, coalesce(sum(d.gd), 0) AS gd, coalesce(sum(d.gf), 0) AS gf FROM k JOIN n USING (competition, season) LEFT JOIN d ON d.competition = k.competition AND d.season = k.season AND d.team = n.team AND d.kickoff_at < k.kickoff_at GROUP BY ALL),
s1 AS (SELECT x.competition, x.season, x.kickoff_at, x.team, x.pts, 1 + count(*) FILTER (WHERE (y.pts, y.gd, y.gf, -y.team) > (x.pts, x.gd, x.gf, -x.team)) AS place, count(*) AS n FROM z x JOIN d USING (competition, season, kickoff_at, team) JOIN z y ON y.competition = x.competition AND y.season = x.season AND y.kickoff_at = x.kickoff_at GROUP BY ALL)"""
_PLACE = " SELECT competition, season, kickoff_at, team, CAST(pts AS BIGINT) AS points, CAST(place AS BIGINT) AS place, round(place / CAST(n AS DOUBLE), 6) AS share FROM s1"
_CLIMB = " SELECT competition, season, kickoff_at, team, CAST(coalesce(lag(place) OVER (PARTITION BY competition, season, team ORDER BY kickoff_at) - place, 0) AS BIGINT) AS climbed FROM s1"
sql_query("hist_standings", "O-108: the place of a side before each of its kickoffs, by points, goal difference and goals of the season so far.", STANDINGS + _PLACE, STANDINGS_ORACLE + _PLACE)
sql_query("hist_rank_change", "O-109: change of place against the side's own kickoff before, within a season.", STANDINGS + _CLIMB, STANDINGS_ORACLE + _CLIMB)
_US = "[[unix_micros(CAST({0} AS TIMESTAMP))||epoch_us({0})]]"
sql_query("hist_rest_days", "O-110: whole days since the last match strictly before the kickoff, 14 without one, 30 at most.", SIDES + f"""
SELECT uid, team, CAST(CASE WHEN max(kickoff_at) OVER w IS NULL THEN 14 ELSE least(30, floor(({_US.format('kickoff_at')} - {_US.format('max(kickoff_at) OVER w')}) / 86400e6)) END AS BIGINT) AS rest FROM p
WINDOW w AS (PARTITION BY team ORDER BY kickoff_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '1' SECOND PRECEDING)""", SIDES + """
SELECT a.uid, a.team, CAST(CASE WHEN count(b.uid) = 0 THEN 14 ELSE least(30, floor((epoch_us(a.kickoff_at) - epoch_us(max(b.kickoff_at))) / 86400e6)) END AS BIGINT) AS rest FROM p a LEFT JOIN p b ON b.team = a.team AND b.kickoff_at < a.kickoff_at GROUP BY a.uid, a.team, a.kickoff_at""")
_MATCH = """SELECT m.uid, round(h.form, 6) AS home_form, round(a.form, 6) AS away_form, round(h.attack - a.defence, 6) AS home_edge, round(a.attack - h.defence, 6) AS away_edge, CAST(least(h.played, a.played) AS BIGINT) AS known, CASE WHEN m.home_goals > m.away_goals THEN 'home' WHEN m.home_goals = m.away_goals THEN 'draw' ELSE 'away' END AS label
FROM m JOIN f h ON h.uid = m.uid AND h.venue = 'home' JOIN f a ON a.uid = m.uid AND a.venue = 'away'"""
sql_query("hist_projection", "O-105: both sides' form, attack and defence before a match, with defaults; all features (O-198) are in projection_v2 and projection_v3.", SIDES + f""",
q AS (SELECT uid, team, venue, kickoff_at, {before('CAST(points AS DOUBLE)', 'team', 10)} AS form, {before('CAST(gf AS DOUBLE)', 'team', 10)} AS attack, {before('CAST(ga AS DOUBLE)', 'team', 10)} AS defence, {before('*', 'team', 10, 'count')} AS played FROM p),
f AS (SELECT uid, venue, coalesce({at_kickoff('form', 'team')}, 1e0) AS form, coalesce({at_kickoff('attack', 'team')}, 1.2e0) AS attack, coalesce({at_kickoff('defence', 'team')}, 1.2e0) AS defence, {at_kickoff('played', 'team')} AS played FROM q)
""" + _MATCH, SIDES + """,
e AS (SELECT a.uid, a.venue, b.points, b.gf, b.ga, row_number() OVER (PARTITION BY a.uid, a.venue ORDER BY b.kickoff_at DESC, b.uid DESC) AS back FROM p a LEFT JOIN p b ON b.team = a.team AND b.kickoff_at < a.kickoff_at),
f AS (SELECT uid, venue, coalesce(avg(points), 1e0) AS form, coalesce(avg(gf), 1.2e0) AS attack, coalesce(avg(ga), 1.2e0) AS defence, count(points) AS played FROM e WHERE back <= 10 GROUP BY uid, venue)
""" + _MATCH)
sql_query("hist_temporal_split", "O-200, O-232: splits by year, goal bands, counts.", """
SELECT CASE WHEN year(kickoff_at) <= 1999 THEN 'train' WHEN year(kickoff_at) = 2000 THEN 'validation' ELSE 'holdout' END AS split, CASE WHEN home_goals + away_goals <= 1 THEN 'low' WHEN home_goals + away_goals <= 3 THEN 'mid' ELSE 'high' END AS goals, CAST(count(*) AS BIGINT) AS n FROM {matches} GROUP BY 1, 2""")
sql_query("hist_signals", "Five measures of each side, unpivoted; the signals of a scope (O-192, O-194, O-195) are in intelligence.", SIDES + """,
g AS (SELECT team, avg(CAST(gf + ga AS DOUBLE)) AS goals, avg(CASE WHEN gf = ga THEN 1e0 ELSE 0 END) AS draws, stddev_pop(CAST(gf - ga AS DOUBLE)) AS swing, avg(CAST(points AS DOUBLE)) AS points, count(*) AS n FROM p GROUP BY team)
SELECT team, 'low_scoring' AS signal, round(greatest(0.0, 1 - goals / 4), 6) AS strength FROM g UNION ALL SELECT team, 'draw_prone', round(draws, 6) FROM g UNION ALL SELECT team, 'volatile', round(least(1.0, swing / 3), 6) FROM g UNION ALL SELECT team, 'dominant', round(points / 3, 6) FROM g UNION ALL SELECT team, 'uncertain', round(1 / sqrt(CAST(n AS DOUBLE)), 6) FROM g""")
sql_query("hist_market_insight", "O-191: favourite at the opening and now, dispersion, direction.", """
WITH t AS (SELECT match_id, min_by(home, (ts, event_id)) AS h0, min_by(away, (ts, event_id)) AS a0, max_by(home, (ts, event_id)) AS h1, max_by(away, (ts, event_id)) AS a1, stddev_pop(1 / home) AS dispersion FROM {ticks} GROUP BY match_id)
SELECT match_id, CASE WHEN h0 <= a0 THEN 'home' ELSE 'away' END AS opened, CASE WHEN h1 <= a1 THEN 'home' ELSE 'away' END AS closed, round(dispersion, 6) AS dispersion, CASE WHEN 1 / h1 - 1 / h0 > 0.005 THEN 'in' WHEN 1 / h1 - 1 / h0 < -0.005 THEN 'out' ELSE 'flat' END AS direction FROM t""")
sql_query("hist_calibration", "O-233: confidence buckets with their hit rate, for the calibration error.", """
WITH f AS (SELECT l_orderkey, l_discount * 10 AS confidence, CASE WHEN l_returnflag = 'A' THEN 1e0 ELSE 0 END AS hit FROM {lineitem})
SELECT CAST(floor(confidence * 10 + 0.000001) AS INT) AS bucket, CAST(count(*) AS BIGINT) AS n, round(avg(confidence), 6) AS confidence, round(avg(hit), 6) AS accuracy, round(abs(avg(confidence) - avg(hit)), 6) AS gap FROM f GROUP BY 1""")

_TEMPERATURES = [round(0.5 + 0.1 * i, 1) for i in range(26)]
_LOGIT = "ln(greatest(0.000001e0, least(0.999999e0, l_discount * 10e0)) / (1 - greatest(0.000001e0, least(0.999999e0, l_discount * 10e0))))"
_FORECASTS = f"(SELECT {_LOGIT} AS z, CASE WHEN l_returnflag = 'A' THEN 1e0 ELSE 0e0 END AS hit FROM {{lineitem}})"


def _loss(t: object) -> str:
    return f"avg(hit * ln(1 + exp(-z / {t})) + (1 - hit) * ln(1 + exp(z / {t})))"


sql_query("hist_temperature", "O-233: the temperature from 0.5 to 3 that gives forecasts the least log loss; the losses of all are worked out in one pass.", f"""
WITH f AS (SELECT {", ".join(f"{_loss(f'{t}e0')} AS x{i}" for i, t in enumerate(_TEMPERATURES))} FROM {_FORECASTS}),
l AS (SELECT stack(26, {", ".join(f"{t}e0, x{i}" for i, t in enumerate(_TEMPERATURES))}) AS (temperature, loss) FROM f)
SELECT temperature, round(loss, 6) AS loss FROM l ORDER BY round(loss, 8), temperature LIMIT 1""", f"""
WITH t AS (SELECT 0.5e0 + 0.1e0 * unnest(range(26)) AS temperature), l AS (SELECT temperature, {_loss("temperature")} AS loss FROM {_FORECASTS} CROSS JOIN t GROUP BY temperature)
SELECT round(temperature, 1) AS temperature, round(loss, 6) AS loss FROM l ORDER BY round(loss, 8), temperature LIMIT 1""")
