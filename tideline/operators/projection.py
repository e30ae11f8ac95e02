"""Leakage-safe projection of matches: 74 features of both sides before the kickoff, and 18 of market and strength.

Form, venue, meetings and rest are window frames. The first row of a kickoff has nothing of that kickoff in its frame,
and all rows of the kickoff take its value, so matches of one instant never see each other. Places in the table are
those before each kickoff: teams sort anew only when their season has a kickoff, so a season is one fold in the order of
time with its teams' sums as state. Ratings are folded by connected league.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.history import SIDES, at_kickoff, before
from tideline.operators.leagues import ratings
from tideline.operators.state import _fold
from tideline.registry import query, run_sql
from tideline.session import written

_SHARE = {"wins": "CASE WHEN points = 3 THEN 1e0 ELSE 0e0 END", "draws": "CASE WHEN points = 1 THEN 1e0 ELSE 0e0 END", "losses": "CASE WHEN points = 0 THEN 1e0 ELSE 0e0 END", "points": "points / 3e0"}
#: Columns of a side: (name, expression over its earlier rows, partition, how many of them).
FRAMES = [(f"{n}_{w}", x, "team", w) for w in (3, 5, 10) for n, x in _SHARE.items()]
FRAMES += [(f"{n}_{w}", f"CAST({c} AS DOUBLE)", "team", w) for w in (5, 10) for n, c in (("goals_for", "gf"), ("goals_against", "ga"))]
FRAMES += [("venue_points", _SHARE["points"], "team, venue", 10), ("venue_wins", _SHARE["wins"], "team, venue", 10), ("venue_goals", "CAST(gf AS DOUBLE)", "team, venue", 10)]
_OF_SIDE = [f"{n}_{w}" for w in (3, 5, 10) for n in _SHARE] + [f"{n}_{w}" for w in (5, 10) for n in ("goals_for", "goals_against", "goal_difference")]
_TABLE = ["league_position", "league_points", "league_goal_difference", "recent_rank_change"]
_MARKET = ["opening_home", "opening_draw", "opening_away", "closing_home", "closing_draw", "closing_away", "implied_home_probability", "implied_draw_probability", "implied_away_probability", "bookmaker_spread", "odds_available"]
_GAPS = ["home_advantage", "form_strength_gap", "goal_rate_gap", "draw_rate_mean_5", "draw_rate_gap_5", "expected_total_goals_5"]
_MEETINGS = ["last_h2h_matches", "h2h_home_wins", "h2h_away_wins", "h2h_draws", "h2h_goal_difference"]
V2 = [f"{s}_{c}" for s in ("home", "away") for c in [*_OF_SIDE, "strength", "win_rate", "goal_rate", "rest_days", *_TABLE]] + _MEETINGS + _GAPS + _MARKET
V3 = ["implied_home", "implied_draw", "implied_away", "market_favorite", "favorite_strength", "market_gap", "market_entropy", "home_elo_rating", "away_elo_rating", "elo_difference", "home_attack_strength", "away_attack_strength", "home_defense_strength", "away_defense_strength", "home_rating", "away_rating", "league_strength", "competition_weight"]
# Weights of competitions, and of those that are not listed.
WEIGHTS = {"champions_league": 1.00, "premier_league": 0.96, "la_liga": 0.94, "serie_a": 0.92, "bundesliga": 0.90, "ligue_1": 0.86, "brasileirao_serie_a": 0.82}
OTHER_WEIGHT = 0.75

# both sides' frames, wide; one text for both engines but for the frames, which the oracle gets from self-joins
_JOINED = """
x AS (SELECT m.uid, m.kickoff_at, m.competition, m.home, m.away, {h}, {a}, t.n AS met, t.hw, t.aw, t.dr, t.gd FROM m JOIN f h ON h.uid = m.uid AND h.venue = 'home' JOIN f a ON a.uid = m.uid AND a.venue = 'away' JOIN t ON t.uid = m.uid)"""
_REST = "CASE WHEN last_us IS NULL THEN 14 ELSE least(30, greatest(0, floor(([[unix_micros(CAST(kickoff_at AS TIMESTAMP))||epoch_us(kickoff_at)]] - last_us) / 86400e6))) END"
FRAMED = SIDES + f""",
q AS (SELECT uid, team, venue, kickoff_at, {', '.join(f'{before(x, part, w)} AS {n}' for n, x, part, w in FRAMES)}, [[unix_micros(CAST(max(kickoff_at) OVER l AS TIMESTAMP))||epoch_us(max(kickoff_at) OVER l)]] AS last_us FROM p WINDOW l AS (PARTITION BY team ORDER BY kickoff_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '1' SECOND PRECEDING)),
f AS (SELECT uid, venue, {', '.join(f"coalesce({at_kickoff(n, part)}, 0e0) AS {n}" for n, _, part, _ in FRAMES)}, {_REST} / 30e0 AS rest_days FROM q),
k AS (SELECT *, least(home, away) AS a, greatest(home, away) AS b, CASE WHEN home < away THEN home_goals - away_goals ELSE away_goals - home_goals END AS diff FROM m),
u AS (SELECT uid, home, away, a, b, kickoff_at, {before('*', 'a, b', 10, 'count')} AS n, {before('CASE WHEN diff > 0 THEN 1e0 ELSE 0e0 END', 'a, b', 10)} AS won, {before('CASE WHEN diff < 0 THEN 1e0 ELSE 0e0 END', 'a, b', 10)} AS lost, {before('CAST(diff AS DOUBLE)', 'a, b', 10)} AS gd FROM k),
w AS (SELECT uid, home < away AS first, {', '.join(f"coalesce({at_kickoff(c, 'a, b')}, 0e0) AS {c}" for c in ('n', 'won', 'lost', 'gd'))} FROM u),
t AS (SELECT uid, n, CASE WHEN first THEN won ELSE lost END AS hw, CASE WHEN first THEN lost ELSE won END AS aw, CASE WHEN n > 0 THEN 1 - won - lost ELSE 0e0 END AS dr, CASE WHEN first THEN gd ELSE -gd END AS gd FROM w),"""
_ORACLE_FRAMED = SIDES + f""",
e AS (SELECT a.uid, a.venue AS side, a.kickoff_at AS t0, b.*, row_number() OVER (PARTITION BY a.uid, a.venue ORDER BY b.kickoff_at DESC, b.uid DESC) AS back, row_number() OVER (PARTITION BY a.uid, a.venue, b.venue ORDER BY b.kickoff_at DESC, b.uid DESC) AS vback FROM p a LEFT JOIN p b ON b.team = a.team AND b.kickoff_at < a.kickoff_at),
f AS (SELECT uid, side AS venue, {', '.join(f"coalesce(avg({x}) FILTER (WHERE {'back' if part == 'team' else 'e.venue = side AND vback'} <= {w}), 0e0) AS {n}" for n, x, part, w in FRAMES)}, CASE WHEN max(kickoff_at) IS NULL THEN 14 ELSE least(30, floor((epoch_us(any_value(t0)) - epoch_us(max(kickoff_at))) / 86400e6)) END / 30e0 AS rest_days FROM e GROUP BY uid, side),
o AS (SELECT x.uid, CASE WHEN y.home = x.home THEN y.home_goals - y.away_goals ELSE y.away_goals - y.home_goals END AS d, row_number() OVER (PARTITION BY x.uid ORDER BY y.kickoff_at DESC, y.uid DESC) AS back FROM m x LEFT JOIN m y ON y.kickoff_at < x.kickoff_at AND ((y.home = x.home AND y.away = x.away) OR (y.home = x.away AND y.away = x.home))),
t AS (SELECT uid, CAST(count(d) AS DOUBLE) AS n, coalesce(avg(CASE WHEN d > 0 THEN 1e0 WHEN d IS NOT NULL THEN 0e0 END), 0e0) AS hw, coalesce(avg(CASE WHEN d < 0 THEN 1e0 WHEN d IS NOT NULL THEN 0e0 END), 0e0) AS aw, coalesce(avg(CASE WHEN d = 0 THEN 1e0 WHEN d IS NOT NULL THEN 0e0 END), 0e0) AS dr, coalesce(avg(d), 0e0) AS gd FROM o WHERE back <= 10 GROUP BY uid),"""
_ORACLE_FRAMED = _ORACLE_FRAMED.replace("SELECT a.uid, a.venue AS side, a.kickoff_at AS t0, b.*,", "SELECT a.uid, a.venue AS side, a.kickoff_at AS t0, b.venue, b.kickoff_at, b.points, b.gf, b.ga,")
_COLUMNS = [n for n, *_ in FRAMES] + ["rest_days"]
_X = _JOINED.format(h=", ".join(f"h.{c} AS h_{c}" for c in _COLUMNS), a=", ".join(f"a.{c} AS a_{c}" for c in _COLUMNS))
#: Odds of two phases a match; a fifth of the matches has none, a fifth of the rest only the later ones.
ODDS = """(SELECT o_orderkey AS uid, phase, 1.2 + (o_orderkey % 300) / 100e0 * s AS home, 2.5 + (o_custkey % 150) / 100e0 * s AS draw, 1.3 + (o_orderkey * 7 % 400) / 100e0 * s AS away FROM (SELECT o_orderkey, o_custkey, 'opening' AS phase, 1e0 AS s FROM {orders} WHERE o_orderkey % 5 > 1 UNION ALL SELECT o_orderkey, o_custkey, 'closing', 0.95e0 FROM {orders} WHERE o_orderkey % 5 > 0) z)"""


def _side_features(s: str) -> list[str]:
    c = s[0]
    own = [f"{c}_{n} AS {s}_{n}" for n in _OF_SIDE if not n.startswith("goal_difference")]
    own += [f"{c}_goals_for_{w} - {c}_goals_against_{w} AS {s}_goal_difference_{w}" for w in (5, 10)]
    return own + [f"{c}_venue_points AS {s}_strength", f"{c}_venue_wins AS {s}_win_rate", f"{c}_venue_goals AS {s}_goal_rate", f"{c}_rest_days AS {s}_rest_days"]


_FEATURES = [*_side_features("home"), *_side_features("away"), "met / 10e0 AS last_h2h_matches", "hw AS h2h_home_wins", "aw AS h2h_away_wins", "dr AS h2h_draws", "gd AS h2h_goal_difference", "1e0 AS home_advantage", "h_points_5 - a_points_5 AS form_strength_gap", "h_goals_for_5 - a_goals_for_5 AS goal_rate_gap", "(h_draws_5 + a_draws_5) / 2 AS draw_rate_mean_5", "abs(h_draws_5 - a_draws_5) AS draw_rate_gap_5", "(h_goals_for_5 + a_goals_for_5 + h_goals_against_5 + a_goals_against_5) / 2 AS expected_total_goals_5"]


class Table:
    """A season's table: places before each kickoff by points, goal difference and goals; equal teams as they first appeared."""

    def __init__(self) -> None:
        self.teams: dict[object, list[int]] = {}
        self.last: dict[object, int] = {}
        self.kickoff, self.waiting, self.place = None, [], {}

    def step(self, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            if r.kickoff_at != self.kickoff:
                for m in self.waiting:
                    self._record(*m)
                self.kickoff, self.waiting = r.kickoff_at, []
                ranked = sorted(self.teams, key=lambda t: (self.teams[t][1], self.teams[t][2] - self.teams[t][3], self.teams[t][2]), reverse=True)
                self.place = {t: n + 1 for n, t in enumerate(ranked)}
            out.append((r.uid, *self._of(r.home), *self._of(r.away)))
            self.waiting.append((r.home, r.away, r.home_goals, r.away_goals))
        return pd.DataFrame(out, columns=["uid", *(f"{s}_{c}" for s in ("home", "away") for c in _TABLE)])

    def _of(self, team: object) -> tuple[float, float, float, float]:
        size = max(len(self.place), 1)
        place = self.place.get(team, size)
        change = (self.last.get(team, place) - place) / size
        self.last[team] = place
        if team not in self.place:
            return 1.0, 0.0, 0.0, change
        played, points, gf, ga = self.teams[team]
        return place / size, points / max(played * 3, 1), (gf - ga) / max(played, 1), change

    def _record(self, home: object, away: object, home_goals: int, away_goals: int) -> None:
        for team, gf, ga in ((home, home_goals, away_goals), (away, away_goals, home_goals)):
            t = self.teams.setdefault(team, [0, 0, 0, 0])
            t[0] += 1
            t[1] += 3 if gf > ga else 1 if gf == ga else 0
            t[2] += gf
            t[3] += ga


def market(odds: DataFrame) -> DataFrame:
    """(uid, market features) of matches with odds: a missing phase takes the other's; odds that are not positive are none."""
    at = lambda phase, c: F.max(F.when(F.col("phase") == phase, F.col(c)))
    per = odds.groupBy("uid").agg(*[F.coalesce(at(p, c), at(o, c)).alias(f"{p}_{c}") for p, o in (("opening", "closing"), ("closing", "opening")) for c in ("home", "draw", "away")])
    ok = per.where(" AND ".join(f"{p}_{c} > 0" for p in ("opening", "closing") for c in ("home", "draw", "away")))
    whole = sum((1 / F.col(f"closing_{c}") for c in ("draw", "away")), 1 / F.col("closing_home"))
    closing = [F.col(f"closing_{c}") for c in ("home", "draw", "away")]
    return ok.select("*", *[(1 / F.col(f"closing_{c}") / whole).alias(f"implied_{c}_probability") for c in ("home", "draw", "away")], (F.greatest(*closing) - F.least(*closing)).alias("bookmaker_spread"), F.lit(1.0).alias("odds_available"))


def _timed(matches: DataFrame) -> DataFrame:
    return matches.withColumn("kickoff_at", F.unix_micros(F.col("kickoff_at").cast("timestamp"))).withColumn("season", F.year(F.timestamp_micros("kickoff_at")))


def projection_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a match with the 74 features; what is not known has its default."""
    framed = run_sql(spark, sf_dir, FRAMED + _X + f" SELECT uid, {', '.join(_FEATURES)} FROM x")
    m = _timed(run_sql(spark, sf_dir, "SELECT * FROM {matches}"))
    table = _fold(m, ["competition", "season"], ["kickoff_at", "uid"], lambda: Table().step, "uid long, " + ", ".join(f"{s}_{c} double" for s in ("home", "away") for c in _TABLE))
    whole = framed.join(table, "uid").join(market(run_sql(spark, sf_dir, f"SELECT * FROM {ODDS} o")), "uid", "left")
    return whole.select("uid", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in V2])


def projection_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 74 features and 18 more: what the market implies, ratings, attack and defence against the league's goals."""
    v2 = written(projection_v2(spark, sf_dir), "projection")
    m = _timed(run_sql(spark, sf_dir, "SELECT * FROM {matches}"))
    rate = run_sql(spark, sf_dir, "SELECT uid, competition, avg((home_goals + away_goals) / 2e0) OVER (PARTITION BY competition, year(kickoff_at) ORDER BY kickoff_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '1' SECOND PRECEDING) AS goals FROM {matches}")
    both = v2.join(rate.withColumn("goals", F.coalesce("goals", F.lit(1.35))), "uid").join(ratings(m), "uid")
    implied = [F.col(f"implied_{c}_probability") for c in ("home", "draw", "away")]
    known = F.col("odds_available") > 0
    if_known = lambda x: F.when(known, x).otherwise(F.lit(0.0))
    order = F.sort_array(F.array(*implied))
    most = F.greatest(*implied)
    favourite = F.when(implied[2] == most, 2).when(implied[1] == most, 1).otherwise(0)
    entropy = -sum((p * F.log(p + 1e-12) for p in implied[1:]), implied[0] * F.log(implied[0] + 1e-12)) / math.log(3)
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("competition").cast("string")], F.lit(OTHER_WEIGHT))
    attack = lambda s: F.col(f"{s}_goals_for_10") / F.greatest(F.col("goals"), F.lit(0.25))
    defence = lambda s: F.col("goals") / F.greatest(F.col(f"{s}_goals_against_10"), F.lit(0.25))
    new = [*[if_known(p) for p in implied], if_known(favourite / 2), if_known(most), if_known(order[2] - order[1]), if_known(entropy), F.col("home_elo") / 3000, F.col("away_elo") / 3000, (F.col("home_elo") - F.col("away_elo")) / 400, attack("home"), attack("away"), defence("home"), defence("away"), F.col("home_venue") / 3000, F.col("away_venue") / 3000, F.col("league_strength") / 3000, weight]
    return both.select("uid", *V2, *[x.cast("double").alias(n) for n, x in zip(V3, new, strict=True)])


_ORACLE_TABLE = """,
ps AS (SELECT *, year(kickoff_at) AS season, CASE venue WHEN 'home' THEN 0 ELSE 1 END AS sd FROM p),
ks AS (SELECT DISTINCT competition, season, kickoff_at FROM ps),
g AS (SELECT k.competition, k.season, k.kickoff_at, b.team, count(*) AS played, sum(b.points) AS pts, sum(b.gf) AS gf, sum(b.ga) AS ga, min((b.kickoff_at, b.uid, b.sd)) AS fa FROM ks k JOIN ps b ON b.competition = k.competition AND b.season = k.season AND b.kickoff_at < k.kickoff_at GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY competition, season, kickoff_at ORDER BY pts DESC, gf - ga DESC, gf DESC, fa) AS place, count(*) OVER (PARTITION BY competition, season, kickoff_at) AS size FROM g),
sz AS (SELECT competition, season, kickoff_at, max(size) AS size FROM rk GROUP BY ALL),
pl AS (SELECT s.uid, s.venue, coalesce(z.size, 1) AS size, r.place IS NOT NULL AS there, coalesce(r.place, z.size, 1) AS place, r.pts / (r.played * 3e0) AS pp, (r.gf - r.ga) / CAST(r.played AS DOUBLE) AS pg, s.competition, s.season, s.team, s.kickoff_at, s.sd FROM ps s LEFT JOIN sz z USING (competition, season, kickoff_at) LEFT JOIN rk r USING (competition, season, kickoff_at, team)),
ch AS (SELECT *, (coalesce(lag(place) OVER (PARTITION BY competition, season, team ORDER BY kickoff_at, uid, sd), place) - place) / CAST(size AS DOUBLE) AS change FROM pl),
od AS (SELECT uid, """ + ", ".join(f"coalesce(max({c}) FILTER (WHERE phase = '{p}'), max({c}) FILTER (WHERE phase = '{o}')) AS {p}_{c}" for p, o in (("opening", "closing"), ("closing", "opening")) for c in ("home", "draw", "away")) + f""" FROM {ODDS} GROUP BY uid),
mk AS (SELECT *, 1 / closing_home + 1 / closing_draw + 1 / closing_away AS w FROM od)"""
_ORACLE_TAIL = [f"CASE WHEN {s[0]}x.there THEN {s[0]}x.place / CAST({s[0]}x.size AS DOUBLE) ELSE 1 END AS {s}_league_position, CASE WHEN {s[0]}x.there THEN {s[0]}x.pp ELSE 0 END AS {s}_league_points, CASE WHEN {s[0]}x.there THEN {s[0]}x.pg ELSE 0 END AS {s}_league_goal_difference, {s[0]}x.change AS {s}_recent_rank_change" for s in ("home", "away")]
_ORACLE_TAIL += [f"coalesce({p}_{c}, 0) AS {p}_{c}" for p in ("opening", "closing") for c in ("home", "draw", "away")] + [f"coalesce(1 / closing_{c} / w, 0) AS implied_{c}_probability" for c in ("home", "draw", "away")] + ["coalesce(greatest(closing_home, closing_draw, closing_away) - least(closing_home, closing_draw, closing_away), 0) AS bookmaker_spread", "CASE WHEN w IS NULL THEN 0e0 ELSE 1e0 END AS odds_available"]


def _digest(cols: list[str]) -> str:
    return ", ".join(f"round({c} + 1e-9, 5) AS {c}" for c in cols)


@query("projection_v2", _ORACLE_FRAMED + _X + _ORACLE_TABLE + f""",
al AS (SELECT x.uid, {', '.join(_FEATURES)}, {', '.join(_ORACLE_TAIL)} FROM x JOIN ch hx ON hx.uid = x.uid AND hx.venue = 'home' JOIN ch ax ON ax.uid = x.uid AND ax.venue = 'away' LEFT JOIN mk ON mk.uid = x.uid)
SELECT uid, {_digest(V2)} FROM al""")
def q_projection_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-198, O-105, O-106, O-107, O-108, O-109, O-110: the 74 features of each match before its kickoff."""
    return projection_v2(spark, sf_dir).select("uid", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in V2])


@query("projection_v3")
def q_projection_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-198, O-199: the 92 features (the 18 of market and strength are held against plain Python in the tests)."""
    return projection_v3(spark, sf_dir)
