"""Connected leagues: competitions that share teams, directly or over others, as the unit of ratings.

A team keeps one rating over all its competitions, so ratings of competitions that share a team depend on each other;
those of different connected leagues don't, and are folded in parallel. The leagues are connected components of the
graph of teams and competitions: every competition takes the least label of any competition that one of its teams plays
in, then the label of that label, until nothing changes. All state is in tables; a round is two aggregations.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.state import Elo, _fold
from tideline.registry import query, run_sql
from tideline.session import written


def leagues(plays: DataFrame) -> DataFrame:
    """(competition, league) from rows of (team, competition); a league is named after its least competition."""
    edges = written(plays.select("team", "competition").where("team IS NOT NULL AND competition IS NOT NULL").distinct(), "plays")
    labels = written(edges.select("competition").distinct().withColumn("league", F.col("competition")), "labels")
    before = None
    while True:
        by_team = edges.join(labels, "competition").groupBy("team").agg(F.min("league").alias("league"))
        near = edges.join(by_team, "team").groupBy("competition").agg(F.min("league").alias("league"))
        far = labels.select(F.col("competition").alias("league"), F.col("league").alias("further"))
        labels = written(near.join(far, "league").select("competition", F.col("further").alias("league")), "labels")
        now = labels.agg(F.count_distinct("league"), F.sum(F.xxhash64("competition", "league").cast("decimal(38,0)"))).first()
        if now == before:
            return labels
        before = now


class Strength(Elo):
    """Ratings of both sides before each match, and the mean rating of those that have played in its competition's season."""

    def __init__(self) -> None:
        super().__init__()
        self.seen: dict[object, set] = {}

    def step(self, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            if r.kickoff_at != self.kickoff:
                for m, where in self.waiting:
                    self._record(*m)
                    self.seen.setdefault(where, set()).update(m[:2])
                self.kickoff, self.waiting = r.kickoff_at, []
            there = self.seen.get((r.competition, r.season), ())
            mean = sum(self.rating[t] for t in there) / len(there) if there else self.first
            out.append((r.uid, *(round(x, 6) for x in (*self._of(r.home, r.away), mean))))
            self.waiting.append(((r.home, r.away, r.home_goals, r.away_goals), (r.competition, r.season)))
        return pd.DataFrame(out, columns=["uid", "home_elo", "away_elo", "home_venue", "away_venue", "league_strength"])


def ratings(matches: DataFrame) -> DataFrame:
    """(uid, ratings) of matches with uid, home, away, goals, kickoff_at (microseconds), competition and season."""
    sides = matches.select(F.col("home").alias("team"), "competition").unionByName(matches.select(F.col("away").alias("team"), "competition"))
    named = matches.join(leagues(sides), "competition")
    return _fold(named, ["league"], ["kickoff_at", "uid"], lambda: Strength().step, "uid long, home_elo double, away_elo double, home_venue double, away_venue double, league_strength double")


#: Customers as teams in groups of fifty with three competitions each; a cup joins every second group with the next.
FIXTURES = """(SELECT o_orderkey AS uid, h AS home, CASE WHEN cup THEN (g + 1) * 50 + r ELSE g * 50 + r END AS away, CAST(floor(o_totalprice) AS BIGINT) % 5 AS home_goals, CAST(floor(o_totalprice / 7) AS BIGINT) % 4 AS away_goals, o_orderdate AS kickoff_at, CASE WHEN cup THEN 1000000 + g ELSE g * 3 + o_orderkey % 3 END AS competition, year(o_orderdate) AS season
  FROM (SELECT *, o_custkey AS h, CAST(floor(o_custkey / 50e0) AS BIGINT) AS g, (o_custkey * 7 + o_orderkey) % 50 AS r, CAST(floor(o_custkey / 50e0) AS BIGINT) % 2 = 0 AND o_orderkey % 17 = 0 AS cup FROM {orders}) o WHERE cup OR g * 50 + r <> h)"""


@query("league_components", f"""
WITH RECURSIVE m AS (SELECT * FROM {FIXTURES}), p AS (SELECT home AS team, competition FROM m UNION SELECT away, competition FROM m),
n AS (SELECT DISTINCT a.competition AS a, b.competition AS b FROM p a JOIN p b USING (team)),
r AS (SELECT a AS competition, a AS reached FROM n UNION SELECT r.competition, n.b FROM r JOIN n ON n.a = r.reached)
SELECT competition, min(reached) AS league FROM r GROUP BY competition""")
def q_leagues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-199: connected leagues."""
    m = run_sql(spark, sf_dir, f"SELECT * FROM {FIXTURES} f")
    return leagues(m.select(F.col("home").alias("team"), "competition").unionByName(m.select(F.col("away").alias("team"), "competition")))


@query("league_ratings")
def q_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-199, O-198: ratings of both sides and of the league before each match, folded by connected league (held against plain Python in the tests)."""
    m = run_sql(spark, sf_dir, f"SELECT * FROM {FIXTURES} f")
    return ratings(m.withColumn("kickoff_at", F.unix_micros(F.col("kickoff_at").cast("timestamp"))))
