"""Filters with optional arguments: one that is not given (null) does not filter.

Given as values, the conjunction only holds what was given, so Catalyst pushes it into the scan. Given as a table of
scopes, rows meet the scopes of their normalised competition, or those of any, by an equality join on that key; the
optional year and season are conditions of the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.scalar import ACCENTS
from tideline.registry import query, run_sql

# Other names of competitions.
ALIASES = {"brasileirao": "brasileirao_serie_a", "epl": "premier_league", "ucl": "champions_league"}


def optional(rows: DataFrame, since: object = None, until: object = None, at: str = "ts", without: dict[str, object] | None = None, **equal: object) -> DataFrame:
    """Rows that equal what is given of ``equal``, differ from ``without``, and lie in [since, until)."""
    parts = [F.col(c) == v for c, v in equal.items() if v is not None]
    parts += [F.col(c) != v for c, v in (without or {}).items() if v is not None]
    parts += [F.col(at) >= F.lit(since)] if since is not None else []
    parts += [F.col(at) < F.lit(until)] if until is not None else []
    return rows.where(reduce(lambda a, b: a & b, parts)) if parts else rows


def competition_key(name: Column) -> Column:
    """Lower case without accents, words joined by underscores, other names resolved."""
    key = F.regexp_replace(F.regexp_replace(F.translate(F.lower(name), *ACCENTS), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[key], key)


def in_scopes(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """Rows of (competition, kickoff_at, season) with the ``scope`` of each scope (scope, competition, year, season) they are in."""
    keyed = rows.withColumn("_key", competition_key(F.col("competition")))
    asked = scopes.select("scope", competition_key(F.col("competition")).alias("_key"), F.col("year").alias("_year"), F.col("season").alias("_season"))
    own = keyed.join(asked.where("_key IS NOT NULL"), "_key")
    any_ = keyed.select("*", F.lit(1).alias("_one")).join(asked.where("_key IS NULL").drop("_key").withColumn("_one", F.lit(1)), "_one").drop("_one")
    both = own.unionByName(any_.select(*own.columns))
    holds = (F.col("_year").isNull() | (F.year("kickoff_at") == F.col("_year"))) & (F.col("_season").isNull() | (F.col("season") == F.col("_season")))
    return both.where(holds).drop("_key", "_year", "_season")


SCOPES = [("all", None, None, None), ("urgent", " 1-Úrgent ", None, None), ("year", None, 1998, None), ("both", "2 HIGH", 1997, None), ("season", "5_low", None, "1999/2000"), ("none", "5-LOW", 2000, "1995/1996")]
_MATCHES = "SELECT uid, competition, kickoff_at, CASE WHEN month(kickoff_at) >= 7 THEN concat(CAST(year(kickoff_at) AS [[STRING||VARCHAR]]), '/', CAST(year(kickoff_at) + 1 AS [[STRING||VARCHAR]])) ELSE concat(CAST(year(kickoff_at) - 1 AS [[STRING||VARCHAR]]), '/', CAST(year(kickoff_at) AS [[STRING||VARCHAR]])) END AS season FROM {matches}"


@query("filter_scopes", f"""
WITH m AS ({_MATCHES})
SELECT 'all' AS scope, uid FROM m UNION ALL SELECT 'urgent', uid FROM m WHERE competition = '1-URGENT' UNION ALL SELECT 'year', uid FROM m WHERE year(kickoff_at) = 1998
UNION ALL SELECT 'both', uid FROM m WHERE competition = '2-HIGH' AND year(kickoff_at) = 1997 UNION ALL SELECT 'season', uid FROM m WHERE competition = '5-LOW' AND season = '1999/2000' UNION ALL SELECT 'none', uid FROM m WHERE competition = '5-LOW' AND year(kickoff_at) = 2000 AND season = '1995/1996'""")
def q_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-29, O-28: matches by scopes of normalised competition, year and season, each of which may be left open."""
    scopes = spark.createDataFrame(SCOPES, "scope string, competition string, year int, season string")
    return in_scopes(run_sql(spark, sf_dir, _MATCHES), F.broadcast(scopes)).select("scope", "uid")


@query("filter_optional_arguments", """
SELECT 'typed' AS asked, event_id FROM events WHERE event_type = 'click' AND user_id <> 7 UNION ALL SELECT 'open', event_id FROM events UNION ALL SELECT 'interval', event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND user_id = 3""")
def q_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-28, O-30: arguments that are null do not filter; the interval is half open."""
    e = run_sql(spark, sf_dir, "SELECT event_id, event_type, user_id, ts FROM {events}")
    asked = {"typed": optional(e, event_type="click", user_id=None, without={"user_id": 7}), "open": optional(e, event_type=None), "interval": optional(e, F.expr("TIMESTAMP_NTZ '2024-01-05 00:00:00'"), F.expr("TIMESTAMP_NTZ '2024-01-12 00:00:00'"), user_id=3)}
    return reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("asked"), "event_id") for k, d in asked.items()])
