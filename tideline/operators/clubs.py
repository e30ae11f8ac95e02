"""Club resolution: a raw name to a registered club, by its folded name or else by a set-containment join.

A club matches a name if every token of the club's name is in the name; of several, the first in the registry. All
pairs are never formed: a registered name is filed under its rarest token, so a raw name only meets the few names that
are filed under one of its tokens, and those are confirmed by subset. Equal raw names are resolved once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.scalar import ACCENTS
from tideline.registry import query, run_sql

# Words of a club's name that say nothing.
NOISE = r"\b(futebol clube|football club|f\.?c\.?|e\.?c\.?|s\.?c\.?|a\.?c\.?|clube de regatas|esporte clube|associacao|club|cf|cd|afc|sc|ec|ac)\b"


def club_key(name: Column) -> Column:
    """Lower case without accents and noise words; only letters, digits and single spaces."""
    plain = F.translate(F.lower(name), *ACCENTS)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, NOISE, " "), "[^a-z0-9]+", " "))


def registry(clubs: DataFrame) -> DataFrame:
    """(key, club, place, tokens) of each folded name; of clubs with one name the first in ``place`` has it.

    ``clubs`` has club, name and place, the order of the registry; names that fold to nothing are not registered.
    """
    keyed = clubs.select("club", "place", club_key(F.col("name")).alias("key")).where("key <> ''")
    first = keyed.groupBy("key").agg(F.min(F.struct("place", "club")).alias("f"))
    return first.select("key", "f.club", "f.place", F.array_distinct(F.split("key", " ")).alias("tokens"))


def resolve(names: DataFrame, clubs: DataFrame, name: str = "name") -> DataFrame:
    """(key, club, how) of each different folded name: 'exact', 'subset', or no club. Null and empty names are left out."""
    known = registry(clubs)
    keys = names.select(club_key(F.col(name)).alias("key")).where("key <> ''").distinct()
    exact = keys.join(known.select("key", "club"), "key", "left")
    open_ = exact.where("club IS NULL").select("key")
    often = known.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    filed = known.select("key", "club", "place", "tokens", F.explode("tokens").alias("token")).join(often, "token")
    filed = filed.groupBy("key").agg(F.min(F.struct("n", "token")).alias("rarest"), F.first("club").alias("club"), F.first("place").alias("place"), F.first("tokens").alias("tokens"))
    filed = filed.select(F.col("rarest.token").alias("token"), "club", "place", "tokens")
    asked = open_.select("key", F.array_distinct(F.split("key", " ")).alias("own")).select("key", "own", F.explode("own").alias("token"))
    met = asked.join(filed, "token").where(F.size(F.array_except("tokens", "own")) == 0)
    found = met.groupBy("key").agg(F.min(F.struct("place", "club")).alias("f")).select("key", F.col("f.club").alias("found"))
    out = exact.join(found, "key", "left")
    how = F.when(F.col("club").isNotNull(), "exact").when(F.col("found").isNotNull(), "subset").otherwise("none")
    return out.select("key", F.coalesce("club", "found").alias("club"), how.alias("how"))


# customers stand for clubs, orders for rows with raw names of them
CLUBS = "(SELECT c_custkey AS club, c_custkey AS place, concat('Ésporte ', c_mktsegment, ' F.C. ', CAST(c_custkey % 53 AS [[STRING||VARCHAR]]), CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('-', CAST(c_nationkey AS [[STRING||VARCHAR]])) END) AS name FROM {customer})"
NAMES = "(SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 6 = 5 THEN concat('Unknown ', o_orderpriority) ELSE concat(CASE WHEN o_orderkey % 3 = 0 THEN 'AFC ' ELSE '' END, CAST(o_custkey % 53 AS [[STRING||VARCHAR]]), '  esporte ', CASE o_custkey % 5 WHEN 0 THEN 'Building' WHEN 1 THEN 'AUTOMOBILE' WHEN 2 THEN 'machinery' WHEN 3 THEN 'Hôusehold' ELSE 'furniture' END, CASE WHEN o_orderkey % 2 = 0 THEN concat(' ', CAST(o_orderkey % 25 AS [[STRING||VARCHAR]])) ELSE '' END, CASE WHEN o_orderkey % 7 = 0 THEN ' (reserves)' ELSE '' END) END AS name FROM {orders})"
_KEY = "trim(regexp_replace(regexp_replace(translate(lower(name), '{}', '{}'), '{}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))".format(*ACCENTS, NOISE)


@query("club_resolution", f"""
WITH c AS (SELECT club, place, {_KEY} AS key FROM {CLUBS}), r AS (SELECT key, min_by(club, place) AS club, min(place) AS place FROM c WHERE key <> '' GROUP BY key),
n AS (SELECT DISTINCT {_KEY} AS key FROM {NAMES}), x AS (SELECT n.key, r.club FROM n LEFT JOIN r USING (key) WHERE n.key <> ''),
s AS (SELECT x.key, min_by(r.club, r.place) AS club FROM x JOIN r ON list_has_all(string_split(x.key, ' '), string_split(r.key, ' ')) WHERE x.club IS NULL GROUP BY x.key)
SELECT x.key, coalesce(x.club, s.club) AS club, CASE WHEN x.club IS NOT NULL THEN 'exact' WHEN s.club IS NOT NULL THEN 'subset' ELSE 'none' END AS how FROM x LEFT JOIN s USING (key)""")
def q_clubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-202, O-132: raw club names to registered clubs, exactly or by their tokens; the oracle tries all pairs."""
    return resolve(run_sql(spark, sf_dir, f"SELECT * FROM {NAMES} n"), run_sql(spark, sf_dir, f"SELECT * FROM {CLUBS} c"))
