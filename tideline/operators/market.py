"""Market state: fair probabilities, agreement, divergence, confidence, volatility and sharp moves of a match's quotes.

All six scores come from two frames on one partitioning by match: the latest quote of each book, and the forward-filled
median points. Scores are rounded half-even to four places where the next score takes them in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.columns import clamp
from tideline.operators.timeseries import BOOKS, ORDER, POINTS, fair, fair_points, median_of, steps, ticks
from tideline.registry import dialect, query, sql_query

OUTCOMES = ("home", "draw", "away")
EPSILON = 0.0005


def latest_by_book(t: DataFrame) -> DataFrame:
    """Fair probabilities of each book's latest quote."""
    last = t.groupBy("match_id", "book").agg(F.max_by(F.struct("home", "draw", "away"), F.struct(*ORDER)).alias("q"))
    return last.select("match_id", "book", "q.*").select("match_id", "book", *[fair(o).alias(f"p_{o}") for o in OUTCOMES])


def agreement(books: DataFrame) -> DataFrame:
    """Consensus probabilities, consensus score, divergence and outliers of each match."""
    per = books.groupBy("match_id").agg(
        *[F.median(f"p_{o}").alias(f"m_{o}") for o in OUTCOMES],
        F.greatest(*[F.stddev_pop(f"p_{o}") for o in OUTCOMES]).alias("worst"),
        (sum((F.max(f"p_{o}") - F.min(f"p_{o}") for o in OUTCOMES), F.lit(0.0)) / 3).alias("spread"),
        F.collect_list("p_home").alias("homes"),
        F.count("*").alias("books"),
    )
    total = sum((F.col(f"m_{o}") for o in OUTCOMES), F.lit(0.0))
    outliers = F.size(F.filter("homes", lambda p: F.abs(p - F.col("m_home")) >= 0.08))
    return per.select(
        "match_id",
        *[(F.col(f"m_{o}") / total).alias(f"fair_{o}") for o in OUTCOMES],
        F.bround(clamp(1 - F.col("worst") / 0.08), 4).alias("consensus"),
        F.when(F.col("books") >= 2, F.bround(clamp(F.col("spread") / 0.20), 4)).alias("divergence"),
        F.when(F.col("books") >= 3, outliers).otherwise(0).alias("outliers"),
        "books",
    )


def decisiveness(columns: list) -> Column:
    s = F.sort_array(F.array(*columns), asc=False)
    return clamp((s[0] - s[1]) / 0.5)


def confidence(t: DataFrame, state: DataFrame) -> DataFrame:
    """O-151: decisiveness of the consensus, agreement, and the velocity of decisiveness."""
    w = Window.partitionBy("match_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    wide = t.select("match_id", *ORDER, "book", *[fair(o).alias(f"p_{o}") for o in OUTCOMES])
    for o in OUTCOMES:
        filled = F.array(*[F.last(F.when(F.col("book") == b, F.col(f"p_{o}")), ignorenulls=True).over(w) for b in BOOKS])
        wide = wide.withColumn(f"m_{o}", median_of(filled))
    series = wide.withColumn("d", decisiveness([F.col(f"m_{o}") for o in OUTCOMES]))
    series = series.withColumn("i", F.row_number().over(Window.partitionBy("match_id").orderBy(*ORDER)) - 1).withColumn("n", F.count("*").over(Window.partitionBy("match_id")))
    middle = F.when(F.col("n") >= 3, F.floor(F.col("n") / 2)).otherwise(0)
    ends = series.groupBy("match_id").agg((F.max(F.when(F.col("i") == F.col("n") - 1, F.col("d"))) - F.max(F.when(F.col("i") == middle, F.col("d")))).alias("velocity"))
    d = decisiveness([F.col(f"fair_{o}") for o in OUTCOMES])
    joined = state.join(ends, "match_id")
    return joined.select("match_id", F.bround(clamp(0.7 * d + 0.3 * F.col("consensus")), 4).alias("confidence"), F.bround("velocity", 4).alias("velocity"), F.bround(d, 4).alias("decisiveness"))


def movement(t: DataFrame) -> DataFrame:
    """O-152, O-153: volatility, stability and sharp-move score of the median home points."""
    d = steps(fair_points(t)).where("d is not null")
    back = Window.partitionBy("match_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    moving = (F.abs("d") >= 0.005).cast("int")
    d = d.withColumn("island", F.sum(moving).over(Window.partitionBy("match_id").orderBy(*ORDER))).withColumn("back", F.row_number().over(back)).withColumn("last", F.first("d").over(back))
    sign = F.when(F.abs("last") < EPSILON, 0).otherwise(F.signum("last"))
    runs = d.groupBy("match_id", "island").agg(
        F.sum(moving).alias("moves"),
        F.count("*").alias("n"),
        F.sum(F.abs("d")).alias("size"),
        F.max("last").alias("last"),
        F.min(F.when(F.col("d") * sign <= EPSILON, F.col("back"))).alias("stop"),
    )
    per = runs.groupBy("match_id").agg(
        F.sum("n").alias("n"),
        F.sum("moves").alias("moves"),
        F.sum("size").alias("magnitude"),
        F.max(F.col("n") - F.col("moves")).alias("quiet"),
        F.max("last").alias("last"),
        F.min("stop").alias("stop"),
    )
    own = Window.partitionBy("match_id", "book").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    books = t.withColumn("p", fair("home")).withColumn("r", F.row_number().over(own)).withColumn("step", F.col("p") - F.lead("p").over(own)).where("r = 1 and step is not null")
    dirs = per.withColumn("direction", sign.cast("int"))
    coord = books.join(dirs.select("match_id", "direction"), "match_id").groupBy("match_id").agg(F.count(F.when((F.col("direction") != 0) & (F.col("step") * F.col("direction") > EPSILON), 1)).alias("together"), F.count("*").alias("all"))
    out = dirs.join(coord, "match_id", "left").where("n >= 2")
    moved = F.col("direction") != 0
    speed = F.when(moved, clamp(F.abs("last") / 0.06)).otherwise(0.0)
    run = F.when(moved, clamp(F.coalesce(F.col("stop") - 1, F.col("n")) / 3.0)).otherwise(0.0)
    together = F.coalesce(F.col("together") / F.col("all"), F.lit(0.0))
    frequency = F.col("moves") / F.col("n")
    return out.select(
        "match_id",
        F.bround(clamp(0.5 * frequency + 0.5 * clamp(F.col("magnitude") / 0.12)), 4).alias("volatility"),
        F.bround(F.col("quiet") / F.col("n"), 4).alias("stability"),
        F.bround(clamp(0.45 * speed + 0.25 * run + 0.30 * together), 4).alias("sharp"),
        "direction",
    )


def market_state(t: DataFrame) -> DataFrame:
    """O-154: all scores of each match in one row."""
    state = agreement(latest_by_book(t))
    return state.join(confidence(t, state), "match_id").join(movement(t), "match_id", "left")


_BOOKS = """,
b AS (SELECT match_id, book, max_by(fh, k) AS p_home, max_by(fd, k) AS p_draw, max_by(fa, k) AS p_away FROM (SELECT match_id, book, (ts, event_id) AS k, (1 / home) / (1 / home + 1 / draw + 1 / away) AS fh, (1 / draw) / (1 / home + 1 / draw + 1 / away) AS fd, (1 / away) / (1 / home + 1 / draw + 1 / away) AS fa FROM t) GROUP BY match_id, book),
a AS (SELECT match_id, median(p_home) AS mh, median(p_draw) AS md, median(p_away) AS ma, greatest(stddev_pop(p_home), stddev_pop(p_draw), stddev_pop(p_away)) AS worst, (max(p_home) - min(p_home) + max(p_draw) - min(p_draw) + max(p_away) - min(p_away)) / 3 AS spread, count(*) AS books FROM b GROUP BY match_id),
state AS (SELECT match_id, mh / (mh + md + ma) AS fair_home, md / (mh + md + ma) AS fair_draw, ma / (mh + md + ma) AS fair_away, round_even(greatest(0.0, least(1.0, 1 - worst / 0.08)), 4) AS consensus,
  CASE WHEN books >= 2 THEN round_even(greatest(0.0, least(1.0, spread / 0.20)), 4) END AS divergence,
  CASE WHEN books >= 3 THEN (SELECT CAST(count(*) AS INT) FROM b WHERE b.match_id = a.match_id AND abs(p_home - mh) >= 0.08) ELSE 0 END AS outliers, books FROM a)"""


@query("market_agreement", dialect(POINTS.replace("{o}", "home").split(",\nf AS")[0] + _BOOKS, oracle=True) + " SELECT match_id, round(fair_home, 6) AS fair_home, round(fair_draw, 6) AS fair_draw, round(fair_away, 6) AS fair_away, consensus, divergence, outliers, books FROM state")
def market_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-146, O-147, O-149, O-150: fair consensus, consensus score, divergence, outliers."""
    s = agreement(latest_by_book(ticks(spark, sf_dir)))
    return s.select("match_id", *[F.round(f"fair_{o}", 6).alias(f"fair_{o}") for o in OUTCOMES], "consensus", "divergence", "outliers", "books")


_MOVE = dialect(POINTS.replace("{o}", "home"), oracle=True) + """,
d0 AS (SELECT *, p - lag(p) OVER (PARTITION BY match_id ORDER BY ts, event_id) AS d FROM points),
d1 AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY ts DESC, event_id DESC) AS back, sum((abs(d) >= 0.005)::INT) OVER (PARTITION BY match_id ORDER BY ts, event_id) AS island FROM d0 WHERE d IS NOT NULL),
lst AS (SELECT match_id, max(d) AS lastd FROM d1 WHERE back = 1 GROUP BY match_id),
dr AS (SELECT match_id, lastd, CASE WHEN abs(lastd) < 0.0005 THEN 0 ELSE CAST(sign(lastd) AS INT) END AS direction FROM lst),
q AS (SELECT match_id, max(c) AS quiet FROM (SELECT match_id, island, count(*) FILTER (WHERE abs(d) < 0.005) AS c FROM d1 GROUP BY match_id, island) GROUP BY match_id),
per AS (SELECT d1.match_id, count(*) AS n, count(*) FILTER (WHERE abs(d) >= 0.005) AS moves, sum(abs(d)) AS magnitude, min(back) FILTER (WHERE d * direction <= 0.0005) AS stop FROM d1 JOIN dr USING (match_id) GROUP BY d1.match_id),
bs AS (SELECT match_id, fp - lead(fp) OVER (PARTITION BY match_id, book ORDER BY ts DESC, event_id DESC) AS step, row_number() OVER (PARTITION BY match_id, book ORDER BY ts DESC, event_id DESC) AS r FROM f),
co AS (SELECT bs.match_id, count(*) FILTER (WHERE direction <> 0 AND step * direction > 0.0005) AS together, count(*) AS alln FROM bs JOIN dr USING (match_id) WHERE r = 1 AND step IS NOT NULL GROUP BY bs.match_id),
mv AS (SELECT match_id, round_even(greatest(0.0, least(1.0, 0.5 * moves / n + 0.5 * greatest(0.0, least(1.0, magnitude / 0.12)))), 4) AS volatility, round_even(quiet * 1.0 / n, 4) AS stability,
  round_even(greatest(0.0, least(1.0, 0.45 * CASE WHEN direction <> 0 THEN least(1.0, abs(lastd) / 0.06) ELSE 0 END + 0.25 * CASE WHEN direction <> 0 THEN least(1.0, coalesce(stop - 1, n) / 3.0) ELSE 0 END + 0.30 * coalesce(together * 1.0 / alln, 0))), 4) AS sharp, direction
  FROM per JOIN dr USING (match_id) JOIN q USING (match_id) LEFT JOIN co USING (match_id) WHERE n >= 2)"""


@query("market_movement", _MOVE + " SELECT * FROM mv")
def market_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-152, O-153: volatility, stability, sharp move."""
    return movement(ticks(spark, sf_dir))


@query("trend_sharp_move", _MOVE + " SELECT match_id, direction, sharp AS strength, CASE WHEN sharp < 0.85 THEN 'high' ELSE 'critical' END AS severity FROM mv WHERE sharp >= 0.6")
def trend_sharp_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-166, O-153: sharp moves by speed, run and coordination of the books."""
    m = movement(ticks(spark, sf_dir)).where("sharp >= 0.6")
    return m.select("match_id", "direction", F.col("sharp").alias("strength"), F.when(F.col("sharp") < 0.85, "high").otherwise("critical").alias("severity"))


@query("market_state_shares", _MOVE + _BOOKS + " SELECT direction, CAST(count(*) AS BIGINT) AS n, round(avg(consensus), 4) AS consensus, round(avg(divergence), 4) AS divergence, round(avg(volatility), 4) AS volatility, round(avg(sharp), 4) AS sharp FROM state JOIN mv USING (match_id) GROUP BY direction")
def market_state_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-154: the composed market state, summed up by direction."""
    s = market_state(ticks(spark, sf_dir)).where("direction is not null")
    return s.groupBy("direction").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in ("consensus", "divergence", "volatility", "sharp")])


_CONF = dialect("""
WITH t AS (SELECT * FROM {ticks}),
f AS (SELECT *, (1 / home) / (1 / home + 1 / draw + 1 / away) AS fh, (1 / draw) / (1 / home + 1 / draw + 1 / away) AS fd, (1 / away) / (1 / home + 1 / draw + 1 / away) AS fa FROM t),
g AS (SELECT t.match_id, t.ts, t.event_id, b.book FROM t CROSS JOIN (SELECT DISTINCT book FROM t) b),
j AS (SELECT g.match_id, g.ts, g.event_id, f.fh, f.fd, f.fa FROM g ASOF JOIN f ON g.match_id = f.match_id AND g.book = f.book AND g.ts >= f.ts),
m AS (SELECT match_id, ts, event_id, list_reverse_sort([median(fh), median(fd), median(fa)]) AS s FROM j GROUP BY match_id, ts, event_id),
i AS (SELECT match_id, greatest(0.0, least(1.0, (s[1] - s[2]) / 0.5)) AS d, row_number() OVER (PARTITION BY match_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY match_id) AS n FROM m),
v AS (SELECT match_id, max(d) FILTER (WHERE i = n - 1) - max(d) FILTER (WHERE i = CASE WHEN n >= 3 THEN n // 2 ELSE 0 END) AS velocity FROM i GROUP BY match_id)""", oracle=True)


@query("market_confidence", _CONF + _BOOKS + """,
x AS (SELECT match_id, consensus, list_reverse_sort([fair_home, fair_draw, fair_away]) AS s FROM state)
SELECT match_id, round_even(greatest(0.0, least(1.0, 0.7 * greatest(0.0, least(1.0, (s[1] - s[2]) / 0.5)) + 0.3 * consensus)), 4) AS confidence, round_even(velocity, 4) + 0.0 AS velocity, round_even(greatest(0.0, least(1.0, (s[1] - s[2]) / 0.5)), 4) AS decisiveness FROM x JOIN v USING (match_id)""")
def market_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-112, O-151: confidence, its velocity, decisiveness."""
    t = ticks(spark, sf_dir)
    return confidence(t, agreement(latest_by_book(t))).withColumn("velocity", F.col("velocity") + F.lit(0.0))


sql_query("market_odds_features", "O-155: the seven odds features.", """
WITH t AS (SELECT * FROM {ticks}),
l AS (SELECT match_id, book, max_by(home, (ts, event_id)) AS home, max_by(draw, (ts, event_id)) AS draw, max_by(away, (ts, event_id)) AS away FROM t GROUP BY match_id, book),
c AS (SELECT match_id, avg(home) AS home_odds, avg(draw) AS draw_odds, avg(away) AS away_odds, count(*) AS books FROM l GROUP BY match_id),
s AS (SELECT match_id, home - lag(home) OVER (PARTITION BY match_id ORDER BY ts, event_id) AS d, row_number() OVER (PARTITION BY match_id ORDER BY ts DESC, event_id DESC) AS back FROM t)
SELECT c.match_id, round(home_odds, 6) AS home_odds, round(draw_odds, 6) AS draw_odds, round(away_odds, 6) AS away_odds, CAST(1 AS BIGINT) AS market_count, CAST(books AS BIGINT) AS bookmaker_count, round(coalesce(d, 0.0), 6) AS odds_delta, CAST(coalesce(sign(d), 0) AS INT) AS odds_movement
FROM c LEFT JOIN s ON s.match_id = c.match_id AND s.back = 1""")

sql_query("market_context_recompute", "O-156: implied probabilities and the pressure carried forward or recomputed.", """
WITH l AS (SELECT match_id, max_by(home, (ts, event_id)) AS home, max_by(draw, (ts, event_id)) AS draw, max_by(away, (ts, event_id)) AS away, CAST(max(event_id) % 95 AS DOUBLE) AS minute, count(*) AS n FROM {ticks} GROUP BY match_id),
p AS (SELECT *, 1 / home AS ih, 1 / draw AS idr, 1 / away AS ia FROM l)
SELECT match_id, round(ih / (ih + idr + ia), 6) AS p_home, round(idr / (ih + idr + ia), 6) AS p_draw, round(ia / (ih + idr + ia), 6) AS p_away,
  round(CASE WHEN n >= 60 THEN (greatest(ih, idr, ia) - least(ih, idr, ia)) / (ih + idr + ia) * (0.5 + 0.5 * least(minute / 90, 1.2)) ELSE 0.5 * 0.95 END, 6) AS pressure FROM p""")
