"""Time-series operators over quotes: latest per key, forward fill, deltas, runs, downsampling, half windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.registry import ENTITIES, dialect, query, run_sql, sql_query

BOOKS = ("click", "error", "purchase", "signup", "view")
ORDER = ("ts", "event_id")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, "SELECT * FROM {ticks}")


def fair(outcome: str) -> Column:
    """A book's probability of an outcome without its margin (O-146)."""
    total = sum((F.coalesce(1 / F.col(c), F.lit(0.0)) for c in ("home", "draw", "away")), F.lit(0.0))
    return (1 / F.col(outcome)) / total


def median_of(xs: Column) -> Column:
    """Midpoint median of an array, nulls left out."""
    s = F.array_sort(F.filter(xs, lambda x: x.isNotNull()))
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def fair_points(t: DataFrame, outcome: str = "home", books: tuple[str, ...] = BOOKS) -> DataFrame:
    """Median over books of each book's latest fair probability, at every instant of a match (O-53, O-148).

    One window pass with one forward-filled column a book instead of a grid of books and instants, which would grow with
    the square of a match's quotes.
    """
    w = Window.partitionBy("match_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.array(*[F.last(F.when(F.col("book") == b, F.col("_p")), ignorenulls=True).over(w) for b in books])
    return t.withColumn("_p", fair(outcome)).select("match_id", "ts", "event_id", median_of(filled).alias("p"))


#: The same points for the oracle: an as-of join of every instant with every book.
POINTS = """
WITH t AS (SELECT * FROM {ticks}),
f AS (SELECT *, (1 / {o}) / (1 / home + 1 / draw + 1 / away) AS fp FROM t),
g AS (SELECT t.match_id, t.ts, t.event_id, b.book FROM t CROSS JOIN (SELECT DISTINCT book FROM t) b),
j AS (SELECT g.match_id, g.ts, g.event_id, f.fp FROM g ASOF JOIN f ON g.match_id = f.match_id AND g.book = f.book AND g.ts >= f.ts),
points AS (SELECT match_id, ts, event_id, median(fp) AS p FROM j GROUP BY match_id, ts, event_id)""".replace("{ticks}", ENTITIES["ticks"])


@query("ts_forward_fill_points", dialect(POINTS.replace("{o}", "home"), oracle=True) + " SELECT match_id, event_id, round(p, 6) AS p FROM points")
def ts_forward_fill_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-53, O-102, O-148: forward-filled median fair probability at every instant."""
    return fair_points(ticks(spark, sf_dir)).select("match_id", "event_id", F.round("p", 6).alias("p"))


def steps(points: DataFrame) -> DataFrame:
    """Deltas of a series with their order and the length of the series."""
    w = Window.partitionBy("match_id").orderBy(*ORDER)
    return points.withColumn("d", F.col("p") - F.lag("p").over(w)).withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("match_id")))


@query("ts_runs", dialect(POINTS.replace("{o}", "home"), oracle=True) + """,
d AS (SELECT *, p - lag(p) OVER (PARTITION BY match_id ORDER BY ts, event_id) AS d FROM points),
m AS (SELECT *, abs(d) >= 0.005 AS moving FROM d WHERE d IS NOT NULL),
i AS (SELECT *, sum(moving::INT) OVER (PARTITION BY match_id ORDER BY ts, event_id) AS island FROM m),
r AS (SELECT match_id, island, count(*) FILTER (WHERE NOT moving) AS quiet FROM i GROUP BY match_id, island),
k AS (SELECT *, sign(d) AS s, count(*) OVER (PARTITION BY match_id) AS n, row_number() OVER (PARTITION BY match_id ORDER BY ts DESC, event_id DESC) AS back FROM m),
l AS (SELECT match_id, max(CASE WHEN back = 1 THEN s END) AS last_sign FROM k GROUP BY match_id),
b AS (SELECT k.match_id, min(CASE WHEN k.s <> l.last_sign OR abs(k.d) <= 0.0005 THEN k.back END) AS first_break, max(k.n) AS n FROM k JOIN l USING (match_id) GROUP BY k.match_id)
SELECT b.match_id, CAST((SELECT max(quiet) FROM r WHERE r.match_id = b.match_id) AS BIGINT) AS longest_quiet, CAST(coalesce(first_break - 1, n) AS BIGINT) AS trailing_run FROM b""")
def ts_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-103, O-104: longest quiet run and trailing run in the latest direction (gaps and islands)."""
    d = steps(fair_points(ticks(spark, sf_dir))).where("d is not null")
    w = Window.partitionBy("match_id").orderBy(*ORDER)
    moving = F.abs("d") >= 0.005
    d = d.withColumn("island", F.sum(moving.cast("int")).over(w)).withColumn("quiet", (~moving).cast("int"))
    d = d.withColumn("back", F.row_number().over(Window.partitionBy("match_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())))
    d = d.withColumn("last_sign", F.first(F.signum("d")).over(Window.partitionBy("match_id").orderBy("back")))
    breaks = F.when((F.signum("d") != F.col("last_sign")) | (F.abs("d") <= 0.0005), F.col("back"))
    per = d.groupBy("match_id", "island").agg(F.sum("quiet").alias("quiet"), F.min(breaks).alias("first_break"), F.count("*").alias("n"))
    return per.groupBy("match_id").agg(F.max("quiet").alias("longest_quiet"), F.coalesce(F.min("first_break") - 1, F.sum("n")).cast("bigint").alias("trailing_run"))


sql_query("ts_latest_per_book", "O-83, O-84, O-85: latest quote of each book, means over books, distinct counts.", """
WITH l AS (SELECT match_id, book, max_by(home, (ts, event_id)) AS home, max_by(draw, (ts, event_id)) AS draw, max_by(away, (ts, event_id)) AS away, count(*) AS n FROM {ticks} GROUP BY match_id, book)
SELECT match_id, round(avg(home), 6) AS home, round(avg(draw), 6) AS draw, round(avg(away), 6) AS away, CAST(count(DISTINCT book) AS BIGINT) AS books, CAST(sum(n) AS BIGINT) AS snapshots FROM l GROUP BY match_id""")

sql_query("ts_lag_delta_sign", "O-101: last delta of a series and its sign.", """
WITH s AS (SELECT match_id, ts, event_id, home - lag(home) OVER (PARTITION BY match_id ORDER BY ts, event_id) AS d, row_number() OVER (PARTITION BY match_id ORDER BY ts DESC, event_id DESC) AS back FROM {ticks})
SELECT match_id, round(d, 6) AS delta, CAST(sign(d) AS INT) AS movement FROM s WHERE back = 1""")

sql_query("ts_ntile_downsample", "O-100: ntile buckets, then the last row of each bucket.", """
WITH b AS (SELECT user_id, event_id, ts, value, ntile(8) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bucket FROM {events}),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY ts DESC, event_id DESC) AS rk FROM b)
SELECT user_id, CAST(bucket AS INT) AS bucket, event_id, value FROM r WHERE rk = 1""")

sql_query("ts_window_vs_baseline", "O-111: mean of the last 5 and 10 against all; the larger change wins.", """
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM {events}),
a AS (SELECT user_id, avg(value) AS base, avg(CASE WHEN back <= 5 THEN value END) AS v5, avg(CASE WHEN back <= 10 THEN value END) AS v10 FROM r GROUP BY user_id)
SELECT user_id, round(base, 6) AS base, CASE WHEN abs(v5 - base) > abs(v10 - base) THEN 5 ELSE 10 END AS size, round(CASE WHEN abs(v5 - base) > abs(v10 - base) THEN v5 ELSE v10 END - base, 6) AS delta FROM a""")

sql_query("ts_midpoint_velocity", "O-112: last value against the one at index n div 2.", """
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM {events})
SELECT user_id, round(max(CASE WHEN i = n - 1 THEN value END) - max(CASE WHEN i = CAST(floor(n / 2.0) AS BIGINT) THEN value END), 6) AS velocity FROM r GROUP BY user_id""")

sql_query("ts_monotonic_growth", "O-113: windows of a day in which every step is up and the net change positive.", """
WITH s AS (SELECT user_id, CAST(CAST(ts AS DATE) AS [[STRING||VARCHAR]]) AS day, ts, event_id, value, value - lag(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS step FROM {events})
SELECT user_id, day, round(max_by(value, (ts, event_id)) - min_by(value, (ts, event_id)), 6) AS growth FROM s GROUP BY user_id, day HAVING min(step) >= 0 AND max_by(value, (ts, event_id)) > min_by(value, (ts, event_id))""")

sql_query("ts_half_window_split", "O-115: mean before and after the middle of the last two days.", """
WITH m AS (SELECT *, max(ts) OVER (PARTITION BY user_id) AS latest FROM {events})
SELECT user_id, round(avg(CASE WHEN ts <= latest - INTERVAL '24' HOUR THEN value END), 6) AS prior, round(avg(CASE WHEN ts > latest - INTERVAL '24' HOUR THEN value END), 6) AS now FROM m WHERE ts >= latest - INTERVAL '48' HOUR GROUP BY user_id""")

sql_query("ts_retention_recent", "O-222: rows of the last four hours of each series and the matches seen in them.", """
WITH m AS (SELECT max(ts) AS latest FROM {events})
SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n, max(ts) AS last_ts FROM {events} CROSS JOIN m WHERE ts >= latest - INTERVAL '4' HOUR GROUP BY user_id, event_type""")

sql_query("ts_label_streak", "O-103: longest streak of one label.", """
WITH r AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM {events}),
c AS (SELECT user_id, event_type, island, count(*) AS n FROM r GROUP BY user_id, event_type, island)
SELECT user_id, CAST(max(n) AS BIGINT) AS longest FROM c GROUP BY user_id""")
