"""As-of feature queries over one fact table: latest version per key, trailing windows, defaults, latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.columns import clamp, nz
from tideline.registry import load, query, sql_query


def latest_version(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key, the one with the greatest version (O-17); the aggregation combines before it shuffles."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def asof_features(events: DataFrame, seconds: int = 1) -> DataFrame:
    """The windowed feature snapshot as of each user's last event.

    ``seconds`` stretches the windows of 300 and 600 s. Windows are closed at both ends. One pass: the as-of instant is a
    window maximum over the user's rows, after which all features are one aggregation on the same partitioning.
    """
    rows = latest_version(events, ["event_id"], "ts").withColumn("as_of", F.max("ts").over(Window.partitionBy("user_id")))
    age = F.unix_micros(F.col("as_of").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    within = lambda n: age <= n * seconds * 1_000_000
    v = F.col("value")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    agg = (
        rows.withColumn("_rank", rank)
        .groupBy("user_id", "as_of")
        .agg(
            F.avg(F.when(within(300), v)).alias("pressure"),
            F.stddev_pop(F.when(within(600), v)).alias("volatility"),
            (F.max_by(F.when(within(600), v), F.when(within(600), F.struct("ts", "event_id"))) - F.min_by(F.when(within(600), v), F.when(within(600), F.struct("ts", "event_id")))).alias("shift"),
            F.count(F.when(within(600), 1)).alias("n"),
            F.max(F.when(F.col("_rank") == 1, v)).alias("newest"),
            F.max_by(F.when(F.col("_rank") <= 6, v), F.when(F.col("_rank") <= 6, F.col("_rank"))).alias("oldest"),
        )
    )
    known = agg.select(
        "user_id",
        F.col("as_of").cast("timestamp_ntz").alias("as_of"),
        F.round(F.coalesce("pressure", F.lit(0.0)), 6).alias("pressure"),
        F.round(F.coalesce("volatility", F.lit(0.0)), 6).alias("volatility"),
        F.round(F.coalesce("shift", F.lit(0.0)), 6).alias("shift"),
        F.round(F.col("n") / 10.0, 6).alias("density"),
        F.round(nz(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("newest") - F.col("oldest")))), 6).alias("momentum"),
    )
    known = known.withColumn("stability", F.round(1 - clamp(F.col("volatility") / 0.5), 6))
    differs = [(c, d) for c, d in (("pressure", 0.0), ("volatility", 0.0), ("shift", 0.0), ("density", 0.0), ("momentum", 0.0), ("stability", 1.0))]
    share = sum((F.when(F.col(c) != d, 1.0).otherwise(0.0) for c, d in differs), F.lit(0.0)) / len(differs)
    return known.withColumn("data_confidence", F.round(share, 6))


_ASOF = """
WITH r AS (SELECT *, max(ts) OVER (PARTITION BY user_id) AS as_of, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events),
a AS (SELECT user_id, as_of,
  avg(value) FILTER (WHERE ts >= as_of - INTERVAL '{five}' SECOND) AS p,
  stddev_pop(value) FILTER (WHERE ts >= as_of - INTERVAL '{ten}' SECOND) AS v,
  max_by(value, (ts, event_id)) FILTER (WHERE ts >= as_of - INTERVAL '{ten}' SECOND) - min_by(value, (ts, event_id)) FILTER (WHERE ts >= as_of - INTERVAL '{ten}' SECOND) AS s,
  count(*) FILTER (WHERE ts >= as_of - INTERVAL '{ten}' SECOND) AS n,
  max(value) FILTER (WHERE rk = 1) AS newest, max_by(value, rk) FILTER (WHERE rk <= 6) AS oldest
  FROM r GROUP BY user_id, as_of),
k AS (SELECT user_id, as_of, round(coalesce(p, 0.0), 6) AS pressure, round(coalesce(v, 0.0), 6) AS volatility, round(coalesce(s, 0.0), 6) AS shift, round(n / 10.0, 6) AS density,
  round(greatest(-1.0, least(1.0, newest - oldest)), 6) + 0.0 AS momentum FROM a),
f AS (SELECT *, round(1 - greatest(0.0, least(1.0, volatility / 0.5)), 6) AS stability FROM k)
SELECT *, round(((pressure <> 0)::INT + (volatility <> 0)::INT + (shift <> 0)::INT + (density <> 0)::INT + (momentum <> 0)::INT + (stability <> 1)::INT) / 6.0, 6) AS data_confidence FROM f"""


@query("window_asof_features", _ASOF.format(five=300, ten=600))
def window_asof_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-17, O-27, O-63, O-64, O-65, O-66, O-114, O-157: the feature snapshot with windows of 300 and 600 s."""
    return asof_features(load(spark, sf_dir, "events"))


@query("window_asof_features_days", _ASOF.format(five=300 * 288, ten=600 * 288))
def window_asof_features_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same snapshot with windows of 1 and 2 days, which hold several events."""
    return asof_features(load(spark, sf_dir, "events"), 288)


@query("window_latest_minute", "SELECT user_id, max_by(CAST(json_extract_string(props, '$.k') AS BIGINT), (ts, event_id)) AS minute FROM events WHERE event_type <> 'error' GROUP BY user_id")
def window_latest_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-66: the latest non-null minute of each match."""
    e = load(spark, sf_dir, "events").where("event_type <> 'error'")
    minute = F.get_json_object("props", "$.k").cast("bigint")
    return e.groupBy("user_id").agg(F.max_by(minute, F.struct("ts", "event_id")).alias("minute"))


@query("window_latest_six", "SELECT user_id, string_agg(CAST(value AS VARCHAR), ',' ORDER BY ts, event_id) AS series, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk <= 6 GROUP BY user_id")
def window_latest_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-114: the latest six rows of each match, oldest first."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    six = load(spark, sf_dir, "events").withColumn("rk", F.row_number().over(w)).where("rk <= 6")
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    return six.groupBy("user_id").agg(F.array_join(F.transform(rows, lambda r: r["value"].cast("string")), ",").alias("series"), F.count("*").alias("n"))


sql_query("lake_replacing_latest", "O-17, O-19: keyed latest-wins over duplicated deliveries.", """
WITH deliveries AS (SELECT user_id, event_type, event_id AS ingest, value FROM {events} UNION ALL SELECT user_id, event_type, event_id + 1000000, value * 2 FROM {events} WHERE event_id % 3 = 0)
SELECT user_id, event_type, max(ingest) AS ingest, round(max_by(value, ingest), 6) AS value FROM deliveries GROUP BY user_id, event_type""")

sql_query("lake_insert_once", "O-20: first delivery of a key wins.", """
WITH deliveries AS (SELECT user_id AS k, ts, event_id FROM {events})
SELECT k, min_by(event_id, [[struct(ts, event_id)||(ts, event_id)]]) AS event_id, min(ts) AS ts FROM deliveries GROUP BY k""")

sql_query("lake_ttl_days", "O-18: retention by day, seven days before the newest row.", """
SELECT event_id, ts FROM {events} WHERE CAST(ts AS DATE) + INTERVAL '7' DAY > (SELECT CAST(max(ts) AS DATE) FROM {events})""")

sql_query("filter_optional_conjunction", "O-30: an equality, an inequality and a half-open interval; optional arguments (O-28, O-29) are in filter_scopes.", """
SELECT event_id, user_id, event_type, ts FROM {events}
WHERE event_type = 'click' AND user_id <> 7 AND ts >= TIMESTAMP[[_NTZ||]] '2024-01-05 00:00:00' AND ts < TIMESTAMP[[_NTZ||]] '2024-01-12 00:00:00'""")

sql_query("filter_quarantine", "O-31, O-32: first failing reason of a cascade, staleness against the newest row.", """
WITH m AS (SELECT max(ts) AS now FROM {events}),
q AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN 'sport_mismatch' WHEN event_id % 50 = 0 THEN 'schema_mismatch' WHEN ts < now - INTERVAL '24' HOUR THEN 'stale' WHEN value / 400.0 < 0.02 THEN 'low_confidence' END AS reason FROM {events} CROSS JOIN m)
SELECT coalesce(reason, 'accepted') AS reason, CAST(count(*) AS BIGINT) AS n, min(event_id) AS first_id FROM q GROUP BY 1""")
