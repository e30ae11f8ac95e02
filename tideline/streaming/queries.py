"""Structured Streaming twins of the batch operators.

Each query reads the event table as a stream, runs what is there (``availableNow``) and returns what the sink holds.
Sinks are Parquet folders written per micro-batch into a path named after the batch, so a batch that is replayed after a
failure overwrites itself: with the checkpoint this gives every row once (O-2, O-223). Aggregates run in update mode: a
trigger writes the groups it changed, the watermark lets old windows go, and readers take a key's newest row. Sessions
have no update mode and are written whole. Results equal the batch queries.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.operators.state import change_gate, cooldown
from tideline.registry import load, query
from tideline.session import shared_dir
from tideline.sources.lake import decode, flatten, split_bad

LATE = "1 hour"


def _folder(spark: SparkSession) -> str:
    root = shared_dir(spark, "spark-stream-")
    return os.path.join(root, f"stream-{uuid.uuid4().hex}")


def stream(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """O-1: the event table as a stream with event time; ``files`` bounds what one trigger takes."""
    path = f"{sf_dir}/event[s].parquet"  # a pattern, as a stream takes a file only by one
    reader = spark.readStream.schema(load(spark, sf_dir, "events").schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def drain(df: DataFrame, mode: str = "append", write: Callable[[DataFrame, str], None] | None = None) -> str:
    """O-6: runs a stream to its present end; the folder its batches were written to."""
    folder = _folder(df.sparkSession)
    write = write or (lambda rows, path: rows.write.mode("overwrite").parquet(path))
    keep = (lambda _: f"{folder}/out/batch=0") if mode == "complete" else (lambda i: f"{folder}/out/batch={i}")
    q = df.writeStream.outputMode(mode).foreachBatch(lambda rows, i: write(rows, keep(i))).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return f"{folder}/out"


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    spark, schema = df.sparkSession, df.schema
    path = drain(df, mode)
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


def _newest(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The last written row of each key of a folder of micro-batches."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    rest = [c for c in schema.names if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_newest")).select(*keys, "_newest.*")


def updated(df: DataFrame, keys: list[str]) -> DataFrame:
    """O-19: an aggregate in update mode, each trigger's changed groups in a folder of their own; the newest row of each key."""
    return _newest(df.sparkSession, drain(df, "update"), df.schema, keys)


def retrying(write: Callable[[DataFrame, str], None], dead: Callable[[DataFrame, str, Exception], None] | None = None, delays: tuple[float, ...] = (1, 3, 10, 30, 120), sleep: Callable[[float], None] = time.sleep) -> Callable[[DataFrame, str], None]:
    """O-223: a sink that tries a micro-batch once per delay, waiting in between, and then hands it to ``dead`` or fails.

    A batch that fails is not committed, so the stream's next start delivers it again.
    """

    def run(rows: DataFrame, path: str) -> None:
        for attempt, delay in enumerate(delays, 1):
            try:
                return write(rows, path)
            except Exception as fault:
                if attempt < len(delays):
                    sleep(delay)
                elif dead is None:
                    raise
                else:
                    dead(rows, path, fault)
        return None

    return run


@query("stream_tumbling_counts", "SELECT event_type, date_trunc('hour', ts) AS hour, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-218, O-225: counts by tumbling hours of event time, with a watermark."""
    s = stream(spark, sf_dir).withWatermark("at", LATE)
    c = s.groupBy("event_type", F.window("at", "1 hour")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return updated(c, ["event_type", "window"]).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n", F.round("total", 4).alias("total"))


def lag_seconds(ingest: Column, now: Column) -> Column:
    """O-224: seconds from the ingest time (ISO text, to the second) until ``now``, not below 0; null if it is no time."""
    at = F.try_to_timestamp(F.substring(ingest, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    lag = F.unix_micros(now) / 1e6 - F.unix_micros(at) / 1e6
    return F.when(lag > 0, lag).when(lag <= 0, 0.0)


@query("stream_lag", """
WITH l AS (SELECT event_type, CASE WHEN event_id % 50 <> 7 THEN greatest(0e0, (epoch_us(ts) + (event_id % 300 - 10) * 1000000 - epoch_us(date_trunc('second', ts))) / 1e6) END AS lag FROM events)
SELECT event_type, CAST(count(lag) AS BIGINT) AS n, round(avg(lag), 3) AS mean, round(max(lag), 3) AS most, CAST(count(*) FILTER (WHERE lag > 60) AS BIGINT) AS over_a_minute FROM l GROUP BY event_type""")
def stream_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-224: end-to-end lag per type; broken ingest times do not count. The clock is simulated from the id."""
    s = stream(spark, sf_dir)
    ingest = F.when(F.col("event_id") % 50 != 7, F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("n/a")
    now = F.timestamp_micros(F.unix_micros("at") + (F.col("event_id") % 300 - 10) * 1_000_000)
    lag = s.select("event_type", lag_seconds(ingest, now).alias("lag"))
    c = lag.groupBy("event_type").agg(F.count("lag").alias("n"), F.sum("lag").alias("total"), F.max("lag").alias("most"), F.count(F.when(F.col("lag") > 60, 1)).alias("over_a_minute"))
    return updated(c, ["event_type"]).select("event_type", "n", F.round(F.col("total") / F.col("n"), 3).alias("mean"), F.round("most", 3).alias("most"), "over_a_minute")


@query("stream_sliding_counts", "SELECT event_type, w AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '12 hours', ts), time_bucket(INTERVAL '12 hours', ts) - INTERVAL '12 hours']) AS w FROM events) GROUP BY 1, 2")
def stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-209, O-222: counts in windows of a day that begin every half day."""
    s = stream(spark, sf_dir).withWatermark("at", LATE)
    c = s.groupBy("event_type", F.window("at", "24 hours", "12 hours")).count()
    return updated(c, ["event_type", "window"]).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("count").alias("n"))


@query("stream_story_sessions", """
WITH e AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) > INTERVAL '36' HOUR AS gap FROM events),
s AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS story FROM e)
SELECT user_id, event_type, min(ts) AS opened, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, event_type, story""")
def stream_story_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-220, O-213: stories as session windows of a stream."""
    s = stream(spark, sf_dir).withWatermark("at", LATE)
    c = s.groupBy("user_id", "event_type", F.session_window("at", "129600 seconds 1 microsecond")).count()
    return drained(c, "complete").select("user_id", "event_type", F.col("session_window.start").cast("timestamp_ntz").alias("opened"), F.col("count").alias("n"))


@query("stream_dedup", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-2, O-211: deliveries that come twice count once."""
    s = stream(spark, sf_dir)
    twice = s.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy").withWatermark("at", LATE)
    return drained(twice.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_interval_join", "SELECT p.event_id AS purchase, v.event_id AS seen FROM events p JOIN events v ON p.user_id = v.user_id AND v.ts BETWEEN p.ts - INTERVAL '90' MINUTE AND p.ts WHERE p.event_type = 'purchase' AND v.event_type = 'view'")
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-61, O-176: a stream-stream join within 90 minutes; the watermarks bound both sides' state."""
    p = stream(spark, sf_dir).where("event_type = 'purchase'").withWatermark("at", LATE).select(F.col("event_id").alias("purchase"), F.col("user_id").alias("pu"), F.col("at").alias("pa"))
    v = stream(spark, sf_dir).where("event_type = 'view'").withWatermark("at", LATE).select(F.col("event_id").alias("seen"), F.col("user_id").alias("vu"), F.col("at").alias("va"))
    j = p.join(v, F.expr("pu = vu AND va >= pa - INTERVAL 90 MINUTES AND va <= pa"))
    return drained(j.select("purchase", "seen"))


def _gate(s: DataFrame, keys: list[str], fold: Callable[[pd.DataFrame, object], tuple[list[bool], object]], state: str) -> DataFrame:
    """A gate with its last accepted row as state; rows of a trigger are put in order before the fold."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(["t", "event_id"])
        ok, last = fold(pdf, held.get[0] if held.exists else None)
        held.update((last,))
        yield pdf.loc[ok, ["event_id"]]

    rows = s.select(*keys, "event_id", "value", F.unix_micros("at").alias("t"))
    return rows.groupBy(*keys).applyInPandasWithState(run, "event_id long", f"last {state}", "append", GroupStateTimeout.NoTimeout)


@query("stream_cooldown_gate", "WITH RECURSIVE e AS (SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), g AS (SELECT user_id, event_id, i, t AS last, TRUE AS passed FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.t - g.last >= 21600000000 THEN e.t ELSE g.last END, e.t - g.last >= 21600000000 FROM g JOIN e ON e.user_id = g.user_id AND e.i = g.i + 1) SELECT event_id FROM g WHERE passed")
def stream_cooldown_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-210: the cooldown gate with state kept between triggers."""
    return drained(_gate(stream(spark, sf_dir), ["user_id"], lambda pdf, last: cooldown(pdf.t.tolist(), 21_600_000_000, last), "long"))


@query("stream_change_gate", "WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events), g AS (SELECT user_id, event_type, event_id, i, value AS last, TRUE AS passed FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_type, e.event_id, e.i, CASE WHEN abs(e.value - g.last) / abs(g.last) >= 0.5 THEN e.value ELSE g.last END, abs(e.value - g.last) / abs(g.last) >= 0.5 FROM g JOIN e ON e.user_id = g.user_id AND e.event_type = g.event_type AND e.i = g.i + 1) SELECT event_id FROM g WHERE passed")
def stream_change_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-216: the change gate of each lane with the last published value as state."""
    return drained(_gate(stream(spark, sf_dir), ["user_id", "event_type"], lambda pdf, last: change_gate(pdf.value.tolist(), 0.5, last), "double"))


@query("stream_replacing_latest", "SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def stream_replacing_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-17, O-19: the latest version of each key: each micro-batch is reduced to one row a key, and readers merge them. No state."""
    keys, newest = ["user_id", "event_type"], F.max_by(F.struct("at", "event_id", "value"), F.struct("at", "event_id")).alias("r")

    def write(rows: DataFrame, path: str) -> None:
        rows.groupBy(*keys).agg(newest).select(*keys, "r.*").write.mode("overwrite").parquet(path)

    s = stream(spark, sf_dir).select(*keys, "at", "event_id", "value")
    rows = spark.read.schema(s.schema).parquet(f"{drain(s, write=retrying(write))}/batch=*")
    return rows.groupBy(*keys).agg(newest).select(*keys, "r.event_id", "r.value")


@query("stream_decode_sink", "SELECT 'good' AS kind, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_id % 90 <> 3 UNION ALL SELECT 'undecodable', count(*) FROM events WHERE event_id % 90 = 3")
def stream_decode_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-3, O-4, O-6, O-9, O-21, O-139, O-223: envelopes decoded per micro-batch; good rows and dead letters to tables of their own."""
    body = F.to_json(F.struct(F.lit("v1").alias("schema_version"), "event_id", "event_type", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("occurred_at"), F.col("user_id").alias("match_id"), F.from_json("props", "k INT").alias("payload")))
    raw = stream(spark, sf_dir).select(F.when(F.col("event_id") % 90 == 3, F.concat(F.lit("{broken "), "event_id")).otherwise(body).alias("raw"))

    def write(rows: DataFrame, path: str) -> None:
        rows = rows.persist()
        good, bad = split_bad(decode(rows, "raw"), "raw")
        flatten(good).write.mode("overwrite").parquet(path.replace("/out/", "/good/"))
        bad.write.mode("overwrite").parquet(path.replace("/out/", "/bad/"))
        rows.unpersist()

    folder = os.path.dirname(drain(raw, write=retrying(write)))
    good = spark.read.schema("event_id long").parquet(f"{folder}/good/batch=*").select(F.lit("good").alias("kind"))
    bad = spark.read.schema("reason string").parquet(f"{folder}/bad/batch=*").select(F.col("reason").alias("kind"))
    return good.unionByName(bad).groupBy("kind").agg(F.count("*").alias("n"))
