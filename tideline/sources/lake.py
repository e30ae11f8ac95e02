"""Lake sources and sinks: partitioned scans and appends, replay-safe by checksum, side tables for refused rows."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.registry import load, query
from tideline.session import shared_dir

LAYERS = ("raw", "normalized", "validated", "training", "exports", "reports")
ENVELOPE = "schema_version string, event_id bigint, event_type string, occurred_at timestamp, match_id bigint, payload struct<k: int>"


def checksum(*columns: str) -> Column:
    """Digest of a record's canonical JSON: the same for equal records, whatever wrote them."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


class Lake:
    """A directory tree layer/competition=../season=../source=../entity=.. of JSON-lines or Parquet files."""

    KEYS = ("competition", "season", "source", "entity")

    def __init__(self, spark: SparkSession, root: str, fmt: str = "json") -> None:
        self.spark, self.root, self.fmt = spark, root, fmt

    def path(self, layer: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"no such layer: {layer}")
        return f"{self.root}/{layer}"

    def read(self, layer: str, schema: T.StructType | str, **where: str) -> DataFrame:
        """O-10: scan; the named partitions prune directories."""
        df = self.spark.read.schema(schema).format(self.fmt).load(self.path(layer))
        for k, v in where.items():
            df = df.where(F.col(k) == v)
        return df

    #: Up to so many partitions a batch names the directories that are looked through; with more, all are.
    NAMED = 1000

    def append(self, layer: str, records: DataFrame, schema: T.StructType | str | None = None) -> None:
        """O-11: rows whose checksum is not there yet are added, under their partition's directory; others are not read."""
        self._append(layer, records, schema, [k for k in self.KEYS if k in records.columns])

    def append_signals(self, layer: str, records: DataFrame, at: str, schema: T.StructType | str | None = None) -> None:
        """O-12: rows added under their source and the UTC day of ``at``; a null time has a directory of its own."""
        day = F.date_format(F.to_utc_timestamp(F.col(at).cast("timestamp"), F.current_timezone()), "yyyy-MM-dd")
        self._append(layer, records.withColumn("day", day), schema, ["source", "day"])

    def _append(self, layer: str, records: DataFrame, schema: T.StructType | str | None, keys: list[str]) -> None:
        fresh = records.dropDuplicates(["checksum"])
        if schema is not None:
            there = self.read(layer, schema)
            parts = records.select(*keys).distinct().limit(self.NAMED + 1).collect() if keys else []
            if len(parts) <= self.NAMED:
                for k in keys:
                    there = there.where(F.col(k).isNull() | F.col(k).isin(*{r[k] for r in parts if r[k] is not None}))
            fresh = fresh.join(there.select("checksum"), "checksum", "left_anti")
        fresh.write.mode("append").partitionBy(*keys).format(self.fmt).save(self.path(layer))

    def report(self, name: str, rows: DataFrame) -> str:
        """O-13: a report of its own."""
        path = f"{self.path('reports')}/{name}"
        rows.write.mode("overwrite").json(path)
        return path


def dataset(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str | None = None) -> DataFrame:
    """O-14, O-16: csv, json lines or parquet by the name's ending; a malformed row fails the scan."""
    fmt = fmt or path.rsplit(".", 1)[-1].replace("ndjson", "json").replace("jsonl", "json")
    reader = spark.read.option("mode", "FAILFAST") if fmt != "parquet" else spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
    return (reader.schema(schema) if schema is not None else reader).format(fmt).load(path)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """O-16: rows of JSON lines; ValueError names the file and the line of the first malformed one. Empty lines are passed over."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    full = F.trim("value") != ""
    parsed = F.from_json("value", f"{schema}, _malformed string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
    bad = lines.where(full & parsed["_malformed"].isNotNull()).orderBy("file", "start", "at").first()
    if bad is not None:
        before = (F.col("start") < bad.start) | ((F.col("start") == bad.start) & (F.col("at") <= bad["at"]))
        raise ValueError(f"{bad.file}: line {lines.where((F.col('file') == bad.file) & before).count()} is malformed")
    return lines.where(full).select(F.from_json("value", schema).alias("r")).select("r.*")


def decode(rows: DataFrame, raw: str, versions: tuple[str, ...] = ("v1",), most_bytes: int = 200_000) -> DataFrame:
    """O-3, O-4, O-9: envelopes from JSON text with ``reason`` null for good ones, else the first fault."""
    parsed = rows.withColumn("e", F.from_json(raw, ENVELOPE, {"mode": "PERMISSIVE", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}))
    known = F.create_map(*[x for t in ("click", "view", "error", "signup", "purchase") for x in (F.lit(t), F.lit(True))])
    reason = (
        F.when(F.octet_length(raw) > most_bytes, "too_large")
        .when(F.col("e").isNull() | F.col("e.event_id").isNull(), "undecodable")
        .when(~F.col("e.schema_version").isin(*versions), "version")
        .when(F.col("e.match_id").isNull() | F.col("e.occurred_at").isNull(), "missing_field")
        .when(F.try_element_at(known, F.col("e.event_type")).isNull(), "unknown_type")
    )
    return parsed.withColumn("reason", reason)


def split_bad(decoded: DataFrame, raw: str) -> tuple[DataFrame, DataFrame]:
    """O-21, O-22, O-36: good rows, and dead letters with sizes and digests instead of payloads."""
    good = decoded.where("reason is null").select("e.*")
    bad = decoded.where("reason is not null").select("reason", F.octet_length(raw).alias("bytes"), F.sha2(raw, 256).alias("digest"))
    return good, bad


def flatten(envelopes: DataFrame) -> DataFrame:
    """O-7, O-8: the nested payload as columns, decimals never by way of floats, blocks with defaults."""
    return envelopes.select("event_id", "match_id", "event_type", F.coalesce("payload.k", F.lit(0)).cast("decimal(18,6)").alias("price"), F.date_format("occurred_at", "yyyyMM").alias("yyyymm"))


def _scratch(spark: SparkSession) -> str:
    root = shared_dir(spark, "spark-lake-")
    return os.path.join(root, f"lake-{uuid.uuid4().hex}")


_ENVELOPES = "to_json(named_struct('schema_version', IF(event_id % 40 = 0, 'v0', 'v1'), 'event_id', event_id, 'event_type', IF(event_id % 60 = 1, 'odd', event_type), 'occurred_at', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), 'match_id', IF(event_id % 70 = 2, NULL, user_id), 'payload', from_json(props, 'k INT')))"
_REASON = "CASE WHEN event_id % 90 = 3 THEN 'undecodable' WHEN event_id % 40 = 0 THEN 'version' WHEN event_id % 70 = 2 THEN 'missing_field' WHEN event_id % 60 = 1 THEN 'unknown_type' END"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(F.expr(f"IF(event_id % 90 = 3, concat('{{broken ', event_id), {_ENVELOPES})").alias("raw"))


@query("lake_decode_route", f"SELECT coalesce({_REASON}, 'good') AS reason, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def lake_decode_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-3, O-4, O-9, O-34: envelopes decoded and routed, faults counted."""
    d = decode(_raw(spark, sf_dir), "raw")
    return d.groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count("*").alias("n"))


@query("lake_flatten_partition", f"SELECT strftime(ts, '%Y%m') AS yyyymm, event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events WHERE {_REASON} IS NULL GROUP BY 1, 2")
def lake_flatten_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-6, O-7, O-8: good envelopes flattened, written by month and read again."""
    good, _ = split_bad(decode(_raw(spark, sf_dir), "raw"), "raw")
    path = _scratch(spark)
    flatten(good).write.partitionBy("yyyymm").parquet(path)
    back = spark.read.schema("event_id long, match_id long, event_type string, price decimal(18,6), yyyymm string").parquet(path)
    return back.groupBy("yyyymm", "event_type").agg(F.count("*").alias("n"), F.sum("price").cast("bigint").alias("total"))


@query("lake_append_replay_safe", "SELECT event_type AS source, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def lake_append_replay_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-10, O-11, O-12: the same batch appended twice and an overlapping one leave every record once."""
    schema = "checksum string, event_id long, value double, season string, source string"
    rows = load(spark, sf_dir, "events").select("event_id", "value", F.col("event_type").alias("source"), F.lit("2024").alias("season"))
    rows = rows.withColumn("checksum", checksum("event_id", "value", "source"))
    lake = Lake(spark, _scratch(spark))
    lake.append("raw", rows.where("event_id % 3 > 0"))
    lake.append("raw", rows.where("event_id % 3 > 0"), schema)
    lake.append("raw", rows.where("event_id % 3 < 2"), schema)
    return lake.read("raw", schema, season="2024").groupBy("source").agg(F.count("*").alias("n"))


@query("lake_training_rows", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 3) AS total FROM events GROUP BY event_type")
def lake_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-16: training rows written as JSON lines and loaded again."""
    path = _scratch(spark)
    load(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "event_type", "value")).alias("value")).write.text(path)
    return jsonl(spark, path, "event_id long, event_type string, value double").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("lake_signal_days", "SELECT event_type AS source, strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def lake_signal_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-12: signals under their source and UTC day; an append that overlaps another reads only the days it has."""
    schema = "checksum string, event_id long, at timestamp, source string, day string"
    rows = load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("at"))
    rows = rows.withColumn("checksum", checksum("event_id", "source"))
    lake = Lake(spark, _scratch(spark), "parquet")
    lake.append_signals("raw", rows.where("event_id % 3 > 0"), "at")
    lake.append_signals("raw", rows.where("event_id % 3 < 2"), "at", schema)
    return lake.read("raw", schema).groupBy("source", "day").agg(F.count("*").alias("n"))


@query("lake_dataset_formats", "SELECT f AS fmt, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation CROSS JOIN (SELECT unnest(['csv', 'json', 'parquet']) AS f) GROUP BY f")
def lake_dataset_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-13, O-14, O-15: one table through every format."""
    n, out = load(spark, sf_dir, "nation"), None
    for fmt in ("csv", "json", "parquet"):
        path = _scratch(spark) + "." + fmt
        n.write.option("header", True).format(fmt).save(path)
        part = dataset(spark, path, n.schema).groupBy(F.lit(fmt).alias("fmt")).agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


@query("lake_projection_join", "SELECT o_orderkey AS uid, o_totalprice AS price, p.k AS projected FROM orders LEFT JOIN (SELECT l_orderkey, max(l_discount) AS k FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey) p ON l_orderkey = o_orderkey")
def lake_projection_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-15: matches with their projection by uid; one without has null."""
    p = load(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("uid")).agg(F.max("l_discount").alias("projected"))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_totalprice").alias("price")).join(p, "uid", "left")
