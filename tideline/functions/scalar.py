"""Scalar function families: folding, hashes and stable ids, dates, arrays, maps, JSON, banding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.registry import load, query, sql_query

# Accented letters and what they fold to.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿß", "aaaaaaceeeeiiiinooooouuuuyys")
NOISE = r"\b(fc|cf|sc|club|the|de)\b"
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"  # fixed value: the DNS namespace


def fold(x: Column) -> Column:
    """O-132: lower case, accents and noise words off, only letters and digits."""
    plain = F.translate(F.lower(x), *ACCENTS)
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, NOISE, " "), "[^a-z0-9]+", " "), " +", " "))


def stable_id(name: Column, namespace: str = NAMESPACE) -> Column:
    """O-135: UUID version 5 of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def stream_partition(key: Column, n: int = 8) -> Column:
    """O-5: the first four bytes of a key's SHA-1, big-endian, modulo n."""
    return (F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("bigint") % n).cast("int")


@query("fn_fold_key", "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿß', 'aaaaaaceeeeiiiinooooouuuuyys'), '\\b(fc|cf|sc|club|the|de)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')) AS key FROM documents")
def fn_fold_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-132: the folded key of each document's whole text."""
    return load(spark, sf_dir, "documents").select("doc_id", fold(F.col("text")).alias("key"))


@query("fn_stream_partition", "SELECT user_id, CAST(('0x' || substr(sha1(CAST(user_id AS VARCHAR)), 1, 8))::BIGINT % 8 AS INT) AS part FROM (SELECT DISTINCT user_id FROM events)")
def fn_stream_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-5: partition of each match."""
    return load(spark, sf_dir, "events").select("user_id").distinct().select("user_id", stream_partition(F.col("user_id").cast("string")).alias("part"))


_VARIANT = "CASE WHEN h[17:17] IN ('0', '4', '8', 'c') THEN '8' WHEN h[17:17] IN ('1', '5', '9', 'd') THEN '9' WHEN h[17:17] IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END"


@query("fn_stable_id", f"WITH h AS (SELECT c_custkey, c_name, sha1(unhex('{NAMESPACE}') || encode(c_name)) AS h FROM customer) SELECT c_custkey, c_name, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', {_VARIANT}, h[18:20], '-', h[21:32]) AS id FROM h")
def fn_stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-135: UUIDv5 of each customer's name (checked against Python's uuid in the tests)."""
    return load(spark, sf_dir, "customer").select("c_custkey", "c_name", stable_id(F.col("c_name")).alias("id"))


sql_query("fn_hashes", "O-135: digests of canonical text.", "SELECT c_custkey, [[sha1(c_name)||sha1(c_name)]] AS s1, [[sha2(c_name, 256)||sha256(c_name)]] AS s256, md5(c_name) AS m FROM {customer}")
sql_query("fn_dates", "O-136, O-137: truncation, season that turns in July, hour, epoch, window bounds.", """
SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS INT) AS season, CAST(dayofweek(o_orderdate) AS INT) [[- 1||]] AS dow, [[date_format(o_orderdate, 'yyyy-MM-dd')||strftime(o_orderdate, '%Y-%m-%d')]] AS day, CAST([[unix_micros(CAST(o_orderdate AS TIMESTAMP))||epoch_us(o_orderdate)]] / 1000000 AS BIGINT) AS epoch, o_orderdate + INTERVAL '36' HOUR AS until FROM {orders}""")
sql_query("fn_math", "O-138: entropy over ln 3, logarithm, power, root, sign, floor and ceiling.", """
WITH t AS (SELECT event_id, 1 / home AS a, 1 / draw AS b, 1 / away AS c FROM {ticks}), p AS (SELECT event_id, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM t)
SELECT event_id, round(-(a * ln(a) + b * ln(b) + c * ln(c)) / ln(3e0), 6) AS entropy, round(log10(1 + event_id), 6) AS lg, round(power(a, 2) + sqrt(b), 6) AS pw, CAST(sign(a - c) AS INT) AS sg, CAST(floor(a * 10) AS INT) AS fl, CAST(ceil(a * 10) AS INT) AS ce FROM p""")
sql_query("fn_arrays", "O-139: append, last n, distinct in order, contains, size of a history.", """
WITH h AS (SELECT user_id, [[transform(array_sort(collect_list(struct(ts, event_id, event_type))), x -> x.event_type)||list(event_type ORDER BY ts, event_id)]] AS a FROM {events} GROUP BY user_id)
SELECT user_id, [[array_join(slice(a, -5, 5), ',')||array_to_string(a[-5:], ',')]] AS last5, [[array_contains(a, 'error')||list_contains(a, 'error')]] AS has_error, [[size(a)||CAST(len(a) AS INT)]] AS n, [[array_join(array_sort(array_distinct(a)), ',')||array_to_string(list_sort(list_distinct(a)), ',')]] AS kinds FROM h""")
sql_query("fn_json", "O-142, O-3, O-4: fields of a payload with byte bounds and a validity flag.", """
SELECT event_id, CAST([[get_json_object(props, '$.k')||json_extract_string(props, '$.k')]] AS INT) AS k, [[get_json_object(props, '$.missing')||json_extract_string(props, '$.missing')]] IS NULL AS missing, CAST([[octet_length(props)||octet_length(CAST(props AS BLOB))]] AS INT) AS bytes, [[octet_length(props)||octet_length(CAST(props AS BLOB))]] <= 200000 AND [[try_cast(get_json_object(props, '$.k') AS INT)||TRY_CAST(json_extract_string(props, '$.k') AS INT)]] IS NOT NULL AS valid FROM {events}""")
sql_query("fn_banding", "O-143: severity, tier, game state and grade bands.", """
WITH x AS (SELECT event_id, least(1.0, value / 120) AS v, CAST(event_id % 95 AS INT) AS minute FROM {events})
SELECT event_id, CASE WHEN v < 0.35 THEN 'low' WHEN v < 0.6 THEN 'medium' WHEN v < 0.85 THEN 'high' ELSE 'critical' END AS severity, CASE WHEN v < 0.3 THEN 'internal' WHEN v < 0.6 THEN 'agent' WHEN v < 0.8 THEN 'public' ELSE 'headline' END AS tier, CASE WHEN minute < 15 THEN 'opening' WHEN minute < 60 THEN 'middle' WHEN minute < 80 THEN 'late' ELSE 'closing' END AS state FROM x""")
sql_query("fn_lookup", "O-145, O-264: a routing table with a default.", """
WITH r AS (SELECT * FROM (VALUES ('1-URGENT', 'fast', 1.2e0), ('2-HIGH', 'fast', 1.1e0), ('5-LOW', 'slow', 0.8e0)) AS t(kind, route, factor))
SELECT o_orderkey, coalesce(route, 'normal') AS route, coalesce(factor, 1e0) AS factor FROM {orders} LEFT JOIN r ON kind = o_orderpriority""")


@query("fn_map_defaults", "SELECT user_id, round(coalesce(avg(value) FILTER (WHERE event_type = 'click'), 0), 6) AS click, round(coalesce(avg(value) FILTER (WHERE event_type = 'refund'), 0.5), 6) AS refund, CAST(count(DISTINCT event_type) FILTER (WHERE event_type IN ('click', 'view')) AS INT) AS known FROM events GROUP BY user_id")
def fn_map_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-141: lookups in a sparse map with defaults, and only the known keys of it."""
    m = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    m = m.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    full = F.map_concat(F.map_filter(F.create_map(F.lit("click"), F.lit(0.0), F.lit("refund"), F.lit(0.5)), lambda k, _: ~F.map_contains_key(F.col("m"), k)), F.col("m"))
    known = F.map_filter(F.col("m"), lambda k, _: k.isin("click", "view"))
    return m.select("user_id", F.round(F.try_element_at(full, F.lit("click")), 6).alias("click"), F.round(F.try_element_at(full, F.lit("refund")), 6).alias("refund"), F.size(known).alias("known"))


@query("fn_confidence_policy", "SELECT user_id, round((count(*) FILTER (WHERE event_type <> 'error') / count(*)) * least(coalesce(avg(value) FILTER (WHERE event_type = 'click'), 1000), coalesce(avg(value) FILTER (WHERE event_type = 'view'), 1000)) / 100, 6) AS confidence FROM events GROUP BY user_id")
def fn_confidence_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-227, O-230: quality times the least confident source."""
    e = load(spark, sf_dir, "events")
    per = e.groupBy("user_id").agg(F.avg((F.col("event_type") != "error").cast("double")).alias("quality"), F.array(F.avg(F.when(F.col("event_type") == "click", F.col("value"))), F.avg(F.when(F.col("event_type") == "view", F.col("value")))).alias("sources"))
    least = F.array_min(F.transform("sources", lambda x: F.coalesce(x, F.lit(1000.0))))
    return per.select("user_id", F.round(F.col("quality") * least / 100, 6).alias("confidence"))
