"""Validation, dedup by two keys, record quality and the lake's approval stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.registry import load, query, sql_query

sql_query("lake_consistency_rules", "O-33, O-35, O-36: rules a record breaks, as a list; accepted without any.", """
WITH m AS (SELECT uid, home, away, home_goals, away_goals, kickoff_at FROM {matches}),
r AS (SELECT uid, [[array_join(array_compact(array(CASE WHEN home = away THEN 'same_team' END, CASE WHEN home_goals + away_goals > 6 THEN 'score_range' END, CASE WHEN uid % 11 = 0 AND home_goals = 0 THEN 'finished_without_score' END)), ',')||array_to_string(list_filter([CASE WHEN home = away THEN 'same_team' END, CASE WHEN home_goals + away_goals > 6 THEN 'score_range' END, CASE WHEN uid % 11 = 0 AND home_goals = 0 THEN 'finished_without_score' END], lambda x: x IS NOT NULL), ',')]] AS errors FROM m)
SELECT uid, errors, errors = '' AS accepted FROM r""")

sql_query("lake_record_quality", "O-202, O-34: weighted quality of each record and what it lacks.", """
SELECT doc_id, round(0.2 * CASE WHEN text <> '' THEN 1e0 ELSE 0 END + 0.15 * CASE WHEN lang IS NOT NULL THEN 1e0 ELSE 0 END + 0.15 * CASE WHEN source IS NOT NULL THEN 1e0 ELSE 0 END + 0.2 * least(1e0, n_chars / 500e0) + 0.1 * CASE WHEN n_chars < 50000 THEN 1e0 ELSE 0 END + 0.2 * CASE WHEN contains(text, '.') THEN 1e0 ELSE 0 END, 6) AS quality FROM {documents}""")


def two_key_dedup(df: DataFrame, checksum: str, logical: list[str], order: list[str]) -> DataFrame:
    """O-90: first by checksum, then first by logical key among those kept.

    A row that the checksum drops does not hold its logical key; in an order in which a checksum's rows follow its first
    one, this is the sequential rule for rows whose checksum determines the logical key.
    """
    first = lambda d, keys: d.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    return first(first(df, [checksum]), logical)


@query("lake_two_key_dedup", """
WITH a AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY source, n_chars ORDER BY doc_id) AS r FROM a WHERE r = 1) SELECT doc_id FROM b WHERE r = 1""")
def lake_two_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-90: documents by content digest, then by source and length."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("sha"))
    return two_key_dedup(d, "sha", ["source", "n_chars"], ["doc_id"]).select("doc_id")


sql_query("lake_approval_stages", "O-260: normalise, validate, dedup, resolve, score; approved or the first reason for review.", """
WITH d AS (SELECT doc_id, source, lang, n_chars, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) AS copy FROM {documents}),
s AS (SELECT d.doc_id, copy, lang, n_chars, quality, least(1e0, n_chars / 800e0) AS score FROM d LEFT JOIN {labels} l ON l.doc_id = d.doc_id)
SELECT CASE WHEN copy > 1 THEN 'duplicate' WHEN score < 0.2 THEN 'low_quality' WHEN quality IS NULL THEN 'entity_unresolved' WHEN quality = 0 THEN 'consistency_warning' ELSE 'approved' END AS stage, lang, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1, 2""")

sql_query("lake_dead_letters", "O-21, O-22: refused rows with the size and digest of their payload, newest first by key.", """
SELECT event_id, event_type AS reason, CAST([[octet_length(props)||octet_length(CAST(props AS BLOB))]] AS INT) AS bytes, [[sha2(props, 256)||sha256(props)]] AS digest, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM {events} WHERE value < 1""")
