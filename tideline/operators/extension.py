"""Extension points: detectors as table functions, injectable categorisers, guarded outputs, parameterised SQL."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.registry import load, query

#: O-226: a detector takes the wide tick frame and returns its trends, none or many a row.
Detector = Callable[[DataFrame], DataFrame]
COLUMNS = ("match_id", "event_id", "trend_type", "strength")
FORBIDDEN = re.compile(r"predict|winner|forecast|probability_of", re.I)


def threshold_detector(kind: str, when: Column, strength: Column) -> Detector:
    def detect(ticks: DataFrame) -> DataFrame:
        return ticks.where(when).select("match_id", "event_id", F.lit(kind).alias("trend_type"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), strength)).alias("strength"))

    return detect


def run_detectors(ticks: DataFrame, detectors: Iterable[Detector]) -> DataFrame:
    """Union of all detectors' rows over one frame."""
    return reduce(DataFrame.unionByName, [d(ticks).select(*COLUMNS) for d in detectors])


def guard_columns(df: DataFrame, forbidden: re.Pattern[str] = FORBIDDEN) -> DataFrame:
    """O-42: ``df``, unless a column, nested ones included, has a forbidden name."""

    def names(t, path: str = "") -> Iterable[str]:  # noqa: ANN001
        for f in getattr(t, "fields", []):
            yield path + f.name
            yield from names(getattr(f.dataType, "elementType", f.dataType), f"{path}{f.name}.")

    bad = [n for n in names(df.schema) if forbidden.search(n)]
    if bad:
        raise ValueError(f"forbidden output columns: {bad}")
    return df


def categorise(df: DataFrame, column: str, policy: dict[str, str], default: str, out: str = "category") -> DataFrame:
    """O-228: a category by an injected policy, matched by equality and joined as a broadcast of the policy's few rows."""
    table = df.sparkSession.createDataFrame(sorted(policy.items()), f"{column} string, {out} string")
    return df.join(F.broadcast(table), column, "left").fillna({out: default})


def parameterised(spark: SparkSession, text: str, tables: dict[str, DataFrame], **values: object) -> DataFrame:
    """O-26: SQL with named parameters; values never become part of the text."""
    return spark.sql(text, args=values, **tables)


@query("ext_detector_registry", "SELECT user_id AS match_id, event_id, 'spike' AS trend_type, round(least(1.0, value / 200), 6) AS strength FROM events WHERE value >= 100 UNION ALL SELECT user_id, event_id, 'alarm', 1.0 FROM events WHERE event_type = 'error' AND value >= 50")
def ext_detector_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-42, O-226, O-229: registered detectors over one frame, their output guarded."""
    ticks = load(spark, sf_dir, "events").withColumnRenamed("user_id", "match_id")
    v = F.col("value")
    found = run_detectors(ticks, [threshold_detector("spike", v >= 100, v / 200), threshold_detector("alarm", (F.col("event_type") == "error") & (v >= 50), F.lit(1.0))])
    return guard_columns(found.withColumn("strength", F.round("strength", 6)))


@query("ext_injected_policy", "SELECT CASE event_type WHEN 'click' THEN 'engagement' WHEN 'view' THEN 'engagement' WHEN 'purchase' THEN 'money' ELSE 'other' END AS category, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def ext_injected_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-228: events by the categories of an injected policy."""
    policy = {"click": "engagement", "view": "engagement", "purchase": "money"}
    return categorise(load(spark, sf_dir, "events"), "event_type", policy, "other").groupBy("category").agg(F.count("*").alias("n"))


@query("ext_parameterised_sql", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE user_id <= 40 AND value >= 25 GROUP BY event_type")
def ext_parameterised_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-26: a count under two named parameters."""
    text = "SELECT event_type, count(*) AS n FROM {events} WHERE user_id <= :most AND value >= :least GROUP BY event_type"
    return parameterised(spark, text, {"events": load(spark, sf_dir, "events")}, most=40, least=25.0)
