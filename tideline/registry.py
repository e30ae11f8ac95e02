"""Named queries and their oracle SQL.

``query`` registers a DataFrame function. ``sql_query`` registers a Spark SQL text whose oracle is the same text: tables
are written ``{orders}``, and where two dialects differ, ``[[spark||oracle]]`` holds both spellings.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
MODULES = (
    "tideline.operators.features",
    "tideline.operators.timeseries",
    "tideline.operators.market",
    "tideline.operators.trends",
    "tideline.operators.joins",
    "tideline.operators.profiles",
    "tideline.operators.readmodels",
    "tideline.operators.history",
    "tideline.operators.vectors",
    "tideline.operators.state",
    "tideline.operators.quality",
    "tideline.operators.extension",
    "tideline.operators.signals",
    "tideline.operators.versions",
    "tideline.operators.reasoning",
    "tideline.operators.clubs",
    "tideline.operators.fulltext",
    "tideline.operators.leagues",
    "tideline.operators.cells",
    "tideline.operators.projection",
    "tideline.operators.intelligence",
    "tideline.operators.publishing",
    "tideline.operators.filters",
    "tideline.operators.replay",
    "tideline.functions.scalar",
    "tideline.sources.lake",
    "tideline.streaming.queries",
    "tideline.streaming.publication",
    "tideline.streaming.lifecycle",
    "tideline.plans.reports",
)
#: Subqueries that texts may name as ``{ticks}``: entities of the domain bound to the tables at hand.
ENTITIES = {
    # one quote: match, book, time and decimal odds of three outcomes
    "ticks": "(SELECT user_id AS match_id, event_type AS book, ts, event_id, 1 + value / 100.0 AS home, 1 + CAST([[get_json_object(props, '$.k')||json_extract_string(props, '$.k')]] AS DOUBLE) / 25.0 AS draw, 1 + CAST(event_id % 40 AS DOUBLE) / 10.0 AS away FROM {events})",
    # one closed trend: competition (supplier), type (status), outcome and its measures
    "outcomes": "(SELECT l_orderkey, l_linenumber, l_partkey % 50 AS team, l_suppkey AS competition, concat(l_linestatus, '-', CAST(l_linenumber AS [[STRING||VARCHAR]])) AS trend_type, CASE l_returnflag WHEN 'A' THEN 'confirmed' WHEN 'R' THEN 'failed' ELSE 'expired' END AS outcome, l_quantity * 60 AS duration_seconds, l_discount * 10 AS confidence, l_tax * 12 AS strength, l_shipdate AS closed_at, l_orderkey AS match_id FROM {lineitem})",
    # one finished match: two sides, goals, day
    "matches": "(SELECT o_orderkey AS uid, o_custkey % 40 AS home, (o_custkey * 7 + o_orderkey) % 40 AS away, CAST(floor(o_totalprice) AS BIGINT) % 5 AS home_goals, CAST(floor(o_totalprice / 7) AS BIGINT) % 4 AS away_goals, o_orderdate AS kickoff_at, o_orderpriority AS competition FROM {orders} WHERE o_custkey % 40 <> (o_custkey * 7 + o_orderkey) % 40)",
}


def dialect(text: str, oracle: bool) -> str:
    for name, body in ENTITIES.items():
        text = text.replace("{" + name + "}", body)
    text = re.sub(r"\[\[(.*?)\|\|(.*?)\]\]", lambda m: m[2 if oracle else 1], text, flags=re.S)
    return re.sub(r"\{(\w+)\}", r"\1", text) if oracle else text


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = dialect(oracle, oracle=True)
        return f

    return add


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    text = dialect(text, oracle=False)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def sql_query(name: str, doc: str, text: str, oracle: str | None = None) -> None:
    """``oracle``: SQL that finds the same rows another way; without one it is the query's own text in the other dialect."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(spark, sf_dir, text)

    run.__doc__ = doc
    query(name, oracle or text)(run)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(m)
