"""Publication: what an agent does with a trend, the state it is in, the health of its stories, and what a draft may not be.

A decision depends on how many drafts the agent already has in the story, and the agent's state on the state before: both
are one fold a (agent, story), with two numbers as state. All that a trend decides by itself is worked out before the
fold, in columns. Drafts are checked by a cascade of columns, first reason wins; the titles an agent has used lately are
one lag over equal titles, not a comparison of all of them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.operators.state import _fold
from tideline.registry import load, query, run_sql
from tideline.session import written

# What a tier leads to, and the order in which an action is demoted.
ACTIONS = {"suppress": "IGNORE", "store_only": "MEMORY_ONLY", "publish": "DRAFT", "priority_publish": "HIGH_PRIORITY"}
DEMOTED = {"GLOBAL_CANDIDATE": "HIGH_PRIORITY", "HIGH_PRIORITY": "DRAFT", "DRAFT": "MEMORY_ONLY"}
DRAFTS = ("DRAFT", "HIGH_PRIORITY", "GLOBAL_CANDIDATE")
# Drafts of an agent in a story, minutes until a trend is stale, occurrences and rate of a pattern that counts.
MOST_DRAFTS, STALE_MINUTES, PATTERN_OCCURRENCES, PATTERN_RATE = 10, 30, 3, 0.7


def first_action(tier: Column, lifecycle: Column, correlations: Column, severity: Column) -> Column:
    """The action before the agent's drafts and the trend's age are looked at; an unknown tier is only remembered."""
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[tier], F.lit("MEMORY_ONLY"))
    dead = F.coalesce(lifecycle.isin("failed", "expired"), F.lit(False))
    return F.when(dead, "IGNORE").when((base == "HIGH_PRIORITY") & (correlations > 0) & (severity == "critical"), "GLOBAL_CANDIDATE").otherwise(base)


def sureness(score: Column, lifecycle: Column, occurrences: Column, rate: Column) -> Column:
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    confirmed = F.when(lifecycle == "confirmed", clamp(clamp(score) + 0.1)).otherwise(clamp(score))
    return F.when((occurrences >= PATTERN_OCCURRENCES) & (rate >= PATTERN_RATE), clamp(confirmed + 0.05)).otherwise(confirmed)


class Agent:
    """An agent in one story: its drafts so far and its state."""

    def __init__(self) -> None:
        self.drafts, self.state = 0, "IDLE"

    def decide(self, action: str, age: float, lifecycle: str) -> tuple[str, str, int]:
        """(action, state, drafts before) of the agent's next trend."""
        before = self.drafts
        if action in DRAFTS and before >= MOST_DRAFTS:
            action = "MEMORY_ONLY"
        if action in DRAFTS and age is not None and age > STALE_MINUTES:
            action = DEMOTED[action]
        self.drafts += action in DRAFTS
        if lifecycle in ("confirmed", "failed", "expired") and self.state in ("TRACKING", "ALERTING"):
            self.state = "RETROSPECTIVE"
        elif action in ("HIGH_PRIORITY", "GLOBAL_CANDIDATE"):
            self.state = "ALERTING"
        elif action != "IGNORE":
            self.state = {"IDLE": "OBSERVING", "OBSERVING": "TRACKING", "ALERTING": "TRACKING"}.get(self.state, self.state)
        return action, self.state, before


def decisions(trends: DataFrame) -> DataFrame:
    """(trend_id, agent, story, action, priority, confidence, state, drafts) of trends in the order of ``t`` and trend_id.

    Columns: trend_id, agent, story, t, tier, lifecycle, correlations, severity, age_minutes (null: unknown), score, occurrences, rate.
    """
    own = trends.withColumn("first", first_action(F.col("tier"), F.col("lifecycle"), F.col("correlations"), F.col("severity"))).withColumn("confidence", F.round(sureness(F.col("score"), F.col("lifecycle"), F.col("occurrences"), F.col("rate")), 6))

    def start():  # noqa: ANN202
        a = Agent()

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = [(r.trend_id, r.agent, r.story, *a.decide(r.first, None if pd.isna(r.age_minutes) else r.age_minutes, r.lifecycle), r.severity, r.confidence, r.lifecycle) for r in pdf.itertuples()]
            return pd.DataFrame(rows, columns=["trend_id", "agent", "story", "action", "state", "drafts", "severity", "confidence", "lifecycle"])

        return step

    done = _fold(own, ["agent", "story"], ["t", "trend_id"], start, "trend_id long, agent string, story long, action string, state string, drafts long, severity string, confidence double, lifecycle string")
    priority = F.when((F.col("action") == "GLOBAL_CANDIDATE") | ((F.col("action") == "HIGH_PRIORITY") & (F.col("severity") == "critical")), "critical").when(F.col("action") == "HIGH_PRIORITY", "high").when(F.col("action") == "DRAFT", "medium").otherwise("low")
    return done.withColumn("priority", priority)


def health(stories: DataFrame, drafts: DataFrame) -> DataFrame:
    """(story, drafts, score): stories of (story, confidence, kinds, state), drafts of (story, draft_type)."""
    n = lambda kind: F.count(F.when(F.col("draft_type") == kind, 1))
    per = drafts.groupBy("story").agg(F.count("*").alias("drafts"), n("CONFIRMATION").alias("confirmations"), n("FOLLOW_UP").alias("follow_ups"))
    all_ = stories.join(per, "story", "left").na.fill(0, ["drafts", "confirmations", "follow_ups"])
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    # fixed values: weights of confidence, diversity, confirmations and continuity; penalties
    score = 0.40 * clamp(F.col("confidence")) + 0.20 * clamp(F.col("kinds") / 3) + 0.20 * F.when(F.col("drafts") > 0, F.col("confirmations") / F.col("drafts")).otherwise(0.0) + F.when(F.col("confirmations") + F.col("follow_ups") > 0, 0.20).otherwise(0.0)
    score = score - F.when(F.col("state") == "failed", 0.25).when(F.col("state") == "expired", 0.10).otherwise(0.0)
    return all_.select("story", "drafts", F.round(clamp(score) + 1e-9, 4).alias("score"))


# Limits of a draft, and what it may not say.
MOST_TITLE, MOST_SUMMARY, LEAST_WORDS, MOST_HIGHLIGHTS, MOST_TAGS, RECENT_TITLES = 120, 600, 3, 3, 4, 20
FORBIDDEN = ("aposte", "aposta garantida", "stake", "odds garantida", "arbitragem", "surebet", "overround", "margem do bookmaker", "dinheiro garantido", "lucro garantido", "bet now", "guaranteed win")
PREDICTIONS = ("vai ganhar de ", "placar final será", "vai ser 2x", "final score will be")


def draft_verdicts(drafts: DataFrame) -> DataFrame:
    """(draft_id, reason) with the first rule that a draft breaks, or 'valid'. Columns: draft_id, agent, title, summary, tags, highlights."""
    title, summary = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("summary", F.lit("")))
    plain = F.lower(F.regexp_replace(title, r"\s+", " "))
    own = drafts.select("draft_id", "agent", title.alias("title"), summary.alias("summary"), "tags", "highlights", plain.alias("plain"), F.concat(F.lower(title), F.lit(" "), F.lower(summary)).alias("all_"))
    nth = own.withColumn("nth", F.row_number().over(Window.partitionBy("agent").orderBy("draft_id")))
    again = F.lag("nth").over(Window.partitionBy("agent", "plain").orderBy("nth"))
    nth = nth.withColumn("repeats", F.coalesce(F.col("nth") - again <= RECENT_TITLES, F.lit(False)))
    count = lambda c, rx: F.length(F.regexp_replace(c, rx, ""))
    letters, upper = count(F.col("title"), r"[^\p{L}]"), count(F.col("title"), r"[^\p{Lu}]")
    own_letters, latin = count(F.col("summary"), r"[^\p{L}]"), count(F.col("summary"), r"[^\p{IsLatin}]")
    says = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("all_"), w))
    reason = (
        F.when(F.col("title") == "", "empty_content: title")
        .when(F.col("summary") == "", "empty_content: summary")
        .when(F.length("title") > MOST_TITLE, "length: title")
        .when(F.length("summary") > MOST_SUMMARY, "length: summary")
        .when(F.size(F.split("summary", r"\s+")) < LEAST_WORDS, "length: summary too short")
        .when(F.col("highlights") > MOST_HIGHLIGHTS, "malformed: highlights")
        .when(F.col("tags") > MOST_TAGS, "malformed: tags")
        .when((letters >= 12) & (upper * 10 >= letters * 9), "spam: all caps")
        .when((own_letters >= 10) & (latin * 2 < own_letters), "language: not Latin")
        .when(says(FORBIDDEN), "forbidden_content")
        .when(says(PREDICTIONS), "persona: score prediction")
        .when(F.col("repeats"), "duplicate: title")
        .otherwise("valid")
    )
    return nth.select("draft_id", "agent", reason.alias("reason"))


# events as trends: an agent a type, a story a match
TRENDS = """(SELECT event_id AS trend_id, event_type AS agent, user_id AS story, ts, CASE WHEN value < 20 THEN 'suppress' WHEN value < 50 THEN 'store_only' WHEN value < 120 THEN 'publish' WHEN value < 300 THEN 'priority_publish' END AS tier,
  CASE event_id % 9 WHEN 0 THEN 'failed' WHEN 1 THEN 'expired' WHEN 2 THEN 'confirmed' WHEN 3 THEN 'confirmed' ELSE 'active' END AS lifecycle, CASE WHEN event_id % 4 = 0 THEN 2 ELSE 0 END AS correlations, CASE WHEN k >= 80 THEN 'critical' WHEN k >= 40 THEN 'high' ELSE 'low' END AS severity,
  CASE WHEN event_id % 13 <> 0 THEN CAST(event_id % 41 AS DOUBLE) END AS age_minutes, value / 150 AS score, CAST(k % 7 AS INT) AS occurrences, k / 100 AS rate FROM (SELECT *, CAST([[get_json_object(props, '$.k')||json_extract_string(props, '$.k')]] AS DOUBLE) AS k FROM {events}) e)"""
_CLAMP = "greatest(0e0, least(1e0, {}))"
_DECIDED = f"""
WITH RECURSIVE o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY agent, story ORDER BY ts, trend_id) AS i, CASE WHEN lifecycle IN ('failed', 'expired') THEN 'IGNORE' WHEN tier = 'priority_publish' AND correlations > 0 AND severity = 'critical' THEN 'GLOBAL_CANDIDATE' WHEN tier = 'priority_publish' THEN 'HIGH_PRIORITY' WHEN tier = 'publish' THEN 'DRAFT' WHEN tier = 'suppress' THEN 'IGNORE' ELSE 'MEMORY_ONLY' END AS a0 FROM {TRENDS}),
n AS (SELECT o.*, a0 IN {DRAFTS} AS d0, coalesce(age_minutes > {STALE_MINUTES}, false) AS stale FROM o),
r AS (SELECT agent, story, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS trend_id, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS drafts, CAST(NULL AS VARCHAR) AS action, 'IDLE' AS state FROM (SELECT DISTINCT agent, story FROM n) UNION ALL
  SELECT agent, story, i, trend_id, total + CASE WHEN action IN {DRAFTS} THEN 1 ELSE 0 END, total, action, CASE WHEN lifecycle IN ('confirmed', 'failed', 'expired') AND state IN ('TRACKING', 'ALERTING') THEN 'RETROSPECTIVE' WHEN action IN ('HIGH_PRIORITY', 'GLOBAL_CANDIDATE') THEN 'ALERTING' WHEN action = 'IGNORE' THEN state WHEN state = 'IDLE' THEN 'OBSERVING' WHEN state IN ('OBSERVING', 'ALERTING') THEN 'TRACKING' ELSE state END
  FROM (SELECT n.agent, n.story, n.i, n.trend_id, r.total, n.lifecycle, r.state, CASE WHEN d0 AND r.total >= {MOST_DRAFTS} THEN 'MEMORY_ONLY' WHEN d0 AND stale THEN CASE a0 WHEN 'GLOBAL_CANDIDATE' THEN 'HIGH_PRIORITY' WHEN 'HIGH_PRIORITY' THEN 'DRAFT' ELSE 'MEMORY_ONLY' END ELSE a0 END AS action FROM r JOIN n ON n.agent = r.agent AND n.story = r.story AND n.i = r.i + 1)),
d AS (SELECT r.trend_id, r.agent, r.story, action, CASE WHEN action = 'GLOBAL_CANDIDATE' OR (action = 'HIGH_PRIORITY' AND severity = 'critical') THEN 'critical' WHEN action = 'HIGH_PRIORITY' THEN 'high' WHEN action = 'DRAFT' THEN 'medium' ELSE 'low' END AS priority, state, drafts, lifecycle,
  round({_CLAMP.format(f"{_CLAMP.format('score')} + CASE WHEN lifecycle = 'confirmed' THEN 0.1 ELSE 0 END + CASE WHEN occurrences >= {PATTERN_OCCURRENCES} AND rate >= {PATTERN_RATE} THEN 0.05 ELSE 0 END")}, 6) AS confidence FROM r JOIN n USING (trend_id) WHERE r.i > 0)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(run_sql(spark, sf_dir, f"SELECT * FROM {TRENDS} t").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))))


@query("publish_decisions", _DECIDED + " SELECT trend_id, agent, story, action, priority, state, drafts, confidence FROM d")
def q_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-203, O-205: each trend's action, priority and confidence, and the state that it leaves its agent in."""
    return _decided(spark, sf_dir).select("trend_id", "agent", "story", "action", "priority", "state", "drafts", "confidence")


_TYPE = "CASE WHEN lifecycle = 'confirmed' THEN 'CONFIRMATION' WHEN drafts > 0 THEN 'FOLLOW_UP' ELSE 'INITIAL' END"


@query("publish_story_health", _DECIDED + f""",
dr AS (SELECT story, count(*) AS drafts, count(*) FILTER (WHERE {_TYPE} = 'CONFIRMATION') AS c, count(*) FILTER (WHERE {_TYPE} = 'FOLLOW_UP') AS f FROM d WHERE action IN {DRAFTS} GROUP BY story),
s AS (SELECT story, max(confidence) AS confidence, count(DISTINCT agent) AS kinds, max_by(lifecycle, trend_id) AS state FROM d GROUP BY story)
SELECT s.story, coalesce(drafts, 0) AS drafts, round({_CLAMP.format("0.4 * confidence + 0.2 * least(1, kinds / 3e0) + coalesce(0.2 * c / drafts, 0) + CASE WHEN coalesce(c + f, 0) > 0 THEN 0.2 ELSE 0 END - CASE state WHEN 'failed' THEN 0.25 WHEN 'expired' THEN 0.1 ELSE 0 END")} + 1e-9, 4) AS score FROM s LEFT JOIN dr USING (story)""")
def q_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-204: story health from its strongest confidence, kinds of trends, confirmations, continuity and how it ended."""
    d = written(_decided(spark, sf_dir), "decisions")
    stories = d.groupBy("story").agg(F.max("confidence").alias("confidence"), F.count_distinct("agent").alias("kinds"), F.max_by("lifecycle", "trend_id").alias("state"))
    return health(stories, d.where(F.col("action").isin(*DRAFTS)).select("story", F.expr(_TYPE).alias("draft_type")))


_TITLES = "trim(CASE doc_id % 7 WHEN 0 THEN upper(concat('Match report of ', source)) WHEN 1 THEN '' ELSE concat('Round ', CAST(doc_id % 60 AS VARCHAR), ' of  ', coalesce(lang, 'all')) END)"
_SUMMARY = "CASE doc_id % 11 WHEN 0 THEN concat('The final score will be ', lang) WHEN 1 THEN 'Get your SUREBET here now' WHEN 2 THEN 'only two' WHEN 3 THEN 'Обзор матча и что было дальше' ELSE text END"


@query("publish_draft_verdicts", f"""
WITH p AS (SELECT doc_id, source AS agent, {_TITLES} AS title, trim(coalesce({_SUMMARY}, '')) AS summary, doc_id % 6 AS tags, doc_id % 5 AS highlights FROM documents),
q AS (SELECT *, lower(regexp_replace(title, '\\s+', ' ', 'g')) AS plain, row_number() OVER (PARTITION BY agent ORDER BY doc_id) AS i FROM p),
u AS (SELECT a.doc_id, count(b.doc_id) > 0 AS again FROM q a LEFT JOIN q b ON b.agent IS NOT DISTINCT FROM a.agent AND b.plain = a.plain AND b.i < a.i AND a.i - b.i <= {RECENT_TITLES} GROUP BY a.doc_id)
SELECT doc_id AS draft_id, agent, CASE WHEN title = '' THEN 'empty_content: title' WHEN summary = '' THEN 'empty_content: summary' WHEN length(title) > {MOST_TITLE} THEN 'length: title' WHEN length(summary) > {MOST_SUMMARY} THEN 'length: summary' WHEN len(regexp_split_to_array(summary, '\\s+')) < {LEAST_WORDS} THEN 'length: summary too short' WHEN highlights > {MOST_HIGHLIGHTS} THEN 'malformed: highlights' WHEN tags > {MOST_TAGS} THEN 'malformed: tags'
  WHEN length(regexp_replace(title, '\\p{{^L}}', '', 'g')) >= 12 AND length(regexp_replace(title, '\\p{{^Lu}}', '', 'g')) * 10 >= length(regexp_replace(title, '\\p{{^L}}', '', 'g')) * 9 THEN 'spam: all caps' WHEN length(regexp_replace(summary, '\\p{{^L}}', '', 'g')) >= 10 AND length(regexp_replace(summary, '\\p{{^Latin}}', '', 'g')) * 2 < length(regexp_replace(summary, '\\p{{^L}}', '', 'g')) THEN 'language: not Latin'
  WHEN {" OR ".join(f"contains(lower(title) || ' ' || lower(summary), '{w}')" for w in FORBIDDEN)} THEN 'forbidden_content' WHEN {" OR ".join(f"contains(lower(title) || ' ' || lower(summary), '{w}')" for w in PREDICTIONS)} THEN 'persona: score prediction' WHEN again THEN 'duplicate: title' ELSE 'valid' END AS reason FROM q JOIN u USING (doc_id)""")
def q_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-265: the first rule that a draft breaks; titles are compared with those the agent used lately."""
    d = load(spark, sf_dir, "documents")
    drafts = d.select(F.col("doc_id").alias("draft_id"), F.col("source").alias("agent"), F.expr(_TITLES.replace("VARCHAR", "STRING")).alias("title"), F.expr(_SUMMARY).alias("summary"), (F.col("doc_id") % 6).alias("tags"), (F.col("doc_id") % 5).alias("highlights"))
    return draft_verdicts(drafts)


# Fixed values: (meta trend, counted, out of, least counted, least share)
META = [("market_underestimation", "toward_confirmed", "toward", 3, 0.7), ("market_overestimation", "against_confirmed", "against", 3, 0.7), ("recurring_confidence_failure", "failures", "sure", 3, 0.6), ("recurring_sharp_reversal", "reversals", "sharp", 3, 0.5)]
LEAST_CLOSURES, LEAST_MATCHES = 3, 2


def meta_trends(log: DataFrame) -> DataFrame:
    """(competition, team, meta, strength, confidence): what keeps happening to a team or in a competition.

    Columns: competition, match_id, team, trend_type, direction, outcome. One pass with grouping sets of team and competition.
    """
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    kind, out = F.col("trend_type"), F.col("outcome")
    shift = kind == "market_shift"
    counted = log.groupingSets([[F.col("competition"), F.col("team")], [F.col("competition")]], F.col("competition"), F.col("team")).agg(
        F.grouping_id().alias("g"),
        one(shift & (F.col("direction") > 0)).alias("toward"), one(shift & (F.col("direction") > 0) & (out == "confirmed")).alias("toward_confirmed"),
        one(shift & (F.col("direction") < 0)).alias("against"), one(shift & (F.col("direction") < 0) & (out == "confirmed")).alias("against_confirmed"),
        one(kind == "confidence_acceleration").alias("sure"), one((kind == "confidence_acceleration") & (out == "failed")).alias("failures"),
        one(kind == "sharp_market_move").alias("sharp"), one((kind == "sharp_market_move") & (out == "failed")).alias("reversals"),
        one((kind == "volatility_increase") & (out == "confirmed")).alias("closures"), F.count_distinct(F.when((kind == "volatility_increase") & (out == "confirmed"), F.col("match_id"))).alias("matches"),
    )
    entry = lambda name, when, strength, n: F.when(when, F.struct(F.lit(name).alias("meta"), F.round(F.least(F.lit(1.0), strength), 6).alias("strength"), F.round(F.least(F.lit(1.0), 0.4 + 0.1 * n), 6).alias("confidence")))
    found = [entry(m, (F.col("g") == (0 if m.startswith("market") else 1)) & (F.col(of) >= least) & (F.col(n) / F.greatest(F.col(of), F.lit(1)) >= share), F.col(n) / F.greatest(F.col(of), F.lit(1)), F.col(of)) for m, n, of, least, share in META]
    found.append(entry("recurring_volatility", (F.col("g") == 1) & (F.col("closures") >= LEAST_CLOSURES) & (F.col("matches") >= LEAST_MATCHES), F.col("closures") / (3.0 * LEAST_CLOSURES), F.col("matches")))
    return counted.select("competition", "team", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("m")).select("competition", "team", "m.*")


LOG = """(SELECT l_orderkey AS match_id, l_partkey % 40 AS team, l_suppkey AS competition, CASE l_linenumber % 4 WHEN 0 THEN 'confidence_acceleration' WHEN 1 THEN 'market_shift' WHEN 2 THEN 'sharp_market_move' ELSE 'volatility_increase' END AS trend_type, CASE WHEN l_quantity > 25 THEN 1 ELSE -1 END AS direction,
  CASE WHEN (l_orderkey + l_suppkey) % 10 < 3 + l_suppkey % 6 THEN 'confirmed' WHEN l_returnflag = 'N' OR l_suppkey % 3 = 0 THEN 'failed' ELSE 'expired' END AS outcome FROM {lineitem})"""
_RATE = "SELECT competition, {team}, '{name}' AS meta, round(least(1, k / CAST(n AS DOUBLE)), 6) AS strength, round(least(1, 0.4 + 0.1 * n), 6) AS confidence FROM (SELECT competition, {group} count(*) AS n, count(*) FILTER (WHERE outcome = '{out}') AS k FROM {log} WHERE trend_type = '{kind}' {side} GROUP BY {by}) WHERE n >= 3 AND k / CAST(n AS DOUBLE) >= {share}"
_META = [("market_underestimation", "confirmed", "market_shift", "AND direction > 0", 0.7, True), ("market_overestimation", "confirmed", "market_shift", "AND direction < 0", 0.7, True), ("recurring_confidence_failure", "failed", "confidence_acceleration", "", 0.6, False), ("recurring_sharp_reversal", "failed", "sharp_market_move", "", 0.5, False)]


@query("trend_meta_recurrences", " UNION ALL ".join(_RATE.format(team="team" if t else "NULL AS team", group="team," if t else "", by="competition, team" if t else "competition", name=n, out=o, kind=k, side=s, share=x, log=LOG) for n, o, k, s, x, t in _META) + f"""
UNION ALL SELECT competition, NULL, 'recurring_volatility', round(least(1, n / 9e0), 6), round(least(1, 0.4 + 0.1 * m), 6) FROM (SELECT competition, count(*) AS n, count(DISTINCT match_id) AS m FROM {LOG} WHERE trend_type = 'volatility_increase' AND outcome = 'confirmed' GROUP BY competition) WHERE n >= 3 AND m >= 2""")
def q_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-175, O-72: under- and overestimation of teams; volatility, failing confidence and sharp reversals that recur in a competition."""
    return meta_trends(run_sql(spark, sf_dir, f"SELECT * FROM {LOG} l"))
