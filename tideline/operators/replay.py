"""Replay and quality gate: two versions of detectors over the same ordered steps, and what may be promoted.

Both versions read the same frame of ticks. Their detections are compared as sets of (match, step, type); each version's
detections are matched one to one with the outcomes that followed them in time, every outcome taking the oldest
detection that is still open. That matching depends on itself, so it is a fold in the order of time, with only the open
detections of a match and type as state.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.state import _fold
from tideline.operators.trends import PULSE, WIDE, branch, detect
from tideline.registry import query, run_sql
from tideline.session import written

# Coverage and stability below which evidence is thin.
LEAST_COVERAGE, LEAST_STABILITY = 0.02, 0.30
#: Hours within which an outcome confirms a detection.
WINDOW_HOURS = 48


def detector_reports(found: DataFrame, steps: int) -> DataFrame:
    """(version, trend_type, executions, detections, quiet, means, coverage): each detector runs at every step."""
    per = found.groupBy("version", "trend_type").agg(F.count("*").alias("detections"), F.avg("confidence").alias("confidence"), F.avg("strength").alias("strength"), F.count_distinct("match_id", "event_id").alias("steps"))
    return per.select("version", "trend_type", F.lit(steps).cast("long").alias("executions"), "detections", F.greatest(F.lit(0), F.lit(steps) - F.col("detections")).cast("long").alias("quiet"), F.round("confidence", 6).alias("confidence"), F.round("strength", 6).alias("strength"), F.round(F.col("steps") / max(steps, 1), 6).alias("coverage"))


def compared(found: DataFrame) -> DataFrame:
    """(trend_type, both, gained, lost, lowered) of the candidate against the baseline, as sets of steps."""
    sides = found.groupBy("trend_type", "match_id", "event_id").agg(F.max(F.when(F.col("version") == "baseline", F.col("confidence"))).alias("b"), F.max(F.when(F.col("version") == "candidate", F.col("confidence"))).alias("c"))
    n = lambda cond: F.count(F.when(cond, 1))
    b, c = F.col("b"), F.col("c")
    return sides.groupBy("trend_type").agg(n(b.isNotNull() & c.isNotNull()).alias("both"), n(b.isNull()).alias("gained"), n(c.isNull()).alias("lost"), n(F.round(c, 6) < F.round(b, 6)).alias("lowered"))


def gate(found: DataFrame, steps: int) -> DataFrame:
    """The verdict on each detector of the candidate: rejected if it lost detections, a warning if evidence is thin."""
    own = detector_reports(found, steps).where("version = 'candidate'")
    both = compared(found).join(own.select("trend_type", "detections", "coverage"), "trend_type", "left").na.fill(0, ["detections", "coverage"])
    tp, fp, fn = F.col("both"), F.col("gained"), F.col("lost")
    precision = F.when(tp + fp > 0, tp / (tp + fp)).when(fn == 0, 1.0).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).when(fp == 0, 1.0).otherwise(0.0)
    scored = both.withColumn("precision", F.round(precision, 6)).withColumn("recall", F.round(recall, 6))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, F.round(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")), 6)).otherwise(0.0)
    verdict = F.when(fn > 0, "Rejected").when((F.col("detections") == 0) | (F.col("coverage") < LEAST_COVERAGE), "Warning").when(F.col("coverage") < LEAST_STABILITY, "Warning").otherwise("Approved")
    return scored.select("trend_type", "both", "gained", "lost", "lowered", "precision", "recall", f1.alias("f1"), "coverage", verdict.alias("verdict"))


def matched(found: DataFrame, outcomes: DataFrame, hours: int = WINDOW_HOURS) -> DataFrame:
    """(version, trend_type, match_id, event_id, outcome_id): detections with the outcome that each one is matched to, if any.

    ``outcomes`` has match_id, outcome_id and ts. Of things of one instant detections come first.
    """
    kinds = found.select("version", "match_id", "trend_type").distinct()
    rows = found.select("version", "match_id", "trend_type", "ts", F.lit(0).alias("side"), F.col("event_id").alias("id"))
    rows = rows.unionByName(outcomes.join(kinds, "match_id").select("version", "match_id", "trend_type", "ts", F.lit(1).alias("side"), F.col("outcome_id").alias("id")))

    def start():  # noqa: ANN202
        open_: deque[tuple[int, int]] = deque()

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for r in pdf.itertuples():
                while open_ and r.t - open_[0][0] > hours * 3_600_000_000:
                    open_.popleft()
                if r.side == 0:
                    open_.append((r.t, r.id))
                elif open_:
                    out.append((r.version, r.trend_type, r.match_id, open_.popleft()[1], r.id))
            return pd.DataFrame(out, columns=["version", "trend_type", "match_id", "event_id", "outcome_id"])

        return step

    timed = rows.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    pairs = _fold(timed, ["version", "match_id", "trend_type"], ["t", "side", "id"], start, "version string, trend_type string, match_id long, event_id long, outcome_id long")
    return found.select("version", "trend_type", "match_id", "event_id").join(pairs, ["version", "trend_type", "match_id", "event_id"], "left")


# the candidate takes smaller swings of pressure, asks more of momentum, and is surer of tempo
CANDIDATE = [
    branch("momentum_shift", "abs(momentum - momentum0) >= 0.5 OR (momentum * momentum0 < 0)", "sign(momentum - momentum0)", "abs(momentum - momentum0)", "CASE WHEN momentum * momentum0 < 0 THEN 0.8 ELSE 0.65 END"),
    branch("pressure_building", "pressure - pressure0 >= 0.05 AND pressure >= 0.5", "0", "pressure", "0.5 + pressure - pressure0"),
    branch("tempo_change", "abs(density - density0) >= 0.3", "sign(density - density0)", "abs(density - density0)", "0.65"),
    PULSE[3],
]
_FOUND = WIDE + detect(PULSE) + detect(CANDIDATE).replace("d AS (", "d2 AS (", 1) + """,
found AS (SELECT 'baseline' AS version, * FROM d UNION ALL SELECT 'candidate', * FROM d2)"""


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    return written(run_sql(spark, sf_dir, _FOUND + " SELECT * FROM found"), "replay"), run_sql(spark, sf_dir, "SELECT count(*) AS n FROM {events}").first()[0]


_SETS = """,
old AS (SELECT trend_type, match_id, event_id, confidence FROM found WHERE version = 'baseline'), new AS (SELECT trend_type, match_id, event_id, confidence FROM found WHERE version = 'candidate'),
j AS (SELECT coalesce(o.trend_type, w.trend_type) AS trend_type, o.confidence AS b, w.confidence AS c FROM old o FULL JOIN new w ON o.trend_type = w.trend_type AND o.match_id = w.match_id AND o.event_id = w.event_id),
kk AS (SELECT trend_type, count(*) FILTER (WHERE b IS NOT NULL AND c IS NOT NULL) AS both_, count(*) FILTER (WHERE b IS NULL) AS gained, count(*) FILTER (WHERE c IS NULL) AS lost, count(*) FILTER (WHERE round(c, 6) < round(b, 6)) AS lowered, round(count(c) / CAST((SELECT count(*) FROM {events}) AS DOUBLE), 6) AS coverage, count(c) AS n FROM j GROUP BY trend_type),
pp AS (SELECT *, round(both_ / CAST(both_ + gained AS DOUBLE), 6) AS precision, round(both_ / CAST(both_ + lost AS DOUBLE), 6) AS recall FROM kk)
SELECT trend_type, both_ AS both, gained, lost, lowered, precision, recall, round(2 * precision * recall / (precision + recall), 6) AS f1, coverage, CASE WHEN lost > 0 THEN 'Rejected' WHEN n = 0 OR coverage < 0.30 THEN 'Warning' ELSE 'Approved' END AS verdict FROM pp"""


@query("replay_gate", _FOUND + _SETS)
def q_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-201, O-126, O-127: a candidate's detections against the baseline's over the same steps, and the verdict on each detector."""
    return gate(*_found(spark, sf_dir))


@query("replay_outcomes")
def q_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-201, O-96: precision and recall of each version and detector by outcomes matched one to one (held against plain Python in the tests)."""
    found, _ = _found(spark, sf_dir)
    outcomes = run_sql(spark, sf_dir, "SELECT user_id AS match_id, event_id AS outcome_id, ts FROM {events} WHERE event_type = 'purchase'")
    hits = matched(found, outcomes).groupBy("version", "trend_type").agg(F.count("*").alias("detections"), F.count("outcome_id").alias("hits"))
    n = outcomes.count()
    return hits.select("version", "trend_type", "detections", "hits", F.round(F.col("hits") / F.col("detections"), 6).alias("precision"), F.round(F.col("hits") / max(n, 1), 6).alias("recall"))
