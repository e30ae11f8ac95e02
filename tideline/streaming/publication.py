"""A bounded log of published trends: a sink that keeps the newest entries, with a priority lane.

A commit is one small table that names the segments that are live, how many entries each has and how many of its oldest
have run out; it is written after the batch's own segment. Trimming is part of that commit: entries beyond the bound
are not named any more. A batch that is delivered again writes the same segment and the same commit, so every entry is
there once. Readers see the last commit. What a commit costs depends on the bound and the batch, not on the history.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.registry import load, query
from tideline.session import shared_dir

# Fixed value: entries that the log holds.
MOST = 100_000
_LIVE = "batch long, live array<struct<batch:long,n:long,skip:long>>"


class Log:
    """``publish`` is a ``foreachBatch`` sink; entries are ordered by the ``order`` columns within a batch."""

    def __init__(self, spark: SparkSession, path: str, order: list[str], most: int = MOST) -> None:
        self.spark, self.path, self.order, self.most = spark, path, order, most

    def _commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(_LIVE).parquet(f"{self.path}/commits/*")
        except Exception as fault:  # no commit yet
            if "PATH_NOT_FOUND" in str(fault):
                return self.spark.createDataFrame([], _LIVE)
            raise

    def live(self, before: int | None = None) -> list[tuple[int, int, int]]:
        """(batch, entries, of which run out) of the last commit, or of the last before a batch."""
        rows = self._commits()
        last = (rows if before is None else rows.where(F.col("batch") < before)).orderBy(F.col("batch").desc()).limit(1).collect()
        return [(s.batch, s.n, s.skip) for s in last[0].live] if last else []

    def publish(self, rows: DataFrame, batch: int) -> None:
        """Appends a micro-batch and trims the oldest entries in the same commit. ``priority`` is a column of ``rows``."""
        newest = [F.col(c).desc() for c in self.order]
        kept = rows.orderBy(*newest).limit(self.most)  # a batch of more than the bound only leaves its newest
        nth = F.row_number().over(Window.orderBy(*self.order))  # over at most ``most`` rows
        kept.withColumn("entry", nth).write.mode("overwrite").partitionBy("priority").parquet(f"{self.path}/segments/batch={batch}")
        n = self.spark.read.parquet(f"{self.path}/segments/batch={batch}").count() if not rows.isEmpty() else 0
        live = [*self.live(batch), (batch, n, 0)] if n else self.live(batch)
        over = sum(size - skip for _, size, skip in live) - self.most
        trimmed = []
        for b, size, skip in live:
            gone = min(max(over, 0), size - skip)
            over -= gone
            if skip + gone < size:
                trimmed.append((b, size, skip + gone))
        self.spark.createDataFrame([(batch, trimmed)], _LIVE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch-{batch:012d}")

    def read(self, schema: str, priority: bool | None = None) -> DataFrame:
        """The live entries with ``batch`` and ``entry``, oldest first by both; of one lane only its files are read."""
        live = self.live()
        parts = [self.spark.createDataFrame([], f"{schema}, priority boolean, entry int, batch long")]
        for b, _, skip in live:
            part = self.spark.read.schema(f"{schema}, entry int, priority boolean").parquet(f"{self.path}/segments/batch={b}").where(F.col("entry") > skip)
            parts.append(part.withColumn("batch", F.lit(b).cast("long")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out if priority is None else out.where(F.col("priority") == priority)


def tier(score: Column) -> Column:
    """What becomes of a trend by its score."""
    return F.when(score < 0.30, "internal").when(score < 0.60, "agent").when(score < 0.80, "public").otherwise("headline")


@query("stream_publication_log", """
WITH s AS (SELECT event_id, ts, user_id AS match_id, event_type AS trend_type, greatest(0e0, least(1e0, value / 150)) AS score, ntile(6) OVER (ORDER BY ts, event_id) AS b FROM events),
p AS (SELECT * FROM s WHERE score >= 0.30)
SELECT event_id, match_id, trend_type, round(score, 6) AS score, score >= 0.80 AS priority FROM p QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) <= 700""")
def stream_publication_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-23: published trends of six micro-batches, one of them delivered twice, in a log of 700 entries."""
    log = Log(spark, os.path.join(shared_dir(spark, "spark-log-"), f"log-{uuid.uuid4().hex}"), ["ts", "event_id"], 700)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 150))
    s = load(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("match_id"), F.col("event_type").alias("trend_type"), score.alias("score"))
    cuts = s.agg(F.percentile("event_id", [i / 6 for i in range(1, 6)])).first()[0]
    out = s.where(tier(F.col("score")) != "internal").withColumn("priority", tier(F.col("score")) == "headline")
    bounds = [float("-inf"), *cuts, float("inf")]
    for i in (0, 1, 2, 2, 3, 4, 5):
        log.publish(out.where((F.col("event_id") > bounds[i]) & (F.col("event_id") <= bounds[i + 1])), i)
    return log.read("event_id long, ts timestamp_ntz, match_id long, trend_type string, score double").select("event_id", "match_id", "trend_type", F.round("score", 6).alias("score"), "priority")
