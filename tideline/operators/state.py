"""Sequential state per key: gates that compare with the last accepted row, limits, lifecycle, Elo.

A gate's answer depends on its own earlier answers, so no window function gives it. A table is dealt by key, sorted by
(key, time, id) by Spark, whose sort spills, and passed on in Arrow batches; of a key only its small state is in memory
(the last accepted row, the calls of the longest limit, the open instances, the ratings), whatever the number of its
rows. The oracles are recursive queries or brute force in the tests. The same folds run as stateful stream processors in
``tideline.streaming``. A fold is sequential in its key: the rows of one key are one task's work, in one pass.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.registry import load, query, run_sql


def cooldown(times: Iterable[int], gap: int, last: int | None = None) -> tuple[list[bool], int | None]:
    """O-210: a row passes if at least ``gap`` has gone by since the last row that passed."""
    out = []
    for t in times:
        ok = last is None or t - last >= gap
        if ok:
            last = t
        out.append(ok)
    return out, last


def change_gate(values: Iterable[float], share: float, last: float | None = None) -> tuple[list[bool], float | None]:
    """O-216: a row passes if it differs from the last published value by at least ``share`` of it."""
    out = []
    for v in values:
        ok = last is None or (abs(v - last) / abs(last) >= share if last else v != last)
        if ok:
            last = v
        out.append(ok)
    return out, last


def sliding_limit(times: Iterable[int], limits: list[tuple[int, int]], allowed: deque[int] | None = None) -> list[bool]:
    """O-217: a call passes if every window (length, most) has room; only calls that pass are counted.

    ``allowed`` holds the calls that passed before and is carried on; at most the calls of the longest window stay in it.
    """
    allowed = deque() if allowed is None else allowed
    longest = max(w for w, _ in limits)
    out = []
    for t in times:
        while allowed and t - allowed[0] >= longest:
            allowed.popleft()
        ok = all(len(allowed) < most or t - allowed[-most] >= w for w, most in limits)
        if ok:
            allowed.append(t)
        out.append(ok)
    return out


class Antispam:
    """O-219: first rule that stops a post of one agent, cheapest first; only allowed posts are remembered.

    Times are in seconds. ``gaps`` are the cooldowns of the agent, the story, the trend and the match.
    """

    RULES = ("cluster_cooldown", "trend_cooldown", "match_cooldown")

    def __init__(self, gaps: tuple[int, int, int, int] = (300, 900, 1800, 600), hourly: int = 6, daily: int = 30) -> None:
        self.gaps, self.hourly, self.daily = gaps, hourly, daily
        self.posts: deque[int] = deque()
        self.last: tuple[dict, dict, dict] = ({}, {}, {})

    def post(self, t: int, *about: object) -> str:
        """The verdict on a post at ``t`` about a story, a trend and a match."""
        while self.posts and t - self.posts[0] >= 86_400:
            self.posts.popleft()
        if self.posts and t - self.posts[-1] < self.gaps[0]:
            return "agent_cooldown"
        for rule, last, gap, key in zip(self.RULES, self.last, self.gaps[1:], about, strict=True):
            if key in last and t - last[key] < gap:
                return rule
        if len(self.posts) >= self.hourly and t - self.posts[-self.hourly] < 3600:
            return "hourly_limit"
        if len(self.posts) >= self.daily:
            return "daily_limit"
        self.posts.append(t)
        for last, gap, key in zip(self.last, self.gaps[1:], about, strict=True):
            if len(last) > 2 * self.daily:  # what has run out is forgotten
                for k in [k for k, at in last.items() if t - at >= gap]:
                    del last[k]
            last[key] = t
        return "allowed"


class Lifecycle:
    """O-212, O-213: open instances of one match by trend type; each tick expires, confirms, fails, then observes."""

    def __init__(self, expiry: int = 86_400, sustain: int = 3, confirms: str = "purchase", eps: float = 0.05) -> None:
        self.open: dict[str, dict] = {}
        self.expiry, self.sustain, self.confirms, self.eps, self.serial = expiry, sustain, confirms, eps, 0

    def tick(self, t: int, kind: str, direction: int, strength: float, impact: bool) -> list[tuple[int, str, str]]:
        """Closed or touched instances as (serial, type, state)."""
        out = []
        for k in sorted(self.open):
            if t - self.open[k]["seen"] > self.expiry:
                out.append((self.open.pop(k)["serial"], k, "EXPIRED"))
        if impact:
            for k in sorted(self.open):
                if k != kind:
                    out.append((self.open.pop(k)["serial"], k, "CONFIRMED"))
        held = self.open.get(kind)
        if held and held["direction"] and direction == -held["direction"]:
            out.append((self.open.pop(kind)["serial"], kind, "FAILED"))
            held = None
        if held is None:
            self.serial += 1
            self.open[kind] = {"serial": self.serial, "direction": direction, "strength": strength, "seen": t, "n": 1}
            out.append((self.serial, kind, "ACTIVE"))
            return out
        change = strength - held["strength"]
        held |= {"seen": t, "strength": strength, "n": held["n"] + 1, "direction": direction or held["direction"]}
        if held["n"] >= self.sustain:
            out.append((self.open.pop(kind)["serial"], kind, "CONFIRMED"))
        else:
            out.append((held["serial"], kind, "STRENGTHENING" if change > self.eps else "WEAKENING" if change < -self.eps else "ACTIVE"))
        return out


Step = Callable[[pd.DataFrame], pd.DataFrame]


def _fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Step], schema: str) -> DataFrame:
    """Rows of each key, in order and batch by batch, through what ``start`` returns for the key; nulls are a key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, step = None, None
        for pdf in frames:
            out = []
            for _, rows in pdf.groupby((pdf["_key"] != pdf["_key"].shift()).cumsum(), sort=False):
                key = rows["_key"].iloc[0]
                if step is None or key != now:
                    now, step = key, start()
                out.append(step(rows))
            if out:
                yield pd.concat(out)

    keyed = df.withColumn("_key", F.to_json(F.struct(*keys)))
    return keyed.repartition("_key").sortWithinPartitions("_key", *order).mapInPandas(run, schema)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))


ORDER = ["t", "event_id"]
_ORDERED = "e AS (SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS i FROM events)"


@query("state_cooldown_gate", "WITH RECURSIVE " + _ORDERED.format(key="user_id") + """,
g AS (SELECT user_id, event_id, i, t AS last, TRUE AS passed FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.t - g.last >= 21600000000 THEN e.t ELSE g.last END, e.t - g.last >= 21600000000 FROM g JOIN e ON e.user_id = g.user_id AND e.i = g.i + 1)
SELECT user_id, event_id FROM g WHERE passed""")
def state_cooldown_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-210: at most one row a match in six hours, counted from the last one that passed."""

    def start() -> Step:
        last = None

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal last
            ok, last = cooldown(pdf.t.tolist(), 21_600_000_000, last)
            return pdf.loc[ok, ["user_id", "event_id"]]

        return step

    return _fold(_events(spark, sf_dir).select("user_id", "event_id", "t"), ["user_id"], ORDER, start, "user_id long, event_id long")


@query("state_change_gate", "WITH RECURSIVE " + _ORDERED.format(key="user_id, event_type") + """,
g AS (SELECT user_id, event_type, event_id, i, value AS last, TRUE AS passed FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_type, e.event_id, e.i, CASE WHEN abs(e.value - g.last) / abs(g.last) >= 0.5 THEN e.value ELSE g.last END, abs(e.value - g.last) / abs(g.last) >= 0.5 FROM g JOIN e ON e.user_id = g.user_id AND e.event_type = g.event_type AND e.i = g.i + 1)
SELECT event_id FROM g WHERE passed""")
def state_change_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-216: a lane's price is published when it moved by half of the last published one."""

    def start() -> Step:
        last = None

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal last
            ok, last = change_gate(pdf.value.tolist(), 0.5, last)
            return pdf.loc[ok, ["event_id"]]

        return step

    return _fold(_events(spark, sf_dir).select("user_id", "event_type", "event_id", "t", "value"), ["user_id", "event_type"], ORDER, start, "event_id long")


@query("state_sliding_limit")
def state_sliding_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-217: calls of each provider within limits of a quarter hour, an hour and a day (brute force in the tests)."""
    limits = [(900_000_000, 3), (3_600_000_000, 9), (86_400_000_000, 180)]

    def start() -> Step:
        allowed: deque[int] = deque()
        return lambda pdf: pdf.loc[sliding_limit(pdf.t.tolist(), limits, allowed), ["event_id"]]

    return _fold(_events(spark, sf_dir).select("event_type", "event_id", "t"), ["event_type"], ORDER, start, "event_id long")


@query("state_antispam")
def state_antispam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-219: first violated rule of each post of an agent; cooldowns of hours, as the table's agents post rarely (brute force in the tests)."""

    def start() -> Step:
        agent = Antispam((1800, 14_400, 7200, 28_800))

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = zip((pdf.t // 1_000_000).tolist(), (pdf.event_id % 7).tolist(), pdf.event_type.tolist(), (pdf.event_id % 11).tolist(), strict=True)
            return pd.DataFrame({"event_id": pdf.event_id, "verdict": [agent.post(*r) for r in rows]})

        return step

    return _fold(_events(spark, sf_dir).select("user_id", "event_id", "event_type", "t"), ["user_id"], ORDER, start, "event_id long, verdict string")


@query("state_lifecycle")
def state_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-212, O-213, O-215: every state an instance goes through, in order."""

    def start() -> Step:
        m = Lifecycle()

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for r in pdf.itertuples():
                for serial, kind, state in m.tick(r.t // 1_000_000, r.event_type, int(r.event_id % 3) - 1, r.value / 100, r.event_type == m.confirms):
                    out.append((r.user_id, r.event_id, serial, kind, state))
            return pd.DataFrame(out, columns=["user_id", "event_id", "serial", "trend_type", "state"])

        return step

    return _fold(_events(spark, sf_dir).select("user_id", "event_id", "event_type", "value", "t"), ["user_id"], ORDER, start, "user_id long, event_id long, serial long, trend_type string, state string")


@query("state_checkpoints", """
WITH e AS (SELECT user_id, event_id, ts, CAST(event_id % 95 AS INT) AS minute FROM events),
c AS (SELECT unnest([15, 30, 45, 60, 75, 90]) AS checkpoint)
SELECT user_id, CAST(checkpoint AS INT) AS checkpoint, min_by(event_id, (ts, event_id)) AS event_id FROM e JOIN c ON minute >= checkpoint GROUP BY user_id, checkpoint""")
def state_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-214: each checkpoint fires once, at the first row that reaches it."""
    e = load(spark, sf_dir, "events").withColumn("minute", (F.col("event_id") % 95).cast("int"))
    c = e.select("user_id", "event_id", "ts", F.explode(F.filter(F.array(*map(F.lit, (15, 30, 45, 60, 75, 90))), lambda x: x <= F.col("minute"))).alias("checkpoint"))
    return c.groupBy("user_id", "checkpoint").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("state_threshold_window", """
WITH c AS (SELECT event_id, event_type, user_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW) AS n FROM events)
SELECT event_id, CAST(n AS BIGINT) AS n FROM c WHERE n >= 3""")
def state_threshold_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-209: rows at which a sliding window of two days holds at least three of their kind."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("t").rangeBetween(-172_800_000_000, 0)
    return _events(spark, sf_dir).withColumn("n", F.count("*").over(w)).where("n >= 3").select("event_id", "n")


@query("state_recalculation", """
WITH e AS (SELECT user_id, event_id, ts, event_type, CAST(event_id % 95 AS INT) AS minute, lag(CAST(event_id % 95 AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)
SELECT event_id, CASE WHEN event_type = 'error' THEN 'critical' WHEN abs(step) >= 80 THEN 'odds' WHEN minute // 15 <> before // 15 THEN 'time' END AS cause FROM e WHERE event_type = 'error' OR abs(step) >= 80 OR minute // 15 <> before // 15""")
def state_recalculation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-215: what makes a context be worked out anew: a critical event, the odds, or the clock, in this order."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, sf_dir, "events").withColumn("minute", (F.col("event_id") % 95).cast("int"))
    e = e.withColumn("before", F.lag("minute").over(w)).withColumn("step", F.col("value") - F.lag("value").over(w))
    quarter = lambda c: F.floor(F.col(c) / 15)
    cause = F.when(F.col("event_type") == "error", "critical").when(F.abs("step") >= 80, "odds").when(quarter("minute") != quarter("before"), "time")
    return e.withColumn("cause", cause).where("cause is not null").select("event_id", "cause")


@query("state_story_sessions", """
WITH e AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) > INTERVAL '36' HOUR AS gap FROM events),
s AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS story FROM e)
SELECT user_id, event_type, min(ts) AS opened, CAST(count(*) AS BIGINT) AS n, max(value) AS peak FROM s GROUP BY user_id, event_type, story""")
def state_story_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-220, O-221: stories are session windows that close after a day and a half without a row."""
    e = load(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", "event_type", F.session_window("at", "129600 seconds 1 microsecond")).agg(F.count("*").alias("n"), F.max("value").alias("peak"))
    return s.select("user_id", "event_type", F.col("session_window.start").cast("timestamp_ntz").alias("opened"), "n", "peak")


class Elo:
    """O-199: ratings before each match, rows in the order of kickoffs; matches of one kickoff are all rated before any is recorded.

    Two lists: a team's rating, with an edge for the home side and a step that grows with the margin; and its rating at
    that venue, home teams and away teams apart.
    """

    def __init__(self, k: float = 20.0, edge: float = 65.0, venue_k: float = 16.0, first: float = 1500.0) -> None:
        self.k, self.edge, self.venue_k, self.first = k, edge, venue_k, first
        self.rating: dict[object, float] = {}
        self.venue: dict[tuple[object, str], float] = {}
        self.kickoff, self.waiting = None, []

    def step(self, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            if r.kickoff_at != self.kickoff:
                for m in self.waiting:
                    self._record(*m)
                self.kickoff, self.waiting = r.kickoff_at, []
            sides = self._of(r.home, r.away)
            out.append((r.uid, *(round(x, 6) for x in sides)))
            self.waiting.append((r.home, r.away, r.home_goals, r.away_goals))
        return pd.DataFrame(out, columns=["uid", "home_elo", "away_elo", "home_venue", "away_venue"])

    def _of(self, home: object, away: object) -> tuple[float, float, float, float]:
        r, v = self.rating, self.venue
        return r.get(home, self.first), r.get(away, self.first), v.get((home, "home"), self.first), v.get((away, "away"), self.first)

    def _record(self, home: object, away: object, home_goals: int, away_goals: int) -> None:
        h, a, hv, av = self._of(home, away)
        margin = abs(home_goals - away_goals)
        score = 1.0 if home_goals > away_goals else 0.5 if margin == 0 else 0.0
        moved = self.k * (1 + 0.15 * min(margin, 4)) * (score - 1 / (1 + 10 ** ((a - h - self.edge) / 400)))
        self.rating[home], self.rating[away] = h + moved, a - moved
        moved = self.venue_k * (score - 1 / (1 + 10 ** ((av - hv) / 400)))
        self.venue[home, "home"], self.venue[away, "away"] = hv + moved, av - moved


@query("state_elo")
def state_elo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-199, O-198: Elo of both sides before each match, overall and by venue. Both sides move with every match, so the unit is a competition."""
    m = run_sql(spark, sf_dir, "SELECT * FROM {matches}").withColumn("kickoff_at", F.unix_micros(F.col("kickoff_at").cast("timestamp")))
    return _fold(m, ["competition"], ["kickoff_at", "uid"], lambda: Elo().step, "uid long, home_elo double, away_elo double, home_venue double, away_venue double")
