"""The folds against brute force, and the batch queries against their streams."""

import random
import uuid

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.functions.scalar import fn_stable_id
from tideline.operators import state
from tideline.operators.vectors import cosine_topk
from tideline.registry import QUERIES, load, load_all

load_all()
TIMES = st.lists(st.integers(0, 500), max_size=60).map(sorted)


@settings(max_examples=100, deadline=None)
@given(TIMES, st.integers(1, 60), st.integers(0, 60))
def test_cooldown_in_two_parts(times, gap, cut):
    ok, last = state.cooldown(times, gap)
    a, held = state.cooldown(times[:cut], gap)
    b, end = state.cooldown(times[cut:], gap, held)
    assert (a + b, end) == (ok, last)
    passed = [t for t, x in zip(times, ok, strict=True) if x]
    assert all(y - x >= gap for x, y in zip(passed, passed[1:]))  # noqa: B905


@settings(max_examples=100, deadline=None)
@given(TIMES)
def test_sliding_limit_brute_force(times):
    limits = [(10, 2), (50, 5)]
    allowed, out = [], []
    for t in times:
        ok = all(sum(1 for a in allowed if a > t - w) < most for w, most in limits)
        if ok:
            allowed.append(t)
        out.append(ok)
    assert state.sliding_limit(times, limits) == out


@settings(max_examples=100, deadline=None)
@given(TIMES, st.integers(0, 60))
def test_sliding_limit_in_two_parts(times, cut):
    limits, held = [(10, 2), (50, 5)], state.deque()
    assert state.sliding_limit(times[:cut], limits, held) + state.sliding_limit(times[cut:], limits, held) == state.sliding_limit(times, limits)
    assert len(held) <= 5


def test_antispam_rules():
    rows = [(0, 1, "a", 1), (5, 2, "b", 2), (100, 1, "b", 2), (100, 2, "a", 2), (110, 2, "c", 1), (200, 3, "c", 3), (300, 4, "d", 4), (400, 5, "e", 5)]
    agent = state.Antispam((10, 150, 120, 130), hourly=3, daily=4)
    assert [agent.post(*r) for r in rows] == ["allowed", "agent_cooldown", "cluster_cooldown", "trend_cooldown", "match_cooldown", "allowed", "allowed", "hourly_limit"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200_000), st.integers(0, 2), st.integers(0, 2), st.integers(0, 2)), max_size=80).map(sorted))
def test_antispam_brute_force(rows):
    gaps, agent, allowed = (50, 900, 700, 1100), state.Antispam((50, 900, 700, 1100), hourly=3, daily=8), []
    for t, *about in rows:
        since = lambda w, t=t: [a for a in allowed if t - a[0] < w]
        want = "allowed"
        if since(gaps[0]):
            want = "agent_cooldown"
        else:
            for i, rule in enumerate(state.Antispam.RULES):
                if want == "allowed" and any(a[1 + i] == about[i] for a in since(gaps[1 + i])):
                    want = rule
            if want == "allowed":
                want = "hourly_limit" if len(since(3600)) >= 3 else "daily_limit" if len(since(86_400)) >= 8 else want
        assert agent.post(t, *about) == want
        if want == "allowed":
            allowed.append((t, *about))


def test_lifecycle_states():
    m = state.Lifecycle(expiry=100, sustain=3)
    assert m.tick(0, "view", 1, 0.5, False) == [(1, "view", "ACTIVE")]
    assert m.tick(10, "view", 1, 0.7, False) == [(1, "view", "STRENGTHENING")]
    assert m.tick(20, "view", 1, 0.4, False) == [(1, "view", "CONFIRMED")]
    assert m.tick(30, "view", 1, 0.4, False) == [(2, "view", "ACTIVE")]
    assert m.tick(40, "view", -1, 0.4, False) == [(2, "view", "FAILED"), (3, "view", "ACTIVE")]
    assert m.tick(50, "purchase", 0, 0.4, True) == [(3, "view", "CONFIRMED"), (4, "purchase", "ACTIVE")]
    assert m.tick(500, "click", 0, 0.4, False) == [(4, "purchase", "EXPIRED"), (5, "click", "ACTIVE")]


def test_elo_sums_and_equal_kickoffs():
    pdf = pd.DataFrame({"uid": [1, 2, 3], "kickoff_at": [0, 0, 5], "home": [1, 1, 2], "away": [2, 3, 3], "home_goals": [1, 0, 2], "away_goals": [0, 0, 0]})
    got = state.Elo().step(pdf).set_index("uid")
    assert (got.loc[[1, 2]].to_numpy() == 1500).all()
    assert got.loc[3, "home_elo"] < 1500 < got.loc[3, "away_elo"]
    assert got.loc[3, "home_venue"] == 1500 < got.loc[3, "away_venue"]
    parts = state.Elo()
    assert pd.concat([parts.step(pdf[:1]), parts.step(pdf[1:])]).set_index("uid").equals(got)


def test_folds_batch_by_batch(spark, sf):
    """A key's rows may come in any number of batches."""
    names = ("state_cooldown_gate", "state_change_gate", "state_sliding_limit", "state_antispam", "state_lifecycle", "state_elo")
    whole = {n: sorted(map(tuple, QUERIES[n](spark, sf).collect())) for n in names}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert all(sorted(map(tuple, QUERIES[n](spark, sf).collect())) == whole[n] for n in names)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_folds_take_null_keys(spark):
    rows = [(None, 1, 0), (None, 2, 5), (1, 3, 0), (None, 4, 20)]
    df = spark.createDataFrame(rows, "k long, event_id long, t long")

    def start():
        n = 0

        def step(pdf):
            nonlocal n
            n += len(pdf)
            return pd.DataFrame({"n": [n], "event_id": [pdf.event_id.max()]})

        return step

    got = state._fold(df, ["k"], ["t"], start, "n long, event_id long").collect()
    assert max((r.n, r.event_id) for r in got) == (3, 4) and (1, 3) in {(r.n, r.event_id) for r in got}
    assert state._fold(df.limit(0), ["k"], ["t"], start, "n long, event_id long").count() == 0


@pytest.mark.parametrize("name", ["cooldown_gate", "change_gate", "story_sessions"])
def test_stream_is_batch(spark, sf, name):
    batch, stream = QUERIES[f"state_{name}"](spark, sf), QUERIES[f"stream_{name}"](spark, sf)
    columns = [c for c in stream.columns if c in batch.columns]
    assert sorted(map(tuple, batch.select(columns).collect())) == sorted(map(tuple, stream.select(columns).collect()))


def test_order_of_input_does_not_matter(spark, sf, tmp_path):
    load(spark, sf, "events").orderBy("value").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("window_asof_features", "state_lifecycle", "ts_runs"):
        assert sorted(map(tuple, QUERIES[name](spark, sf).collect())) == sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))


def test_stable_ids(spark, sf):
    for r in fn_stable_id(spark, sf).collect():
        assert r.id == str(uuid.uuid5(uuid.NAMESPACE_DNS, r.c_name))


def test_topk_in_blocks_with_ties(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randint(0, 2)) for _ in range(3)]) for i in range(60)] + [(100, None), (101, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    q = v.where("vec_id % 5 = 0 and embedding is not null")
    one = sorted(map(tuple, cosine_topk(q, v, 4).collect()))
    assert one == sorted(map(tuple, cosine_topk(q, v, 4, block=3).collect()))
    assert all(sum(1 for r in one if r[0] == i) == 4 for i in {r[0] for r in one})
    assert cosine_topk(q.limit(0), v).count() == 0


def test_guard_and_policy(spark):
    from pyspark.sql import functions as F

    from tideline.operators.extension import categorise, guard_columns

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id long, kind string")
    assert {r.id: r.category for r in categorise(df, "kind", {"a": "first"}, "other").collect()} == {1: "first", 2: "other", 3: "other"}
    assert guard_columns(df) is df
    with pytest.raises(ValueError):
        guard_columns(df.select(F.struct(F.lit(1).alias("predicted_goals")).alias("s")))


def test_retries_then_dead_letters():
    from tideline.streaming.queries import retrying

    tries, waits, dead = [], [], []

    def write(rows, path):
        tries.append(path)
        if len(tries) < 4:
            raise OSError("away")

    retrying(write, sleep=waits.append)(None, "p")
    assert len(tries) == 4 and waits == [1, 3, 10]
    broken = retrying(lambda rows, path: 1 / 0, lambda rows, path, fault: dead.append(fault), sleep=waits.append)
    broken(None, "p")
    assert len(dead) == 1 and waits == [1, 3, 10, 1, 3, 10, 30]
    with pytest.raises(ZeroDivisionError):
        retrying(lambda rows, path: 1 / 0, delays=(0, 0), sleep=waits.append)(None, "p")


def test_update_mode_over_many_triggers(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from tideline.streaming.queries import stream, updated

    for i in range(4):
        load(spark, sf, "events").where(F.col("event_id") % 4 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    s = stream(spark, str(tmp_path), files=1).groupBy("event_type").agg(F.count("*").alias("n"))
    want = {tuple(r) for r in load(spark, sf, "events").groupBy("event_type").count().collect()}
    assert {tuple(r) for r in updated(s, ["event_type"]).collect()} == want


def test_jsonl_names_the_line(spark, tmp_path):
    from tideline.sources.lake import jsonl

    path = tmp_path / "rows.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2}\n{"a": oops}\n{"a": 3}\n')
    with pytest.raises(ValueError, match="line 4 "):
        jsonl(spark, str(path), "a long")
    path.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in jsonl(spark, str(path), "a long").collect()) == [1, 2]


def test_gated_neighbours(spark):
    rows = [(i, [float(i % 3), 1.0], "a" if i % 2 else "b") for i in range(20)] + [(50, [1.0, 1.0], None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = cosine_topk(v.where("vec_id in (9, 50)"), v, 30, same="label", prior="vec_id").collect()
    assert {r.vec_id for r in got if r.q == 9} == {1, 3, 5, 7}
    assert {r.vec_id for r in got if r.q == 50} == set(range(20))
