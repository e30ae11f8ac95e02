"""Signals, trends, versions, reasoning, clubs, search, leagues, cells, replay, the publication log and the lifecycle stream on awkward rows and against plain Python."""

import datetime as dt
import math
import random
import re
from collections import defaultdict, deque

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline import registry
from tideline.operators import cells, clubs, fulltext, leagues, projection, reasoning, replay, signals, versions
from tideline.operators.state import Lifecycle
from tideline.operators.vectors import cosine_topk
from tideline.registry import load, run_sql
from tideline.streaming import lifecycle as stream_lifecycle
from tideline.streaming import publication

registry.load_all()
DAY = dt.datetime(2024, 1, 1)


# signals
SIGNAL = "scope string, signal_id long, name string, signal_type string, strength double, confidence double, weight double, generated_at timestamp, expires_at timestamp, coverage double, sources int"


def test_signal_states_by_hand(spark):
    rows = [
        ("a", 1, "Home Form", "t", 0.9, 0.8, 0.8, DAY, None, 1.0, 2),
        ("a", 2, "home-form", "t", 0.9, 0.8, 0.9, DAY, None, 1.0, 2),  # the same key, weighs more
        ("a", 3, "away form", "t", 0.8, 0.7, 0.8, DAY, None, None, None),
        ("a", 4, "momentum", "t", 0.5, 0.6, 0.8, DAY, None, 0.5, 1),
        ("a", 5, "home_streak", "t", 0.5, 0.6, 0.8, DAY, DAY, 0.5, 1),  # expired
        ("b", 6, "of no table", "t", 2.0, None, None, None, None, 0.5, 1),
        ("c", 7, "streak", "t", None, 0.02, 0.1, DAY, None, 0.5, 1),
    ]
    got = {(r.scope, r.signal_key): r.state for r in signals.signal_states(spark.createDataFrame(rows, SIGNAL), F.lit(DAY + dt.timedelta(days=1))).collect()}
    home = got["a", "home_form"]
    # two missing or dead parents (0.92 * 0.75), one supporter in its group (momentum), then the conflict of forms
    passed, other = round(0.8 * 0.92 * 0.75, 6), round(0.7 * 0.92 * 0.92, 6)
    home_conf, away_conf = round(passed + 0.04, 6), round(other + 0.04, 6)
    severity = min(1.0, (0.9 + 0.8) * (home_conf + away_conf) / 4)
    assert (home.signal_id, home.status, home.conflicts_with, home.reinforced_by) == (2, "conflicting", ["away_form"], ["momentum"])
    assert home.confidence == pytest.approx(home_conf - min(0.28, 0.12 + 0.18 * severity), abs=1e-6)
    assert [(e.parent, e.relation) for e in home.edges] == [("home_points_5", "requires"), ("home_streak", "weakens")]
    assert got["a", "momentum"].reinforced_by == ["away_form", "home_form"]
    assert (got["a", "home_streak"].status, got["a", "home_streak"].confidence, got["a", "home_streak"].stability) == ("expired", 0.0, 0.0)
    assert (got["b", "of_no_table"].status, got["b", "of_no_table"].base_strength, got["b", "of_no_table"].base_confidence) == ("active", 1.0, 0.5)
    assert (got["c", "streak"].status, got["c", "streak"].active) == ("inactive", False)
    assert signals.signal_states(spark.createDataFrame([], SIGNAL), F.lit(DAY)).count() == 0


def test_six_digits_are_those_of_the_sql(spark):
    draw = random.Random(7)
    # halves at the seventh digit and sums that end beside them, as stability has them
    some = [0.6365014999999999, 0.5201815, 0.41730849999999997, 0.5000195, -0.1234565] + [0.35 * draw.randrange(4) / 4 + 0.25 * min(1, draw.randrange(4) / 3) + 0.3 * (draw.randrange(10**6) / 1e6) + 0.1 for _ in range(20000)]
    got = [r.y for r in spark.createDataFrame([(x,) for x in some], "x double").select(signals.six(F.col("x")).alias("y")).collect()]
    assert got == [duckdb_round for (duckdb_round,) in duckdb.execute("SELECT round(unnest(?::DOUBLE[]), 6)", [some]).fetchall()]


@pytest.mark.parametrize("layered", [False, True])
def test_signal_states_are_exactly_those_of_the_sql(spark, layered):
    name, sf = "signal_states" + "_layered" * layered, "/root/testdata/sf0.01"
    rows = lambda df: sorted(df[["scope", "signal_key", "strength", "confidence", "weight", "stability"]].itertuples(index=False, name=None))
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
        assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(c.sql(registry.ORACLES[name]).df())


def test_layers_of_dependencies():
    assert signals.layers({"a": ("b",), "b": ("c",), "d": ("x",)}) == [["b", "d"], ["a"]]
    with pytest.raises(ValueError, match="circle"):
        signals.layers({"a": ("b",), "b": ("a",)})


# trends
def watchers_and_their_sql(spark, at, rows):
    """Rows of the query on a file that holds ``rows`` in their order, and those of its SQL, by one thread, on the same in order of events."""
    rows = [(m, e, DAY + dt.timedelta(minutes=e), "view", v, k) for m, e, v, k in rows]
    spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz, event_type string, value double, props string").coalesce(1).write.parquet(f"{at}/events.parquet")
    with duckdb.connect() as c:
        c.sql("SET threads = 1")
        c.sql(f"CREATE TABLE events AS SELECT * FROM '{at}/events.parquet/*.parquet' ORDER BY event_id")
        return sorted(tuple(r) for r in registry.QUERIES["trend_watchers"](spark, at).collect()), sorted(c.sql(registry.ORACLES["trend_watchers"]).fetchall())


@pytest.mark.parametrize("step", [1, -1])
def test_watchers_do_not_depend_on_the_order_of_a_file(spark, tmp_path, step):
    """Means of exactly 0.2, which the order of a sum puts on one side or the other."""
    rows = [(m, e, 50.0, '{"k": 5}') for m, ids in ((1, (74, 86, 93)), (2, (60, 63, 89))) for e in ids]
    got, want = watchers_and_their_sql(spark, str(tmp_path), rows[::step])
    assert got == want and [r[4] for r in got] == [True, False]


def test_watchers_pass_over_missing_ends(spark, tmp_path):
    got, want = watchers_and_their_sql(spark, str(tmp_path), [(1, 1, None, None), (1, 2, 10.0, '{"k": 5}'), (1, 3, 90.0, '{"k": 45}'), (1, 4, None, None), (2, 5, None, None)])
    assert got == want == [(1, True, False, True, True), (2, None, None, None, True)]


# versions
def test_as_of_brute_force(spark):
    rng = random.Random(4)
    at = lambda: DAY + dt.timedelta(hours=rng.randrange(24 * 9))
    rows = [(i, rng.choice(["k", "k", "k", "m", None]), at() if i % 9 else None) for i in range(200)]
    vs = [(rng.choice(["k", "k", "m", "z", None]), at() if i % 11 else None, i) for i in range(80)]
    got = versions.as_of(spark.createDataFrame(rows, "id long, key string, t timestamp"), spark.createDataFrame(vs, "key string, since timestamp, n long"), ["key"], "t", "since", "v")
    want = []
    for i, k, t in rows:
        before = [(s, n) for kk, s, n in vs if kk == k and None not in (k, s, t) and s < t]
        want.append((i, max(before)[1] if before else None))
    assert sorted((r.id, r.v.n if r.v else None) for r in got.collect()) == sorted(want)
    assert got.columns == ["id", "key", "t", "v"]


# reasoning
def test_rules_in_layers_and_contradictions(spark):
    rules = [(1, "r1", "x", "mean", 1.0, 0.1, 0.0), (1, "r2", "y", "mean", 1.0, 0.0, 0.0), (2, "r3", "z", "min", 0.5, 0.0, 0.2), (1, "r4", "x", "mean", 1.0, 0.0, 0.0)]
    premises = [("r1", "a", 0.5, None, 1), ("r1", "b", None, 0.5, 1), ("r2", "b", None, None, 1), ("r3", "x", None, None, 1), ("r3", "a", None, None, 0), ("r4", "c", 0.0, None, 1)]
    facts = [("s", "a", 0.6, 0.9), ("s", "b", 0.4, 0.7), ("t", "a", 0.6, 0.2), ("t", "b", 0.5, 0.9), ("u", "c", 1.0, 0.9), ("u", "a", None, 0.9)]
    known, evidence = reasoning.conclude(spark.createDataFrame(facts, "scope string, fact string, value double, confidence double"), rules, premises, [("x", "y")])
    got = {(r.scope, r.fact): round(r.confidence, 6) for r in known.collect()}
    assert ("s", "y") not in got and got["s", "x"] == 0.8 and got["s", "z"] == 0.5  # x is surer than y
    assert got["t", "y"] == 0.9 and ("t", "x") not in got and ("t", "z") not in got
    assert got["u", "x"] == 0.9 and got["u", "z"] == 0.5
    assert {(r.rule, r.premise) for r in evidence.where("scope = 's'").collect()} == {("r1", "a"), ("r1", "b"), ("r2", "b"), ("r3", "x"), ("r3", "a")}
    empty, none = reasoning.conclude(spark.createDataFrame([], "scope string, fact string, value double, confidence double"))
    assert empty.count() == none.count() == 0


# clubs
def test_clubs_awkward(spark):
    known = spark.createDataFrame([(1, 1, "São Paulo FC"), (2, 2, "Paulo"), (3, 3, "F.C."), (4, 4, "paulo sao"), (5, 0, "Sao  Paulo"), (6, 6, None)], "club long, place long, name string")
    names = spark.createDataFrame([("SAO PAULO",), ("Sport Paulo Sao (reserves)",), ("Santo Paulo",), ("Nobody",), ("F.C.",), (None,), ("",), ("SAO PAULO",)], "name string")
    got = {r.key: (r.club, r.how) for r in clubs.resolve(names, known).collect()}
    assert got == {"sao paulo": (5, "exact"), "sport paulo sao reserves": (5, "subset"), "santo paulo": (2, "subset"), "nobody": (None, "none")}
    assert clubs.resolve(names.limit(0), known).count() == 0


# full text
def test_queries_are_parsed():
    assert fulltext.parse('one "two three" -four or five -"six seven') == [([("one",), ("two", "three")], [("four",)]), ([("five",)], [("six", "seven")])]
    assert fulltext.parse("  -  \"\" or ") == []


def test_search_brute_force(spark):
    texts = [None, "", "the The THE end", "in the end the end", "Straße über Äpfel, die Äpfel", "a-b a b", "x " * 3000 + "end the", "the\nend"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = {"a": "the end", "b": '"the end"', "c": '-the', "d": 'äpfel or "a b" -the', "e": '"the the"', "f": '"a b" "b a"'}
    got = {(r.query, r.doc_id): (r.rank, r["first"]) for r in fulltext.search(docs, fulltext.index(docs), asked).collect()}
    want = {}
    for q, text in asked.items():
        alts = fulltext.parse(text)
        for i, t in enumerate(texts):
            words = [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
            at = lambda a, words=words: [k for k in range(len(words) - len(a) + 1) if tuple(words[k : k + len(a)]) == a]
            if any(all(at(a) for a in must) and not any(at(a) for a in never) for must, never in alts):
                hits = [at(a) for a in sorted({a for must, _ in alts for a in must})]
                want[q, i] = (round(sum(map(len, hits)) / (1 + len(words)), 9), min((h[0] for h in hits if h), default=-1))
    assert got == want


# leagues and ratings
def plain_ratings(rows):
    """Ratings over all matches in the order of kickoffs, without any grouping."""
    elo, venue, seen, out = defaultdict(lambda: 1500.0), defaultdict(lambda: 1500.0), defaultdict(set), {}
    rows = sorted(rows, key=lambda r: (r["kickoff_at"], r["uid"]))
    for t in sorted({r["kickoff_at"] for r in rows}):
        now = [r for r in rows if r["kickoff_at"] == t]
        for r in now:
            there = seen[r["competition"], r["season"]]
            out[r["uid"]] = (elo[r["home"]], elo[r["away"]], venue[r["home"], 0], venue[r["away"], 1], sum(elo[x] for x in there) / len(there) if there else 1500.0)
        for r in now:
            h, a, m = r["home"], r["away"], r["home_goals"] - r["away_goals"]
            score = 1.0 if m > 0 else 0.5 if m == 0 else 0.0
            d = 20 * (1 + 0.15 * min(abs(m), 4)) * (score - 1 / (1 + 10 ** ((elo[a] - elo[h] - 65) / 400)))
            v = 16 * (score - 1 / (1 + 10 ** ((venue[a, 1] - venue[h, 0]) / 400)))
            elo[h], elo[a], venue[h, 0], venue[a, 1] = elo[h] + d, elo[a] - d, venue[h, 0] + v, venue[a, 1] - v
            seen[r["competition"], r["season"]] |= {h, a}
    return out


def test_ratings_by_league_are_those_of_one_list(spark, sf):
    m = run_sql(spark, sf, f"SELECT * FROM {leagues.FIXTURES} f").withColumn("kickoff_at", F.unix_micros(F.col("kickoff_at").cast("timestamp")))
    want = plain_ratings([r.asDict() for r in m.collect()])
    got = {r.uid: tuple(r)[1:] for r in leagues.ratings(m).collect()}
    assert got.keys() == want.keys() and len(got) > 1000
    assert max(abs(x - y) for u in got for x, y in zip(got[u], want[u], strict=True)) < 1e-4


def test_leagues_chain(spark):
    n = 40
    plays = [(f"t{i}", c) for i in range(n) for c in (i, i + 1)] + [("alone", 99), (None, 5), ("x", None)]
    got = {r.competition: r.league for r in leagues.leagues(spark.createDataFrame(plays, "team string, competition long")).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 99: 99}


def test_projection_v3_market_and_strength(spark, sf):
    got = {r.uid: r for r in projection.projection_v3(spark, sf).collect()}
    m = [r.asDict() for r in projection._timed(run_sql(spark, sf, "SELECT * FROM {matches}")).collect()]
    rate = plain_ratings(m)
    odds = {r.uid: r for r in projection.market(run_sql(spark, sf, f"SELECT * FROM {projection.ODDS} o")).collect()}
    assert got.keys() == rate.keys()
    for r in m[::17]:
        g, (he, ae, hv, av, league) = got[r["uid"]], rate[r["uid"]]
        before = [x for x in m if x["competition"] == r["competition"] and x["season"] == r["season"] and x["kickoff_at"] < r["kickoff_at"]]
        goals = sum(x["home_goals"] + x["away_goals"] for x in before) / (2 * len(before)) if before else 1.35
        want = [he / 3000, ae / 3000, (he - ae) / 400, g.home_goals_for_10 / max(goals, 0.25), g.away_goals_for_10 / max(goals, 0.25), goals / max(g.home_goals_against_10, 0.25), goals / max(g.away_goals_against_10, 0.25), hv / 3000, av / 3000, league / 3000, 0.75]
        if r["uid"] in odds:
            o = odds[r["uid"]]
            p = [o.implied_home_probability, o.implied_draw_probability, o.implied_away_probability]
            s = sorted(p)
            market = [*p, p.index(s[2]) / 2, s[2], s[2] - s[1], -sum(x * math.log(x + 1e-12) for x in p) / math.log(3)]
        else:
            market = [0.0] * 7
        assert [g[c] for c in projection.V3] == pytest.approx(market + want, abs=1e-5)
    assert len(projection.V2) == 74 and len(projection.V2 + projection.V3) == 92


# cells
@pytest.mark.parametrize("name", ["sf0.001", "sf0.1"])
def test_recall_of_cells(spark, name):
    v = load(spark, f"/root/testdata/{name}", "embeddings")
    q = v.where("vec_id % 100 = 0")
    centres = cells.fit(v)
    got = {(r.q, r.vec_id) for r in cells.search(q, cells.file(v, centres), centres, searched=cells.probes(v, centres)).collect()}
    want = {(r.q, r.vec_id) for r in cosine_topk(q, v).collect()}
    assert len(got & want) >= 0.9 * len(want)
    exact = {(r.q, r.vec_id) for r in cells.search(q, cells.file(v, centres), centres, searched=len(centres)).collect()}
    assert exact == want  # all cells searched is the exact way


def test_cells_awkward(spark, monkeypatch):
    monkeypatch.setattr(cells, "SLICE_ROWS", 10)
    rows = [(i, [1.0, float(i % 3)] if i % 7 else None) for i in range(60)] + [(99, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    centres = cells.fit(v, 3)
    got = cells.search(v.where("vec_id IN (1, 99)"), cells.file(v, centres), centres, k=4, searched=3).orderBy("q", F.desc("sim"), "vec_id").collect()
    assert [r.vec_id for r in got if r.q == 1] == [4, 10, 13, 16] and len([r for r in got if r.q == 99]) == 4
    assert cells.search(v.limit(0), cells.file(v, centres), centres).count() == 0


# replay
def test_outcomes_are_matched_one_to_one(spark):
    rng = random.Random(8)
    t = lambda: DAY + dt.timedelta(minutes=rng.randrange(9000))
    found = [("baseline", m, k, i, t()) for i, (m, k) in enumerate((rng.randrange(3), rng.choice("xy")) for _ in range(80))]
    outcomes = [(rng.randrange(4), 1000 + i, t()) for i in range(50)]
    rows = spark.createDataFrame(found, "version string, match_id long, trend_type string, event_id long, ts timestamp")
    got = {r.event_id: r.outcome_id for r in replay.matched(rows, spark.createDataFrame(outcomes, "match_id long, outcome_id long, ts timestamp"), 6).collect()}
    want = dict.fromkeys(range(80))
    for m in range(3):
        for k in "xy":
            line = sorted([(at, 0, i) for _, mm, kk, i, at in found if (mm, kk) == (m, k)] + [(at, 1, o) for mm, o, at in outcomes if mm == m])
            open_ = deque()
            for at, side, i in line:
                while open_ and at - open_[0][0] > dt.timedelta(hours=6):
                    open_.popleft()
                if side == 0:
                    open_.append((at, i))
                elif open_:
                    want[open_.popleft()[1]] = i
    assert got == want and any(got.values())


# the publication log
def test_log_keeps_the_newest_once(spark, tmp_path):
    log = publication.Log(spark, str(tmp_path / "log"), ["ts", "id"], 25)
    schema = "id long, ts long"
    batch = lambda a, b: spark.range(a, b).select("id", F.floor(F.col("id") / 3).alias("ts"), (F.col("id") % 4 == 0).alias("priority"))
    have = lambda **k: [r.id for r in log.read(schema, **k).orderBy("batch", "entry").collect()]
    assert have() == []
    log.publish(batch(0, 10), 0)
    log.publish(batch(10, 20), 1)
    assert have() == list(range(20))
    for _ in range(2):  # delivered twice
        log.publish(batch(20, 31), 2)
        assert have() == list(range(6, 31))
    log.publish(batch(31, 31), 3)  # empty
    assert have() == list(range(6, 31)) and have(priority=True) == [8, 12, 16, 20, 24, 28]
    log.publish(batch(31, 90), 4)  # more than the bound
    assert have() == list(range(65, 90)) and len(log.live()) == 1


def test_log_over_a_stream(spark, tmp_path):
    for i in range(4):
        spark.range(i * 30, i * 30 + 30).withColumn("ts", F.col("id")).withColumn("priority", F.col("id") % 2 == 0).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    log = publication.Log(spark, str(tmp_path / "log"), ["ts", "id"], 50)
    s = spark.readStream.schema("id long, ts long, priority boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))
    s.writeStream.foreachBatch(log.publish).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in log.read("id long, ts long").collect()) == list(range(70, 120))


# the lifecycle stream
def test_stream_lifecycle_is_the_machine_with_timers(spark, sf):
    rows = load(spark, sf, "events").orderBy("ts", "event_id").collect()
    us = lambda r: int((r.ts - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    end = max(map(us, rows)) // 1000 - 3_600_000  # the last watermark
    want = []
    for user in {r.user_id for r in rows}:
        m = Lifecycle()
        for r in (r for r in rows if r.user_id == user):
            row = type("Row", (), {"event_id": r.event_id, "event_type": r.event_type, "value": r.value, "t": us(r)})
            want += [(user, *x) for x in stream_lifecycle.tick(m, row)]
        want += [(user, held["serial"], k, "EXPIRED") for k, held in m.open.items() if (held["seen"] + m.expiry + 1) * 1000 <= end]
    got = [(r.user_id, r.instance, r.trend_type, r.state) for r in registry.QUERIES["stream_lifecycle"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and sum(x[3] == "EXPIRED" for x in got) > 0


def test_lifecycle_state_goes_with_its_last_instance(spark, tmp_path):
    """Two runs of one stream: a match that has gone silent has neither instances nor state after the watermark has passed."""
    def put(i, rows):
        spark.createDataFrame(rows, "user_id long, event_id long, event_type string, value double, at timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))

    def run():
        s = spark.readStream.schema("user_id long, event_id long, event_type string, value double, at timestamp").parquet(str(tmp_path / "in/part=*"))
        q = stream_lifecycle.lifecycle(s).writeStream.outputMode("append").foreachBatch(lambda d, i: d.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={i}"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()

    put(0, [(1, 1, "view", 10.0, DAY), (2, 2, "view", 10.0, DAY + dt.timedelta(hours=1))])
    run()
    put(1, [(2, 3, "click", 5.0, DAY + dt.timedelta(days=4))])
    run()
    got = sorted((r.user_id, r.instance, r.state, r.event_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 1, "ACTIVE", 1), (1, 1, "EXPIRED", -1), (2, 2, "ACTIVE", 2), (2, 2, "EXPIRED", 3), (2, 3, "ACTIVE", 3)]
    held = spark.read.format("statestore").option("stateVarName", "open").load(str(tmp_path / "state"))
    assert {r.key.user_id for r in held.collect()} == {2}


def test_report_of_scopes(spark, sf):
    got = registry.QUERIES["intelligence_report"](spark, sf).collect()
    years = duckdb.sql(f"select count(distinct (o_orderpriority, year(o_orderdate))) from '{sf}/orders.parquet'").fetchall()[0][0]
    assert 0 < len(got) <= years and all(0 <= r.uncertainty <= 1 and r.behaviours and r.strongest for r in got)
    assert np.isfinite([r.stability for r in got]).all()
