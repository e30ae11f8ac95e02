"""Signal states: what the signals of a scope amount to once they are weighed against each other.

Of a scope's signals of one key the best stays. Its state then passes three stages: the signals it depends on lend or
take confidence; compatible signals that are active together reinforce each other, group by group; signals that
contradict each other lose confidence, rule by rule, each rule seeing what the rules before it left.

Best-of-key is one aggregation. All that a scope's stages look at are the signals that the tables below name, so they
become one map a scope (as many entries as the tables have keys) and every stage is an expression over it: no join and
no shuffle a stage. Signals of other keys only have their first state and never enter a map.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.registry import query, run_sql

# What each signal depends on.
DEPENDENCIES = {
    "favorite_pressure": ("implied_home_strength", "odds_gap", "market_consensus"),
    "market_consensus": ("implied_home_strength", "market_entropy"),
    "market_disagreement": ("market_entropy", "bookmaker_spread"),
    "draw_tendency": ("historical_balance", "low_scoring", "market_uncertainty"),
    "low_scoring": ("scoring_tendency", "goal_distribution"),
    "competition_volatility": ("goal_volatility", "market_disagreement"),
    "home_form": ("home_points_5", "home_streak"),
    "away_form": ("away_points_5", "away_streak"),
    "momentum": ("home_form", "away_form"),
}
# Signals that reinforce each other, in the order in which the groups count.
GROUPS = (
    ("favorite_pressure", "market_consensus", "implied_home_strength", "odds_gap"),
    ("draw_tendency", "historical_balance", "low_scoring", "market_uncertainty"),
    ("low_scoring", "goal_distribution", "draw_tendency"),
    ("home_form", "momentum", "home_streak"),
    ("away_form", "momentum", "away_streak"),
    ("competition_volatility", "market_disagreement", "goal_volatility"),
)
# Signals that contradict each other, in the order in which the rules count.
CONFLICTS = (
    ("favorite_pressure", "market_disagreement"),
    ("market_consensus", "market_disagreement"),
    ("scoring_tendency", "low_scoring"),
    ("home_form", "away_form"),
    ("competition_volatility", "market_consensus"),
)
# Least confidence of an active signal; confidence and strength below which a signal is weak.
LEAST_CONFIDENCE, WEAK_CONFIDENCE, WEAK_STRENGTH = 0.05, 0.35, 0.15
# Factors of a dependency without its signal and of an inactive one; share that an active one decides.
ABSENT, INACTIVE, SWAY = 0.92, 0.75, 0.25
# What a supporter adds and all together at most; severity from which a conflict counts.
SUPPORT, MOST_SUPPORT, LEAST_SEVERITY = 0.04, 0.18, 0.18


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def six(x: Column) -> Column:
    """Six digits by the double a million times ``x``, half away from zero; ``F.round`` goes by the decimal text of ``x``, which decides other halves."""
    return F.round(x * 1e6) / 1e6


def settled(x: Column) -> Column:
    """Confidence and weight as they are kept: 0 to 1, six digits."""
    return six(clamp(x))


def signal_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "[ -]", "_")


def stability(confidence: Column, coverage: Column, sources: Column, conflict: Column | float, expired: Column) -> Column:
    """How much a state can be relied on, 0 once it has expired."""
    own = 0.35 * clamp(coverage) + 0.25 * F.least(F.lit(1.0), sources / 3) + 0.30 * clamp(confidence) + 0.10 * (1 - clamp(F.lit(conflict) if isinstance(conflict, float) else conflict))
    return F.when(expired, F.lit(0.0)).otherwise(settled(own))


def best_of_key(signals: DataFrame) -> DataFrame:
    """Of each scope and key the signal of the greatest confidence times weight; then the later, then the lower id."""
    known = signals.withColumn("signal_key", signal_key(F.col("name")))
    for c, default in (("strength", 0.0), ("confidence", 0.5), ("weight", 0.5)):
        known = known.withColumn(c, clamp(F.coalesce(F.col(c).cast("double"), F.lit(default))))
    rank = F.struct(-(F.col("confidence") * F.col("weight")), -F.unix_micros(F.col("generated_at").cast("timestamp")), "signal_id")
    names = ["signal_id", "name", "signal_type", "strength", "confidence", "weight", "expires_at", "coverage", "sources"]
    return known.groupBy("scope", "signal_key").agg(F.min_by(F.struct(*names), rank).alias("best")).select("scope", "signal_key", "best.*")


def first_states(signals: DataFrame, as_of: Column) -> DataFrame:
    """(scope, signal_key, state) of the best signals by themselves."""
    own = best_of_key(signals)
    expired = F.coalesce(F.col("expires_at") <= as_of, F.lit(False))
    inactive = (F.col("confidence") <= LEAST_CONFIDENCE) | (F.col("strength") <= 0)
    weak = (F.col("confidence") < WEAK_CONFIDENCE) | (F.col("strength") < WEAK_STRENGTH)
    left = lambda c: F.when(expired, F.lit(0.0)).otherwise(six(c))
    coverage, sources = F.coalesce(F.col("coverage").cast("double"), F.lit(0.5)), F.coalesce(F.col("sources").cast("int"), F.lit(1))
    state = F.struct(
        F.col("signal_id"),
        F.col("signal_type"),
        F.when(expired, "expired").when(inactive, "inactive").when(weak, "weak").otherwise("active").alias("status"),
        (~expired & ~inactive).alias("active"),
        expired.alias("expired"),
        (weak & ~expired).alias("weak"),
        six(F.col("strength")).alias("base_strength"),
        six(F.col("confidence")).alias("base_confidence"),
        six(F.col("weight")).alias("base_weight"),
        left(F.col("strength")).alias("strength"),
        left(F.col("confidence")).alias("confidence"),
        left(F.col("weight")).alias("weight"),
        coverage.alias("coverage"),
        sources.alias("sources"),
        stability(left(F.col("confidence")), coverage, sources, 0.0, expired).alias("stability"),
        F.array().cast("array<struct<parent:string,relation:string,effect:double>>").alias("edges"),
        F.array().cast("array<string>").alias("reinforced_by"),
        F.array().cast("array<string>").alias("conflicts_with"),
    )
    return own.select("scope", "signal_key", state.alias("state"))


def layers(dependencies: dict[str, tuple[str, ...]]) -> list[list[str]]:
    """Dependants in an order in which every signal comes after those it depends on; a circle raises an error."""
    left, out = dict(dependencies), []
    while left:
        ready = [k for k, parents in left.items() if not any(p in left for p in parents)]
        if not ready:
            raise ValueError(f"signals depend on each other in a circle: {sorted(left)}")
        out.append(ready)
        left = {k: v for k, v in left.items() if k not in ready}
    return out


def _set(states: Column, keys: list[str], change) -> Column:  # noqa: ANN001
    """The map with the states of ``keys`` changed."""
    return F.transform_values(states, lambda k, s: F.when(k.isin(keys), change(k, s)).otherwise(s))


#: Fields of a state.
FIELDS = ("signal_id", "signal_type", "status", "active", "expired", "weak", "base_strength", "base_confidence", "base_weight", "strength", "confidence", "weight", "coverage", "sources", "stability", "edges", "reinforced_by", "conflicts_with")


def _changed(state: Column, **new: Column) -> Column:
    """A state with new fields, written out as one struct: chains of ``withField`` grow with every link."""
    return F.struct(*[new.get(c, state[c]).alias(c) for c in FIELDS])


def _of(names: tuple[str, ...] | list[str]) -> Column:
    return F.array(*map(F.lit, names))


def depend(states: Column, dependencies: dict[str, tuple[str, ...]], before: Column | None = None) -> Column:
    """Confidence passed on by the signals of ``before`` (the same map) that each one depends on."""
    before = states if before is None else before
    table = F.create_map(*[x for k, parents in dependencies.items() for x in (F.lit(k), _of(parents))])

    def change(k: Column, s: Column) -> Column:
        parents = table[k]
        there = lambda p: F.map_contains_key(before, p)
        sure = lambda p: before[p]["confidence"]
        factor = lambda p: F.when(~there(p), ABSENT).when(~before[p]["active"], INACTIVE).otherwise(1 - SWAY + SWAY * sure(p))
        relation = lambda p: F.when(~there(p), "requires").when(~before[p]["active"], "weakens").otherwise("supports")
        effect = lambda p: F.when(~there(p), ABSENT - 1).when(~before[p]["active"], INACTIVE - 1).otherwise((sure(p) - 0.5) * 0.2)
        confidence = settled(s["confidence"] * F.aggregate(parents, F.lit(1.0), lambda acc, p: acc * factor(p)))
        weak = s["weak"] | (s["active"] & (confidence < WEAK_CONFIDENCE))
        edges = F.transform(parents, lambda p: F.struct(p.alias("parent"), relation(p).alias("relation"), six(effect(p)).alias("effect")))
        status = F.when(weak & s["active"], "weak").otherwise(s["status"])
        return _changed(s, confidence=confidence, weak=weak, status=status, edges=edges, stability=stability(confidence, s["coverage"], s["sources"], 0.0, s["expired"]))

    return _set(states, list(dependencies), change)


def reinforce(states: Column, group: tuple[str, ...]) -> Column:
    """The active signals of a group lift each other, if there are two at least."""
    here = F.filter(_of(group), lambda k: F.coalesce(states[k]["active"], F.lit(False)))
    boost = F.least(F.lit(MOST_SUPPORT), SUPPORT * (F.size(here) - 1))

    def change(k: Column, s: Column) -> Column:
        confidence = settled(s["confidence"] + boost)
        by = F.array_sort(F.array_union(s["reinforced_by"], F.filter(here, lambda o: o != k)))
        out = _changed(s, confidence=confidence, weight=settled(s["weight"] + boost / 2), status=F.lit("reinforced"), reinforced_by=by, stability=stability(confidence, s["coverage"], s["sources"], 0.0, s["expired"]))
        return F.when(s["active"] & (F.size(here) >= 2), out).otherwise(s)

    return _set(states, list(group), change)


def contradict(states: Column, left: str, right: str) -> Column:
    """Two active signals that contradict each other lose confidence by how strong and sure both are."""
    a, b = states[left], states[right]
    severity = F.least(F.lit(1.0), (a["strength"] + b["strength"]) * (a["confidence"] + b["confidence"]) / 4)
    holds = F.coalesce(a["active"] & b["active"] & (severity >= LEAST_SEVERITY), F.lit(False))

    def change(k: Column, s: Column) -> Column:
        confidence = settled(s["confidence"] - F.least(F.lit(0.28), 0.12 + severity * 0.18))
        others = F.array_sort(F.array_union(s["conflicts_with"], F.array(F.when(k == left, right).otherwise(left))))
        out = _changed(s, confidence=confidence, status=F.lit("conflicting"), conflicts_with=others, stability=stability(confidence, s["coverage"], s["sources"], severity, s["expired"]))
        return F.when(holds, out).otherwise(s)

    return _set(states, [left, right], change)


def signal_states(signals: DataFrame, as_of: Column, layered: bool = False) -> DataFrame:
    """(scope, signal_key, state) after all stages. Columns of ``signals``: scope, signal_id, name, signal_type, strength,
    confidence, weight, generated_at, expires_at, coverage, sources.

    A signal sees the first states of those it depends on; if ``layered``, their states after they have been passed
    confidence themselves, so that it goes down the graph of dependencies layer by layer until nothing changes.
    """
    named = sorted({*DEPENDENCIES, *sum(DEPENDENCIES.values(), ()), *sum(GROUPS, ()), *sum(CONFLICTS, ())})
    first = first_states(signals, as_of)
    in_tables = F.col("signal_key").isin(named)
    scopes = first.where(in_tables).groupBy("scope").agg(F.map_from_entries(F.collect_list(F.struct("signal_key", "state"))).alias("m"))
    rounds = [{k: DEPENDENCIES[k] for k in layer} for layer in layers(DEPENDENCIES)] if layered else [DEPENDENCIES]
    steps = [lambda m, r=r: depend(m, r) for r in rounds] + [lambda m, g=g: reinforce(m, g) for g in GROUPS] + [lambda m, c=c: contradict(m, *c) for c in CONFLICTS]
    done = reduce(lambda frame, step: frame.withColumn("m", step(F.col("m"))), steps, scopes)
    # no scope is without states; a plain explode would have its filter on empty maps pushed down through every step
    return done.select("scope", F.explode_outer("m").alias("signal_key", "state")).unionByName(first.where(~in_tables | F.col("signal_key").isNull()))


def summary(states: DataFrame, most: int = 8) -> DataFrame:
    """One row a scope: its strongest and weakest active signals by confidence times weight, lists by status, means."""
    pull = F.col("state.confidence") * F.col("state.weight")
    entry = F.struct(pull.alias("pull"), F.col("signal_key"))
    listed = lambda where: F.array_sort(F.collect_list(F.when(where, F.col("signal_key"))))
    active = F.collect_list(F.when(F.col("state.active"), entry))
    out = states.groupBy("scope").agg(
        active.alias("active"),
        listed(F.col("state.expired")).alias("expired"),
        listed(F.size("state.conflicts_with") > 0).alias("conflicting"),
        listed(F.size("state.reinforced_by") > 0).alias("reinforced"),
        six(F.avg("state.stability") + 1e-9).alias("stability"),  # halves go up, whatever the order of the sum
        six(F.avg("state.confidence") + 1e-9).alias("confidence"),
    )
    order = lambda sign: F.transform(F.slice(F.array_sort(F.transform("active", lambda x: F.struct((sign * x["pull"]).alias("p"), x["signal_key"].alias("k")))), 1, most), lambda x: x["k"])
    return out.select("scope", order(-1).alias("strongest"), order(1).alias("weakest"), "expired", "conflicting", "reinforced", "stability", "confidence")


_NAMES = sorted({*DEPENDENCIES, *sum(DEPENDENCIES.values(), ()), *sum(GROUPS, ()), *sum(CONFLICTS, ())}) + ["streak", "defensive_instability"]
#: Events as signals: a match and third of a month is a scope; names are spelt in several ways.
SIGNALS = f"""(SELECT concat(CAST(user_id AS [[STRING||VARCHAR]]), '-', CAST(CAST(floor(day(ts) / 11e0) AS INT) AS [[STRING||VARCHAR]])) AS scope, event_id AS signal_id, event_type AS signal_type,
  CASE event_id % 3 WHEN 0 THEN n WHEN 1 THEN concat(' ', upper(replace(n, '_', ' '))) ELSE replace(n, '_', '-') END AS name, value / 120 AS strength, k / 90 AS confidence, CAST(event_id % 50 AS DOUBLE) / 50 AS weight, ts AS generated_at,
  CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL '14' DAY END AS expires_at, CAST(event_id % 4 AS DOUBLE) / 4 AS coverage, CAST(event_id % 4 AS INT) AS sources
  FROM (SELECT *, CAST([[get_json_object(props, '$.k')||json_extract_string(props, '$.k')]] AS DOUBLE) AS k, [[element_at(array||list_extract(list_value]]({', '.join(f"'{n}'" for n in _NAMES)}), CAST(event_id % {len(_NAMES)} AS INT) + 1) AS n FROM {{events}}) e)"""
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)


#: The same by joins: dependencies by products, groups and rules by recursion over their numbers.
def _oracle(layered: bool) -> str:
    dep = [(k, p) for k, parents in DEPENDENCIES.items() for p in parents]
    depth = {k: n + 1 for n, layer in enumerate(layers(DEPENDENCIES)) for k in layer} if layered else dict.fromkeys(DEPENDENCIES, 1)
    cut = "greatest(0e0, least(1e0, {}))"
    passed = f"""
l{{n}} AS (SELECT c.scope, c.key, any_value(c.conf) AS c0, product(CASE WHEN p.key IS NULL THEN {ABSENT} WHEN NOT p.active THEN {INACTIVE} ELSE {1 - SWAY} + {SWAY} * p.conf END) AS f FROM z{{b}} c JOIN dep ON child = c.key AND layer = {{n}} LEFT JOIN z{{b}} p ON p.scope = c.scope AND p.key = parent GROUP BY c.scope, c.key),
z{{n}} AS (SELECT z.* REPLACE (CASE WHEN f IS NULL THEN conf ELSE round({cut.format('conf * f')}, 6) END AS conf) FROM z{{b}} z LEFT JOIN l{{n}} USING (scope, key)),"""
    deepest = max(depth.values())
    return f"""
WITH RECURSIVE raw AS (SELECT *, replace(replace(lower(trim(name)), ' ', '_'), '-', '_') AS key, {cut.format('strength')} AS s, {cut.format('confidence')} AS c, {cut.format('weight')} AS w FROM {SIGNALS}),
one AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY scope, key ORDER BY c * w DESC, generated_at DESC, signal_id) = 1),
i AS (SELECT *, coalesce(expires_at <= {AS_OF}, false) AS expired, c > {LEAST_CONFIDENCE} AND s > 0 AS alive FROM one),
z0 AS (SELECT scope, key, signal_id, expired, alive AND NOT expired AS active, (c < {WEAK_CONFIDENCE} OR s < {WEAK_STRENGTH}) AND NOT expired AS weak0, CASE WHEN expired THEN 'expired' WHEN NOT alive THEN 'inactive' WHEN c < {WEAK_CONFIDENCE} OR s < {WEAK_STRENGTH} THEN 'weak' ELSE 'active' END AS status0,
  CASE WHEN expired THEN 0 ELSE round(s, 6) END AS strength, CASE WHEN expired THEN 0 ELSE round(c, 6) END AS conf, CASE WHEN expired THEN 0 ELSE round(w, 6) END AS weight, coverage, sources FROM i),
dep AS (SELECT * FROM (VALUES {_values([(k, p, depth[k]) for k, p in dep])}) AS d(child, parent, layer)),""" + "".join(passed.format(n=n, b=n - 1) for n in range(1, deepest + 1)) + f"""
gm AS (SELECT * FROM (VALUES {_values([(n + 1, k) for n, g in enumerate(GROUPS) for k in g])}) AS g(g, key)),
have AS (SELECT scope, g, count(*) AS n FROM z{deepest} JOIN gm USING (key) WHERE active GROUP BY scope, g HAVING count(*) >= 2),
r AS (SELECT 0 AS g, scope, key, conf, weight, 0 AS hits FROM z{deepest} UNION ALL
  SELECT r.g + 1, r.scope, r.key, CASE WHEN n IS NULL OR NOT active THEN r.conf ELSE round({cut.format(f"r.conf + least({MOST_SUPPORT}, {SUPPORT} * (n - 1))")}, 6) END, CASE WHEN n IS NULL OR NOT active THEN r.weight ELSE round({cut.format(f"r.weight + least({MOST_SUPPORT}, {SUPPORT} * (n - 1)) / 2")}, 6) END, r.hits + CASE WHEN n IS NULL OR NOT active THEN 0 ELSE 1 END
  FROM r JOIN z{deepest} z ON z.scope = r.scope AND z.key = r.key LEFT JOIN gm ON gm.g = r.g + 1 AND gm.key = r.key LEFT JOIN have h ON h.scope = r.scope AND h.g = gm.g WHERE r.g < {len(GROUPS)}),
cr AS (SELECT * FROM (VALUES {_values([(n + 1, a, b) for n, (a, b) in enumerate(CONFLICTS)])}) AS c(n, a, b)),
q AS (SELECT 0 AS n, r.scope, r.key, r.conf, r.weight, r.hits, 0 AS fights, 0e0 AS severity, z.active, z.strength FROM r JOIN z{deepest} z ON z.scope = r.scope AND z.key = r.key WHERE r.g = {len(GROUPS)} UNION ALL
  SELECT n, scope, key, CASE WHEN hit THEN round({cut.format('conf - least(0.28, 0.12 + sev * 0.18)')}, 6) ELSE conf END, weight, hits, fights + CASE WHEN hit THEN 1 ELSE 0 END, CASE WHEN hit THEN sev ELSE severity END, active, strength
  FROM (SELECT *, (key = a OR key = b) AND coalesce(both_active = 2 AND sev >= {LEAST_SEVERITY}, false) AS hit FROM (SELECT q.n + 1 AS n, q.scope, q.key, q.conf, q.weight, q.hits, q.fights, q.severity, q.active, q.strength, a, b,
    sum(CASE WHEN q.key IN (a, b) AND q.active THEN 1 ELSE 0 END) OVER (PARTITION BY q.scope) AS both_active, least(1.0, sum(CASE WHEN q.key IN (a, b) THEN q.strength END) OVER (PARTITION BY q.scope) * sum(CASE WHEN q.key IN (a, b) THEN q.conf END) OVER (PARTITION BY q.scope) / 4) AS sev
    FROM q JOIN cr ON cr.n = q.n + 1))),
f AS (SELECT q.scope, q.key AS signal_key, z.signal_id, z.active, z.expired, CASE WHEN q.fights > 0 THEN 'conflicting' WHEN q.hits > 0 THEN 'reinforced' WHEN z.active AND (weak0 OR (z.conf < {WEAK_CONFIDENCE} AND z.key IN (SELECT child FROM dep))) THEN 'weak' ELSE status0 END AS status, q.strength, q.conf AS confidence, q.weight,
  CASE WHEN z.expired THEN 0 ELSE round({cut.format(f"0.35 * {cut.format('coverage')} + 0.25 * least(1, sources / 3e0) + 0.30 * q.conf + 0.10 * (1 - q.severity)")}, 6) END AS stability, q.fights, q.hits FROM q JOIN z{deepest} z ON z.scope = q.scope AND z.key = q.key WHERE q.n = {len(CONFLICTS)})"""


_STATE = " SELECT scope, signal_key, signal_id, status, active, round(strength, 6) AS strength, round(confidence, 6) AS confidence, round(weight, 6) AS weight, round(stability, 6) AS stability FROM f"


def _states(spark: SparkSession, sf_dir: str, layered: bool = False) -> DataFrame:
    return signal_states(run_sql(spark, sf_dir, f"SELECT * FROM {SIGNALS} s"), F.expr(AS_OF + "::timestamp_ntz"), layered)


def _flat(states: DataFrame) -> DataFrame:
    return states.select("scope", "signal_key", *[F.col(f"state.{c}") for c in ("signal_id", "status", "active", "strength", "confidence", "weight", "stability")])


@query("signal_states", _oracle(False) + _STATE)
def q_signal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-193: the state of each signal after dependencies, reinforcement and conflicts."""
    return _flat(_states(spark, sf_dir))


@query("signal_states_layered", _oracle(True) + _STATE)
def q_signal_states_layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-193: the same with confidence passed down the whole graph of dependencies."""
    return _flat(_states(spark, sf_dir, layered=True))


@query("signal_summary", _oracle(False) + """,
o AS (SELECT scope, signal_key, row_number() OVER (PARTITION BY scope ORDER BY confidence * weight DESC, signal_key) AS up, row_number() OVER (PARTITION BY scope ORDER BY confidence * weight, signal_key) AS down FROM f WHERE active)
SELECT scope, coalesce((SELECT string_agg(signal_key, ',' ORDER BY up) FROM o WHERE o.scope = x.scope AND up <= 8), '') AS strongest, coalesce((SELECT string_agg(signal_key, ',' ORDER BY down) FROM o WHERE o.scope = x.scope AND down <= 8), '') AS weakest,
  coalesce(string_agg(signal_key, ',' ORDER BY signal_key) FILTER (WHERE expired), '') AS expired, coalesce(string_agg(signal_key, ',' ORDER BY signal_key) FILTER (WHERE fights > 0), '') AS conflicting, coalesce(string_agg(signal_key, ',' ORDER BY signal_key) FILTER (WHERE hits > 0), '') AS reinforced, round(avg(stability) + 1e-9, 6) AS stability, round(avg(confidence) + 1e-9, 6) AS confidence FROM f x GROUP BY scope""")
def q_signal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-193: strongest, weakest, expired, conflicting and reinforced signals of each scope."""
    s = summary(_states(spark, sf_dir))
    return s.select("scope", *[F.array_join(c, ",").alias(c) for c in ("strongest", "weakest", "expired", "conflicting", "reinforced")], "stability", "confidence")


@query("signal_dependencies", _oracle(False).replace("gm AS", """edges AS (SELECT c.scope, c.key AS child, parent, CASE WHEN p.key IS NULL THEN 'requires' WHEN NOT p.active THEN 'weakens' ELSE 'supports' END AS relation, round(CASE WHEN p.key IS NULL THEN -0.08 WHEN NOT p.active THEN -0.25 ELSE (p.conf - 0.5) * 0.2 END, 6) AS effect FROM z0 c JOIN dep ON child = c.key LEFT JOIN z0 p ON p.scope = c.scope AND p.key = parent),
gm AS""", 1) + " SELECT * FROM edges")
def q_signal_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-193: why the confidence of a signal changed: one row for each signal it depends on."""
    s = _states(spark, sf_dir).select("scope", F.col("signal_key").alias("child"), F.explode("state.edges").alias("e"))
    return s.select("scope", "child", "e.parent", "e.relation", "e.effect")
