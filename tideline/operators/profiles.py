"""Aggregations: outcome profiles with scope fallback, match and team summaries, conflicts, merges, rates, rollups."""

from __future__ import annotations

from tideline.registry import sql_query

COUNTS = "CAST(count(*) AS BIGINT) AS occurrences, CAST(count(*) FILTER (WHERE outcome = 'confirmed') AS BIGINT) AS confirmed, CAST(count(*) FILTER (WHERE outcome = 'failed') AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE outcome = 'expired') AS BIGINT) AS expired, round(avg(duration_seconds), 6) AS duration, round(avg(confidence), 6) AS confidence, round(avg(strength), 6) AS strength"

sql_query("agg_outcome_scopes", "O-67: conditional counts at all scopes in one pass of grouping sets.", f"""
SELECT trend_type, competition, team, {COUNTS} FROM {{outcomes}} GROUP BY GROUPING SETS ((trend_type), (trend_type, competition), (trend_type, team))""")

sql_query("agg_outcome_fallback", "O-68, O-69: the competition's distribution where its sample is large enough, else the global one.", """
WITH c AS (SELECT trend_type, competition, count(*) AS n, avg(CASE WHEN outcome = 'confirmed' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS rate, avg(duration_seconds) AS duration FROM {outcomes} GROUP BY trend_type, competition),
g AS (SELECT trend_type, count(*) AS n, avg(CASE WHEN outcome = 'confirmed' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS rate, avg(duration_seconds) AS duration FROM {outcomes} GROUP BY trend_type)
SELECT c.trend_type, c.competition, CASE WHEN c.n >= 5 THEN 'competition' ELSE 'global' END AS scope, CAST(CASE WHEN c.n >= 5 THEN c.n ELSE g.n END AS BIGINT) AS sample, round(CASE WHEN c.n >= 5 THEN c.rate ELSE g.rate END, 6) AS continuation, round(CASE WHEN c.n >= 5 THEN c.duration ELSE g.duration END, 6) AS duration FROM c JOIN g ON c.trend_type = g.trend_type""")

sql_query("agg_competition_profile", "O-70, O-73: distinct matches, conditional shares, rates per competition.", """
SELECT competition, CAST(count(*) AS BIGINT) AS trends, CAST(count(DISTINCT match_id) AS BIGINT) AS matches, round(avg(confidence), 6) AS confidence, round(avg(CASE WHEN strength >= 0.6 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS strong_share, round(avg(CASE WHEN trend_type LIKE 'O%' THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS open_share,
  CAST(count(DISTINCT CASE WHEN trend_type IN ('O-1', 'F-1') THEN match_id END) AS BIGINT) AS first_matches, CAST(count(DISTINCT CASE WHEN outcome = 'failed' THEN match_id END) AS BIGINT) AS failed_matches, round(count(*) / CAST(count(DISTINCT match_id) AS DOUBLE), 6) AS per_match FROM {outcomes} GROUP BY competition""")

sql_query("agg_recently_active", "O-71: groups by their newest row.", "SELECT user_id, max(ts) AS last_ts, CAST(count(*) AS BIGINT) AS n FROM {events} GROUP BY user_id ORDER BY last_ts DESC, user_id LIMIT 20")

sql_query("agg_toward_against", "O-72: counts of several keys, then one row a team with both directions.", """
WITH s AS (SELECT home AS team, CASE WHEN home_goals > away_goals THEN 1 ELSE -1 END AS dir FROM {matches} UNION ALL SELECT away, CASE WHEN away_goals > home_goals THEN 1 ELSE -1 END FROM {matches})
SELECT team, CAST(sum(CASE WHEN dir > 0 THEN 1 ELSE 0 END) AS BIGINT) AS toward, CAST(sum(CASE WHEN dir < 0 THEN 1 ELSE 0 END) AS BIGINT) AS against FROM s GROUP BY team""")

sql_query("agg_pattern_memory", "O-74: success rate of a pattern, null without resolved outcomes.", """
SELECT competition, trend_type, CAST(count(*) AS BIGINT) AS seen, round(sum(CASE WHEN outcome = 'confirmed' THEN CAST(1 AS DOUBLE) ELSE 0 END) / nullif(sum(CASE WHEN outcome IN ('confirmed', 'failed') THEN 1 ELSE 0 END), 0), 6) AS success FROM {outcomes} GROUP BY competition, trend_type""")

sql_query("agg_dataset_summary", "O-75, O-76, O-84: label rates, means, population deviation, mean of a sparse map entry, distinct sources.", """
SELECT competition, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN home_goals > away_goals THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS home_rate, round(avg(CASE WHEN home_goals = away_goals THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS draw_rate, round(avg(home_goals + away_goals), 6) AS goals, round(stddev_pop(home_goals + away_goals), 6) AS deviation,
  round(avg(CASE WHEN uid % 3 = 0 THEN CAST(home_goals AS DOUBLE) END), 6) AS sparse, CAST(count(DISTINCT home) AS BIGINT) AS sources FROM {matches} GROUP BY competition""")

sql_query("agg_head_to_head", "O-77: outcomes on the canonical pair, from the lesser side's view.", """
SELECT least(home, away) AS a, greatest(home, away) AS b, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN home_goals = away_goals THEN 1 ELSE 0 END) AS BIGINT) AS draws, CAST(sum(CASE WHEN (home < away AND home_goals > away_goals) OR (home > away AND away_goals > home_goals) THEN 1 ELSE 0 END) AS BIGINT) AS a_wins, round(avg(home_goals + away_goals), 6) AS goals FROM {matches} GROUP BY 1, 2""")

sql_query("agg_team_profile", "O-78: one row a team and role, and volatility of its goals.", """
WITH s AS (SELECT home AS team, 'home' AS role, home_goals AS gf, away_goals AS ga FROM {matches} UNION ALL SELECT away, 'away', away_goals, home_goals FROM {matches})
SELECT team, role, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN gf = ga THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS draw_rate, round(avg(gf), 6) AS goals_for, round(avg(ga), 6) AS goals_against, round(least(1.0, stddev_pop(gf + ga) / 3), 6) AS volatility FROM s GROUP BY team, role""")

sql_query("agg_competition_memory", "O-79: one row a competition and year.", """
SELECT competition, CAST(year(kickoff_at) AS INT) AS season, CAST(count(*) AS BIGINT) AS n, round(avg(home_goals - away_goals), 6) AS home_edge FROM {matches} GROUP BY 1, 2""")

sql_query("agg_behaviour_common", "O-80: patterns in at least 40 percent of a match's hits.", """
WITH n AS (SELECT user_id, count(*) AS n FROM {events} GROUP BY user_id), c AS (SELECT user_id, event_type, count(*) AS c FROM {events} GROUP BY user_id, event_type)
SELECT c.user_id, event_type, CAST(c AS BIGINT) AS hits FROM c JOIN n ON c.user_id = n.user_id WHERE c >= 0.4 * n""")

sql_query("agg_memory_confidence", "O-81, O-263: capped coverage parts under fixed weights.", """
WITH t AS (SELECT home AS team, count(*) AS n, count(DISTINCT away) AS rivals, count(DISTINCT competition) AS comps, [[datediff(max(kickoff_at), min(kickoff_at))||date_diff('day', CAST(min(kickoff_at) AS DATE), CAST(max(kickoff_at) AS DATE))]] AS days FROM {matches} GROUP BY home)
SELECT team, round(0.35 * least(1.0, n / 400e0) + 0.20 * least(1.0, rivals / 40e0) + 0.20 * least(1.0, comps / 5e0) + 0.15 * least(1.0, days / 1825e0) + 0.10 * least(1.0, log10(n) / 3e0), 6) AS confidence FROM t""")

sql_query("agg_weighted_confidence", "O-82: weighted mean of confidences, clamped.", """
SELECT l_orderkey, round(greatest(0.0, least(1.0, sum(l_quantity * l_discount * 10) / sum(l_quantity))), 6) AS confidence FROM {lineitem} GROUP BY l_orderkey""")

sql_query("agg_conflicts", "O-86: keys that two authoritative sources value differently.", """
SELECT l_partkey, l_linenumber, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS sources, CAST(count(DISTINCT l_tax) AS BIGINT) AS vals FROM {lineitem} WHERE l_linestatus = 'O' GROUP BY l_partkey, l_linenumber HAVING count(DISTINCT l_suppkey) >= 2 AND count(DISTINCT l_tax) > 1""")

sql_query("agg_payload_merge", "O-87: latest authoritative value of each key; candidates only fill gaps, the first of them wins.", """
WITH kv AS (SELECT user_id, concat('k', CAST(event_id % 7 AS [[STRING||VARCHAR]])) AS k, value, ts, event_id, event_type IN ('click', 'view') AS auth FROM {events})
SELECT user_id, k, round(coalesce(max_by(CASE WHEN auth THEN value END, CASE WHEN auth THEN (ts, event_id) END), min_by(CASE WHEN NOT auth THEN value END, CASE WHEN NOT auth THEN (ts, event_id) END)), 6) AS value FROM kv GROUP BY user_id, k""")

sql_query("agg_dataset_quality", "O-89: five weighted ratios of a source's records and a grade from A to D; agreement is 0.7 where nothing was labelled.", """
WITH q AS (SELECT source, count(*) AS collected, sum(CASE WHEN n_chars >= 200 THEN 1 ELSE 0 END) AS validated, sum(CASE WHEN n_chars < 50 THEN 1 ELSE 0 END) AS rejected, count(*) - count(DISTINCT text) AS dups, count(*) FILTER (WHERE n_chars IS NOT NULL) AS considered, avg(CASE WHEN lang = 'en' THEN 1e0 WHEN lang IS NOT NULL THEN 0e0 END) AS agreement FROM {documents} GROUP BY source),
d AS (SELECT source, validated / CAST(collected AS DOUBLE) AS completeness, coalesce(validated / CAST(nullif(considered, 0) AS DOUBLE), 0) AS success, coalesce(1 - rejected / CAST(nullif(considered, 0) AS DOUBLE), 1) AS consistency, 1 - dups / CAST(collected AS DOUBLE) AS clean, coalesce(agreement, 0.7e0) AS agreement FROM q),
s AS (SELECT *, round(0.25e0 * completeness + 0.30e0 * success + 0.20e0 * consistency + 0.15e0 * clean + 0.10e0 * agreement, 4) AS score FROM d)
SELECT source, score, CASE WHEN score >= 0.85 THEN 'A' WHEN score >= 0.7 THEN 'B' WHEN score >= 0.5 THEN 'C' ELSE 'D' END AS grade FROM s""")

sql_query("agg_count_matrix", "O-91: counts by two keys, pivoted.", """
SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS f, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS o, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS p, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY o_orderpriority""")
sql_query("agg_top_targets", "O-91: the most frequent targets.", "SELECT l_partkey, CAST(count(*) AS BIGINT) AS n FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 25")
sql_query("agg_filtered_counts", "O-92: counts under a filter clause.", "SELECT event_type, CAST(count(*) FILTER (WHERE value >= 50) AS BIGINT) AS active, CAST(count(*) FILTER (WHERE value < 50) AS BIGINT) AS revoked FROM {events} GROUP BY event_type")

sql_query("agg_overview", "O-93: seventeen counts in one row, one pass a table; the window is the last 30 days of the table.", """
WITH p AS (SELECT count(*) AS posts, count(*) FILTER (WHERE o_custkey % 3 = 0) AS posts_user, count(*) FILTER (WHERE o_custkey % 3 = 1) AS posts_agent, count(*) FILTER (WHERE o_custkey % 3 = 2) AS posts_admin, count(*) FILTER (WHERE o_orderdate >= since) AS recent_posts, count(DISTINCT CASE WHEN o_custkey % 3 = 0 AND o_orderdate >= since THEN o_custkey END) AS recent_authors FROM {orders} CROSS JOIN (SELECT max(o_orderdate) - INTERVAL '30' DAY AS since FROM {orders}) WHERE o_orderstatus <> 'P'),
c AS (SELECT count(*) AS comments, count(*) FILTER (WHERE l_linenumber % 2 = 0) AS comments_user, count(*) FILTER (WHERE l_linenumber % 2 = 1) AS comments_agent, count(*) FILTER (WHERE l_shipdate >= since) AS recent_comments FROM {lineitem} CROSS JOIN (SELECT max(l_shipdate) - INTERVAL '30' DAY AS since FROM {lineitem})),
e AS (SELECT count(*) FILTER (WHERE event_type = 'signup') AS follows, count(*) FILTER (WHERE event_type = 'purchase' AND value >= 50) AS active_boosts, count(*) FILTER (WHERE event_type = 'click') AS saves FROM {events}),
a AS (SELECT count(*) AS agents, count(*) FILTER (WHERE s_acctbal > 0) AS active_agents FROM {supplier}), u AS (SELECT count(*) AS users FROM {customer}), n AS (SELECT count(*) AS communities FROM {nation})
SELECT * FROM u CROSS JOIN a CROSS JOIN p CROSS JOIN c CROSS JOIN e CROSS JOIN n""", """
SELECT (SELECT count(*) FROM {customer}) AS users, (SELECT count(*) FROM {supplier}) AS agents, (SELECT count(*) FROM {supplier} WHERE s_acctbal > 0) AS active_agents,
 (SELECT count(*) FROM {orders} WHERE o_orderstatus <> 'P') AS posts, (SELECT count(*) FROM {orders} WHERE o_orderstatus <> 'P' AND o_custkey % 3 = 0) AS posts_user, (SELECT count(*) FROM {orders} WHERE o_orderstatus <> 'P' AND o_custkey % 3 = 1) AS posts_agent, (SELECT count(*) FROM {orders} WHERE o_orderstatus <> 'P' AND o_custkey % 3 = 2) AS posts_admin,
 (SELECT count(*) FROM {lineitem}) AS comments, (SELECT count(*) FROM {lineitem} WHERE l_linenumber IN (2, 4, 6)) AS comments_user, (SELECT count(*) FROM {lineitem} WHERE l_linenumber IN (1, 3, 5, 7)) AS comments_agent,
 (SELECT count(*) FROM {orders} WHERE o_orderstatus <> 'P' AND o_orderdate >= (SELECT max(o_orderdate) FROM {orders}) - INTERVAL '30' DAY) AS recent_posts, (SELECT count(*) FROM {lineitem} WHERE l_shipdate >= (SELECT max(l_shipdate) FROM {lineitem}) - INTERVAL '30' DAY) AS recent_comments,
 (SELECT count(DISTINCT o_custkey) FROM {orders} WHERE o_orderstatus <> 'P' AND o_custkey % 3 = 0 AND o_orderdate >= (SELECT max(o_orderdate) FROM {orders}) - INTERVAL '30' DAY) AS recent_authors,
 (SELECT count(*) FROM {events} WHERE event_type = 'signup') AS follows, (SELECT count(*) FROM {events} WHERE event_type = 'purchase' AND value >= 50) AS active_boosts, (SELECT count(*) FROM {events} WHERE event_type = 'click') AS saves, (SELECT count(*) FROM {nation}) AS communities""")

sql_query("agg_type_set_matches", "O-73: matches with at least one trend of each of three type sets in the last 90 days, and their shares; one row a match before the counts.", """
WITH m AS (SELECT competition, match_id, max(CASE WHEN trend_type IN ('O-1', 'F-1', 'O-2') THEN 1 ELSE 0 END) AS shift, max(CASE WHEN trend_type IN ('F-2', 'O-2', 'F-1') THEN 1 ELSE 0 END) AS volatile, max(CASE WHEN trend_type IN ('O-3', 'F-3', 'O-4') THEN 1 ELSE 0 END) AS unsure FROM {outcomes} CROSS JOIN (SELECT max(l_shipdate) - INTERVAL '90' DAY AS since FROM {lineitem}) WHERE closed_at >= since GROUP BY competition, match_id)
SELECT competition, CAST(count(*) AS BIGINT) AS matches, CAST(sum(shift) AS BIGINT) AS shift_matches, CAST(sum(volatile) AS BIGINT) AS volatile_matches, CAST(sum(unsure) AS BIGINT) AS unsure_matches, round(avg(CAST(shift AS DOUBLE)), 6) AS shift_rate, round(avg(CAST(volatile AS DOUBLE)), 6) AS volatile_rate, round(avg(CAST(unsure AS DOUBLE)), 6) AS unsure_rate FROM m GROUP BY competition""", """
WITH t AS (SELECT * FROM {outcomes} WHERE closed_at >= (SELECT max(l_shipdate) FROM {lineitem}) - INTERVAL '90' DAY),
c AS (SELECT competition, count(DISTINCT match_id) AS matches, count(DISTINCT match_id) FILTER (WHERE trend_type IN ('O-1', 'F-1', 'O-2')) AS a, count(DISTINCT match_id) FILTER (WHERE trend_type IN ('F-2', 'O-2', 'F-1')) AS b, count(DISTINCT match_id) FILTER (WHERE trend_type IN ('O-3', 'F-3', 'O-4')) AS c FROM t GROUP BY competition)
SELECT competition, matches, a AS shift_matches, b AS volatile_matches, c AS unsure_matches, round(a / matches, 6) AS shift_rate, round(b / matches, 6) AS volatile_rate, round(c / matches, 6) AS unsure_rate FROM c""")

sql_query("agg_reputation", "O-94: sum of a ledger, clamped to 0..100, and its tier.", """
WITH s AS (SELECT o_custkey, greatest(CAST(0 AS BIGINT), least(CAST(100 AS BIGINT), CAST(50 + sum(CASE o_orderstatus WHEN 'F' THEN 6 WHEN 'O' THEN 1 ELSE -4 END) AS BIGINT))) AS reputation FROM {orders} GROUP BY o_custkey)
SELECT o_custkey, reputation, CASE WHEN reputation >= 85 THEN 'elite' WHEN reputation >= 60 THEN 'trusted' WHEN reputation >= 40 THEN 'member' ELSE 'new' END AS tier FROM s""")

sql_query("agg_detector_evaluation", "O-96: count, mean and coverage of steps per detector.", """
WITH s AS (SELECT count(DISTINCT CAST(ts AS DATE)) AS steps FROM {events})
SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(count(DISTINCT CAST(ts AS DATE)) / CAST(max(steps) AS DOUBLE), 6) AS coverage FROM {events} CROSS JOIN s GROUP BY event_type""")

sql_query("agg_fingerprint", "O-97, O-200: hash of a group's sorted lines, whatever their order.", """
SELECT user_id, [[sha2(array_join(array_sort(collect_list(concat(event_type, ':', CAST(event_id AS STRING)))), ','), 256)||sha256(string_agg(concat(event_type, ':', CAST(event_id AS VARCHAR)), ',' ORDER BY concat(event_type, ':', CAST(event_id AS VARCHAR))))]] AS fingerprint FROM {events} GROUP BY user_id""")

sql_query("agg_neighbour_outcomes", "O-99: outcome counts and distance spread of each label's vectors.", """
SELECT label, CAST(count(*) AS BIGINT) AS n, round(min(CAST([[element_at(embedding, 1)||list_extract(embedding, 1)]] AS DOUBLE)), 6) AS low, round(avg(CAST([[element_at(embedding, 1)||list_extract(embedding, 1)]] AS DOUBLE)), 6) AS mean, round(max(CAST([[element_at(embedding, 1)||list_extract(embedding, 1)]] AS DOUBLE)), 6) AS high FROM {embeddings} GROUP BY label""")

sql_query("agg_duplicate_rates", "O-256: duplicate rate per type and overall by rollup.", """
SELECT coalesce(lang, 'all') AS lang, CAST(count(*) AS BIGINT) AS n, round(1 - count(DISTINCT text) / CAST(count(*) AS DOUBLE), 6) AS duplicate_rate FROM {documents} GROUP BY ROLLUP (lang)""")
sql_query("agg_quality_grains", "O-257, O-258: one pass over three grains.", """
SELECT lang, source, CAST(count(*) AS BIGINT) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(quality), 6) AS quality FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))""")
sql_query("agg_rates_null_denominator", "O-254, O-255, O-248: success, failure and latency; null where nothing was tried.", """
SELECT s_suppkey, CAST(count(l_orderkey) AS BIGINT) AS tried, round(sum(CASE WHEN l_returnflag = 'A' THEN CAST(1 AS DOUBLE) ELSE 0 END) / nullif(sum(CASE WHEN l_returnflag IN ('A', 'R') THEN 1 ELSE 0 END), 0), 6) AS success, round(avg(l_quantity), 6) AS latency FROM {supplier} LEFT JOIN {lineitem} ON l_suppkey = s_suppkey AND l_linenumber = 7 GROUP BY s_suppkey""")
sql_query("agg_inventory", "O-253: counts of a registry left-joined with sums, and totals by rollup.", """
SELECT n_name, c_mktsegment, CAST(count(DISTINCT c_custkey) AS BIGINT) AS customers, CAST(count(o_orderkey) AS BIGINT) AS orders FROM {nation} LEFT JOIN {customer} ON c_nationkey = n_nationkey LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY ROLLUP (n_name, c_mktsegment)""")
sql_query("agg_community_roles", "O-207: distribution of roles per community.", """
SELECT n_nationkey, CASE WHEN c_acctbal > 7000 THEN 'owner' WHEN c_acctbal > 3000 THEN 'moderator' ELSE 'member' END AS role, CAST(count(*) AS BIGINT) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY 1, 2""")
sql_query("agg_tickets", "O-251, O-252: latest snapshot of a ticket, then the filter; occurrences by composite key.", """
SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS occurrences, max(ts) AS last_seen, max_by(event_id, (ts, event_id)) AS latest FROM {events} GROUP BY user_id, event_type HAVING max_by(value, (ts, event_id)) >= 50""")
sql_query("agg_budget_tiers", "O-218, O-245, O-246: tumbling budgets by hour, day and month; the greatest ratio is the pressure, its band the tier.", """
WITH h AS (SELECT event_type, [[date_trunc('HOUR', ts)||date_trunc('hour', ts)]] AS hour, count(*) AS nh FROM {events} GROUP BY 1, 2),
d AS (SELECT event_type, hour, nh, sum(nh) OVER (PARTITION BY event_type, [[date_trunc('DAY', hour)||date_trunc('day', hour)]]) AS nd, sum(nh) OVER (PARTITION BY event_type, [[date_trunc('MONTH', hour)||date_trunc('month', hour)]]) AS nm FROM h),
p AS (SELECT event_type, nh, greatest(nh / 10e0, nd / 120e0, nm / 2500e0) AS pressure FROM d)
SELECT event_type, CASE WHEN pressure >= 0.9 THEN 'critical' WHEN pressure >= 0.7 THEN 'high' ELSE 'normal' END AS tier, CAST(count(*) AS BIGINT) AS hours, round(max(pressure), 6) AS peak FROM p GROUP BY 1, 2""")
sql_query("agg_workspace_statistics", "O-261, O-262: selection by kind, first half against second half by row position, last five.", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY home ORDER BY kickoff_at, uid) AS i, count(*) OVER (PARTITION BY home) AS n FROM {matches} WHERE contains(competition, 'H'))
SELECT home, CAST(max(n) AS BIGINT) AS n, round(avg(CASE WHEN i <= floor(n / 2e0) THEN home_goals END), 6) AS first_half, round(avg(CASE WHEN i > floor(n / 2e0) THEN home_goals END), 6) AS second_half, CAST(sum(CASE WHEN i > n - 5 THEN CASE WHEN home_goals > away_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS last_five FROM r GROUP BY home""")
