"""Joins: as-of, interval and identity joins, existence flags, polymorphic authors, unordered pairs, either-side keys."""

from __future__ import annotations

from tideline.registry import sql_query

sql_query("join_polymorphic_author", "O-43, O-133: two left joins whose ON clause holds the author's kind, coalesced.", """
WITH posts AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'agent' ELSE 'user' END AS author_type, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 120 ELSE o_custkey END AS author_id FROM {orders})
SELECT p.id, p.author_type, coalesce(c.c_name, s.s_name, 'unknown') AS author, left(lower(coalesce(c.c_name, s.s_name, '')), 12) AS handle
FROM posts p LEFT JOIN {customer} c ON p.author_type = 'user' AND c.c_custkey = p.author_id LEFT JOIN {supplier} s ON p.author_type = 'agent' AND s.s_suppkey = p.author_id""")

sql_query("join_preaggregated_counts", "O-44, O-95, O-240: counts are grouped before they are joined to their owner.", """
WITH o AS (SELECT o_custkey, count(*) AS posts, count(DISTINCT o_orderpriority) AS kinds FROM {orders} GROUP BY o_custkey),
l AS (SELECT o_custkey, count(*) AS comments, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS reported FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey)
SELECT c_custkey, c_name, coalesce(posts, 0) AS posts, coalesce(kinds, 0) AS kinds, coalesce(comments, 0) AS comments, CAST(coalesce(reported, 0) AS BIGINT) AS reported
FROM {customer} LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey""")

sql_query("join_scalar_subquery_counts", "O-45, O-93: correlated scalar counts a row.", """
SELECT s_suppkey, (SELECT count(*) FROM {lineitem} WHERE l_suppkey = s_suppkey) AS items, (SELECT count(*) FROM {lineitem} WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') AS returned, (SELECT max(l_shipdate) FROM {lineitem} WHERE l_suppkey = s_suppkey) AS last_ship FROM {supplier}""")

sql_query("join_exists_flags", "O-46, O-238: a semi-join and two existence columns.", """
SELECT c_custkey, EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS boosted, EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS saved
FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)""")

sql_query("join_anti", "O-47, O-129, O-259: rows without a partner, and a plan without what is done.", """
SELECT c_custkey, c_mktsegment FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")

sql_query("join_batch_state", "O-48, O-238: a list of ids with counts and the viewer's flag; unknown ids get zero and false.", """
WITH ids AS (SELECT [[explode(sequence(CAST(0 AS BIGINT), CAST(3000 AS BIGINT), CAST(7 AS BIGINT)))||unnest(range(0, 3001, 7))]] AS id),
likes AS (SELECT o_custkey AS id, count(*) AS n FROM {orders} GROUP BY o_custkey),
mine AS (SELECT DISTINCT o_custkey AS id FROM {orders} WHERE o_orderpriority = '2-HIGH')
SELECT ids.id, coalesce(n, 0) AS likes, mine.id IS NOT NULL AS liked FROM ids LEFT JOIN likes ON likes.id = ids.id LEFT JOIN mine ON mine.id = ids.id""")

sql_query("join_inner_dimension", "O-49, O-241: facts with their dimension and an editorial sort key.", """
SELECT c_custkey, n_name, r_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""")

sql_query("join_latest_match_subquery", "O-51, O-52: latest row of a key no later than an instant, then an equi-join.", """
WITH l AS (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM {orders} WHERE o_orderdate <= TIMESTAMP[[_NTZ||]] '2000-01-01 00:00:00' GROUP BY o_custkey)
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice FROM {orders} o JOIN l ON o.o_orderkey = l.latest""")

sql_query("join_asof_quote", "O-52, O-53: each purchase with the latest view of its user at or before it.", """
WITH u AS (SELECT user_id, ts, event_id, event_type, value, [[last_value(CASE WHEN event_type = 'view' THEN value END) IGNORE NULLS||last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS)]] OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS quote FROM {events})
SELECT event_id, user_id, value, quote FROM u WHERE event_type = 'purchase'""")

sql_query("join_identity_band", "O-54: same competition and sides and kickoff within 90 minutes; the nearest wins.", """
WITH a AS (SELECT event_id, user_id, ts FROM {events} WHERE event_type = 'click'),
b AS (SELECT event_id AS other, user_id, ts AS ots FROM {events} WHERE event_type = 'view'),
j AS (SELECT a.event_id, b.other, row_number() OVER (PARTITION BY a.event_id ORDER BY abs([[unix_micros(CAST(a.ts AS TIMESTAMP)) - unix_micros(CAST(b.ots AS TIMESTAMP))||epoch_us(a.ts) - epoch_us(b.ots)]]), b.other) AS rk FROM a JOIN b ON a.user_id = b.user_id AND b.ots BETWEEN a.ts - INTERVAL '90' MINUTE AND a.ts + INTERVAL '90' MINUTE)
SELECT event_id, other FROM j WHERE rk = 1""")

sql_query("join_identity_precedence", "O-55: stamp, alias, fuzzy, minted: the first that answers.", """
WITH s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN c_custkey * 10 END AS stamp FROM {customer}),
alias AS (SELECT s_suppkey * 3 AS id, s_suppkey AS canonical FROM {supplier}),
fuzzy AS (SELECT n_nationkey * 11 AS id, n_nationkey AS canonical FROM {nation})
SELECT s.id, coalesce(stamp, alias.canonical, fuzzy.canonical, -s.id) AS canonical, CASE WHEN stamp IS NOT NULL THEN 'stamp' WHEN alias.canonical IS NOT NULL THEN 'alias' WHEN fuzzy.canonical IS NOT NULL THEN 'fuzzy' ELSE 'minted' END AS via FROM s LEFT JOIN alias ON alias.id = s.id LEFT JOIN fuzzy ON fuzzy.id = s.id""")

sql_query("join_strictly_prior", "O-56: how many earlier rows of the same competition and regime are within reach; a running window in place of an inequality join.", """
SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderdate RANGE BETWEEN INTERVAL '30' DAY PRECEDING AND INTERVAL '1' DAY PRECEDING) AS BIGINT) AS earlier FROM {orders}""")

sql_query("join_unordered_pair", "O-57: head-to-head key of two sides in any order.", """
SELECT least(home, away) AS a, greatest(home, away) AS b, CAST(count(*) AS BIGINT) AS met, CAST(sum(CASE WHEN home_goals = away_goals THEN 1 ELSE 0 END) AS BIGINT) AS draws FROM {matches} GROUP BY 1, 2""")

sql_query("join_either_side", "O-58: a team on either side, unpivoted before the equi-join.", """
WITH sides AS (SELECT uid, home AS team, 'home' AS role FROM {matches} UNION ALL SELECT uid, away, 'away' FROM {matches})
SELECT n.n_nationkey, n.n_name, role, CAST(count(*) AS BIGINT) AS n FROM {nation} n JOIN sides ON sides.team = n.n_nationkey GROUP BY 1, 2, 3""")

sql_query("join_alias_catalogue", "O-59, O-249: external to canonical with first and last sighting; more than one canonical is a conflict.", """
SELECT concat(p_brand, ':', p_type) AS external, min(p_partkey) AS canonical, count(DISTINCT p_name) > 3 AS conflict, min(p_retailprice) AS first_seen, max(p_retailprice) AS last_seen FROM {part} GROUP BY 1""")

sql_query("join_cross_source_reconcile", "O-60, O-88: sources of one match agree or not; trust from their number.", """
WITH e AS (SELECT user_id, CAST(CAST(ts AS DATE) AS [[STRING||VARCHAR]]) AS day, event_type AS source, CAST(floor(value) AS BIGINT) % 2 AS score FROM {events})
SELECT user_id, day, CAST(count(DISTINCT source) AS BIGINT) AS sources, count(DISTINCT score) = 1 AS agree, round(CASE WHEN count(DISTINCT score) = 1 THEN least(1.0, 0.6 + 0.1 * count(DISTINCT source)) ELSE 0.4 END, 4) + 0e0 AS confidence FROM e GROUP BY user_id, day HAVING count(DISTINCT source) >= 2""")

sql_query("join_search_fan_in", "O-62: six categories searched alike and put together.", """
SELECT 'user' AS category, c_custkey AS id, c_name AS title FROM {customer} WHERE lower(c_name) LIKE '%99%' UNION ALL SELECT 'agent', s_suppkey, s_name FROM {supplier} WHERE lower(s_name) LIKE '%9%'
UNION ALL SELECT 'part', p_partkey, p_name FROM {part} WHERE lower(p_name) LIKE 'small%' UNION ALL SELECT 'nation', CAST(n_nationkey AS BIGINT), n_name FROM {nation} WHERE lower(n_name) LIKE '%a%'
UNION ALL SELECT 'region', CAST(r_regionkey AS BIGINT), r_name FROM {region} UNION ALL SELECT 'page', page_id, url FROM {pages} WHERE url LIKE '%1%'""")

sql_query("join_cross_one_row", "O-50: a query row joined to every row it applies to.", """
WITH q AS (SELECT 'ing' AS needle, 40 AS least)
SELECT item_id, length(text) AS n FROM {benchmark} CROSS JOIN q WHERE contains(text, needle) AND length(text) >= least""")

sql_query("join_interests_route", "O-236, O-237, O-267: each row to every subscriber whose optional sets hold it.", """
WITH subs AS (SELECT * FROM (VALUES (1, 'click', CAST(NULL AS BIGINT)), (2, CAST(NULL AS [[STRING||VARCHAR]]), 3), (3, 'error', 7), (4, CAST(NULL AS [[STRING||VARCHAR]]), CAST(NULL AS BIGINT))) AS s(sub, kind, who))
SELECT sub, event_id FROM {events} JOIN subs ON (kind IS NULL OR kind = event_type) AND (who IS NULL OR who = user_id)""")
