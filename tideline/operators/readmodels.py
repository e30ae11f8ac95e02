"""Read models: search, feeds, timelines, paging, moderation, notifications, schedules, drafts."""

from __future__ import annotations

from tideline.registry import sql_query

POSTS = "posts AS (SELECT o_orderkey AS id, o_custkey AS author_id, o_orderdate AS created_at, o_totalprice AS score, o_orderpriority AS kind, o_orderstatus AS status FROM {orders})"

sql_query("read_like_search", "O-38: exact, prefix and contained matches, ranked, with an escaped wildcard.", """
SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'red ring' THEN 0 WHEN lower(p_name) LIKE 'red%' THEN 1 ELSE 2 END AS rank FROM {part} WHERE lower(p_name) LIKE '%re%' AND NOT lower(p_name) LIKE '%!_%' ESCAPE '!'""")
sql_query("read_keyset_page", "O-39, O-116: a page after a cursor in mixed directions, with one row over to tell whether there is more.", f"""
WITH {POSTS}
SELECT id, created_at, score FROM posts WHERE created_at < TIMESTAMP[[_NTZ||]] '2000-06-01 00:00:00' OR (created_at = TIMESTAMP[[_NTZ||]] '2000-06-01 00:00:00' AND id > 500) ORDER BY created_at DESC, id ASC LIMIT 51""")
sql_query("read_visible", "O-40: soft deletes and visibility.", f"WITH {POSTS} SELECT id, author_id FROM posts WHERE status <> 'P' AND kind IN ('1-URGENT', '2-HIGH')")
sql_query("read_activity_union", "O-124: four activity sources in one order.", """
SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS happened FROM {orders} UNION ALL SELECT 'shipment', l_orderkey * 10 + l_linenumber, l_shipdate FROM {lineitem} UNION ALL SELECT 'event', event_id, ts FROM {events} UNION ALL SELECT 'page', page_id, TIMESTAMP[[_NTZ||]] '2024-01-15 00:00:00' FROM {pages}) ORDER BY happened DESC, kind, id LIMIT 100""")
sql_query("read_entity_timeline", "O-125: branches of a timeline, each filtered for its entity.", """
SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS at FROM {orders} WHERE o_custkey = 42 UNION ALL SELECT 'shipment', l_orderkey, l_shipdate FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE o_custkey = 42 UNION ALL SELECT event_type, event_id, ts FROM {events} WHERE user_id = 42""")
sql_query("read_feed_sections", "O-130: followed agents, followed users, then public rows not seen and not muted.", f"""
WITH {POSTS},
follows AS (SELECT DISTINCT l_partkey % 1500 AS target FROM {{lineitem}} WHERE l_suppkey = 7),
muted AS (SELECT DISTINCT l_partkey % 1500 AS target FROM {{lineitem}} WHERE l_suppkey = 9),
a AS (SELECT 0 AS section, id, created_at FROM posts WHERE author_id % 4 = 0 AND author_id IN (SELECT target FROM follows) AND NOT EXISTS (SELECT 1 FROM muted WHERE muted.target = author_id)),
u AS (SELECT 1 AS section, id, created_at FROM posts WHERE author_id % 4 <> 0 AND author_id IN (SELECT target FROM follows) AND NOT EXISTS (SELECT 1 FROM muted WHERE muted.target = author_id)),
pub AS (SELECT 2 AS section, id, created_at FROM posts WHERE kind = '1-URGENT' AND NOT EXISTS (SELECT 1 FROM a WHERE a.id = posts.id) AND NOT EXISTS (SELECT 1 FROM u WHERE u.id = posts.id) AND NOT EXISTS (SELECT 1 FROM muted WHERE muted.target = author_id))
SELECT section, id FROM (SELECT *, row_number() OVER (ORDER BY section, created_at DESC, id) AS rk FROM (SELECT * FROM a UNION ALL SELECT * FROM u UNION ALL SELECT * FROM pub)) WHERE rk <= 500""")
#: Categories by priority: name, table, id, measure.
CATEGORIES = (
    ("user", "customer", "c_custkey", "c_acctbal"),
    ("agent", "supplier", "s_suppkey", "s_acctbal"),
    ("part", "part", "p_partkey", "p_retailprice"),
    ("post", "orders", "o_orderkey", "o_totalprice"),
    ("community", "nation", "n_nationkey", "n_regionkey"),
    ("event", "events", "event_id", "value"),
)
_TOPS = ", ".join(f"{c} AS (SELECT {i} AS id, {v} AS v FROM {{{t}}} ORDER BY {v} DESC, {i} LIMIT 60)" for c, t, i, v in CATEGORIES)
_RANKED = " UNION ALL ".join(f"SELECT {n} AS pri, '{c}' AS category, id, row_number() OVER (ORDER BY v DESC, id) AS pos FROM {c}" for n, (c, *_) in enumerate(CATEGORIES))
_ALL = " UNION ALL ".join(f"SELECT {n} AS pri, '{c}' AS category, {i} AS id, row_number() OVER (ORDER BY {v} DESC, {i}) AS pos FROM {{{t}}}" for n, (c, t, i, v) in enumerate(CATEGORIES))
sql_query("read_reciprocal_rank", "O-131: six rankings merged by reciprocal rank, category order and id. Only rows that can be among the merged 60 are ranked, so no task sorts a whole category.",
    f"WITH {_TOPS}, r AS ({_RANKED}) SELECT category, id, round(1 / (1e0 + pos), 9) AS score FROM r ORDER BY 1 / (1e0 + pos) DESC, pri, id LIMIT 60",
    f"SELECT category, id, round(1 / (1e0 + pos), 9) AS score FROM ({_ALL}) ORDER BY pos, pri, id LIMIT 60")
sql_query("read_topk_both_ends", "O-119: the eight strongest and weakest of each group.", """
WITH r AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS top, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS low FROM {events})
SELECT event_type, event_id, value, CASE WHEN top <= 8 THEN 'strong' ELSE 'weak' END AS side FROM r WHERE top <= 8 OR low <= 8""")
sql_query("read_role_priority", "O-120: rows by the priority of their role.", """
SELECT n_nationkey, c_custkey, CASE WHEN c_acctbal > 7000 THEN 0 WHEN c_acctbal > 3000 THEN 1 ELSE 2 END AS role, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal > 7000 THEN 0 WHEN c_acctbal > 3000 THEN 1 ELSE 2 END, c_name, c_custkey) AS place FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""")
sql_query("read_offset_page", "O-121, O-243, O-250: a page by offset with the total.", "SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM {orders}) AS total FROM {orders} ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
sql_query("read_prune_recent", "O-122, O-47: only the newest ten rows of each user stay.", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM {events}) WHERE rk <= 10")
sql_query("read_time_bucket_order", "O-123: buckets of ten minutes, agents before users in a bucket, then newest first.", """
SELECT event_id, row_number() OVER (PARTITION BY [[date_trunc('DAY', ts)||date_trunc('day', ts)]] ORDER BY floor([[unix_micros(CAST(ts AS TIMESTAMP))||epoch_us(ts)]] / 600000000e0) DESC, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, ts DESC, event_id) AS place FROM {events}""")
sql_query("read_regression_diff", "O-126: new, lost and changed rows of two runs.", """
WITH base AS (SELECT event_id, value FROM {events} WHERE event_id % 10 <> 3), cand AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN value + 1 ELSE value END AS value FROM {events} WHERE event_id % 10 <> 4)
SELECT 'new' AS change, event_id FROM cand WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.event_id = cand.event_id) UNION ALL SELECT 'lost', event_id FROM base WHERE NOT EXISTS (SELECT 1 FROM cand WHERE cand.event_id = base.event_id) UNION ALL SELECT 'changed', base.event_id FROM base JOIN cand ON base.event_id = cand.event_id WHERE abs(base.value - cand.value) > 0.000001""")
sql_query("read_precision_recall", "O-127, O-201: precision, recall and F1 of detections by a full outer join.", """
WITH t AS (SELECT event_id, event_type FROM {events} WHERE value >= 60), d AS (SELECT event_id, event_type FROM {events} WHERE value >= 55 AND event_id % 9 <> 0),
j AS (SELECT coalesce(t.event_type, d.event_type) AS kind, sum(CASE WHEN t.event_id IS NOT NULL AND d.event_id IS NOT NULL THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN t.event_id IS NULL THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN d.event_id IS NULL THEN 1 ELSE 0 END) AS fn FROM t FULL OUTER JOIN d ON t.event_id = d.event_id GROUP BY 1)
SELECT kind, round(tp / CAST(tp + fp AS DOUBLE), 6) AS prec, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1 FROM j""")
sql_query("read_label_intersections", "O-128, O-139: shared and joint labels of two users, sorted.", """
WITH s AS (SELECT user_id, [[array_sort(collect_set(event_type))||list_sort(list(DISTINCT event_type))]] AS labels FROM {events} WHERE CAST(ts AS DATE) < DATE '2024-01-04' GROUP BY user_id)
SELECT a.user_id AS a, b.user_id AS b, [[array_join(array_sort(array_intersect(a.labels, b.labels)), ',')||array_to_string(list_sort(list_intersect(a.labels, b.labels)), ',')]] AS shared FROM s a JOIN s b ON b.user_id = a.user_id + 1""")
sql_query("read_muted_follows", "O-129: all follows but the unmuted.", "SELECT DISTINCT l_suppkey, l_partkey FROM {lineitem} WHERE l_returnflag = 'R' EXCEPT SELECT l_suppkey, l_partkey FROM {lineitem} WHERE l_returnflag = 'A'")
sql_query("read_moderation_lens", "O-234, O-235: rows of hidden, banned or suspended authors go; a suspension holds until it ends.", """
WITH hidden AS (SELECT c_custkey AS id FROM {customer} WHERE c_acctbal < 0 UNION SELECT s_suppkey FROM {supplier} WHERE s_acctbal < 0 UNION SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P' AND o_totalprice > 495000)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND (o_orderdate IS NULL OR o_orderdate > TIMESTAMP[[_NTZ||]] '2001-01-01 00:00:00') THEN 'suspended' WHEN o_orderstatus = 'F' THEN 'banned' ELSE 'ok' END AS state FROM {orders} WHERE NOT EXISTS (SELECT 1 FROM hidden WHERE hidden.id = o_custkey)""")
sql_query("read_saved_posts", "O-239: saved rows newest first.", "SELECT o_orderkey, o_orderdate FROM {orders} JOIN {customer} ON o_custkey = c_custkey AND c_acctbal >= 0 WHERE c_mktsegment = 'MACHINERY' ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
sql_query("read_competition_highlights", "O-241: the first hundred by a four-key editorial order.", "SELECT p_partkey, p_brand, p_type, p_size FROM {part} WHERE p_size >= 45 ORDER BY p_size DESC, p_brand, p_type, p_partkey LIMIT 100")
sql_query("read_lineage", "O-242: raws of a canonical row in order.", "SELECT o_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate, l_linenumber, l_suppkey, l_partkey) AS place FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'")
sql_query("read_due_lanes", "O-244, O-245: enabled competitions by adapters and policies, those due by their interval band.", """
WITH lanes AS (SELECT n_nationkey, s_suppkey, CASE WHEN (n_nationkey + s_suppkey) % 90 < 15 THEN 30 WHEN (n_nationkey + s_suppkey) % 90 < 45 THEN 300 ELSE 3600 END AS every, (n_nationkey * 37 + s_suppkey * 11) % 4000 AS since FROM {nation} CROSS JOIN (SELECT s_suppkey FROM {supplier} WHERE s_suppkey % 10 = 0) x WHERE n_regionkey <> 2)
SELECT n_nationkey, s_suppkey, every FROM lanes WHERE since >= every""")
sql_query("read_failure_classes", "O-247: failure kind from its text, whether to retry and after how long.", """
WITH f AS (SELECT event_id, concat(event_type, CASE event_id % 4 WHEN 0 THEN ' timeout after 5s' WHEN 1 THEN ' HTTP 429 too many' WHEN 2 THEN ' invalid json' ELSE ' refused' END) AS reason, CAST(event_id % 7 AS INT) AS attempt FROM {events} WHERE event_type = 'error')
SELECT event_id, CASE WHEN contains(reason, 'timeout') THEN 'timeout' WHEN contains(reason, '429') THEN 'rate_limit' WHEN contains(reason, 'invalid') THEN 'permanent' ELSE 'network' END AS kind, NOT contains(reason, 'invalid') AND attempt < 5 AS retry, CASE WHEN attempt = 0 THEN 1 WHEN attempt = 1 THEN 3 WHEN attempt = 2 THEN 10 WHEN attempt = 3 THEN 30 ELSE 120 END AS delay FROM f""")
sql_query("read_memory_windows", "O-266: newest rows by two keys.", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rk FROM {events}) WHERE rk <= 3")
sql_query("read_notifications", "O-268, O-20: insert-once feed with unread counts.", """
WITH n AS (SELECT user_id, event_type, min(event_id) AS id, max(CASE WHEN event_id % 3 = 0 THEN ts END) AS read_at FROM {events} GROUP BY user_id, event_type)
SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE read_at IS NULL OR id % 2 = 0) AS BIGINT) AS unread, max(id) AS newest FROM n GROUP BY user_id""")
sql_query("read_audit", "O-269: audit rows with their operator under optional predicates.", "SELECT e.event_id, e.event_type, coalesce(c.c_name, 'system') AS operator FROM {events} e LEFT JOIN {customer} c ON c.c_custkey = e.user_id AND c.c_acctbal >= 0 WHERE e.event_type IN ('error', 'purchase') AND e.ts >= TIMESTAMP[[_NTZ||]] '2024-01-20 00:00:00'")
sql_query("read_relationships", "O-208: in and out edges with typed targets.", "SELECT 'out' AS dir, l_suppkey AS node, 'part' AS kind, l_partkey AS other FROM {lineitem} WHERE l_suppkey = 3 UNION ALL SELECT 'in', l_suppkey, 'order', l_orderkey FROM {lineitem} WHERE l_suppkey = 3")
sql_query("read_engagement", "O-206: engagement counts of each post.", "SELECT o_orderkey, CAST(count(l_orderkey) AS BIGINT) AS likes, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS boosts, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS saves FROM {orders} LEFT JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_orderkey")
sql_query("read_draft_validation", "A cascade of draft rules by length and words; O-265 in full is publish_draft_verdicts.", """
WITH t AS (SELECT conv_id, turn, text, length(text) AS n, length(text) - length(replace(text, ' ', '')) + 1 AS words FROM {conversations})
SELECT conv_id, turn, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN n < 40 THEN 'too_short' WHEN n > 1500 THEN 'too_long' WHEN words < 8 THEN 'few_words' WHEN upper(text) = text THEN 'caps' WHEN contains(lower(text), 'http') THEN 'forbidden' WHEN count(*) OVER (PARTITION BY lower(text)) > 1 THEN 'duplicate' ELSE 'ok' END AS verdict FROM t""")
sql_query("read_publication_cascade", "Labels of stories by thresholds over counts; O-203 to O-205 are publish_decisions and publish_story_health.", """
WITH s AS (SELECT user_id, count(*) AS n, avg(value) AS mean, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors, max(ts) AS last_ts FROM {events} GROUP BY user_id)
SELECT user_id, CASE WHEN n < 50 THEN 'thin' WHEN errors / CAST(n AS DOUBLE) > 0.25 THEN 'noisy' WHEN mean < 45 THEN 'weak' ELSE 'publish' END AS decision, round(least(1.0, n / 90e0) * 0.5 + least(1.0, mean / 60) * 0.3 + (1 - errors / CAST(n AS DOUBLE)) * 0.2, 6) AS health, CASE WHEN errors >= 20 THEN 'resting' WHEN mean >= 55 THEN 'active' ELSE 'watching' END AS state FROM s""")
sql_query("read_fulltext", "Two fixed words by substring counts, with a headline; queries of any text (O-134) are in search_fulltext.", """
WITH d AS (SELECT doc_id, lower(text) AS t FROM {documents} WHERE lang = 'en'),
h AS (SELECT doc_id, t, (length(t) - length(replace(t, 'with', ''))) / 4e0 + (length(t) - length(replace(t, 'from', ''))) / 4e0 AS tf FROM d WHERE contains(t, 'with') AND contains(t, 'from'))
SELECT doc_id, round(tf / (1 + length(t)), 9) AS rank, substring(t, greatest(1, [[instr(t, 'with')||instr(t, 'with')]] - 10), 30) AS headline FROM h""")
