"""Projection, filter, sort, join, aggregation, window and set queries, in SQL that Catalyst plans."""

from weftline.plans.registry import sql
from weftline.plans.views import EDGES, HISTORY, PAIRS, REVIEWS, SEARCH, SESSIONS, SNAPSHOTS, TELEMETRY

# projection, filter, predicate, limit
sql("p1_ratio_column", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity AS unit_price FROM lineitem WHERE l_quantity > 0")
sql("p2_filters_null_safe", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_nationkey IN (1, 2, 3, 5, 8) AND (c_mktsegment NOT IN ('BUILDING', 'MACHINERY') OR c_mktsegment IS NULL)")
sql("p3_contains_any_case", "SELECT doc_id, source FROM documents WHERE LOWER(text) LIKE '%license%' OR LOWER(source) LIKE '%src1%'")
sql("p4_predicate_tree", "SELECT event_id, event_type, user_id FROM events WHERE (event_type = 'error' AND value >= 10) OR (event_type = 'purchase' AND (value < 5 OR user_id = 0))")
sql("p5_columns_across_join", "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = c_nationkey GROUP BY o_orderkey, c_custkey")
sql("p6_date_part_as_range", "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'")
sql("p7_json_containment", "SELECT event_id, user_id FROM events WHERE get_json_object(props, '$.k') = '69'", "SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '69'")
sql(
    "p8_guard_filters",
    f"""WITH {EDGES}, degree AS (SELECT src, COUNT(*) AS n FROM edges GROUP BY src),
candidates AS (SELECT s1.s_suppkey AS host, s2.s_suppkey AS dest FROM supplier s1 JOIN supplier s2 ON s1.s_nationkey = s2.s_nationkey)
SELECT c.host, c.dest, CASE WHEN c.host = c.dest THEN 'self_link' WHEN e.src IS NOT NULL THEN 'existing_link' WHEN COALESCE(d.n, 0) >= 45 THEN 'out_link_cap' ELSE 'pass' END AS reason
FROM candidates c LEFT JOIN edges e ON e.src = c.host AND e.dst = c.dest LEFT JOIN degree d ON d.src = c.host""",
)
sql("p9_language_filter", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'und')")
sql("p10_time_window", "WITH anchor AS (SELECT MAX(CAST(ts AS DATE)) AS day FROM events) SELECT event_id FROM events, anchor WHERE CAST(ts AS DATE) > anchor.day - INTERVAL '7' DAY")
sql("p11_host_scan_limit", "SELECT doc_id, n_chars FROM documents WHERE n_chars <= 2000")
sql("p12_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
sql("p13_distinct", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
sql("p14_case_labels", "SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'low' END AS tier FROM orders")
sql("p15_country_exclusion", "SELECT n_nationkey, n_name FROM nation WHERE UPPER(TRIM(n_name)) NOT IN ('CHINA', 'RUSSIA', 'CN', 'RU', 'CHN', 'RUS')")
sql("p16_optional_filters", f"WITH {PAIRS}, n AS (SELECT page, COUNT(*) AS n FROM sessions GROUP BY page) SELECT a, b, co FROM pairs JOIN n x ON x.page = a JOIN n y ON y.page = b WHERE co >= 5 AND co * 1.0 / (x.n + y.n - co) >= 0.01")

# sort and top-k
sql("t1_top_n_multi_key", f"WITH {TELEMETRY} SELECT user_id, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions FROM telemetry GROUP BY user_id ORDER BY clicks DESC, impressions DESC, user_id LIMIT 20")
sql("t4_composite_order", "SELECT * FROM (SELECT o_orderkey, o_custkey, ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderpriority, o_custkey, o_orderkey) AS place FROM orders) x WHERE place <= 100")
sql("t5_latest_per_group", "SELECT o_custkey, MAX(o_orderkey) AS latest FROM orders GROUP BY o_custkey")
sql("t6_keep_latest_n", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) x WHERE rn <= 3")
sql("t7_hard_examples", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ROUND(l_discount * l_extendedprice, 4) AS loss FROM lineitem ORDER BY l_discount * l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50")
sql(
    "t9_uncertainty",
    f"""WITH {TELEMETRY}, p AS (SELECT user_id, SUM(CAST(clicks + 1 AS DOUBLE)) / SUM(sessions + 2) AS p FROM telemetry GROUP BY user_id)
SELECT user_id, ROUND(1 - GREATEST(p, 1 - p), 6) AS least_confidence, ROUND(-ABS(2 * p - 1), 6) AS margin, ROUND(-(p * LN(p) + (1 - p) * LN(1 - p)), 6) AS entropy FROM p""",
)

# joins
sql("j1_inner", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'")
sql("j2_left_chain", "SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
sql("j3_lookup_with_neutral", f"WITH {TELEMETRY}, score AS (SELECT user_id, CAST(SUM(clicks) AS DOUBLE) / SUM(sessions) AS s FROM telemetry GROUP BY user_id) SELECT c_custkey, ROUND(COALESCE(s, 0.5E0), 6) AS score FROM customer LEFT JOIN score ON c_custkey = user_id")
sql("j4_orphans", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON o_custkey = c_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
_ghost = f"WITH {EDGES}, {REVIEWS}, wanted AS (SELECT DISTINCT host % 100 AS src, destination AS dst FROM reviews WHERE status = 'pending') SELECT w.src, w.dst FROM wanted w LEFT {{}} JOIN edges e ON w.src = e.src AND w.dst = e.dst"
sql("j5_ghost_edges", _ghost.format("ANTI"), _ghost.replace("LEFT {}", "ANTI"))
sql(
    "j6_suppression_with_reason",
    f"""WITH {REVIEWS}, approved AS (SELECT DISTINCT host, destination FROM reviews WHERE status = 'approved'),
rejected AS (SELECT DISTINCT host, destination FROM reviews WHERE status = 'rejected' AND reviewed_at >= TIMESTAMP '2001-05-03 00:00:00')
SELECT r.suggestion, CASE WHEN a.host IS NOT NULL THEN 'already_approved' WHEN j.host IS NOT NULL THEN 'rejected_recently' ELSE 'keep' END AS reason
FROM reviews r LEFT JOIN approved a ON a.host = r.host AND a.destination = r.destination LEFT JOIN rejected j ON j.host = r.host AND j.destination = r.destination WHERE r.status = 'pending'""",
)
_top = f"WITH {EDGES}, top AS (SELECT s_suppkey AS node FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 30) SELECT src, dst, w FROM edges LEFT SEMI JOIN top x ON src = x.node LEFT SEMI JOIN top y ON dst = y.node"
sql("j7_edges_in_top_nodes", _top, _top.replace("LEFT SEMI", "SEMI"))
sql(
    "j8_window_full_outer",
    """WITH recent AS (SELECT user_id, COUNT(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-25 00:00:00' GROUP BY user_id),
base AS (SELECT user_id, COUNT(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-05 00:00:00' GROUP BY user_id)
SELECT COALESCE(r.user_id, b.user_id) AS item, COALESCE(r.n, 0) AS recent, COALESCE(b.n, 0) AS baseline FROM recent r FULL OUTER JOIN base b ON r.user_id = b.user_id""",
)
sql("j9_active_on_date", f"WITH {HISTORY} SELECT src, dst FROM history WHERE first_seen <= TIMESTAMP '1997-06-01 00:00:00' AND (is_active OR last_seen >= TIMESTAMP '1997-06-01 00:00:00')")
sql(
    "j10_scd_reconcile",
    """WITH stored AS (SELECT o_custkey AS src, o_orderkey % 50 AS dst, MIN(o_orderpriority) AS anchor FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01 00:00:00' GROUP BY o_custkey, o_orderkey % 50),
parsed AS (SELECT o_custkey AS src, o_orderkey % 50 AS dst, MIN(o_orderpriority) AS anchor FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY o_custkey, o_orderkey % 50)
SELECT COALESCE(p.src, s.src) AS src, COALESCE(p.dst, s.dst) AS dst, CASE WHEN s.src IS NULL THEN 'insert' WHEN p.src IS NULL THEN 'disappeared' WHEN p.anchor <> s.anchor THEN 'update' ELSE 'keep' END AS action
FROM parsed p FULL OUTER JOIN stored s ON p.src = s.src AND p.dst = s.dst""",
)
sql("j11_scalar_subquery", "SELECT c_custkey, (SELECT MAX(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS largest FROM customer")
sql("j12_session_cooccurrence", f"WITH {SESSIONS} SELECT x.page AS src, y.page AS dst, COUNT(*) AS co FROM sessions x JOIN sessions y ON x.session = y.session AND x.page <> y.page GROUP BY x.page, y.page")
sql(
    "j13_pairs_with_outcome",
    f"""WITH {REVIEWS} SELECT x.suggestion AS first, y.suggestion AS second, CASE WHEN x.status = y.status THEN 'draw' WHEN x.status = 'approved' THEN 'win' ELSE 'loss' END AS outcome
FROM reviews x JOIN reviews y ON x.host = y.host AND x.suggestion < y.suggestion WHERE x.status <> 'pending' AND y.status <> 'pending'""",
)
#: Buckets of five minutes since a fixed day.
_band = """WITH e AS (SELECT event_id, ts, user_id, CAST(FLOOR({0} * 288 + EXTRACT(HOUR FROM ts) * 12 + EXTRACT(MINUTE FROM ts) / 5) AS BIGINT) AS bucket FROM events WHERE event_type = 'error'),
near AS (SELECT event_id, ts, bucket + d AS bucket FROM e, (SELECT -1 AS d UNION ALL SELECT 0 UNION ALL SELECT 1) x)
SELECT a.event_id AS event, b.event_id AS related FROM near a JOIN e b ON a.bucket = b.bucket AND a.event_id <> b.event_id WHERE b.ts BETWEEN a.ts - INTERVAL '5' MINUTE AND a.ts + INTERVAL '5' MINUTE"""
sql(
    "j17_band_join",
    _band.format("DATEDIFF(CAST(ts AS DATE), DATE '2000-01-01')"),
    _band.format("DATE_DIFF('day', DATE '2000-01-01', CAST(ts AS DATE))"),
)
sql("j18_paragraph_band", "SELECT a.l_orderkey AS host, a.l_linenumber AS x, b.l_linenumber AS y, COUNT(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND b.l_linenumber - a.l_linenumber <= 3 GROUP BY a.l_orderkey, a.l_linenumber, b.l_linenumber")
_path = r"WITH p AS (SELECT page_id, url, {} AS path FROM pages) SELECT a.page_id AS page, MIN(b.page_id) AS target FROM p a JOIN p b ON a.path = b.path GROUP BY a.page_id"
sql("j19_path_lookup", _path.format(r"RTRIM('/', REGEXP_REPLACE(url, '^[a-z]+://[^/]+|[?#].*$', ''))"), _path.format(r"RTRIM(REGEXP_REPLACE(url, '^[a-z]+://[^/]+|[?#].*$', '', 'g'), '/')"))
sql("j20_duplicates_by_hash", "SELECT doc_id, first_id FROM (SELECT doc_id, MIN(doc_id) OVER (PARTITION BY MD5(text)) AS first_id, COUNT(*) OVER (PARTITION BY MD5(text)) AS n FROM documents) x WHERE n > 1")
sql(
    "j21_multi_source_merge",
    """WITH parts AS (SELECT user_id, COUNT(*) AS views, CAST(0 AS BIGINT) AS clicks FROM events WHERE event_type = 'view' GROUP BY user_id
UNION ALL SELECT user_id, CAST(0 AS BIGINT), COUNT(*) FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT user_id, CAST(SUM(views) AS BIGINT) AS views, CAST(SUM(clicks) AS BIGINT) AS clicks FROM parts GROUP BY user_id""",
)
sql("j22_join_strategies", "SELECT /*+ BROADCAST(n), MERGE(o) */ n_name, COUNT(*) AS orders FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey GROUP BY n_name")

# aggregation
sql("a1_global_aggregates", "SELECT COUNT(*) AS n, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high, ROUND(AVG(o_totalprice), 4) AS mean, CAST(SUM(o_orderkey) AS BIGINT) AS keys FROM orders")
sql("a2_group_by_one", f"WITH {TELEMETRY} SELECT day, CAST(SUM(impressions) AS BIGINT) AS impressions, CAST(SUM(clicks) AS BIGINT) AS clicks FROM telemetry GROUP BY day")
sql("a3_group_by_two", "SELECT event_type, user_id % 10 AS device, COUNT(*) AS n FROM events GROUP BY event_type, user_id % 10")
sql("a4_having", "SELECT MD5(text) AS title, COUNT(*) AS n FROM documents GROUP BY MD5(text) HAVING COUNT(*) > 1")
sql("a5_count_distinct", f"WITH {EDGES}, o AS (SELECT src AS node, COUNT(DISTINCT dst) AS n FROM edges GROUP BY src), i AS (SELECT dst AS node, COUNT(DISTINCT src) AS n FROM edges GROUP BY dst) SELECT s_suppkey AS node, COALESCE(o.n, 0) AS out_degree, COALESCE(i.n, 0) AS in_degree FROM supplier LEFT JOIN o ON o.node = s_suppkey LEFT JOIN i ON i.node = s_suppkey")
sql("a6_filtered_aggregate", "SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'purchase') AS bought, COUNT(*) AS n FROM events GROUP BY user_id")
sql(
    "a7_conditional_counts",
    """SELECT COUNT(*) AS pages, CAST(SUM(CASE WHEN html LIKE '%<title>%' THEN 0 ELSE 1 END) AS BIGINT) AS missing_title, CAST(SUM(CASE WHEN html LIKE '%name="description"%' THEN 0 ELSE 1 END) AS BIGINT) AS missing_description,
CAST(SUM(CASE WHEN html LIKE '%rel="canonical"%' THEN 0 ELSE 1 END) AS BIGINT) AS missing_canonical, CAST(SUM(CASE WHEN html LIKE '%noindex%' THEN 1 ELSE 0 END) AS BIGINT) AS noindex, CAST(SUM(CASE WHEN html LIKE '%<h1%' THEN 0 ELSE 1 END) AS BIGINT) AS missing_h1,
CAST(SUM(CASE WHEN LENGTH(html) < 2000 THEN 1 ELSE 0 END) AS BIGINT) AS thin FROM pages""",
)
sql("a8_day_buckets", "SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY CAST(ts AS DATE)")
_dense = "WITH days AS ({}), n AS (SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n FROM orders GROUP BY CAST(o_orderdate AS DATE)) SELECT days.day, COALESCE(n.n, 0) AS n FROM days LEFT JOIN n ON n.day = days.day"
_spark_days = "SELECT EXPLODE(SEQUENCE(DATE '1998-01-01', DATE '1998-12-31')) AS day"
_duck_days = "SELECT CAST(UNNEST(GENERATE_SERIES(DATE '1998-01-01', DATE '1998-12-31', INTERVAL 1 DAY)) AS DATE) AS day"
sql("a9_densify_days", _dense.format(_spark_days), _dense.format(_duck_days))
sql("a10_safe_rate", f"WITH {TELEMETRY} SELECT user_id, CASE WHEN SUM(impressions) = 0 THEN 0.0E0 ELSE ROUND(CAST(SUM(clicks) AS DOUBLE) / SUM(impressions), 4) END AS ctr FROM telemetry GROUP BY user_id")
sql("a11_funnel_rollup", f"WITH {TELEMETRY} SELECT user_id % 5 AS source, CAST(GROUPING(user_id % 5) AS BIGINT) AS is_total, CAST(SUM(impressions) AS BIGINT) AS impressions, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(conversions) AS BIGINT) AS conversions FROM telemetry GROUP BY ROLLUP (user_id % 5)")
sql("a12_engagement_mix", f"WITH {TELEMETRY} SELECT day, ROUND(CAST(SUM(engaged) AS DOUBLE) / SUM(sessions), 4) AS engaged_rate, ROUND(CAST(SUM(quick_exit) AS DOUBLE) / SUM(sessions), 4) AS quick_exit_rate FROM telemetry GROUP BY day")
sql("a13_coverage_summary", f"WITH {TELEMETRY} SELECT COUNT(DISTINCT day) AS days, CAST(SUM(impressions) AS BIGINT) AS impressions, COUNT(DISTINCT CASE WHEN clicks > 0 THEN day END) AS days_with_clicks, MAX(day) AS latest, ROUND(CAST(SUM(clicks) AS DOUBLE) / SUM(sessions), 4) AS click_rate FROM telemetry")
sql("a14_concentration", "WITH r AS (SELECT c_acctbal, ROW_NUMBER() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rn, COUNT(*) OVER () AS n FROM customer WHERE c_acctbal > 0) SELECT ROUND(SUM(CASE WHEN rn <= GREATEST(1, FLOOR(0.05 * n)) THEN c_acctbal ELSE 0 END) / SUM(c_acctbal), 6) AS share FROM r")
sql("a15_fifth_percentile_by_offset", "WITH r AS (SELECT c_acctbal, ROW_NUMBER() OVER (ORDER BY c_acctbal, c_custkey) AS rn, COUNT(*) OVER () AS n FROM customer), t AS (SELECT MAX(c_acctbal) AS threshold FROM r WHERE rn = GREATEST(0, FLOOR(0.05 * n) - 1) + 1) SELECT c_custkey FROM customer, t WHERE c_acctbal <= t.threshold")
_pct = "SELECT event_type, ROUND({0}(value, 0.5), 6) AS p50, ROUND({0}(value, 0.75), 6) AS p75, ROUND({0}(value, 0.95), 6) AS p95 FROM events GROUP BY event_type"
sql("a16_percentiles", _pct.format("PERCENTILE"), _pct.format("QUANTILE_CONT"))
sql("a17_median_mad", "WITH m AS (SELECT event_type, MEDIAN(value) AS med FROM events GROUP BY event_type) SELECT m.event_type, ROUND(MAX(med), 6) AS med, ROUND(MEDIAN(ABS(value - med)), 6) AS mad FROM events e JOIN m ON e.event_type = m.event_type GROUP BY m.event_type")
sql(
    "a18_zscore_anomaly",
    """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(COUNT(*) AS DOUBLE) AS n FROM events GROUP BY event_type, CAST(ts AS DATE)), last AS (SELECT MAX(day) AS day FROM d),
b AS (SELECT event_type, AVG(n) AS mean, STDDEV_SAMP(n) AS sd, COUNT(*) AS points FROM d, last WHERE d.day < last.day GROUP BY event_type)
SELECT d.event_type, ROUND((d.n - b.mean) / b.sd, 4) AS z, ABS((d.n - b.mean) / b.sd) >= 3 AS anomaly FROM d JOIN last ON d.day = last.day JOIN b ON b.event_type = d.event_type WHERE b.points >= 3 AND b.sd > 0""",
)
_gaps = "WITH days AS ({}), kinds AS (SELECT DISTINCT o_orderpriority AS kind FROM orders), n AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS kind, COUNT(*) AS n FROM orders GROUP BY CAST(o_orderdate AS DATE), o_orderpriority) SELECT kinds.kind, days.day FROM days CROSS JOIN kinds LEFT JOIN n ON n.day = days.day AND n.kind = kinds.kind WHERE COALESCE(n.n, 0) = 0"
sql("a19_backfill_gaps", _gaps.format(_spark_days), _gaps.format(_duck_days))
sql("a20_source_scorecard", "WITH m AS (SELECT MAX(ts) AS anchor FROM events) SELECT event_type, COUNT(*) AS n, MAX(ts) AS latest, CAST(COUNT(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS days, LEAST(1.0E0, COUNT(DISTINCT CAST(ts AS DATE)) / 30.0E0) AS completeness FROM events GROUP BY event_type")
sql("a21_duplicate_count", "SELECT CAST(SUM(n - 1) AS BIGINT) AS duplicates FROM (SELECT MD5(text) AS k, COUNT(*) AS n FROM documents GROUP BY MD5(text) HAVING COUNT(*) > 1) x")
sql("a22_min_max_normalise", f"WITH {TELEMETRY}, r AS (SELECT user_id, CAST(SUM(clicks) + 2 * SUM(conversions) AS DOUBLE) AS raw FROM telemetry GROUP BY user_id), b AS (SELECT MIN(raw) AS lo, MAX(raw) AS hi FROM r) SELECT user_id, CASE WHEN hi = lo THEN 0.75E0 ELSE ROUND(0.30E0 + 0.60E0 * (raw - lo) / (hi - lo), 6) END AS score FROM r, b")
sql("a23_log_min_max", "WITH b AS (SELECT LN(MIN(o_totalprice) + 1e-9) AS lo, LN(MAX(o_totalprice) + 1e-9) AS hi FROM orders) SELECT o_orderkey, CASE WHEN hi = lo THEN 0.5E0 ELSE ROUND(GREATEST(0.0E0, LEAST(1.0E0, (LN(o_totalprice + 1e-9) - lo) / (hi - lo))), 6) END AS score FROM orders, b")
sql("a24_canonical_election", "SELECT cluster, doc_id AS canonical FROM (SELECT MD5(text) AS cluster, doc_id, ROW_NUMBER() OVER (PARTITION BY MD5(text) ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, n_chars DESC, source, doc_id) AS rn FROM documents) x WHERE rn = 1")
sql("a25_common_reasons", "SELECT o_orderpriority AS reason, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority ORDER BY n DESC, reason LIMIT 5")
sql("a26_weekly_scorecard", f"WITH {REVIEWS} SELECT CAST(EXTRACT(YEAR FROM reviewed_at) AS BIGINT) AS year, CAST(EXTRACT(WEEK FROM reviewed_at) AS BIGINT) AS week, COUNT(*) AS n, CAST(SUM(CASE WHEN status = 'approved' THEN 1 ELSE 0 END) AS BIGINT) AS approved, ROUND(100.0E0 * SUM(CASE WHEN status = 'approved' THEN 1 ELSE 0 END) / COUNT(*), 2) AS rate FROM reviews GROUP BY CAST(EXTRACT(YEAR FROM reviewed_at) AS BIGINT), CAST(EXTRACT(WEEK FROM reviewed_at) AS BIGINT)")
sql(
    "a27_pair_statistics",
    f"""WITH {PAIRS}, n AS (SELECT page, COUNT(*) AS n FROM sessions GROUP BY page), t AS (SELECT CAST(COUNT(DISTINCT session) AS DOUBLE) AS total FROM sessions)
SELECT a, b, co, ROUND(co / CAST(x.n + y.n - co AS DOUBLE), 6) AS jaccard, ROUND(co * total / (x.n * y.n), 6) AS lift, ROUND(LN(co * total / (CAST(x.n AS DOUBLE) * y.n)) / LN(2), 6) AS pmi,
ROUND((LN(co * total / (CAST(x.n AS DOUBLE) * y.n)) / LN(2)) / (-LN(co / total) / LN(2)), 6) AS npmi
FROM pairs JOIN n x ON x.page = a JOIN n y ON y.page = b, t WHERE co >= 5 AND co / CAST(x.n + y.n - co AS DOUBLE) >= 0.01""",
)
sql("a28_shannon_entropy", "WITH c AS (SELECT user_id, event_type, CAST(COUNT(*) AS DOUBLE) AS n FROM events GROUP BY user_id, event_type), p AS (SELECT user_id, n / SUM(n) OVER (PARTITION BY user_id) AS p FROM c) SELECT user_id, ABS(ROUND(SUM(-p * LN(p) / LN(2)), 6)) AS bits FROM p GROUP BY user_id")
sql("a35_decimal_costs", "SELECT l_shipmode, CAST(SUM(cost) AS DECIMAL(38,6)) AS cost, CAST(SUM(tokens) AS BIGINT) AS tokens FROM (SELECT l_returnflag AS l_shipmode, CAST(l_extendedprice AS DECIMAL(12,6)) AS cost, CAST(l_quantity AS BIGINT) AS tokens FROM lineitem WHERE l_extendedprice < 100000) x GROUP BY l_shipmode")
sql("a36_status_dashboard", f"WITH {REVIEWS} SELECT status, COUNT(*) AS n, MAX(suggestion) AS latest FROM reviews GROUP BY status")
sql("a37_scope_counts", "SELECT source, COUNT(*) AS n, CAST(SUM(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
_trend = "WITH days AS ({}), k AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), n AS (SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id, CAST(ts AS DATE)) SELECT k.user_id, days.day, COALESCE(n.n, 0) AS n FROM k CROSS JOIN days LEFT JOIN n ON n.day = days.day AND n.user_id = k.user_id"
sql("a38_severity_trend", _trend.format("SELECT EXPLODE(SEQUENCE(DATE '2024-01-01', DATE '2024-01-30')) AS day"), _trend.format("SELECT CAST(UNNEST(GENERATE_SERIES(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day"))
sql("a39_cube", "SELECT event_type, user_id % 3 AS device, COUNT(*) AS n, CAST(GROUPING(event_type) + GROUPING(user_id % 3) AS BIGINT) AS level FROM events GROUP BY CUBE (event_type, user_id % 3)")
sql("a39_grouping_sets", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
sql("a40_similar_errors", "SELECT event_id, user_id, rn FROM (SELECT event_id, user_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type = 'error') x WHERE rn <= 5")
sql("a40_reach_count", "SELECT get_json_object(props, '$.k') AS fingerprint, COUNT(DISTINCT user_id) AS nodes FROM events WHERE event_type = 'error' GROUP BY get_json_object(props, '$.k')", "SELECT json_extract_string(props, '$.k') AS fingerprint, COUNT(DISTINCT user_id) AS nodes FROM events WHERE event_type = 'error' GROUP BY json_extract_string(props, '$.k')")
sql("a41_unread_summary", "SELECT CASE WHEN value >= 20 THEN 'critical' WHEN value >= 10 THEN 'warning' ELSE 'info' END AS severity, COUNT(*) AS n, MIN(ts) AS oldest FROM events WHERE event_type = 'error' GROUP BY CASE WHEN value >= 20 THEN 'critical' WHEN value >= 10 THEN 'warning' ELSE 'info' END")
_runs = "WITH runs AS (SELECT DISTINCT o_orderdate FROM orders ORDER BY o_orderdate DESC LIMIT 5) SELECT o_orderkey, o_totalprice FROM orders {} JOIN runs ON orders.o_orderdate = runs.o_orderdate WHERE o_orderpriority = '3-MEDIUM'"
sql("a42_benchmark_trend", _runs.format("LEFT SEMI"), _runs.format("SEMI"))
sql("a43_stuck_jobs", "WITH anchor AS (SELECT MAX(ts) AS now FROM events), last AS (SELECT user_id, MAX(ts) AS seen FROM events GROUP BY user_id) SELECT user_id, CASE WHEN seen < now - INTERVAL '2' HOUR THEN 'failed' ELSE 'stuck' END AS state FROM last, anchor WHERE seen < now - INTERVAL '30' MINUTE")
sql("a44_overdue", "WITH anchor AS (SELECT MAX(ts) AS now FROM events), last AS (SELECT event_type, user_id, MAX(ts) AS seen FROM events GROUP BY event_type, user_id) SELECT event_type, user_id, seen FROM last, anchor WHERE seen < now - INTERVAL '72' HOUR")
_bucket = "SELECT c_custkey, {} AS bucket FROM customer"
sql("a45_hash_bucket", _bucket.format("CAST(CONV(SUBSTRING(SHA2(CONCAT(CAST(c_custkey AS STRING), ':rollout'), 256), 1, 8), 16, 10) AS BIGINT) % 100"), _bucket.format("CAST(CAST('0x' || SUBSTRING(SHA256(CAST(c_custkey AS VARCHAR) || ':rollout'), 1, 8) AS BIGINT) % 100 AS BIGINT)"))
sql("a46_applied_still_live", f"WITH {EDGES}, {REVIEWS} SELECT CASE WHEN e.src IS NULL THEN 'missing' ELSE 'live' END AS state, COUNT(*) AS n FROM reviews r LEFT JOIN edges e ON e.src = r.host % 100 AND e.dst = r.destination WHERE r.status = 'approved' GROUP BY CASE WHEN e.src IS NULL THEN 'missing' ELSE 'live' END")
sql("a47_rejected_prune", f"WITH {REVIEWS} SELECT host, destination, COUNT(*) AS lifetime, MAX(reviewed_at) AS latest FROM reviews WHERE status = 'rejected' GROUP BY host, destination HAVING MAX(reviewed_at) >= TIMESTAMP '2000-08-01 00:00:00'")

# windows
sql("n1_row_number_keep", f"WITH {SNAPSHOTS} SELECT item, pk FROM (SELECT item, pk, ROW_NUMBER() OVER (PARTITION BY item ORDER BY captured DESC, pk DESC) AS rn FROM snapshots) x WHERE rn <= 2")
_lag = f"WITH {SNAPSHOTS}, l AS (SELECT item, captured, pk, views, LAG(views) OVER (PARTITION BY item ORDER BY captured, pk) AS before_views, LAG(captured) OVER (PARTITION BY item ORDER BY captured, pk) AS before_day FROM snapshots) SELECT item, pk, ROUND(GREATEST(views - before_views, 0) / CAST(GREATEST({{}}, 1) AS DOUBLE), 6) AS rate FROM l WHERE before_day IS NOT NULL"
sql("n2_lag_rate", _lag.format("DATEDIFF(captured, before_day)"), _lag.format("captured - before_day"))
sql(
    "n3_traffic_spikes",
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS clicks FROM events GROUP BY user_id, CAST(ts AS DATE)),
w AS (SELECT user_id, day, clicks, AVG(clicks) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL '7' DAY PRECEDING AND INTERVAL '1' DAY PRECEDING) AS mean FROM d)
SELECT user_id, day, clicks, ROUND(mean, 6) AS trailing_mean FROM w WHERE mean IS NOT NULL AND clicks > 1.5 * mean""",
)
sql(
    "n4_recent_against_baseline",
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(COUNT(*) AS DOUBLE) AS n FROM events GROUP BY user_id, CAST(ts AS DATE)), m AS (SELECT MAX(day) AS last FROM d),
x AS (SELECT user_id, SUM(CASE WHEN day > last - INTERVAL '3' DAY THEN n ELSE 0 END) / 3 AS recent, SUM(CASE WHEN day <= last - INTERVAL '3' DAY AND day > last - INTERVAL '10' DAY THEN n ELSE 0 END) / 7 AS baseline FROM d, m GROUP BY user_id)
SELECT user_id, ROUND(recent, 6) AS recent, ROUND(baseline, 6) AS baseline, recent - baseline >= 2 * baseline AS urgent FROM x WHERE baseline > 0 AND (recent - baseline) / baseline >= 0.5""",
)
sql("n5_rank_in_list", f"WITH {REVIEWS} SELECT suggestion, host, ROW_NUMBER() OVER (PARTITION BY host ORDER BY score DESC, suggestion) AS place FROM reviews")
sql("n6_first_event_position", f"WITH {REVIEWS}, r AS (SELECT host, status, ROW_NUMBER() OVER (PARTITION BY host ORDER BY score DESC, suggestion) AS place FROM reviews) SELECT host, MIN(CASE WHEN status = 'approved' THEN place END) AS first_approved FROM r GROUP BY host")
sql("n8_newest_cohort", f"WITH {HISTORY} SELECT src, dst FROM (SELECT src, dst, ROW_NUMBER() OVER (PARTITION BY dst ORDER BY first_seen DESC, src) AS rn, COUNT(*) OVER (PARTITION BY dst) AS n FROM history) x WHERE rn <= CEIL(0.25 * n)")
sql(
    "n9_window_family",
    """SELECT o_orderkey, LEAD(o_orderkey) OVER w AS next_order, NTILE(4) OVER w AS quarter, ROUND(CUME_DIST() OVER w, 6) AS cume, ROUND(PERCENT_RANK() OVER w, 6) AS pct, FIRST_VALUE(o_orderkey) OVER w AS first_order,
COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS in_frame FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
# sets
sql("u1_union", "SELECT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'A' UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0")
sql("u2_intersect", "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
sql("u3_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
sql("u4_union_all_in_order", "SELECT id, MIN(pos) AS pos FROM (SELECT o_custkey AS id, ROW_NUMBER() OVER (ORDER BY o_orderkey) AS pos FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT c_custkey, 1000000 + ROW_NUMBER() OVER (ORDER BY c_custkey) FROM customer) x GROUP BY id")
sql("u5_cardinality", "SELECT COUNT(DISTINCT user_id) AS n, CAST(MAX(CASE WHEN user_id = 7 THEN 1 ELSE 0 END) AS BIGINT) AS has_seven FROM events")
# writes whose effect is a table
sql("k2_update_by_key", "WITH u AS (SELECT o_custkey AS k, MAX(o_totalprice) AS v FROM orders GROUP BY o_custkey) SELECT c_custkey, COALESCE(v, c_acctbal) AS balance FROM customer LEFT JOIN u ON c_custkey = k")
sql("k3_upsert", "WITH t AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier), u AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey >= 50) SELECT COALESCE(u.k, t.k) AS k, COALESCE(u.v, t.v) AS v FROM t FULL OUTER JOIN u ON t.k = u.k")
_k4 = f"WITH {SEARCH}, totals AS (SELECT item, day, '' AS query, CAST(SUM(clicks) AS BIGINT) AS clicks FROM search GROUP BY item, day), q AS (SELECT item, day, query, clicks FROM search WHERE query IN ('click', 'view')) SELECT item, day, query, clicks FROM q UNION ALL SELECT t.item, t.day, t.query, t.clicks FROM totals t LEFT ANTI JOIN q ON q.item = t.item AND q.day = t.day"
sql("k4_page_total_precedence", _k4, _k4.replace("LEFT ANTI", "ANTI"))
_k5 = "SELECT s_suppkey AS k, 'stored' AS origin FROM supplier UNION ALL SELECT c_custkey, 'new' FROM customer LEFT ANTI JOIN supplier ON s_suppkey = c_custkey"
sql("k5_insert_or_ignore", _k5, _k5.replace("LEFT ANTI", "ANTI"))
sql("k6_reset_absent", "WITH s AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) SELECT c_custkey, COALESCE(n, 0) AS score FROM customer LEFT JOIN s ON k = c_custkey")
_k7 = f"WITH {REVIEWS}, fresh AS (SELECT suggestion + 1000000 AS suggestion, destination, status FROM reviews WHERE host % 7 = 0) SELECT suggestion, destination, status FROM fresh UNION ALL SELECT r.suggestion, r.destination, r.status FROM reviews r LEFT ANTI JOIN fresh f ON f.destination = r.destination AND r.status = 'pending'"
sql("k7_replace_pending", _k7, _k7.replace("LEFT ANTI", "ANTI"))
sql("k11_top_n_as_kv", f"WITH {EDGES} SELECT CAST(dst AS BIGINT) AS k, CAST(SUM(w) AS BIGINT) AS v FROM edges GROUP BY dst ORDER BY v DESC, k LIMIT 25")
sql("k12_snapshot_append", "SELECT 'job-1' AS import_job, c_custkey AS item, TIMESTAMP '2024-02-01 00:00:00' AS captured_at, CAST(FLOOR(c_acctbal) AS BIGINT) AS views FROM customer")
sql("k14_retention_preview", "SELECT CAST(SUM(CASE WHEN o_orderdate < TIMESTAMP '2000-08-01 00:00:00' THEN 1 ELSE 0 END) AS BIGINT) AS older_than_year, CAST(SUM(CASE WHEN o_orderdate < TIMESTAMP '2001-05-03 00:00:00' THEN 1 ELSE 0 END) AS BIGINT) AS older_than_90_days FROM orders")
sql("k15_archive_then_prune", "SELECT vec_id, label FROM embeddings WHERE NOT (label = 3 AND vec_id % 2 = 0)")
# streaming behaviours in batch form
_m2 = "SELECT user_id, get_json_object(props, '$.k') AS fingerprint, COUNT(*) AS n, MAX_BY(event_id, ts) AS latest FROM events WHERE event_type = 'error' GROUP BY user_id, get_json_object(props, '$.k')"
sql("m2_dedupe_reopen", _m2, _m2.replace("get_json_object(props", "json_extract_string(props"))
sql("m4_payload_dedupe", "SELECT MD5(CONCAT(CAST(user_id AS STRING), props)) AS payload, MIN(event_id) AS first_event FROM events GROUP BY MD5(CONCAT(CAST(user_id AS STRING), props))", "SELECT MD5(CONCAT(CAST(user_id AS VARCHAR), props)) AS payload, MIN(event_id) AS first_event FROM events GROUP BY MD5(CONCAT(CAST(user_id AS VARCHAR), props))")
sql("m5_daily_rollup", "SELECT CAST(ts AS DATE) AS day, event_type, COUNT(*) AS n, CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY CAST(ts AS DATE), event_type")
sql("m6_sliding_seven_days", "WITH d AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY CAST(ts AS DATE)) SELECT day, CAST(SUM(n) OVER (ORDER BY day RANGE BETWEEN INTERVAL '6' DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM d")
sql(
    "m8_gap_sessions",
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT user_id, ts, SUM(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, CAST(n AS BIGINT) AS session, MIN(ts) AS opened, MAX(ts) AS closed, COUNT(*) AS events FROM s GROUP BY user_id, CAST(n AS BIGINT)""",
)
sql("m8_sessions_by_id", "SELECT conv_id AS session, COUNT(*) AS events, COUNT(DISTINCT role) AS roles, MIN(turn) AS opened, MAX(turn) AS closed FROM conversations GROUP BY conv_id")
