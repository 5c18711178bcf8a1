"""Derived inputs that several queries share, as SQL that any dialect reads: prefix a query with one of them."""

#: One row for a day and a destination, counts by kind of event.
TELEMETRY = """telemetry AS (
  SELECT CAST(ts AS DATE) AS day, user_id,
    CAST(SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS impressions,
    CAST(SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks,
    CAST(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS conversions,
    CAST(SUM(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS engaged,
    CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS quick_exit,
    CAST(COUNT(*) AS BIGINT) AS sessions
  FROM events GROUP BY CAST(ts AS DATE), user_id)"""
#: One row for an item, a day and a query.
SEARCH = """search AS (
  SELECT user_id AS item, CAST(ts AS DATE) AS day, event_type AS query,
    CAST(COUNT(*) AS BIGINT) AS clicks, CAST(SUM(CAST(FLOOR(value) AS BIGINT)) AS BIGINT) AS impressions
  FROM events GROUP BY user_id, CAST(ts AS DATE), event_type)"""
SESSIONS = "sessions AS (SELECT DISTINCT l_orderkey AS session, l_suppkey AS page FROM lineitem)"
#: Pages that share sessions, a < b, with the number of sessions.
PAIRS = SESSIONS + """, pairs AS (
  SELECT x.page AS a, y.page AS b, CAST(COUNT(*) AS BIGINT) AS co
  FROM sessions x JOIN sessions y ON x.session = y.session AND x.page < y.page GROUP BY x.page, y.page)"""
#: Directed edges between pages.
EDGES = PAIRS + """, edges AS (
  SELECT CASE WHEN (a + b) % 2 = 0 THEN a ELSE b END AS src, CASE WHEN (a + b) % 2 = 0 THEN b ELSE a END AS dst, co AS w FROM pairs)"""
#: Suggestions with a review status.
REVIEWS = """reviews AS (
  SELECT o_orderkey AS suggestion, o_custkey AS host, o_orderkey % 97 AS destination, o_orderdate AS reviewed_at, o_totalprice AS score,
    CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'rejected' ELSE 'pending' END AS status
  FROM orders)"""
#: First and last time a customer ordered in a month, as the history of an edge.
HISTORY = """history AS (
  SELECT o_custkey AS src, o_orderkey % 50 AS dst, MIN(o_orderdate) AS first_seen, MAX(o_orderdate) AS last_seen,
    MAX(o_orderdate) >= TIMESTAMP '1998-01-01 00:00:00' AS is_active
  FROM orders GROUP BY o_custkey, o_orderkey % 50)"""
#: A quantity of a customer in every month it ordered.
SNAPSHOTS = """snapshots AS (
  SELECT o_custkey AS item, CAST(o_orderdate AS DATE) AS captured, o_orderkey AS pk, CAST(FLOOR(o_totalprice) AS BIGINT) AS views FROM orders)"""
