"""Ranking, scoring and feedback queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.plans.registry import load, query, sql, tables
from weftline.plans.rounds import dropped, written
from weftline.plans.views import EDGES, PAIRS, REVIEWS, SNAPSHOTS, TELEMETRY

_totals = f"""WITH {TELEMETRY}, t AS (SELECT user_id, CAST(SUM(impressions) AS DOUBLE) AS views, CAST(SUM(clicks) AS DOUBLE) AS clicks, CAST(SUM(conversions) AS DOUBLE) AS conversions, CAST(SUM(engaged) AS DOUBLE) AS engaged, CAST(SUM(quick_exit) AS DOUBLE) AS quick_exit, CAST(SUM(sessions) AS DOUBLE) AS sessions FROM telemetry GROUP BY user_id)"""
sql("r3_keyword_jaccard", f"WITH l AS (SELECT DISTINCT o_custkey AS a, l_partkey % 50 AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey), n AS (SELECT a, COUNT(*) AS n FROM l GROUP BY a), {REVIEWS}, asked AS (SELECT DISTINCT host AS a, destination AS b FROM reviews WHERE host <> destination), s AS (SELECT asked.a, asked.b, COUNT(*) AS shared FROM asked JOIN l x ON x.a = asked.a JOIN l y ON y.a = asked.b AND y.t = x.t GROUP BY asked.a, asked.b) SELECT s.a, s.b, ROUND(CAST(shared AS DOUBLE) / (x.n + y.n - shared), 6) AS j FROM s JOIN n x ON x.a = s.a JOIN n y ON y.a = s.b")
sql("r4_node_affinity", "SELECT c.c_custkey, s.s_suppkey, CASE WHEN c_nationkey = s_nationkey THEN 1.0E0 WHEN n1.n_regionkey = n2.n_regionkey THEN 0.6E0 ELSE 0.0E0 END AS affinity FROM customer c JOIN supplier s ON s.s_suppkey = c.c_custkey % 100 JOIN nation n1 ON n1.n_nationkey = c_nationkey JOIN nation n2 ON n2.n_nationkey = s_nationkey")
sql("r5_silo_affinity", "SELECT c_custkey, CASE WHEN c_nationkey % 5 = c_custkey % 5 THEN 0.2E0 ELSE -0.1E0 END AS silo, c_nationkey % 5 <> c_custkey % 5 AS blocked_if_strict FROM customer")
sql(
    "r6_field_relevance",
    """WITH f AS (SELECT l_orderkey AS host, l_partkey % 40 AS term, CAST(COUNT(*) AS DOUBLE) AS tf FROM lineitem GROUP BY l_orderkey, l_partkey % 40), n AS (SELECT host, SUM(tf) AS len FROM f GROUP BY host), a AS (SELECT AVG(len) AS mean FROM n),
s AS (SELECT f.host, f.term, LN(1 + 5.0E0 / (1 + 1)) * tf * 2.2E0 / (tf + 1.2E0 * (0.25E0 + 0.75E0 * len / mean)) AS score FROM f JOIN n ON n.host = f.host, a), r AS (SELECT host, score, ROW_NUMBER() OVER (PARTITION BY host ORDER BY score DESC, term) AS rn FROM s)
SELECT host, ROUND(AVG(score) / (1 + AVG(score)), 6) AS relevance FROM r WHERE rn <= 5 GROUP BY host""",
)
sql(
    "r8_keyword_stuffing",
    """WITH t AS (SELECT o_custkey AS doc, l_partkey % 100 AS term, CAST(COUNT(*) AS DOUBLE) AS tf FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey % 100), c AS (SELECT term, SUM(tf) AS n FROM t GROUP BY term), g AS (SELECT SUM(n) AS total, CAST(COUNT(*) AS DOUBLE) AS vocab FROM c), d AS (SELECT doc, SUM(tf) AS len FROM t GROUP BY doc),
k AS (SELECT t.doc, SUM((tf / len) * LN((tf / len) / ((n + 1) / (total + vocab)))) / MAX(LN(vocab)) AS kl FROM t JOIN c ON c.term = t.term JOIN d ON d.doc = t.doc, g GROUP BY t.doc) SELECT doc, ROUND(0.5E0 - 0.5E0 / (1 + EXP(-6.0E0 * (kl - 0.30E0))), 6) AS score FROM k""",
)
sql("r10_anchor_diversity", "WITH h AS (SELECT o_custkey AS dest, o_orderpriority AS anchor, COUNT(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority), t AS (SELECT dest, SUM(n) AS total FROM h GROUP BY dest) SELECT h.dest, anchor, ROUND(CAST(n + 1 AS DOUBLE) / (total + 1), 6) AS share, n + 1 > 3 AS over_cap, ROUND(0.8E0 * GREATEST(0.0E0, CAST(n + 1 AS DOUBLE) / (total + 1) - 0.4E0) / 0.6E0 + 0.2E0 * LEAST(1.0E0, GREATEST(0, n + 1 - 3) / 3.0E0), 6) AS risk FROM h JOIN t ON t.dest = h.dest")
sql(
    "r11_query_likelihood",
    """WITH t AS (SELECT l_orderkey AS doc, l_suppkey % 30 AS term, CAST(COUNT(*) AS DOUBLE) AS tf FROM lineitem GROUP BY l_orderkey, l_suppkey % 30), c AS (SELECT term, SUM(tf) / SUM(SUM(tf)) OVER () AS p FROM t GROUP BY term), d AS (SELECT doc, SUM(tf) AS len FROM t GROUP BY doc), q AS (SELECT 3 AS term UNION ALL SELECT 7 UNION ALL SELECT 11)
SELECT d.doc, ROUND(SUM(LN((COALESCE(t.tf, 0) + 2000 * c.p) / (d.len + 2000))), 6) AS score FROM d CROSS JOIN q JOIN c ON c.term = q.term LEFT JOIN t ON t.doc = d.doc AND t.term = q.term GROUP BY d.doc""",
)
sql("r12_feedback_expansion", "WITH top AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50), t AS (SELECT l_partkey % 200 AS term, l_orderkey, COUNT(*) AS tf FROM lineitem JOIN top ON o_orderkey = l_orderkey GROUP BY l_partkey % 200, l_orderkey) SELECT term, COUNT(*) AS df, ROUND(CAST(SUM(tf) AS DOUBLE) / 50 * LN(1 + COUNT(*)), 6) AS score FROM t GROUP BY term HAVING COUNT(*) >= 2 ORDER BY score DESC, term LIMIT 10")
sql(
    "r13_rank_fusion",
    f"""WITH {REVIEWS}, a AS (SELECT suggestion, ROW_NUMBER() OVER (ORDER BY score DESC, suggestion) AS rn FROM reviews), b AS (SELECT suggestion, ROW_NUMBER() OVER (ORDER BY host, suggestion) AS rn FROM reviews WHERE status = 'approved'), u AS (SELECT suggestion, rn FROM a WHERE rn <= 500 UNION ALL SELECT suggestion, rn FROM b WHERE rn <= 500)
SELECT suggestion, ROUND(SUM(1.0E0 / (60 + rn)), 9) AS fused FROM u GROUP BY suggestion""",
)
sql("r14_graph_contribution", f"WITH {EDGES}, i AS (SELECT dst, COUNT(*) AS n FROM edges GROUP BY dst), m AS (SELECT MAX(n) AS most FROM i) SELECT s_suppkey, ROUND(COALESCE(0.1E0 * (CAST(n AS DOUBLE) / most - 0.5E0), 0.0E0), 6) AS contribution FROM supplier LEFT JOIN i ON dst = s_suppkey CROSS JOIN m")
sql("r16_explore_exploit", f"WITH {REVIEWS}, p AS (SELECT host % 20 AS h, destination % 20 AS d, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(CASE WHEN status = 'approved' THEN 1 ELSE 0 END) AS DOUBLE) AS ok FROM reviews WHERE status <> 'pending' GROUP BY host % 20, destination % 20), g AS (SELECT SUM(n) AS total FROM p) SELECT h, d, ROUND(GREATEST(0.5E0, LEAST(2.0E0, 1 + 0.2E0 * ((ok + 1) / (n + 2) + SQRT(2) * SQRT(LN(total + 1) / (n + 1)) - 0.5E0))), 6) AS factor FROM p, g")
sql("r17_thin_content", "SELECT doc_id, CASE WHEN n_chars = 0 THEN 0.0E0 WHEN n_chars < 500 THEN 0.7E0 WHEN n_chars < 1000 THEN 0.85E0 ELSE 1.0E0 END AS multiplier FROM documents")
sql("r18_penalty", f"WITH {REVIEWS}, n AS (SELECT host, CAST(COUNT(*) AS DOUBLE) AS links, CAST(SUM(CASE WHEN status = 'approved' THEN 1 ELSE 0 END) AS DOUBLE) AS near FROM reviews GROUP BY host) SELECT host, ROUND(0.35E0 / (1 + EXP(-3 * (links / 3 - 0.7E0))) + 0.35E0 * GREATEST(0.0E0, LEAST(1.0E0, (host % 7) / 4.0E0 - 1)) + 0.30E0 / (1 + EXP(-2 * (near / 3 - 1))), 6) AS penalty FROM n")
sql("r19_value_model", f"{_totals} SELECT user_id, ROUND(GREATEST(0.0E0, LEAST(1.0E0, 0.4E0 * clicks / sessions + 0.3E0 * conversions / sessions + 0.3E0 * engaged / sessions - 0.2E0 * quick_exit / sessions)), 6) AS value FROM t")
sql(
    "r20_content_value",
    f"{_totals} SELECT user_id, ROUND(0.40E0 * LN(1 + clicks) + 0.20E0 * 100 * clicks / GREATEST(views, 1) + 0.20E0 * LN(1 + views) + 0.10E0 * 10 * engaged / GREATEST(views, 1) + 0.05E0 * 10 * conversions / GREATEST(views, 1) + 0.05E0 * 10 * clicks / GREATEST(views, 1) - 0.05E0 * 10 * quick_exit / GREATEST(views, 1), 6) AS raw FROM t",
)
sql("r21_engagement_quality", f"{_totals} SELECT user_id, ROUND(0.5E0 * engaged / sessions + 0.3E0 * (1 - quick_exit / sessions) + 0.2E0 * LEAST(1.0E0, LN(1 + sessions) / 5), 6) AS raw FROM t")
_velocity = f"WITH {SNAPSHOTS}, m AS (SELECT MAX(captured) AS today FROM snapshots), l AS (SELECT item, captured, views, LAG(views) OVER (PARTITION BY item ORDER BY captured, pk) AS before_views, LAG(captured) OVER (PARTITION BY item ORDER BY captured, pk) AS before_day, ROW_NUMBER() OVER (PARTITION BY item ORDER BY captured DESC, pk DESC) AS rn FROM snapshots) SELECT item, ROUND(LN(1 + GREATEST(views - COALESCE(before_views, 0), 0) / CAST(GREATEST(COALESCE({{0}}, 1), 1) AS DOUBLE)) * POWER(0.5E0, {{1}} / 21.0E0), 6) AS velocity FROM l, m WHERE rn = 1"
sql("r22_velocity", _velocity.format("DATEDIFF(captured, before_day)", "DATEDIFF(today, captured)"), _velocity.format("captured - before_day", "(today - captured)"))
@query(
    "r23_matched_controls",
    f"""{_totals}, x AS (SELECT user_id, views / (SELECT MAX(views) FROM t) AS a, clicks / (SELECT MAX(clicks) FROM t) AS b FROM t), d AS (SELECT p.user_id AS item, c.user_id AS control, SQRT((p.a - c.a) * (p.a - c.a) + (p.b - c.b) * (p.b - c.b)) AS dist FROM x p JOIN x c ON c.user_id <> p.user_id AND c.user_id % 10 <> 0 WHERE p.user_id % 10 = 0)
SELECT item, control, ROUND(dist, 6) AS dist FROM (SELECT item, control, dist, ROW_NUMBER() OVER (PARTITION BY item ORDER BY ROUND(dist, 9), control) AS rn FROM d) y WHERE rn <= 5""",
)
def r23(spark, sf_dir):
    """The five controls next to every item, by the places (views, clicks) that items and controls share.

    Of the controls at a place, all at one distance, only the five least can be chosen; so different places are compared, not users.
    """
    tables(spark, sf_dir)
    x = spark.sql(f"{_totals} SELECT user_id, views, clicks, views / (SELECT MAX(views) FROM t) AS a, clicks / (SELECT MAX(clicks) FROM t) AS b FROM t")
    x = written(x, "users")
    # numbers of users are told apart by their last digit, as in SQL; equal counts give equal a and b
    controls = x.where("user_id % 10 <> 0").withColumn("rn", F.row_number().over(Window.partitionBy("views", "clicks").orderBy("user_id"))).where("rn <= 5")
    held = written(controls.groupBy("views", "clicks").agg(F.first("a").alias("ca"), F.first("b").alias("cb"), F.sort_array(F.collect_list("user_id")).alias("ids")).select("ca", "cb", "ids"), "controls")
    asked = x.where("user_id % 10 = 0").groupBy("views", "clicks").agg(F.first("a").alias("a"), F.first("b").alias("b"))
    dist = F.sqrt((F.col("a") - F.col("ca")) * (F.col("a") - F.col("ca")) + (F.col("b") - F.col("cb")) * (F.col("b") - F.col("cb")))
    near = asked.crossJoin(held).select("views", "clicks", dist.alias("dist"), "ids").select("views", "clicks", "dist", F.explode("ids").alias("control"))
    place = F.row_number().over(Window.partitionBy("views", "clicks").orderBy(F.round("dist", 9), "control"))
    near = near.withColumn("rn", place).where("rn <= 5").select("views", "clicks", "control", F.round("dist", 6).alias("dist"))
    return x.where("user_id % 10 = 0").select(F.col("user_id").alias("item"), "views", "clicks").join(near.hint("merge"), ["views", "clicks"]).select("item", "control", "dist")


sql("r25_keyword_lift", "SELECT event_type AS query, CAST(SUM(CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 1 ELSE 0 END) AS BIGINT) AS before_clicks, CAST(SUM(CASE WHEN ts >= TIMESTAMP '2024-01-15 00:00:00' THEN 1 ELSE 0 END) AS BIGINT) AS after_clicks, event_type LIKE '%click%' AS anchor_in_query FROM events GROUP BY event_type")
sql(
    "r27_cascade_click",
    f"""WITH {REVIEWS}, r AS (SELECT host, destination, status, ROW_NUMBER() OVER (PARTITION BY host ORDER BY score DESC, suggestion) AS place FROM reviews), c AS (SELECT host, MIN(CASE WHEN status = 'approved' THEN place END) AS clicked FROM r GROUP BY host)
SELECT destination, ROUND((SUM(CASE WHEN place = clicked THEN 1 ELSE 0 END) + 1) / CAST(COUNT(*) + 2 AS DOUBLE), 6) AS relevance FROM r JOIN c ON c.host = r.host WHERE clicked IS NULL OR place <= clicked GROUP BY destination""",
)
sql("r28_position_bias", f"WITH {REVIEWS}, r AS (SELECT destination, status, ROW_NUMBER() OVER (PARTITION BY host ORDER BY score DESC, suggestion) AS place FROM reviews) SELECT destination, ROUND(SUM(CASE WHEN status = 'approved' THEN LEAST(CAST(place AS DOUBLE), 10) ELSE 0 END) / COUNT(*), 6) AS weighted_ctr FROM r GROUP BY destination")
_conformal = f"WITH {REVIEWS}, r AS (SELECT ABS(CASE WHEN status = 'approved' THEN 1.0E0 ELSE 0.0E0 END - score / 600000) AS residual FROM reviews WHERE status <> 'pending'), k AS (SELECT residual, ROW_NUMBER() OVER (ORDER BY residual) AS rn, COUNT(*) OVER () AS n FROM r) SELECT ROUND(MIN(residual), 6) AS quantile FROM k WHERE rn >= CEIL((n + 1) * 0.9E0)"
sql("r30_split_conformal", _conformal)
sql(
    "r32_ndcg",
    f"""WITH {REVIEWS}, g AS (SELECT host, CASE status WHEN 'approved' THEN 3.0E0 WHEN 'pending' THEN 1.0E0 ELSE 0.0E0 END AS gain, score, suggestion FROM reviews), r AS (SELECT host, gain, ROW_NUMBER() OVER (PARTITION BY host ORDER BY score DESC, suggestion) AS place, ROW_NUMBER() OVER (PARTITION BY host ORDER BY gain DESC, suggestion) AS ideal FROM g)
SELECT host, ROUND(SUM(CASE WHEN place <= 10 THEN gain * LN(2) / LN(place + 1) ELSE 0 END) / SUM(CASE WHEN ideal <= 10 THEN gain * LN(2) / LN(ideal + 1) ELSE 0 END), 6) AS ndcg FROM r GROUP BY host HAVING SUM(gain) > 0""",
)
sql("r43_refresh_interval", "WITH h AS (SELECT o_custkey AS url, COUNT(*) AS crawls, COUNT(DISTINCT o_orderstatus) - 1 AS changes FROM orders GROUP BY o_custkey), p AS (SELECT url, (changes + 1) / CAST(crawls + 2 AS DOUBLE) AS p FROM h) SELECT url, ROUND(GREATEST(0.25E0, LEAST(30.0E0, SQRT(1 / (-LN(1 - p))))), 6) AS days FROM p")
sql("r45_rollback_check", "SELECT user_id, SUM(CASE WHEN ts >= TIMESTAMP '2024-01-15 00:00:00' THEN 1 ELSE 0 END) < 0.7 * SUM(CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 1 ELSE 0 END) AS roll_back FROM events WHERE event_type = 'click' GROUP BY user_id")
sql("r47_broken_links", "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'broken' WHEN page_id % 5 = 0 THEN 'redirect' ELSE 'ok' END AS state FROM pages")
sql("r49_dry_run", "WITH stored AS (SELECT doc_id, MD5(text) AS h FROM documents WHERE doc_id % 3 <> 0), incoming AS (SELECT doc_id, MD5(CASE WHEN doc_id % 10 = 0 THEN CONCAT(text, ' ') ELSE text END) AS h FROM documents) SELECT i.doc_id, CASE WHEN s.doc_id IS NULL THEN 'would_import' WHEN s.h <> i.h THEN 'would_update' ELSE 'would_skip' END AS action FROM incoming i LEFT JOIN stored s ON s.doc_id = i.doc_id")


def ema(values: Column, alpha: float) -> Column:
    """Exponential average of an array in its order, from its first value."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda s, x: F.coalesce(alpha * x + (1 - alpha) * s, x))


@query("n7_ema", f"WITH {TELEMETRY}, d AS (SELECT user_id, clicks, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY day) AS k, COUNT(*) OVER (PARTITION BY user_id) AS n FROM telemetry) SELECT user_id, ROUND(SUM(clicks * POWER(0.9e0, n - k) * CASE WHEN k = 1 THEN 1e0 ELSE 0.1e0 END), 6) AS ema FROM d GROUP BY user_id")
def n7(spark, sf_dir):
    tables(spark, sf_dir)
    daily = spark.sql(f"WITH {TELEMETRY} SELECT user_id, day, CAST(clicks AS DOUBLE) AS clicks FROM telemetry")
    series = daily.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "clicks"))), lambda x: x["clicks"]).alias("v"))
    return series.select("user_id", F.round(ema(F.col("v"), 0.1), 6).alias("ema"))


def elo(matches: pd.DataFrame, k: float = 32.0, scale: float = 400.0, start: float = 1500.0) -> pd.DataFrame:
    """Ratings after matches in their order."""
    ratings: dict[int, float] = {}
    for r in matches.sort_values("seq").itertuples():
        a, b = ratings.get(r.a, start), ratings.get(r.b, start)
        won = k * (r.score - 1 / (1 + 10 ** ((b - a) / scale)))
        ratings[r.a], ratings[r.b] = a + won, b - won
    return pd.DataFrame({"league": matches["league"].iloc[0], "player": list(ratings), "rating": list(ratings.values())})


@query("r26_elo")
def r26(spark, sf_dir):
    """Sequential by nature: one fold for each league, so leagues are what runs in parallel."""
    orders = load(spark, sf_dir, "orders")
    games = orders.select(F.pmod("o_custkey", F.lit(16)).cast("long").alias("league"), F.col("o_orderkey").alias("seq"), "o_custkey", (F.col("o_custkey") * 7 + F.col("o_orderkey")).alias("y"), F.col("o_orderstatus"))
    games = games.select("league", "seq", F.col("o_custkey").alias("a"), (F.pmod("y", F.lit(97)) * 16 + F.col("league")).alias("b"), F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0).otherwise(0.5).alias("score")).where("a <> b")
    return games.groupBy("league").applyInPandas(lambda p: elo(p), "league long, player long, rating double")


def slates(rows: DataFrame, trade: float = 0.65, size: int = 5, cap: float = 0.9, window: float = 0.3) -> DataFrame:
    """host, id, place, redundant: maximal marginal relevance of rows (host, id, score, vec) within each host.

    A pick is the best mix of score and distance from the host's picks so far, among its items whose score is within
    window of its best one; redundant tells that it is closer than cap to one of them. Ties: the higher score, then the
    lesser id. A round picks one item of every host: all items keep their closeness to what is chosen, which the next
    pick alone can raise, and the best one is an aggregate. So no host is a group of its own, and no item is left out.
    """
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    units = rows.select("host", "id", F.col("score").cast("double").alias("score"), F.transform("vec", lambda x: x.cast("double")).alias("vec")).withColumn("vec", F.transform("vec", lambda x: x / F.greatest(norm, F.lit(1e-300))))
    top = units.groupBy("host").agg(F.max("score").alias("top"))
    left = written(units.join(top, "host").where(F.col("score") >= F.col("top") - window).select("host", "id", "score", "vec", F.lit(0.0).alias("close")), "left")
    out = None
    for place in range(1, size + 1):
        value = trade * F.col("score") - (1 - trade) * F.col("close")
        pick = written(left.groupBy("host").agg(F.max_by(F.struct("id", "vec", "close"), F.struct(value, "score", -F.col("id"))).alias("p")).select("host", "p.*"), "pick")
        told = pick.select("host", "id", F.lit(place).cast("long").alias("place"), (F.col("close") > cap).alias("redundant"))
        out = told if out is None else out.unionByName(told)
        if place < size:
            near = F.aggregate(F.zip_with("vec", "own", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
            chosen = pick.select("host", F.col("id").alias("own_id"), F.col("vec").alias("own"))
            new = left.join(chosen, "host").where("id <> own_id").select("host", "id", "score", "vec", F.greatest("close", near).alias("close"))
            new = written(new, "left")
            dropped(left)
            left = new
    return out


@query("r15_diverse_slate")
def r15(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("host"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.pmod(F.xxhash64("vec_id"), F.lit(1000)) / 1000.0).alias("score"))
    return slates(rows)


#: Words that an overlap doesn't count; all others do, the longer list of X.STOPWORDS too.
OVERLAP_STOPWORDS = "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you".split()
_stop = ", ".join(map(repr, OVERLAP_STOPWORDS))


@query(
    "t3_top_k_by_overlap",
    f"WITH t AS (SELECT item_id, unnest(list_filter(list_distinct(regexp_extract_all(lower(text), '{X.TOKEN.replace(chr(39), chr(39) * 2)}')), lambda w: w NOT IN ({_stop}))) AS w FROM benchmark), o AS (SELECT x.item_id AS dest, y.item_id AS host, COUNT(*) AS overlap FROM t x JOIN t y ON x.w = y.w AND x.item_id <> y.item_id GROUP BY x.item_id, y.item_id) SELECT dest, host, overlap FROM (SELECT dest, host, overlap, row_number() OVER (PARTITION BY dest ORDER BY overlap DESC, host) AS rn FROM o) x WHERE rn <= 5",
)
def t3(spark, sf_dir):
    t = load(spark, sf_dir, "benchmark").select("item_id", F.explode(X.token_set(F.col("text"), OVERLAP_STOPWORDS)).alias("w"))
    x, y = t.select(F.col("item_id").alias("dest"), "w"), t.select(F.col("item_id").alias("host"), "w")
    o = x.join(y, "w").where("dest <> host").groupBy("dest", "host").agg(F.count("*").alias("overlap"))
    return o.withColumn("rn", F.row_number().over(Window.partitionBy("dest").orderBy(F.desc("overlap"), "host"))).where("rn <= 5").drop("rn")


@query("a31_distinct_sketch")
def a31(spark, sf_dir):
    """Sketches of each day merged: the union's estimate, which a distinct count bounds within a few per cent."""
    daily = load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.hll_sketch_agg("l_orderkey", 14).alias("sketch"))
    return daily.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("orders"))


@query("a33_reservoir")
def a33(spark, sf_dir):
    """A uniform sample of a fixed size, the same in every run: the rows of least hashes."""
    return load(spark, sf_dir, "events").select("event_id", "event_type").orderBy(F.xxhash64("event_id", F.lit(42)), "event_id").limit(100)
