"""Further scores: composite ranking, vectors of queries, calibration, selection, models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import graph, vectors
from weftline.plans.registry import load, query, sql, tables
from weftline.plans.views import EDGES, REVIEWS, SEARCH, SESSIONS, SNAPSHOTS, TELEMETRY

#: Default weights of the composite score.
WEIGHTS = {"semantic": 0.40, "keyword": 0.25, "node": 0.20, "quality": 0.15}
_tok = "regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z0-9]+)?')"

sql("k13_edge_history_merge", "WITH now AS (SELECT DISTINCT o_custkey AS src, o_orderkey % 50 AS dst FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'), old AS (SELECT o_custkey AS src, o_orderkey % 50 AS dst, MIN(o_orderdate) AS first_seen FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY o_custkey, o_orderkey % 50) SELECT COALESCE(n.src, o.src) AS src, COALESCE(n.dst, o.dst) AS dst, COALESCE(first_seen, TIMESTAMP '1998-01-01 00:00:00') AS first_seen, n.src IS NOT NULL AS is_active FROM now n FULL OUTER JOIN old o ON n.src = o.src AND n.dst = o.dst")
sql("k17_batch_apply", f"WITH {REVIEWS} SELECT suggestion, CASE WHEN host % 5 = 1 THEN score / 600000 ELSE 0.0E0 END AS value FROM reviews")
sql("a34_totals_by_node", "SELECT user_id % 10 AS node, COUNT(*) AS n, MAX(event_type) AS most, CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM events GROUP BY user_id % 10")
sql("x39_collocation_pmi", f"WITH {SESSIONS}, n AS (SELECT page, CAST(COUNT(*) AS DOUBLE) AS n FROM sessions GROUP BY page), t AS (SELECT CAST(COUNT(DISTINCT session) AS DOUBLE) AS total FROM sessions), j AS (SELECT x.page AS a, y.page AS b, CAST(COUNT(*) AS DOUBLE) AS co FROM sessions x JOIN sessions y ON x.session = y.session AND x.page < y.page GROUP BY x.page, y.page) SELECT a, b, ROUND(LN(co * total / (x.n * y.n)) / LN(2), 6) AS pmi FROM j JOIN n x ON x.page = a JOIN n y ON y.page = b, t")
sql("g18_signal_sum", f"WITH {EDGES}, o AS (SELECT src, COUNT(*) AS n FROM edges GROUP BY src), i AS (SELECT dst, COUNT(*) AS n FROM edges GROUP BY dst) SELECT s_suppkey, ROUND(0.05E0 * COALESCE(1.0E0 / (1 + o.n), 0.0E0) + 0.03E0 * COALESCE(CAST(i.n AS DOUBLE) / 100, 0.0E0), 6) AS total FROM supplier LEFT JOIN o ON o.src = s_suppkey LEFT JOIN i ON i.dst = s_suppkey")
sql(
    "v11_query_tfidf",
    f"""WITH {SEARCH}, tf AS (SELECT item, query, CAST(SUM(clicks) AS DOUBLE) AS tf, COUNT(DISTINCT day) AS days FROM search GROUP BY item, query), n AS (SELECT CAST(COUNT(DISTINCT item) AS DOUBLE) AS n FROM tf), df AS (SELECT query, COUNT(*) AS df FROM tf GROUP BY query),
w AS (SELECT item, tf.query, tf * LN(1 + n / (1 + df)) AS w FROM tf JOIN df ON df.query = tf.query, n) SELECT item, query, ROUND(w / SQRT(SUM(w * w) OVER (PARTITION BY item)), 6) AS weight FROM w""",
)
sql(
    "g17_query_alignment",
    f"""WITH {SEARCH}, tf AS (SELECT item, query, CAST(SUM(clicks) AS DOUBLE) AS w FROM search GROUP BY item, query), n AS (SELECT item, SQRT(SUM(w * w)) AS norm FROM tf GROUP BY item), {REVIEWS}, asked AS (SELECT DISTINCT host, destination FROM reviews)
SELECT x.item AS a, y.item AS b, ROUND(SUM(x.w * y.w) / MAX(m.norm * k.norm), 6) AS cosine FROM asked JOIN tf x ON x.item = host JOIN tf y ON y.item = destination AND x.query = y.query JOIN n m ON m.item = x.item JOIN n k ON k.item = y.item GROUP BY x.item, y.item""",
)
sql(
    "r1_composite_score",
    f"WITH {REVIEWS} SELECT suggestion, {WEIGHTS['semantic']}E0 * (host % 100) / 100 + {WEIGHTS['keyword']}E0 * (destination % 10) / 10 + {WEIGHTS['node']}E0 * CASE WHEN host % 5 = destination % 5 THEN 1.0E0 ELSE 0.3E0 END + {WEIGHTS['quality']}E0 * score / 600000 AS final FROM reviews",
)
sql("r2_weights", " UNION ALL ".join(f"SELECT '{k}' AS name, {v}E0 AS weight" for k, v in WEIGHTS.items()))
sql("r7_rare_terms", "WITH t AS (SELECT DISTINCT o_custkey AS doc, l_partkey AS term FROM orders JOIN lineitem ON l_orderkey = o_orderkey), d AS (SELECT term, COUNT(*) AS df FROM t GROUP BY term), c AS (SELECT c_nationkey AS nation, term, COUNT(*) AS support FROM t JOIN customer ON c_custkey = doc GROUP BY c_nationkey, term) SELECT nation, c.term, ROUND(0.35E0 * LEAST(1.0E0, support / 3.0E0) + 0.20E0 / df + 0.45E0, 6) AS evidence FROM c JOIN d ON d.term = c.term WHERE support >= 2 AND df <= 40")
sql("r34_sequential_test", f"WITH {REVIEWS}, c AS (SELECT host % 2 AS arm, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(CASE WHEN status = 'approved' THEN 1 ELSE 0 END) AS DOUBLE) AS ok FROM reviews WHERE status <> 'pending' GROUP BY host % 2) SELECT arm, ROUND(ok * LN(0.55E0 / 0.50E0) + (n - ok) * LN(0.45E0 / 0.50E0), 6) AS llr, CASE WHEN ok * LN(0.55E0 / 0.50E0) + (n - ok) * LN(0.45E0 / 0.50E0) >= LN(19) THEN 'promote' WHEN ok * LN(0.55E0 / 0.50E0) + (n - ok) * LN(0.45E0 / 0.50E0) <= -LN(19) THEN 'reject' ELSE 'go_on' END AS verdict FROM c")
sql("r37_cosine_schedule", "SELECT c_custkey AS step, ROUND(0.001E0 + 0.5E0 * (0.1E0 - 0.001E0) * (1 + COS(PI() * c_custkey / 1500)), 9) AS rate FROM customer WHERE c_custkey <= 1500")
sql("r41_sidecar_sum", f"WITH {TELEMETRY} SELECT user_id, ROUND(0.05E0 * CAST(SUM(clicks) AS DOUBLE) / SUM(sessions) + 0.03E0 * CAST(SUM(engaged) AS DOUBLE) / SUM(sessions) - 0.02E0 * CAST(SUM(quick_exit) AS DOUBLE) / SUM(sessions), 6) AS total FROM telemetry GROUP BY user_id")
sql("r42_linear_attribution", f"WITH {REVIEWS}, x AS (SELECT suggestion, (host % 100) / 100.0E0 AS semantic, (destination % 10) / 10.0E0 AS keyword FROM reviews), b AS (SELECT AVG(semantic) AS s, AVG(keyword) AS k FROM x) SELECT suggestion, 'semantic' AS feature, ROUND(0.4E0 * (semantic - s), 6) AS share FROM x, b UNION ALL SELECT suggestion, 'keyword', ROUND(0.25E0 * (keyword - k), 6) FROM x, b")
_eta = "WITH l AS (SELECT o_orderpriority AS mode, o_totalprice, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) SELECT mode, ROUND(MEDIAN(o_totalprice), 4) AS eta FROM l WHERE rn <= 20 GROUP BY mode HAVING COUNT(*) >= 3"
sql("r44_eta_median", _eta)
sql("r48_import_changes", "WITH stored AS (SELECT doc_id, MD5(text) AS h, 1 AS version FROM documents WHERE doc_id % 4 <> 0), incoming AS (SELECT doc_id, MD5(CASE WHEN doc_id % 6 = 0 THEN CONCAT(text, '!') ELSE text END) AS h FROM documents) SELECT i.doc_id, COALESCE(version, 0) + 1 AS version FROM incoming i LEFT JOIN stored s ON s.doc_id = i.doc_id WHERE s.doc_id IS NULL OR s.h <> i.h")
sql("r46_readiness", f"WITH {TELEMETRY}, {REVIEWS} SELECT 'telemetry' AS prerequisite, COUNT(*) >= 100 AS ready FROM telemetry UNION ALL SELECT 'reviews', COUNT(*) >= 50 FROM reviews WHERE status <> 'pending'")


@query("x27_feature_hash", f"WITH w AS (SELECT DISTINCT unnest({_tok}) AS w FROM benchmark), h AS (SELECT w, list_reduce(list_transform(string_split(w, ''), lambda c: CAST(ord(c) AS UBIGINT)), lambda h, b: (xor(h, b) * CAST(16777619 AS UBIGINT)) % CAST(4294967296 AS UBIGINT), CAST(2166136261 AS UBIGINT)) AS h FROM w) SELECT CAST(h % 1024 AS INTEGER) AS bucket, COUNT(*) AS n FROM h GROUP BY CAST(h % 1024 AS INTEGER)")
def x27(spark, sf_dir):
    """Tokens by FNV-1a mod 1024."""

    def fnv(words: pd.Series) -> pd.Series:
        out = []
        for w in words:
            h = 2166136261
            for b in w.encode():
                h = ((h ^ b) * 16777619) & 0xFFFFFFFF
            out.append(h % 1024)
        return pd.Series(out, dtype="int32")

    words = load(spark, sf_dir, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("w")).distinct()
    return words.groupBy(F.pandas_udf(fnv, "int")("w").alias("bucket")).agg(F.count("*").alias("n"))


@query("x34_phrase_inventory", f"WITH t AS (SELECT item_id, {_tok} AS w FROM benchmark), p AS (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM t) SELECT item_id, COUNT(DISTINCT array_to_string(list_slice(w, i, i + 1), ' ')) AS phrases FROM p GROUP BY item_id")
def x34(spark, sf_dir):
    t = load(spark, sf_dir, "benchmark").select("item_id", X.tokens(F.col("text")).alias("w")).where(F.size("w") > 1)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, F.lit(2)), " "))
    return t.select("item_id", F.size(F.array_distinct(grams)).cast("long").alias("phrases"))


@query("x36_longest_overlap")
def x36(spark, sf_dir):
    def longest(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            best, last = 0, [0] * (len(y) + 1)
            for u in x:
                row = [0]
                for j, v in enumerate(y):
                    row.append(last[j] + 1 if u == v else 0)
                best, last = max(best, *row), row
            out.append(best)
        return pd.Series(out, dtype="int32")

    t = load(spark, sf_dir, "benchmark").select("item_id", X.tokens(F.col("text")).alias("w"))
    after = t.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("next"))
    return t.join(after, "item_id").select("item_id", F.pandas_udf(longest, "int")("w", "next").alias("overlap"))


@query("x40_bigram_fluency", f"WITH t AS (SELECT item_id, {_tok} AS w FROM benchmark), g AS (SELECT item_id, unnest(list_slice(w, 1, len(w) - 1)) AS a, unnest(list_slice(w, 2, len(w))) AS b FROM t), c AS (SELECT a, b, CAST(COUNT(*) AS DOUBLE) AS n FROM g GROUP BY a, b), u AS (SELECT a, SUM(n) AS n FROM c GROUP BY a), v AS (SELECT CAST(COUNT(DISTINCT a) AS DOUBLE) AS v FROM g) SELECT item_id, ROUND(EXP(-AVG(LN((c.n + 1) / (u.n + v)))), 4) AS perplexity FROM g JOIN c ON c.a = g.a AND c.b = g.b JOIN u ON u.a = g.a, v GROUP BY item_id")
def x40(spark, sf_dir):
    t = load(spark, sf_dir, "benchmark").select("item_id", X.tokens(F.col("text")).alias("w")).where(F.size("w") > 1)
    pairs = t.select("item_id", F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))).alias("g")).select("item_id", "g.a", "g.b")
    c = pairs.groupBy("a", "b").agg(F.count("*").cast("double").alias("n"))
    u = c.groupBy("a").agg(F.sum("n").alias("m"))
    v = F.broadcast(u.agg(F.count("*").cast("double").alias("v")))  # one row
    return pairs.join(c, ["a", "b"]).join(u, "a").join(v).groupBy("item_id").agg(F.round(F.exp(-F.avg(F.log((F.col("n") + 1) / (F.col("m") + F.col("v"))))), 4).alias("perplexity"))


@query("v5_vector_clusters")
def v5(spark, sf_dir):
    """Clusters of close vectors; vectors that are equal have the cluster of the first of them."""
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return vector_clusters(rows, 0.9)


def vector_clusters(rows, least):
    """id and cluster (the least id in it) of every vector in rows (id, vec)."""
    pairs = vectors.close_pairs(rows, least).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    first = rows.groupBy("vec").agg(F.min("id").alias("first"))
    named = first.join(graph.labels(pairs), F.col("first") == F.col("node"), "left").select("vec", F.coalesce("root", "first").alias("cluster"))
    return rows.select("id", "vec").join(named, "vec").select("id", "cluster")


@query("v6_product_codes")
def v6(spark, sf_dir):
    """A codebook for each of eight parts, fitted by k-means on a bounded sample; every vector is encoded."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = rows
    for part in range(8):
        piece = rows.select("vec_id", array_to_vector(F.transform(F.slice("embedding", part * 8 + 1, 8), lambda x: x.cast("double"))).alias("features"))
        model = KMeans(k=16, seed=1, maxIter=5).fit(piece.orderBy(F.xxhash64("vec_id")).limit(2000))
        out = out.join(model.transform(piece).select("vec_id", F.col("prediction").alias(f"c{part}")), "vec_id")
    return out.select("vec_id", *(f"c{p}" for p in range(8)))


@query("r24_uplift")
def r24(spark, sf_dir):
    """Chance that the later rate is higher, by draws from both posteriors; the seed is the item's."""
    daily = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("ts") < "2024-01-15").alias("a"), F.count_if(F.col("ts") >= "2024-01-15").alias("b"))

    def run(item: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for i, x, y in zip(item, a, b):
            r = np.random.default_rng(int(i))
            out.append(float((r.gamma(y + 1, 1 / 16, 10_000) > r.gamma(x + 1, 1 / 14, 10_000)).mean()))
        return pd.Series(out)

    return daily.select("user_id", F.pandas_udf(run, "double")("user_id", "a", "b").alias("chance"))


@query("r29_platt")
def r29(spark, sf_dir):
    """Slope and intercept of a logistic fit of approval on the score."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    tables(spark, sf_dir)
    rows = spark.sql(f"WITH {REVIEWS} SELECT score / 600000 AS s, CASE WHEN status = 'approved' THEN 1.0D ELSE 0.0D END AS label FROM reviews WHERE status <> 'pending'")
    model = LogisticRegression(maxIter=20).fit(VectorAssembler(inputCols=["s"], outputCol="features").transform(rows))
    return spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "a double, b double")


@query("r33_bootstrap_interval")
def r33(spark, sf_dir):
    """Means of Poisson resamples, whose draws depend on the row and the round only, so any partitioning gives them."""
    tables(spark, sf_dir)
    rows = spark.sql(f"WITH {REVIEWS} SELECT suggestion, CASE WHEN status = 'approved' THEN 1.0D ELSE 0.0D END AS y FROM reviews WHERE status <> 'pending'")
    rounds = rows.select("y", F.explode(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda k: F.struct(k.alias("k"), (F.pmod(F.xxhash64("suggestion", k), F.lit(10_000)) / 10_000.0).alias("u")))).alias("r"))
    draws = F.expr("CASE WHEN r.u < 0.3679 THEN 0 WHEN r.u < 0.7358 THEN 1 WHEN r.u < 0.9197 THEN 2 WHEN r.u < 0.9810 THEN 3 ELSE 4 END")
    means = rounds.groupBy("r.k").agg((F.sum(F.col("y") * draws) / F.sum(draws)).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


@query("r38_topics")
def r38(spark, sf_dir):
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    docs = load(spark, sf_dir, "benchmark").select("item_id", X.token_set(F.col("text")).alias("w"))
    counts = CountVectorizer(inputCol="w", outputCol="features", vocabSize=2000).fit(docs).transform(docs)
    return LDA(k=4, maxIter=5, seed=1).fit(counts).describeTopics(5).select("topic", "termIndices")


@query("r39_implicit_ranking")
def r39(spark, sf_dir):
    """Implicit-feedback factors by alternating least squares, the nearest that is built in."""
    from pyspark.ml.recommendation import ALS

    seen = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("int").alias("user"), F.pmod("o_orderkey", F.lit(97)).cast("int").alias("item")).agg(F.count("*").cast("float").alias("rating"))
    model = ALS(userCol="user", itemCol="item", ratingCol="rating", implicitPrefs=True, rank=8, maxIter=3, seed=1).fit(seen)
    return model.recommendForAllUsers(3).select("user", F.explode("recommendations").alias("r")).select("user", F.col("r.item").alias("item"))


@query("r40_factorization_machine")
def r40(spark, sf_dir):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import FMRegressor

    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") / 100_000).alias("label"))
    data = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(rows)
    return FMRegressor(factorSize=2, maxIter=3, seed=1).fit(data).transform(data).select("l_orderkey", "l_linenumber", "prediction")
