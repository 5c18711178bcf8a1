"""Membership by Bloom filter, comparison of rankings, and ranking quality of reviewed suggestions."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.registry import load, query, tables
from weftline.plans.views import REVIEWS

FALSE_POSITIVES = 0.01


def bloom_size(n: int, p: float = FALSE_POSITIVES) -> tuple[int, int]:
    """Bits and hashes of a filter of n items with a share p of false positives."""
    n = max(1, n)
    m = ceil(-n * log(p) / log(2) ** 2)
    return m, max(1, round(m / n * log(2)))


def bloom_bits(item: Column, m: int, k: int) -> Column:
    """The k bits of an item, by two halves of its MD5: first + i * second, modulo m."""
    digest = F.md5(item.cast("string").cast("binary"))
    first, second = (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.array(*(F.pmod(first + i * second, F.lit(m)) for i in range(k)))


def bloom_filter(items: DataFrame, m: int, k: int) -> DataFrame:
    """word and bits (64 of them) of the filter of the items in the first column, without empty words.

    Items are reduced to words before the shuffle; the table has m / 64 rows at most and can be kept as a snapshot,
    and two snapshots of one size are merged by union and bit_or.
    """
    at = items.select(F.explode(bloom_bits(F.col(items.columns[0]), m, k)).alias("at"))
    return at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))


def bloom_contains(rows: DataFrame, column: str, words: DataFrame, m: int, k: int) -> DataFrame:
    """The distinct values of a column with member: false if surely not in the filter, true if so but for false positives."""
    asked = rows.select(column).distinct().select(column, F.explode(bloom_bits(F.col(column), m, k)).alias("at")).withColumn("word", F.shiftright("at", 6))
    found = asked.join(words, "word", "left")
    hit = F.coalesce(F.getbit("bits", F.col("at").bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    return found.groupBy(column).agg(F.min(hit).alias("member"))


@query(
    "a32_bloom_membership",
    """WITH n AS (SELECT COUNT(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') x),
size AS (SELECT CAST(CEIL(-n * LN(0.01e0) / (LN(2e0) * LN(2e0))) AS BIGINT) AS m, n FROM n),
seen AS (SELECT DISTINCT o_custkey AS item, MD5(CAST(o_custkey AS VARCHAR)) AS d FROM orders WHERE o_orderstatus = 'F'),
bits AS (SELECT DISTINCT (CAST('0x' || substr(d, 1, 8) AS BIGINT) + i * CAST('0x' || substr(d, 9, 8) AS BIGINT)) % m AS at FROM seen, size, range(0, 7) r(i)),
asked AS (SELECT c_custkey, (CAST('0x' || substr(d, 1, 8) AS BIGINT) + i * CAST('0x' || substr(d, 9, 8) AS BIGINT)) % m AS at FROM (SELECT c_custkey, MD5(CAST(c_custkey AS VARCHAR)) AS d FROM customer) c, size, range(0, 7) r(i))
SELECT c_custkey, COUNT(bits.at) = 7 AS member FROM asked LEFT JOIN bits ON bits.at = asked.at GROUP BY c_custkey""",
)
def a32(spark, sf_dir):
    """Customers that the filter of those with a finished order may hold."""
    seen = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey").distinct()
    m, k = bloom_size(seen.count())
    return bloom_contains(load(spark, sf_dir, "customer"), "c_custkey", bloom_filter(seen, m, k), m, k)


def rank_of_relevant(rows: DataFrame, better: Column) -> DataFrame:
    """query and rank of its relevant item, by counting the items before it: pre-aggregated, so no query's items are sorted."""
    return rows.groupBy("query").agg((F.sum(better.cast("long")) + 1).alias("rank"))


def ranking_quality(ranks: DataFrame, at: int = 10) -> list[Column]:
    """MRR, NDCG and recall at a depth, with one relevant item for each query."""
    near = F.col("rank") <= at
    mean = lambda gain: F.round(F.avg(F.when(near, gain).otherwise(0.0)), 9)
    return [F.count("*").alias("queries"), mean(1.0 / F.col("rank")).alias("mrr"), mean(1.0 / F.log2(F.col("rank") + 1)).alias("ndcg"), mean(F.lit(1.0)).alias("recall")]


@query(
    "v9_ranking_bake_off",
    f"""WITH {REVIEWS}, placed AS (SELECT destination, suggestion, status, row_number() OVER (PARTITION BY destination ORDER BY score DESC, suggestion) AS by_score, row_number() OVER (PARTITION BY destination ORDER BY reviewed_at DESC, suggestion) AS by_date, row_number() OVER (PARTITION BY destination, status ORDER BY suggestion DESC) AS last FROM reviews),
r AS (SELECT 'by_score' AS provider, by_score AS rank FROM placed WHERE status = 'approved' AND last = 1 UNION ALL SELECT 'by_date', by_date FROM placed WHERE status = 'approved' AND last = 1)
SELECT provider, COUNT(*) AS queries, ROUND(AVG(CASE WHEN rank <= 10 THEN 1e0 / rank ELSE 0e0 END), 9) AS mrr, ROUND(AVG(CASE WHEN rank <= 10 THEN LN(2e0) / LN(rank + 1) ELSE 0e0 END), 9) AS ndcg, ROUND(AVG(CASE WHEN rank <= 10 THEN 1e0 ELSE 0e0 END), 9) AS recall FROM r GROUP BY provider""",
)
def v9(spark, sf_dir):
    """How high two orders of a destination's suggestions put the one that was approved last."""
    tables(spark, sf_dir)
    rows = spark.sql(f"WITH {REVIEWS} SELECT destination AS query, suggestion, score, reviewed_at, status FROM reviews")
    relevant = rows.where("status = 'approved'").groupBy("query").agg(F.max(F.struct("suggestion", "score", "reviewed_at")).alias("best"))
    both = rows.join(relevant, "query")
    out = None
    for provider, by in (("by_score", "score"), ("by_date", "reviewed_at")):
        better = (F.col(by) > F.col(f"best.{by}")) | ((F.col(by) == F.col(f"best.{by}")) & (F.col("suggestion") < F.col("best.suggestion")))
        ranks = rank_of_relevant(both, better)
        one = ranks.agg(*ranking_quality(ranks)).select(F.lit(provider).alias("provider"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "r33_reviewed_ndcg",
    f"""WITH {REVIEWS}, labelled AS (SELECT destination, suggestion, score, 'origin' || CAST(host % 3 AS VARCHAR) AS origin, CASE WHEN status = 'approved' THEN 1 ELSE 0 END AS y FROM reviews WHERE status <> 'pending'),
spread AS (SELECT * FROM labelled UNION ALL SELECT destination, suggestion, score, 'all', y FROM labelled),
placed AS (SELECT origin, destination, y, row_number() OVER (PARTITION BY origin, destination ORDER BY score DESC, suggestion) AS rank, row_number() OVER (PARTITION BY origin, destination ORDER BY y DESC, suggestion) AS best FROM spread),
lists AS (SELECT origin, destination, SUM(y * LN(2e0) / LN(rank + 1)) / SUM(y * LN(2e0) / LN(best + 1)) AS ndcg FROM placed GROUP BY origin, destination HAVING SUM(y) > 0) SELECT origin, COUNT(*) AS lists, ROUND(AVG(ndcg), 9) AS ndcg FROM lists GROUP BY origin""",
)
def r33_ndcg(spark, sf_dir):
    """Mean NDCG (gain 2^y - 1) of the reviewed suggestions of each destination, overall and by origin; lists without an approval don't count."""
    tables(spark, sf_dir)
    rows = spark.sql(f"WITH {REVIEWS} SELECT destination, suggestion, score, CONCAT('origin', host % 3) AS own, IF(status = 'approved', 1, 0) AS y FROM reviews WHERE status <> 'pending'")
    spread = rows.withColumn("origin", F.explode(F.array("own", F.lit("all"))))
    place = F.row_number().over(Window.partitionBy("origin", "destination").orderBy(F.desc("score"), "suggestion"))
    gains = spread.select("origin", "destination", "y", ((F.pow(F.lit(2.0), F.col("y")) - 1) / F.log2(place + 1)).alias("gain"))
    lists = gains.groupBy("origin", "destination").agg(F.sum("gain").alias("dcg"), F.sum("y").cast("int").alias("good")).where("good > 0")
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("good")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return lists.groupBy("origin").agg(F.count("*").alias("lists"), F.round(F.avg(F.col("dcg") / ideal), 9).alias("ndcg"))
