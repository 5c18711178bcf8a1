"""Sketches kept between runs: built apart, written as binary columns, read back and merged.

A run's rows lie in a partition of their own, which a repeated run replaces, so nothing is counted twice; what is read
is the merger of all runs. Distinct counts keep the used registers of 2^14 (3 bytes each), Bloom filters their used
words in pages of 4,096, sets of ids the bitmaps of Spark's own aggregates. Rows are combined before every shuffle,
and no sketch reaches the driver.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.further import bloom_contains, bloom_filter, bloom_size
from weftline.plans.registry import load, query
from weftline.plans.rounds import shared_folder

#: Bits of a register's number; registers have a standard error of 1.04 / sqrt(2^BITS), below 1 %.
BITS = 14
PAGE = 4096


def save(rows: DataFrame, path: str, run: str) -> None:
    """rows as the partition of a run, in place of what an earlier try of that run left."""
    rows.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def saved(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def number(hexes: Column) -> Column:
    """A signed 64-bit integer from its hexadecimal digits."""
    return F.conv(hexes, 16, -10).cast("long")


def digits(n: Column, width: int) -> Column:
    return F.lpad(F.hex(n), width, "0")


def packed(entries: Column, key: int, value: int) -> Column:
    """Sorted (key, value) entries as one binary, with so many hexadecimal digits each."""
    return F.unhex(F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(digits(e["key"], key), digits(e["value"], value))), ""))


def unpacked(rows: DataFrame, column: str, key: int, value: int) -> DataFrame:
    """A row for each entry of a binary column: key and value beside the other columns."""
    size, others = (key + value) // 2, [c for c in rows.columns if c != column]
    at = rows.where(F.length(column) > 0).select("*", F.explode(F.sequence(F.lit(0), (F.length(column) / size).cast("int") - 1)).alias("_at"))
    entry = F.hex(F.expr(f"substring({column}, cast(_at * {size} + 1 as int), {size})"))
    return at.select(*others, number(F.substring(entry, 1, key)).alias("key"), number(F.substring(entry, key + 1, value)).alias("value"))


def registers(rows: DataFrame, item: str, groups: list[str]) -> DataFrame:
    """groups, key, value: the registers of the distinct items of each group. Null items don't count."""
    hexes = F.md5(F.col(item).cast("string").cast("binary"))
    head = number(F.substring(hexes, 1, 4))
    rest = F.shiftleft(F.col("head").bitwiseAND(F.lit(3)), 48) + number(F.substring("hexes", 5, 12))
    rank = F.when(F.col("rest") == 0, F.lit(51)).otherwise(51 - F.length(F.bin("rest")))
    hashed = rows.where(F.col(item).isNotNull()).select(*groups, hexes.alias("hexes"), head.alias("head")).withColumn("rest", rest)
    return hashed.groupBy(*groups, F.shiftright("head", 16 - BITS).alias("key")).agg(F.max(rank).alias("value"))


def distinct_sketch(rows: DataFrame, item: str, groups: list[str]) -> DataFrame:
    """groups and sketch: a binary of 49,152 bytes at most."""
    return registers(rows, item, groups).groupBy(*groups).agg(packed(F.collect_list(F.struct("key", "value")), 4, 2).alias("sketch"))


def merged_sketches(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """groups and sketch of the union of all sketches of a group; equal to that of all items at once."""
    most = unpacked(sketches.select(*groups, "sketch"), "sketch", 4, 2).groupBy(*groups, "key").agg(F.max("value").alias("value"))
    return most.groupBy(*groups).agg(packed(F.collect_list(F.struct("key", "value")), 4, 2).alias("sketch"))


def distinct_estimate(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """groups and estimate; small counts by the share of empty registers. Hashes of 64 bits need no upper correction."""
    m = float(1 << BITS)
    entries = unpacked(sketches.select(*groups, "sketch"), "sketch", 4, 2)
    told = entries.groupBy(*groups).agg(F.sum(F.pow(F.lit(2.0), -F.col("value"))).alias("s"), (F.lit(m) - F.count("*")).alias("empty"))
    raw = 0.7213 / (1 + 1.079 / m) * m * m / (F.col("s") + F.col("empty"))
    return told.select(*groups, F.round(F.when((raw <= 2.5 * m) & (F.col("empty") > 0), m * F.log(m / F.col("empty"))).otherwise(raw)).cast("long").alias("estimate"))


def bloom_pages(words: DataFrame) -> DataFrame:
    """page and words of a Bloom filter (word, bits): a binary of 40,960 bytes at most for 4,096 words."""
    entry = F.struct((F.col("word") % PAGE).alias("key"), F.col("bits").alias("value"))
    return words.groupBy(F.floor(F.col("word") / PAGE).alias("page")).agg(packed(F.collect_list(entry), 4, 16).alias("words"))


def merged_bloom(pages: DataFrame) -> DataFrame:
    """word and bits of the union of filters of one size."""
    rows = unpacked(pages.select("page", "words"), "words", 4, 16)
    return rows.groupBy((F.col("page") * PAGE + F.col("key")).alias("word")).agg(F.bit_or("value").alias("bits"))


def id_bitmaps(rows: DataFrame, item: str, groups: list[str]) -> DataFrame:
    """groups, bucket and bitmap of the ids (0 or more) of a group, 4 KB for 32,768 ids."""
    at = rows.where(F.col(item) >= 0).select(*groups, F.bitmap_bucket_number(item).alias("bucket"), F.bitmap_bit_position(item).alias("bit"))
    return at.groupBy(*groups, "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def bitmap_size(bitmaps: DataFrame, groups: list[str]) -> DataFrame:
    """groups and n: distinct ids of the union of all bitmaps of a group."""
    return bitmaps.groupBy(*groups, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("n")).groupBy(*groups).agg(F.sum("n").alias("n"))


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


_hashed = "SELECT {0}, MD5(CAST({1} AS VARCHAR)) AS h FROM {2}"
_registers = "SELECT {0}, (CAST('0x' || substr(h, 1, 4) AS BIGINT) >> 2) AS r, MAX(CASE WHEN rest = 0 THEN 51 ELSE 51 - length(bin(rest)) END) AS v FROM (SELECT {0}, h, (CAST('0x' || substr(h, 1, 4) AS BIGINT) & 3) * 281474976710656 + CAST('0x' || substr(h, 5, 12) AS BIGINT) AS rest FROM ({1}) x) y GROUP BY ALL"
_estimate = "SELECT {0}, CAST(ROUND(CASE WHEN 0.7213e0 / (1 + 1.079e0 / 16384) * 16384 * 16384 / (s + e) <= 40960 AND e > 0 THEN 16384 * LN(16384e0 / e) ELSE 0.7213e0 / (1 + 1.079e0 / 16384) * 16384 * 16384 / (s + e) END) AS BIGINT) AS estimate FROM (SELECT {0}, SUM(POWER(2e0, -v)) AS s, 16384 - COUNT(*) AS e FROM ({1}) z GROUP BY {0}) t"


@query("k10_distinct_snapshots", _estimate.format("l_returnflag", _registers.format("l_returnflag", _hashed.format("l_returnflag", "l_orderkey", "lineitem"))))
def k10_distinct(spark, sf_dir):
    """Orders by return flag: a sketch of every shipping year written by a run of its own, then read and merged."""
    rows = load(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    path = fresh(spark, "sketches")
    save(distinct_sketch(rows.where("year < 1996"), "l_orderkey", ["l_returnflag", "year"]), path, "first")
    save(distinct_sketch(rows.where("year >= 1996 OR year IS NULL"), "l_orderkey", ["l_returnflag", "year"]), path, "second")
    return distinct_estimate(merged_sketches(saved(spark, path), ["l_returnflag"]), ["l_returnflag"])


_bits = "(CAST('0x' || substr(d, 1, 8) AS BIGINT) + i * CAST('0x' || substr(d, 9, 8) AS BIGINT)) % m AS at"


@query(
    "k10_bloom_snapshots",
    f"""WITH size AS (SELECT CAST(CEIL(-n * LN(0.01e0) / (LN(2e0) * LN(2e0))) AS BIGINT) AS m, n FROM (SELECT COUNT(DISTINCT o_custkey) AS n FROM orders) x),
way AS (SELECT m, CAST(ROUND(m * LN(2e0) / n) AS BIGINT) AS k FROM size), seen AS (SELECT DISTINCT MD5(CAST(o_custkey AS VARCHAR)) AS d FROM orders),
bits AS (SELECT DISTINCT {_bits} FROM seen, way, range(0, 30) r(i) WHERE i < k), asked AS (SELECT c_custkey, {_bits}, k FROM (SELECT c_custkey, MD5(CAST(c_custkey AS VARCHAR)) AS d FROM customer) c, way, range(0, 30) r(i) WHERE i < k)
SELECT c_custkey, COUNT(bits.at) = MAX(k) AS member FROM asked LEFT JOIN bits ON bits.at = asked.at GROUP BY c_custkey""",
)
def k10_bloom(spark, sf_dir):
    """Customers that the merger of two runs' filters may hold: those of finished orders and those of all others."""
    orders = load(spark, sf_dir, "orders")
    m, k = bloom_size(orders.agg(F.count_distinct("o_custkey")).first()[0])
    path = fresh(spark, "filters")
    save(bloom_pages(bloom_filter(orders.where("o_orderstatus = 'F'").select("o_custkey"), m, k)), path, "finished")
    save(bloom_pages(bloom_filter(orders.where("o_orderstatus <> 'F'").select("o_custkey"), m, k)), path, "others")
    return bloom_contains(load(spark, sf_dir, "customer"), "c_custkey", merged_bloom(saved(spark, path)), m, k)


@query("k10_bitmap_snapshots", "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority")
def k10_bitmaps(spark, sf_dir):
    """Customers by priority, from bitmaps of each status written by runs of their own."""
    orders, path = load(spark, sf_dir, "orders"), fresh(spark, "bitmaps")
    save(id_bitmaps(orders.where("o_orderstatus = 'F'"), "o_custkey", ["o_orderpriority"]), path, "finished")
    save(id_bitmaps(orders.where("o_orderstatus <> 'F'"), "o_custkey", ["o_orderpriority"]), path, "others")
    return bitmap_size(saved(spark, path), ["o_orderpriority"])
