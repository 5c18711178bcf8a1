"""Sinks that write: appends by job, inserts that ignore what is stored, replacements, archives.

An appended table has a partition for each job, which a repeated job replaces. A replaced table is a folder of whole
versions; readers take the last one that ended, so a writer that is lost leaves the table as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.registry import load, query, tables
from weftline.plans.views import REVIEWS
from weftline.sources import writers
from weftline.sources.snapshots import fresh


def append(rows: DataFrame, path: str, job: str) -> None:
    """rows as those of a job, in place of what an earlier try of that job left; other jobs' rows stay."""
    rows.withColumn("job", F.lit(job)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job").parquet(path)


def insert_or_ignore(rows: DataFrame, path: str, keys: list[str], job: str) -> None:
    """Append the rows whose keys no other job stored; of rows that share keys one is kept. Null keys never meet."""
    stored = rows.sparkSession.read.parquet(path).where(F.col("job") != job)
    append(rows.dropDuplicates(keys).join(stored.select(keys), keys, "left_anti").select(rows.columns), path, job)


def _versions(spark: SparkSession, path: str) -> tuple[list[int], object, object]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    names = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    done = [int(p.getName().removeprefix("v")) for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(done), fs, jvm.org.apache.hadoop.fs.Path


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last whole version of a replaced table."""
    done, _, _ = _versions(spark, path)
    return spark.read.parquet(f"{path}/v{done[-1]:09d}")


def publish(rows: DataFrame, path: str, kept: int = 2) -> None:
    """rows as the next version; versions before the last few go, and readers that began keep theirs until then."""
    spark = rows.sparkSession
    done, fs, to = _versions(spark, path)
    rows.write.mode("overwrite").parquet(f"{path}/v{(done[-1] if done else 0) + 1:09d}")
    for old in done[: max(0, len(done) + 1 - kept)]:
        fs.delete(to(f"{path}/v{old:09d}"), True)


def replace_pending(rows: DataFrame, path: str, keys: list[str], pending: Column) -> None:
    """Publish the stored rows without the pending ones that share keys with rows, and rows."""
    stored = current(rows.sparkSession, path)
    opened = F.coalesce(pending, F.lit(False))
    left = stored.where(opened).join(rows.select(keys).distinct(), keys, "left_anti")
    publish(stored.where(~opened).unionByName(left.select(stored.columns)).unionByName(rows.select(stored.columns)), path)


def supersede(rows: DataFrame, path: str, archive: str, key: str, job: str, archived_at: Column) -> None:
    """Archive the stored rows that rows change, then publish the table with rows in their place.

    The archive is written first and by job: a run that is lost in between archives the same rows again, not twice.
    """
    stored = current(rows.sparkSession, path)
    values = [c for c in stored.columns if c != key]
    new = rows.select(key, F.struct(*values).alias("_new"))
    changed = stored.join(new, key).where(~F.struct(*values).eqNullSafe(F.col("_new"))).select(stored.columns)
    append(changed.withColumns({"archived_at": archived_at, "verified": F.lit(False)}), archive, job)
    publish(writers.replace(stored, rows, [key]), path)


def prunable(archived: DataFrame, today: Column, days: int = 7) -> Column:
    """Whether an archived row may go: verified and older than so many days; nulls stay."""
    return F.coalesce(F.col("verified") & (F.col("archived_at") < F.date_sub(today, days)), F.lit(False))


@query("k1_bulk_insert", "SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 'first' ELSE 'second' END AS job FROM orders")
def k1(spark, sf_dir):
    """Orders appended by two jobs, one of which ran twice."""
    orders, path = load(spark, sf_dir, "orders"), fresh(spark, "inserted")
    rows = lambda which: orders.where(which).select("o_orderkey", "o_custkey", "o_totalprice")
    append(rows("o_orderstatus = 'F'"), path, "first")
    append(rows("o_orderstatus = 'O'"), path, "second")
    append(rows("o_orderstatus <> 'F'"), path, "second")
    return spark.read.parquet(path).select("o_orderkey", "o_custkey", "o_totalprice", F.col("job").cast("string").alias("job"))


@query("k5_ignored_inserts", "SELECT s_suppkey AS k, s_acctbal AS v FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def k5(spark, sf_dir):
    """Customers written beside suppliers where no supplier has their key; the job ran twice."""
    path = fresh(spark, "ignored")
    append(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")), path, "stored")
    for _ in range(2):
        insert_or_ignore(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), path, ["k"], "new")
    return spark.read.parquet(path).select("k", "v")


@query("k7_replaced_pending", f"WITH {REVIEWS}, fresh AS (SELECT suggestion + 1000000 AS suggestion, destination, status FROM reviews WHERE host % 7 = 0) SELECT * FROM fresh UNION ALL SELECT suggestion, destination, status FROM reviews WHERE status <> 'pending' OR destination NOT IN (SELECT destination FROM fresh)")
def k7(spark, sf_dir):
    """Pending suggestions of destinations that get new ones, replaced in a stored table."""
    tables(spark, sf_dir)
    path = fresh(spark, "pending")
    publish(spark.sql(f"WITH {REVIEWS} SELECT suggestion, destination, status FROM reviews"), path)
    new = spark.sql(f"WITH {REVIEWS} SELECT suggestion + 1000000 AS suggestion, destination, status FROM reviews WHERE host % 7 = 0")
    replace_pending(new, path, ["destination"], F.col("status") == "pending")
    return current(spark, path)


@query("k15_superseded_vectors", "SELECT 'current' AS place, vec_id, CASE WHEN label = 3 THEN 30 ELSE label END AS label FROM embeddings UNION ALL SELECT 'archive', vec_id, label FROM embeddings WHERE label = 3")
def k15(spark, sf_dir):
    """Labels changed in a stored table, with the rows that they replace in an archive."""
    path, archive = fresh(spark, "vectors"), fresh(spark, "archive")
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    publish(rows, path)
    supersede(rows.withColumn("label", F.when(F.col("label") == 3, 30).otherwise(F.col("label"))), path, archive, "vec_id", "relabel", F.current_timestamp())
    told = current(spark, path).withColumn("place", F.lit("current")).unionByName(spark.read.parquet(archive).select("vec_id", "label", F.lit("archive").alias("place")))
    return told.select("place", "vec_id", "label")
