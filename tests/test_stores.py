"""Sinks: jobs that run again, rows that are ignored, replaced and archived, writers that are lost."""

from datetime import date, datetime

from pyspark.sql import functions as F

from weftline.sources import stores


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_jobs_and_ignored_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda *r: spark.createDataFrame(r, "k long, v string")
    stores.append(df((1, "a"), (2, "b")), path, "one")
    stores.append(df((3, "lost")), path, "two")
    stores.append(df((4, "d"), (4, "d")), path, "two")
    assert rows(spark.read.parquet(path)) == [(1, "a", "one"), (2, "b", "one"), (4, "d", "two"), (4, "d", "two")]
    for _ in range(2):
        stores.insert_or_ignore(df((1, "new"), (5, "e"), (5, "e"), (None, "n")), path, ["k"], "three")
    assert [r for r in rows(spark.read.parquet(path)) if r[2] == "three"] == [(5, "e", "three"), (None, "n", "three")]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda *r: spark.createDataFrame(r, "d long, s string, x int")
    stores.publish(df((1, "pending", 0), (1, "approved", 1), (2, "pending", 2), (None, "pending", 3), (1, None, 4)), path)
    (tmp_path / "t" / "v000000002").mkdir()  # a writer that was lost
    assert stores.current(spark, path).count() == 5
    stores.replace_pending(df((1, "pending", 9)), path, ["d"], F.col("s") == "pending")
    assert rows(stores.current(spark, path).select("x")) == [(1,), (2,), (3,), (4,), (9,)]
    for _ in range(3):
        stores.publish(df((7, "only", 7)), path)
    assert rows(stores.current(spark, path)) == [(7, "only", 7)] and len(list((tmp_path / "t").iterdir())) == 2
    stores.publish(df().limit(0), path)
    assert stores.current(spark, path).count() == 0


def test_archive(spark, tmp_path):
    path, archive = str(tmp_path / "t"), str(tmp_path / "a")
    df = lambda *r: spark.createDataFrame(r, "id long, v string")
    stores.publish(df((1, "a"), (2, "b"), (3, None)), path)
    new = df((1, "a"), (2, "B"), (3, "c"), (4, "d"))
    stores.supersede(new, path, archive, "id", "j", F.lit(datetime(2024, 1, 1)))
    assert rows(stores.current(spark, path)) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    kept = spark.read.parquet(archive)
    assert rows(kept.select("id", "v")) == [(2, "b"), (3, None)]
    old = kept.withColumn("verified", F.col("id") == 2)
    gone = lambda day: [r.id for r in old.where(stores.prunable(old, F.lit(day))).collect()]
    assert gone(date(2024, 1, 5)) == [] and gone(date(2024, 1, 20)) == [2]
