"""Selection of suggestions: at most one for a destination, under guards that suggestions set each other.

The meaning is that of one pass over all candidates in order of score: a candidate is chosen unless its destination
has one already, its host has as many as it may have, the reverse link was chosen, or a chosen sentence of the host
is too near. The pass is computed in rounds of locally dominant choices. In a round a candidate is chosen if it is its
destination's first open one and would be chosen whatever becomes of the open ones before it; then all that the
chosen ones rule out are closed. The first open candidate of all is always decided, so the rounds end, and by
induction over the order every decision is that of the pass. No task sees all candidates, or all of a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.registry import query, tables
from weftline.plans.rounds import dropped, written
from weftline.plans.views import REVIEWS

#: Suggestions of one host at most, and sentences between two of them at least.
PER_HOST, APART = 3, 3


def near(a: Column, b: Column, apart: int) -> Column:
    """Whether two sentences of a host are too near; a sentence without a position is near none."""
    return F.coalesce(F.abs(a - b) <= apart, F.lit(False))


def of_hosts(chosen: DataFrame) -> DataFrame:
    """host and own: key and position of its chosen candidates, PER_HOST at most."""
    return chosen.groupBy("host").agg(F.collect_list(F.struct("key", "position")).alias("own"))


def earlier(own: Column) -> Column:
    return F.filter(F.coalesce(own, F.array().cast("array<struct<key:struct<a:double,b:double,destination:bigint,id:bigint>,position:bigint>>")), lambda o: o["key"] < F.col("key"))


def dominant(opened: DataFrame, chosen: DataFrame, per_host: int, apart: int) -> DataFrame:
    """The open candidates that would be chosen whatever becomes of the open ones before them."""
    # only a host's first few open candidates can be; both ranks are cut off where the rows are read, before the shuffle
    by_host = Window.partitionBy("host").orderBy("key")
    front = opened.withColumn("place", F.row_number().over(by_host)).where(F.col("place") <= per_host)
    front = front.withColumn("before", F.collect_list("position").over(by_host.rowsBetween(Window.unboundedPreceding, -1)))
    front = front.join(of_hosts(chosen), "host", "left").withColumn("own", earlier(F.col("own")))
    first = opened.withColumn("place", F.row_number().over(Window.partitionBy("destination").orderBy("key"))).where(F.col("place") <= 1)
    free = F.size("own") + F.col("place") <= per_host
    clear = ~F.exists("before", lambda p: near(p, F.col("position"), apart))
    may = front.where(free & clear).join(first.select("id"), "id", "left_semi").select("id", "destination", "host", "key", "position", "mutual")
    back = opened.where("mutual").select(F.col("host").alias("back_host"), F.col("destination").alias("back_destination"), F.col("key").alias("back_key"))
    waits = (F.col("back_host") == F.col("destination")) & (F.col("back_destination") == F.col("host")) & (F.col("back_key") < F.col("key"))
    return may.where("NOT mutual").unionByName(may.where("mutual").join(back, waits, "left_anti"))


def ruled_out(opened: DataFrame, chosen: DataFrame, per_host: int, apart: int) -> DataFrame:
    """The candidates that stay open once these are chosen."""
    left = opened.join(chosen.select("id"), "id", "left_anti").join(chosen.select("destination"), "destination", "left_anti")
    left = left.join(of_hosts(chosen), "host", "left").withColumn("own", earlier(F.col("own")))
    left = left.where((F.size("own") < per_host) & ~F.exists("own", lambda o: near(o["position"], F.col("position"), apart))).drop("own")
    back = chosen.where("mutual").select(F.col("host").alias("back_host"), F.col("destination").alias("back_destination"), F.col("key").alias("back_key"))
    reverse = F.col("mutual") & (F.col("back_host") == F.col("destination")) & (F.col("back_destination") == F.col("host")) & (F.col("back_key") < F.col("key"))
    return left.join(back, reverse, "left_anti").select("id", "destination", "host", "key", "position", "mutual")


def select(candidates: DataFrame, per_host: int = PER_HOST, apart: int = APART) -> DataFrame:
    """id, destination, host, score and semantic of the chosen ones among candidates (these columns and position).

    Order: score, then semantic, descending; then destination and id. Rows that repeat an id count once. Rows without
    an id, destination, host or score are no candidates.
    """
    rows = candidates.select(F.col("id").cast("long"), F.col("destination").cast("long"), F.col("host").cast("long"), F.col("score").cast("double"), F.coalesce(F.col("semantic").cast("double"), F.lit(0.0)).alias("semantic"), F.col("position").cast("long"))
    rows = rows.dropna(subset=["id", "destination", "host", "score"]).dropDuplicates(["id"])
    key = F.struct((-F.col("score")).alias("a"), (-F.col("semantic")).alias("b"), "destination", "id")
    rows = rows.select("id", "destination", "host", key.alias("key"), "position")
    pairs = rows.select(F.col("destination").alias("host"), F.col("host").alias("destination"), F.lit(True).alias("mutual")).distinct()
    opened = written(rows.join(pairs, ["host", "destination"], "left").withColumn("mutual", F.coalesce("mutual", F.lit(False))).select("id", "destination", "host", "key", "position", "mutual"), "opened")
    chosen = written(opened.limit(0), "chosen")
    while not opened.isEmpty():
        new = written(dominant(opened, chosen, per_host, apart), "new")
        more = written(chosen.unionByName(new), "chosen")
        left = written(ruled_out(opened, more, per_host, apart), "opened")
        for old in (opened, chosen, new):
            dropped(old)
        opened, chosen = left, more
    return chosen.select("id", "destination", "host", (-F.col("key.a")).alias("score"), (-F.col("key.b")).alias("semantic"))


def blocked(candidates: DataFrame, chosen: DataFrame, per_host: int = PER_HOST) -> DataFrame:
    """destination and reason of every destination without a suggestion: what kept its last candidate out."""
    last = candidates.join(chosen.select("destination"), "destination", "left_anti")
    key = F.struct((-F.col("score")).alias("a"), (-F.coalesce("semantic", F.lit(0.0))).alias("b"), "destination", "id")
    last = last.groupBy("destination").agg(F.max_by(F.struct("host", key.alias("key")), key).alias("c")).select("destination", "c.host", "c.key")
    taken = chosen.select("host", "destination", F.struct((-F.col("score")).alias("a"), (-F.col("semantic")).alias("b"), "destination", "id").alias("own_key"))
    back = taken.select(F.col("destination").alias("host"), F.col("host").alias("destination"), F.col("own_key").alias("back_key"))
    n = last.join(taken.select("host", "own_key"), "host", "left").groupBy("destination").agg(F.count_if(F.col("own_key") < F.col("key")).alias("n"))
    told = last.join(back, ["host", "destination"], "left").join(n, "destination")
    told = told.groupBy("destination").agg(F.bool_or(F.coalesce(F.col("back_key") < F.col("key"), F.lit(False))).alias("circular"), F.max("n").alias("n"))
    return told.select("destination", F.when(F.col("circular"), "circular_suppressed").when(F.col("n") >= per_host, "host_reuse_cap").otherwise("paragraph_cluster").alias("reason"))


def candidates(spark, sf_dir) -> DataFrame:
    """Open suggestions: hosts and destinations are pages of one set, a sentence's position is the day of the year."""
    tables(spark, sf_dir)
    return spark.sql(f"WITH {REVIEWS} SELECT suggestion AS id, destination, host % 100 AS host, score, score % 1000 AS semantic, dayofyear(reviewed_at) AS position FROM reviews WHERE status = 'pending'")


@query("t10_greedy_selection")
def t10(spark, sf_dir):
    """The chosen suggestions, and the destinations that get none with the reason."""
    rows = candidates(spark, sf_dir)
    chosen = select(rows)
    return chosen.select("destination", "id", "host", F.lit("selected").alias("outcome")).unionByName(blocked(rows, chosen).select("destination", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("host"), F.col("reason").alias("outcome")))
