"""Second-order random walks over a weighted graph without direction, and vectors of nodes from the walks.

A step goes from the current node to a neighbour x with a weight of w(current, x) times 1/p where x is the node before,
1 where x is a neighbour of the node before, 1/q elsewhere. Steps are drawn by rejection, so the law is exact and no
task ever holds a node's neighbours: edges of a node are numbered within kinds of weight (powers of two), a walk draws
a kind, then a number, joins that one edge by its key, and takes it with a probability of at least a half times the
bias. A round makes so many draws for each walk that few are refused all of them, and the first one taken is the step; a
walk whose draws were all refused draws on in the next round. Walks at a hub spread over the hub's edges.

Edges are dealt once into buckets by the columns of the joins, so a round reads them but shuffles and sorts walks only.
Draws are hashes of seed, walk and try: a lost task draws the same again.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators import graph
from weftline.plans.registry import query
from weftline.plans.rounds import dropped, shared_folder, written

LENGTH, WALKS, DIMENSION, WINDOW = 30, 200, 64, 10
#: Groups into which a node's edges of one kind are dealt to be numbered, so that a hub's are not sorted in one task.
PARTS = 64
#: Draws of a step in one round for each unit of the greatest bias.
DRAWS = 6
#: Edges in a bucket, about.
BUCKET = 2**20
#: Numbers that a skip-gram model may hold on the driver (nodes times dimension); beyond it vectors are projections.
MODEL_NUMBERS = 2**27


def undirected(links: DataFrame) -> DataFrame:
    """src, dst, w of both directions of every edge, once: weights of repeated edges are added up.

    Edges without a node, or with a weight of 0 or less, are left out; a null weight, or no column w, counts as 1.
    """
    w = F.coalesce(F.col("w").cast("double"), F.lit(1.0)) if "w" in links.columns else F.lit(1.0)
    rows = links.select(F.col("src").cast("long"), F.col("dst").cast("long"), w.alias("w")).where("src IS NOT NULL AND dst IS NOT NULL AND w > 0 AND w < double('infinity')")
    return rows.union(rows.where("src <> dst").select("dst", "src", "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with their kinds (kind, upto, n) and total, and edges by node, kind and number with what comes next."""
    kind = F.floor(F.log2("w")).cast("int")
    rows = edges.withColumn("kind", kind).withColumn("top", F.pow(F.lit(2.0), F.col("kind") + 1)).withColumn("part", F.pmod(F.xxhash64("dst"), F.lit(PARTS)).cast("int"))
    kinds = rows.groupBy("src", "kind").agg(F.count("*").alias("n"), (F.count("*") * F.first("top")).alias("mass"))
    kinds = kinds.withColumn("upto", F.sum("mass").over(Window.partitionBy("src").orderBy("kind")))
    nodes = kinds.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list(F.struct("kind", "upto", "n"))).alias("kinds"), F.max("upto").alias("total"))
    nodes = written(nodes, "nodes")
    before = rows.groupBy("src", "kind", "part").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("src", "kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("src", "kind", "part").orderBy("dst")) - 1
    rows = rows.withColumn("place", place).join(before, ["src", "kind", "part"])
    rows = rows.select(F.col("src").alias("cur"), "kind", (F.col("before") + F.col("place")).alias("at"), F.col("dst").alias("to"), (F.col("w") / F.col("top")).alias("keep"))
    return nodes, rows


def bucketed(df: DataFrame, name: str, by: list[str], rows: int) -> str:
    """The name of df as a table in buckets by the columns of a join, a file each; drop_bucketed() deletes it."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / BUCKET))
    name = f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, *by).write.option("path", f"{shared_folder(spark)}/{name}").bucketBy(n, *by).saveAsTable(name)
    return name


def drop_bucketed(spark: SparkSession, name: str) -> None:
    """Delete a table that bucketed() made, and its files."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def draw(seed: int, what: int) -> Column:
    """A number from 0 to below 1 for this walk, try and purpose."""
    return F.pmod(F.xxhash64(F.lit(seed), "start", "walk", "tries", F.lit(what)), F.lit(2**53)).cast("double") / 2.0**53


def advance(walks: DataFrame, nodes: DataFrame, steps: DataFrame, known: DataFrame | None, p: float, q: float, seed: int) -> DataFrame:
    """Walks after the first of a round's draws that is taken; those that took none stay where they are."""
    most = max(1.0, 1 / p, 1 / q)
    n = math.ceil(DRAWS * most)
    # draws before the join: so many rows are dealt to all cores, where the walks alone would be one task
    asked = walks.select("start", "walk", "prev", "cur", F.explode(F.sequence("tries", F.col("tries") + (n - 1))).alias("tries"))
    asked = asked.join(nodes.withColumnRenamed("node", "cur").hint("merge"), "cur")
    x = draw(seed, 0) * F.col("total")
    chosen = F.coalesce(F.get(F.filter("kinds", lambda k: k["upto"] > x), F.lit(0)), F.element_at("kinds", -1))
    asked = asked.select("start", "walk", "tries", "prev", "cur", chosen.alias("chosen"))
    asked = asked.select("start", "walk", "tries", "prev", "cur", F.col("chosen.kind").alias("kind"), F.floor(draw(seed, 1) * F.col("chosen.n")).alias("at"))
    found = asked.hint("shuffle_hash").join(steps, ["cur", "kind", "at"]).where(draw(seed, 2) < F.col("keep"))
    bias = F.lit(1.0)
    if known is not None:
        # without a node before the bias is the greatest, whatever the join says
        found = found.withColumn("before", F.coalesce("prev", "to")).hint("shuffle_hash").join(known, ["before", "to"], "left")
        bias = F.when(F.col("near"), 1.0).otherwise(1 / q)
    bias = F.when(F.col("prev").isNull(), most).when(F.col("to") == F.col("prev"), 1 / p).otherwise(bias)
    taken = found.where(draw(seed, 2) * most < F.col("keep") * bias).groupBy("start", "walk").agg(F.min(F.struct("tries", "to")).alias("first"))
    new = walks.join(taken.hint("merge"), ["start", "walk"], "left")
    then = lambda got, old, else_: F.when(F.col("first").isNotNull(), got).otherwise(else_).alias(old)
    return new.select("start", "walk", then(F.col("first.tries") + 1, "tries", F.col("tries") + n), then(F.concat("path", F.array("first.to")), "path", F.col("path")), then(F.col("cur"), "prev", F.col("prev")), then(F.col("first.to"), "cur", F.col("cur")))


def random_walks(links: DataFrame, walks: int = WALKS, length: int = LENGTH, p: float = 1.0, q: float = 1.0, seed: int = 42) -> DataFrame:
    """start, walk (from 0) and path of length nodes: so many walks from every node of an edge of links (src, dst, w)."""
    if walks < 1 or length < 1 or p <= 0 or q <= 0:
        raise ValueError("walks and length must be at least 1, p and q above 0")
    edges = written(undirected(links), "edges")
    nodes, steps = numbered(edges)
    rows, spark = edges.count(), links.sparkSession
    names = [bucketed(steps, "steps", ["cur", "kind", "at"], rows)]
    if q != 1:
        names.append(bucketed(edges.select(F.col("src").alias("before"), F.col("dst").alias("to"), F.lit(True).alias("near")), "known", ["before", "to"], rows))
    steps, known = spark.table(names[0]), spark.table(names[1]) if q != 1 else None
    began = nodes.select(F.col("node").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"), "node")
    opened = began.select("start", "walk", F.lit(0).alias("tries"), F.array("node").alias("path"), F.lit(None).cast("long").alias("prev"), F.col("node").alias("cur"))
    done = [opened.where(F.size("path") == length)]
    opened = opened.where(F.size("path") < length)
    while not opened.isEmpty():
        table = written(advance(opened, nodes, steps, known, p, q, seed), "walks")
        done.append(table.where(F.size("path") == length))
        opened = table.where(F.size("path") < length)
    whole = written(reduce(DataFrame.union, (d.select("start", "walk", "path") for d in done)), "walked")
    for old in (*done[1:], nodes, edges):
        dropped(old)
    for name in names:
        drop_bucketed(spark, name)
    return whole


def by_skip_gram(walked: DataFrame, dimension: int = DIMENSION, window: int = WINDOW, seed: int = 42) -> DataFrame:
    """node and vector of a skip-gram model of the walks; the model, a row for each node, is held by the driver."""
    rows = walked.select(F.col("path").cast("array<string>").alias("words"))
    model = Word2Vec(vectorSize=dimension, windowSize=window, minCount=1, maxIter=1, numPartitions=1, seed=seed, maxSentenceLength=1000, inputCol="words", outputCol="v").fit(rows)
    return model.getVectors().select(F.col("word").cast("long").alias("node"), vector_to_array("vector").alias("vector"))


def by_projection(walked: DataFrame, dimension: int = DIMENSION, window: int = WINDOW) -> DataFrame:
    """node and vector: positive mutual information with the nodes near it in walks, projected by random signs.

    Skip-gram factors the same matrix; here nothing grows on the driver, whatever the number of nodes.
    """
    at = walked.select("path", F.posexplode("path").alias("i", "a"))
    near = F.array_append(F.slice("path", F.col("i") + 2, window), F.lit(None).cast("long"))
    pairs = at.select("a", F.explode(near).alias("b")).where("b IS NOT NULL")
    pairs = written(pairs.groupBy("a", "b").agg(F.count("*").alias("n")), "pairs")
    pairs = pairs.union(pairs.select("b", "a", "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    of = pairs.groupBy("a").agg(F.sum("n").alias("of_a"))
    total = of.agg(F.sum("of_a").alias("total"))
    told = pairs.join(of, "a").join(of.select(F.col("a").alias("b"), F.col("of_a").alias("of_b")), "b").crossJoin(F.broadcast(total))
    weight = F.greatest(F.lit(0.0), F.log(F.col("n").cast("double") * F.col("total") / F.col("of_a") / F.col("of_b")))
    sign = lambda d: F.pmod(F.xxhash64("b", F.lit(d)), F.lit(2)) * 2 - 1
    sums = [F.sum(weight * sign(d)) / dimension**0.5 for d in range(dimension)]
    return told.groupBy(F.col("a").alias("node")).agg(F.array(*sums).alias("vector"))


def node_vectors(links: DataFrame, walks: int = WALKS, length: int = LENGTH, p: float = 1.0, q: float = 1.0, dimension: int = DIMENSION, window: int = WINDOW, seed: int = 42) -> DataFrame:
    """node and vector of every node; a skip-gram model where it is small enough for a driver, else projections."""
    walked = random_walks(links, walks, length, p, q, seed)
    nodes = walked.where("walk = 0").count()
    if not nodes:
        return walked.select(F.col("start").alias("node"), F.array().cast("array<double>").alias("vector"))
    return by_skip_gram(walked, dimension, window, seed) if nodes * dimension <= MODEL_NUMBERS else by_projection(walked, dimension, window)


@query("g21_random_walks")
def g21(spark, sf_dir):
    """Ten walks of thirty pages from every page; far pages count double, the page before a half less."""
    walked = random_walks(graph.edges(spark, sf_dir), walks=10, p=2.0, q=0.5)
    return walked.select("start", "walk", F.array_join("path", " ").alias("path"))


@query("g21_node_vectors")
def g21_vectors(spark, sf_dir):
    """A vector for every page, from ten walks each."""
    return node_vectors(graph.edges(spark, sf_dir), walks=10)
