"""Graph queries over the edges that pages form by sharing sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.registry import query, sql, tables
from weftline.plans.rounds import dropped, written
from weftline.plans.views import EDGES, REVIEWS

#: Rounds that an oracle unrolls; plans go on until nothing changes by more than a tolerance, which takes fewer here.
ROUNDS = 64
TOLERANCE, MOST_ROUNDS = 1e-8, 100
#: Rounds in one plan where no score has to be summed up between them; then a table is written.
AT_ONCE = 4


def edges(spark, sf_dir) -> DataFrame:
    """src, dst and w of the pages' links, written once for the loops that read them in every round."""
    tables(spark, sf_dir)
    return written(spark.sql(f"WITH {EDGES} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, w FROM edges"), "edges")


def pagerank(links: DataFrame, rounds: int = MOST_ROUNDS, teleport: float = 0.15, seeds: list[int] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """node, score: next = (1 - teleport) * (links + dangling) + teleport, over the seeds or all nodes.

    Ends when the sum of changes is below the tolerance. What reaches the driver in a round is two sums.
    """
    out = links.groupBy("src").agg(F.sum("w").alias("total"))
    share = written(links.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")), "shares")
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    base = F.col("node").isin(seeds).cast("double") if seeds else F.lit(1.0)
    nodes = nodes.join(out.select(F.col("src").alias("node"), F.lit(False).alias("dangling")), "node", "left").select("node", base.alias("base"), F.coalesce("dangling", F.lit(True)).alias("dangling"))
    nodes = written(nodes, "nodes")
    weight = nodes.agg(F.sum("base")).first()[0]
    if not weight:  # no node, or no seed among them
        return nodes.select("node", F.lit(0.0).alias("score"))
    rank = written(nodes.select("node", (F.col("base") / weight).alias("base"), "dangling", (F.col("base") / weight).alias("score"), F.lit(0.0).alias("change")), "rank")
    dangles = not nodes.where("dangling").isEmpty()
    for _ in range(0, rounds, 1 if dangles else AT_ONCE):
        new = rank
        for _ in range(1 if dangles else AT_ONCE):
            lost = rank.where("dangling").agg(F.sum("score")).first()[0] if dangles else 0.0
            came = share.join(new.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("score")).alias("came"))
            score = (1 - teleport) * (F.coalesce("came", F.lit(0.0)) + lost * F.col("base")) + teleport * F.col("base")
            new = new.join(came, "node", "left").select("node", "base", "dangling", score.alias("score"), F.abs(score - F.col("score")).alias("change"))
        new = written(new, "rank")
        dropped(rank)
        rank = new
        if rank.agg(F.sum("change")).first()[0] < tolerance:
            break
    return rank.select("node", "score")


def _pagerank_sql(base: str, teleport: float = 0.15) -> str:
    steps = [f"b AS MATERIALIZED (SELECT node, {base} AS raw FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) x), n AS MATERIALIZED (SELECT b.node, raw / (SELECT SUM(raw) FROM b) AS base, o.src IS NULL AS dangling FROM b LEFT JOIN (SELECT DISTINCT src FROM edges) o ON o.src = b.node)",
             "s AS MATERIALIZED (SELECT src, dst, CAST(w AS DOUBLE) / SUM(w) OVER (PARTITION BY src) AS p FROM edges)", "r0 AS MATERIALIZED (SELECT node, base AS score FROM n)"]
    for k in range(1, ROUNDS + 1):
        steps.append(f"r{k} AS MATERIALIZED (SELECT n.node, {1 - teleport} * (COALESCE(c.came, 0) + COALESCE((SELECT SUM(r.score) FROM r{k - 1} r JOIN n m ON m.node = r.node WHERE m.dangling), 0) * n.base) + {teleport} * n.base AS score FROM n LEFT JOIN (SELECT dst, SUM(p * score) AS came FROM s JOIN r{k - 1} ON src = node GROUP BY dst) c ON c.dst = n.node)")
    return f"WITH {EDGES}, {', '.join(steps)} SELECT node, ROUND(score, 6) AS score FROM r{ROUNDS}"


@query("g2_pagerank", _pagerank_sql("1e0"))
def g2(spark, sf_dir):
    return pagerank(edges(spark, sf_dir)).select("node", F.round("score", 6).alias("score"))


@query("g3_personalised_pagerank", _pagerank_sql("CASE WHEN node IN (1, 2, 3) THEN 1e0 ELSE 0e0 END"))
def g3(spark, sf_dir):
    return pagerank(edges(spark, sf_dir), seeds=[1, 2, 3]).select("node", F.round("score", 6).alias("score"))


@query("g5_trust_rank", _pagerank_sql("CASE WHEN node IN (5, 8) THEN 1e0 ELSE 0e0 END"))
def g5(spark, sf_dir):
    return pagerank(edges(spark, sf_dir), seeds=[5, 8]).select("node", F.round("score", 6).alias("score"))


def automatic_seeds(links: DataFrame, quality: DataFrame, pool: int = 100, kept: int = 20, least_quality: float = 0.6, most_readability: float = 16.0) -> DataFrame:
    """node and score of the trusted seeds: of the first pool nodes by PageRank on the reversed links, those that pass the filters.

    quality: node, quality, readability, spam (null: passes). Where none passes, the first nodes by PageRank on the links
    themselves, unfiltered. At most pool rows are ranked; the order is by score, then node.
    """
    first = lambda df, n: df.orderBy(F.desc("score"), "node").limit(n)
    back = pagerank(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    passes = (F.coalesce("quality", F.lit(1.0)) >= least_quality) & (F.coalesce("readability", F.lit(0.0)) <= most_readability) & ~F.coalesce("spam", F.lit(False))
    seeds = written(first(first(back, pool).join(quality, "node", "left").where(passes).select("node", "score"), kept), "seeds")
    return seeds if not seeds.isEmpty() else first(pagerank(links), kept)


_unrounded = _pagerank_sql("1e0").replace("ROUND(score, 6) AS score", "score")
_reversed = EDGES.replace("edges AS (", "forward AS (") + ", edges AS (SELECT dst AS src, src AS dst, w FROM forward)"


@query(
    "g6_automatic_seeds",
    f"WITH back AS (SELECT * FROM ({_unrounded.replace(EDGES, _reversed)}) x ORDER BY score DESC, node LIMIT 100), q AS (SELECT back.node, back.score FROM back JOIN supplier ON s_suppkey = back.node WHERE s_acctbal / 10000 >= 0.6 AND s_nationkey <= 16 ORDER BY back.score DESC, back.node LIMIT 20), "
    f"f AS (SELECT node, score FROM ({_unrounded}) x ORDER BY score DESC, node LIMIT 20) SELECT node, ROUND(score, 6) AS score FROM q UNION ALL SELECT node, ROUND(score, 6) AS score FROM f WHERE NOT EXISTS (SELECT 1 FROM q)",
)
def g6(spark, sf_dir):
    """Suppliers as pages: the balance is their quality, the nation's number stands for readability, none is spam."""
    links = edges(spark, sf_dir)
    quality = spark.sql("SELECT CAST(s_suppkey AS BIGINT) AS node, s_acctbal / 10000 AS quality, CAST(s_nationkey AS DOUBLE) AS readability, CAST(NULL AS BOOLEAN) AS spam FROM supplier")
    return automatic_seeds(links, quality).select("node", F.round("score", 6).alias("score"))


def hits(links: DataFrame, rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """node, authority, hub, both with sum 1: power iteration until the sum of changes over a table's rounds is below the tolerance.

    Scores are scaled by their sums when a table is written; in between scaling would change nothing but the size of numbers.
    """
    names = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    nodes = written(names.select("node", F.lit(1.0).alias("hub"), F.lit(0.0).alias("authority"), F.lit(0.0).alias("old_hub"), F.lit(0.0).alias("old_authority")), "hits")
    sums = nodes.agg(F.sum("hub"), F.lit(1.0), F.lit(1.0), F.lit(1.0)).first()

    def spread(scores: DataFrame, by: str, to: str) -> DataFrame:
        return links.join(scores.select(F.col("node").alias(by), "x"), by).groupBy(F.col(to).alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("x"))

    for _ in range(0, rounds, AT_ONCE // 2):
        hub = nodes.select("node", (F.col("hub") / (sums[0] or 1.0)).alias("x"))
        for _ in range(AT_ONCE // 2):
            auth = spread(hub, "src", "dst")
            hub = spread(auth, "dst", "src")
        now = nodes.join(auth.withColumnRenamed("x", "a"), "node", "left").join(hub.withColumnRenamed("x", "h"), "node", "left")
        new = written(now.select("node", F.coalesce("h", F.lit(0.0)).alias("hub"), F.coalesce("a", F.lit(0.0)).alias("authority"), (F.col("hub") / (sums[0] or 1.0)).alias("old_hub"), (F.col("authority") / (sums[1] or 1.0)).alias("old_authority")), "hits")
        dropped(nodes)
        nodes, sums = new, new.agg(F.sum("hub"), F.sum("authority")).first()
        change = F.abs(F.col("hub") / (sums[0] or 1.0) - F.col("old_hub")) + F.abs(F.col("authority") / (sums[1] or 1.0) - F.col("old_authority"))
        if (nodes.agg(F.sum(change)).first()[0] or 0.0) < tolerance:
            break
    return nodes.select("node", (F.col("authority") / (sums[1] or 1.0)).alias("authority"), (F.col("hub") / (sums[0] or 1.0)).alias("hub"))


def _hits_sql(rounds: int = 48) -> str:
    steps = ["h0 AS MATERIALIZED (SELECT node, 1e0 AS h FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) x)"]
    for k in range(1, rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT dst AS node, SUM(w * h) / SUM(SUM(w * h)) OVER () AS a FROM edges JOIN h{k - 1} ON src = node GROUP BY dst), h{k} AS MATERIALIZED (SELECT src AS node, SUM(w * a) / SUM(SUM(w * a)) OVER () AS h FROM edges JOIN a{k} ON dst = node GROUP BY src)")
    return f"WITH {EDGES}, {', '.join(steps)} SELECT h0.node, ROUND(COALESCE(a, 0e0), 6) AS authority, ROUND(COALESCE(h{rounds}.h, 0e0), 6) AS hub FROM h0 LEFT JOIN a{rounds} ON a{rounds}.node = h0.node LEFT JOIN h{rounds} ON h{rounds}.node = h0.node"


@query("g4_hits", _hits_sql())
def g4(spark, sf_dir):
    return hits(edges(spark, sf_dir)).select("node", F.round("authority", 6).alias("authority"), F.round("hub", 6).alias("hub"))


@query("t8_top_authorities", f"SELECT node, authority FROM ({_hits_sql()}) x ORDER BY authority DESC, node LIMIT 10")
def t8(spark, sf_dir):
    return g4(spark, sf_dir).select("node", "authority").orderBy(F.desc("authority"), "node").limit(10)


def labels(links: DataFrame) -> DataFrame:
    """node, root: connected components by the least label that reaches a node; ends when no label changes."""
    both = written(links.select("src", "dst").union(links.select("dst", "src")).distinct(), "both")
    now = written(both.select(F.col("src").alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    seen = None
    while True:
        got = both.join(now.select(F.col("node").alias("src"), "root"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("root").alias("came"))
        near = written(now.join(got, "node", "left").select("node", F.least("root", F.coalesce("came", "root")).alias("root")), "labels")
        # the label of a label: halves the rounds that long chains need
        new = written(near.join(near.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left").select("node", F.coalesce("further", "root").alias("root")), "labels")
        for old in (now, near):
            dropped(old)
        now = new
        total = now.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if total == seen:
            return now
        seen = total


def _components_sql(links: str) -> str:
    return f"linked AS MATERIALIZED (SELECT src, dst FROM {links} UNION SELECT dst, src FROM {links}), reach AS (SELECT src AS node, src AS root FROM linked UNION SELECT linked.dst, reach.root FROM reach JOIN linked ON linked.src = reach.node WHERE reach.root < linked.dst)"


_strong = EDGES + ", strong AS (SELECT src, dst FROM edges WHERE w >= (SELECT MAX(w) FROM edges) - 6)"


@query("g8_components", f"WITH RECURSIVE {_strong}, {_components_sql('strong')} SELECT node, MIN(root) AS root FROM reach GROUP BY node")
def g8(spark, sf_dir):
    e = edges(spark, sf_dir)
    most = e.agg(F.max("w")).first()[0]
    return labels(e.where(F.col("w") >= most - 6))


sql("g1_normalised_edges", f"WITH {EDGES} SELECT src, dst, ROUND(CAST(w AS DOUBLE) / SUM(w) OVER (PARTITION BY src), 9) AS p FROM edges")
sql("g10_topology", f"WITH {EDGES}, i AS (SELECT dst, COUNT(*) AS n FROM edges GROUP BY dst), o AS (SELECT src, COUNT(*) AS n FROM edges GROUP BY src) SELECT COUNT(*) AS nodes, CAST(SUM(CASE WHEN i.n IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS orphans, MAX(COALESCE(i.n, 0)) AS most_in, MAX(COALESCE(o.n, 0)) AS most_out FROM supplier LEFT JOIN i ON i.dst = s_suppkey LEFT JOIN o ON o.src = s_suppkey")
sql("g7_reciprocal_rings", f"WITH {EDGES}, f AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 100 AS dst FROM lineitem) SELECT f.src, COUNT(*) AS ring, ROUND(1 - EXP(-0.8E0 * COUNT(*) / 100), 6) AS penalty FROM f JOIN f r ON r.src = f.dst AND r.dst = f.src AND f.src <> f.dst GROUP BY f.src")
_suggested = REVIEWS + ", suggested AS (SELECT DISTINCT host % 100 AS host, destination FROM reviews WHERE status = 'pending')"
sql("g14_katz_two_hops", f"WITH {EDGES}, {_suggested}, two AS (SELECT p.host, p.destination, COUNT(*) AS n FROM suggested p JOIN edges a ON a.src = p.host JOIN edges b ON b.src = a.dst AND b.dst = p.destination WHERE p.host <> p.destination GROUP BY p.host, p.destination) SELECT p.host, p.destination, 1 - LEAST(1.0E0, 0.5E0 * CASE WHEN e.src IS NULL THEN 0 ELSE 1 END + 0.25E0 * COALESCE(t.n, 0)) AS gain FROM suggested p LEFT JOIN edges e ON e.src = p.host AND e.dst = p.destination LEFT JOIN two t ON t.host = p.host AND t.destination = p.destination WHERE p.host <> p.destination")
sql("g15_silo_entropy", f"WITH {EDGES}, c AS (SELECT src, s_nationkey AS silo, CAST(COUNT(*) AS DOUBLE) AS n FROM edges JOIN supplier ON dst = s_suppkey GROUP BY src, s_nationkey), p AS (SELECT src, n / SUM(n) OVER (PARTITION BY src) AS p, COUNT(*) OVER (PARTITION BY src) AS k FROM c) SELECT src, ROUND(ABS(SUM(-p * LN(p))) / CASE WHEN MAX(k) > 1 THEN LN(MAX(k)) ELSE 1 END, 6) AS evenness FROM p GROUP BY src")
sql("g16_dangling_authority", f"WITH {EDGES}, o AS (SELECT src, COUNT(*) AS n FROM edges WHERE w >= 10 GROUP BY src), v AS (SELECT s_suppkey, GREATEST(0, LEAST(1, s_acctbal / 10000)) AS value FROM supplier) SELECT s_suppkey, CASE WHEN value < 0.5 OR COALESCE(n, 0) >= 5 THEN 0.0E0 ELSE ROUND(CAST(value AS DOUBLE) / (1 + COALESCE(n, 0)), 6) END AS bonus FROM v LEFT JOIN o ON o.src = s_suppkey")
sql("g19_gap_analysis", f"WITH {EDGES}, {REVIEWS}, ghost AS (SELECT destination, SUM(CAST(FLOOR(score) AS BIGINT)) AS s FROM reviews WHERE status = 'pending' GROUP BY destination), i AS (SELECT dst, COUNT(*) AS n FROM edges GROUP BY dst) SELECT destination, ROUND(CAST(s AS DOUBLE) / (COALESCE(n, 0) + 1), 4) AS neglect FROM ghost LEFT JOIN i ON dst = destination")
sql("g20_click_distance", "SELECT c_custkey, 4.0E0 / (4.0E0 + (0.75E0 * 2 + 0.25E0 * (c_custkey % 5))) AS score FROM customer")
sql("g23_link_freshness", "WITH h AS (SELECT o_orderkey % 50 AS dst, COUNT(*) AS n, MIN(o_orderdate) AS oldest, SUM(CASE WHEN o_orderdate >= TIMESTAMP '2001-07-01 00:00:00' THEN 1 ELSE 0 END) AS recent, SUM(CASE WHEN o_orderdate >= TIMESTAMP '2001-06-01 00:00:00' AND o_orderdate < TIMESTAMP '2001-07-01 00:00:00' THEN 1 ELSE 0 END) AS earlier FROM orders GROUP BY o_orderkey % 50) SELECT dst, CASE WHEN n < 3 THEN 'thin' WHEN recent > earlier THEN 'fresh' WHEN recent < earlier THEN 'stale' ELSE 'steady' END AS state, ROUND(0.5E0 + 0.5E0 * CAST(recent - earlier AS DOUBLE) / GREATEST(recent + earlier, 1), 6) AS score FROM h")


def paths(links: DataFrame, sources: DataFrame, most: int = 4) -> DataFrame:
    """source, node, hops and path of the shortest directed paths of up to most links from each source (node), the least by node numbers.

    The frontier keeps the path it came by; nodes already met from a source are anti-joined, so no node is entered twice.
    """
    front = written(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops"), F.array("node").alias("path")).distinct(), "front")
    met = front
    for hops in range(1, most + 1):
        found = front.join(links.select(F.col("src").alias("node"), "dst"), "node").groupBy("source", F.col("dst").alias("node")).agg(F.min("path").alias("before"))
        new = found.join(met.select("source", "node"), ["source", "node"], "left_anti")
        front = written(new.select("source", "node", F.lit(hops).alias("hops"), F.concat("before", F.array("node")).alias("path")), "front")
        met = met.unionByName(front)
    return met


@query(
    "g9_shortest_paths",
    f"WITH RECURSIVE {EDGES}, one AS MATERIALIZED (SELECT DISTINCT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM edges), d0 AS (SELECT MIN(src) AS node FROM one), d1 AS (SELECT dst AS node, [src, dst] AS path FROM one WHERE src = (SELECT node FROM d0) AND dst <> src), d2 AS (SELECT dst AS node, list_append(MIN(path), dst) AS path FROM d1 JOIN one ON src = node WHERE dst NOT IN (SELECT node FROM d1) AND dst <> (SELECT node FROM d0) GROUP BY dst), d3 AS (SELECT dst AS node, list_append(MIN(path), dst) AS path FROM d2 JOIN one ON src = node WHERE dst NOT IN (SELECT node FROM d1 UNION SELECT node FROM d2 UNION SELECT node FROM d0) GROUP BY dst), "
    "d4 AS (SELECT dst AS node, list_append(MIN(path), dst) AS path FROM d3 JOIN one ON src = node WHERE dst NOT IN (SELECT node FROM d1 UNION SELECT node FROM d2 UNION SELECT node FROM d3 UNION SELECT node FROM d0) GROUP BY dst) SELECT node, 0 AS hops, CAST(node AS VARCHAR) AS path FROM d0 UNION ALL SELECT node, 1, array_to_string(path, '>') FROM d1 UNION ALL SELECT node, 2, array_to_string(path, '>') FROM d2 UNION ALL SELECT node, 3, array_to_string(path, '>') FROM d3 UNION ALL SELECT node, 4, array_to_string(path, '>') FROM d4",
)
def g9(spark, sf_dir):
    """From the first page, over all links."""
    links = edges(spark, sf_dir)
    found = paths(links, links.agg(F.min("src").alias("node")))
    return found.select("node", "hops", F.array_join(F.transform("path", lambda n: n.cast("string")), ">").alias("path"))


def cores(links: DataFrame) -> DataFrame:
    """node, core: every node's value, first its degree, becomes the h-index of its neighbours' values until none changes.

    The fixed point is the core number. A neighbour's value counts up to the node's own, which the h-index can't pass.
    """
    both = written(links.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).union(links.where("src <> dst").select("dst", "src")).distinct(), "both")
    now, seen = written(both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("core")), "cores"), None
    while True:
        near = both.join(now.select(F.col("node").alias("b"), F.col("core").alias("theirs")), "b").join(now.select(F.col("node").alias("a"), "core"), "a")
        counts = near.groupBy("a", F.least("theirs", "core").alias("v")).agg(F.count("*").alias("n"))
        reached = F.sum("n").over(Window.partitionBy("a").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0))
        new = written(counts.withColumn("reached", reached).groupBy(F.col("a").alias("node")).agg(F.max(F.least("v", "reached")).alias("core")), "cores")
        dropped(now)
        now = new
        total = now.agg(F.sum("core")).first()[0]
        if total == seen:
            return now
        seen = total


def forest(links: DataFrame) -> DataFrame:
    """node, parent, depth: a breadth-first tree of every component from its least node, whose parent is null.

    A round is a join of the frontier's links with the nodes not yet met; there are as many as the deepest tree has levels.
    """
    both = written(links.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).union(links.where("src <> dst").select("dst", "src")).distinct(), "both")
    front = written(labels(both.select(F.col("a").alias("src"), F.col("b").alias("dst"))).where("node = root").select("node", F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth")), "tree")
    met, depth = front, 0
    while not front.isEmpty():
        depth += 1
        found = both.join(front.select(F.col("node").alias("a")), "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        front = written(found.join(met.select("node"), "node", "left_anti").select("node", "parent", F.lit(depth).alias("depth")), "tree")
        met = met.unionByName(front)
    return written(met, "forest")


def biconnected(links: DataFrame) -> DataFrame:
    """node, articulation, block (nodes of its largest biconnected component, 1 for a node alone) of undirected links.

    A tree link is named by its lower end. A link outside the breadth-first tree closes a cycle through the tree, and all
    tree links of a cycle are in one block. Both ends of such a link climb to where they meet, all links of a level at
    once, level by level from the deepest; alike pairs are one pair. Blocks are the components of what met on the way.
    A node in two blocks or more is an articulation point. No task sees a whole component.
    """
    tree = forest(links)
    up = tree.select("node", "parent", "depth")
    pairs = links.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    ends = pairs.join(up.select(F.col("node").alias("u"), F.col("parent").alias("pu"), F.col("depth").alias("du")), "u").join(up.select(F.col("node").alias("v"), F.col("parent").alias("pv"), F.col("depth").alias("dv")), "v")
    outside = ends.where("NOT (pu <=> v) AND NOT (pv <=> u)")
    # in a breadth-first tree ends differ by one level at most: the lower one climbs it first
    lower, higher = F.when(F.col("du") > F.col("dv"), F.col("u")).otherwise(F.col("v")), F.when(F.col("du") > F.col("dv"), F.col("v")).otherwise(F.col("u"))
    lifted = outside.where("du <> dv").select(lower.alias("low"), F.when(F.col("du") > F.col("dv"), F.col("pu")).otherwise(F.col("pv")).alias("x"), higher.alias("y"), F.least("du", "dv").alias("depth"))
    lifted = written(lifted, "lifted")
    level = written(outside.where("du = dv").select(F.col("u").alias("x"), F.col("v").alias("y"), F.col("du").alias("depth")).unionByName(lifted.select("x", "y", "depth")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "depth").distinct(), "level")
    met = [lifted.select(F.col("low").alias("src"), F.col("x").alias("dst"))]
    parents = written(up.select("node", "parent"), "parents")
    while not level.isEmpty():
        met.append(level.select(F.col("x").alias("src"), F.col("y").alias("dst")))
        above = level.join(parents.select(F.col("node").alias("x"), F.col("parent").alias("px")), "x").join(parents.select(F.col("node").alias("y"), F.col("parent").alias("py")), "y").where("px <> py")
        above = written(above.select("x", "y", "px", "py", (F.col("depth") - 1).alias("depth")), "above")
        met += [above.select(F.col("x").alias("src"), F.col("px").alias("dst")), above.select(F.col("y").alias("src"), F.col("py").alias("dst"))]
        level = written(above.select(F.least("px", "py").alias("x"), F.greatest("px", "py").alias("y"), "depth").distinct(), "level")
    linked = met[0]
    for m in met[1:]:
        linked = linked.unionByName(m)
    root = labels(written(linked.distinct(), "linked"))
    tops = tree.where("parent IS NOT NULL").join(root, "node", "left").select("node", "parent", F.coalesce("root", "node").alias("block"))
    sizes = tops.groupBy("block").agg((F.count("*") + 1).alias("size"))
    inside = tops.select("node", "block").unionByName(tops.select(F.col("parent").alias("node"), "block")).distinct().join(sizes, "block")
    told = inside.groupBy("node").agg((F.count("*") > 1).alias("articulation"), F.max("size").alias("block"))
    return tree.select("node").join(told, "node", "left").select("node", F.coalesce("articulation", F.lit(False)).alias("articulation"), F.coalesce("block", F.lit(1)).cast("long").alias("block"))


@query("g12_k_core")
def g12(spark, sf_dir):
    """Of all links between pages."""
    return cores(edges(spark, sf_dir))


@query("g11_g13_biconnected")
def g11(spark, sf_dir):
    """Of all links between pages."""
    return biconnected(edges(spark, sf_dir))
