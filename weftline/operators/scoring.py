"""Second-stage search for sentences, and the whole composite score of suggestions with its guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators.vectors import dot, normalise
from weftline.plans.registry import load, query, tables
from weftline.plans.views import REVIEWS

#: Sentences that the second stage keeps for a destination.
SENTENCES = 10
#: The components of the composite score in order, with the weights recommended for them.
COMPONENTS = {
    "semantic": 0.40,
    "keyword": 0.25,
    "node": 0.20,
    "quality": 0.15,
    "authority": 0.10,
    "freshness": 0.05,
    "phrase": 0.0,
    "learned_anchor": 0.0,
    "rare_term": 0.05,
    "field_aware": 0.10,
    "content_value": 0.0,
    "click_distance": 0.07,
    "anchor_diversity": 0.03,
    "keyword_stuffing": 0.04,
    "link_farm": 0.03,
}
#: Fixed values of the guards: cosine, existing links of a host, characters of a sentence.
LEAST_SEMANTIC, MOST_LINKS, LEAST_CHARS, MOST_CHARS = 0.25, 3, 30, 300


def best_sentences(candidates: DataFrame, sentences: DataFrame, destinations: DataFrame, k: int = SENTENCES) -> DataFrame:
    """destination, host, sentence, semantic: the k sentences of its candidate hosts that are nearest to a destination.

    candidates: destination, host; sentences: sentence, host, vec; destinations: destination, vec. Cosine to nine
    places, ties by sentence. A vector that is null or of another length is near nothing. Each task keeps its own k
    best of a destination before the shuffle, so a destination with very many candidates is no large group.
    """
    asked = candidates.select("destination", "host").dropna().distinct()
    wanted = destinations.select("destination", normalise(F.col("vec")).alias("wanted"))
    pairs = asked.join(wanted, "destination").join(sentences.select("sentence", "host", normalise(F.col("vec")).alias("vec")), "host")
    pairs = pairs.where(F.size("vec") == F.size("wanted")).select("destination", "host", "sentence", F.round(dot(F.col("vec"), F.col("wanted")), 9).alias("semantic"))
    order = Window.partitionBy("destination").orderBy(F.desc("semantic"), "sentence")
    return pairs.dropna().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def guarded(matches: DataFrame, links: DataFrame | None = None, least_semantic: float = LEAST_SEMANTIC, most_links: int = MOST_LINKS, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The matches that may be scored, and destination, host, sentence, reason of the others, by the first guard that holds.

    matches: destination, host, sentence, semantic, and where they are known chars, host_silo, destination_silo. links:
    host, destination of those that exist. Nulls of the optional columns block nothing.
    """
    has = lambda c, other: F.col(c) if c in matches.columns else F.lit(None).cast(other)
    rows = matches
    if links is not None:
        there = links.select("host", "destination").dropna().distinct()
        rows = rows.join(there.withColumn("linked", F.lit(True)), ["host", "destination"], "left")
        rows = rows.join(there.groupBy("host").agg(F.count("*").alias("out")), "host", "left")
    else:
        rows = rows.withColumns({"linked": F.lit(None).cast("boolean"), "out": F.lit(0).cast("long")})
    other_silo = F.lit(strict) & (has("host_silo", "long") != has("destination_silo", "long"))
    reason = (
        F.when(F.coalesce(F.col("semantic"), F.lit(-1.0)) < least_semantic, "low_semantic")
        .when(F.col("host") == F.col("destination"), "self_link")
        .when(F.coalesce("linked", F.lit(False)), "already_linked")
        .when(F.coalesce("out", F.lit(0)) >= most_links, "max_links_reached")
        .when(F.coalesce(other_silo, F.lit(False)), "cross_silo_blocked")
        .when(~F.coalesce(has("chars", "long").between(LEAST_CHARS, MOST_CHARS), F.lit(True)), "sentence_length")
    )
    rows = rows.withColumn("reason", reason).drop("linked", "out")
    return rows.where("reason IS NULL").select(*matches.columns), rows.where("reason IS NOT NULL").select("destination", "host", "sentence", "reason")


def composite(columns: list[str], weights: dict[str, float] | None = None) -> Column:
    """The sum of silo and all components by weight, each of single precision, in the order of COMPONENTS.

    A component that the rows lack or hold as null is neutral: 0. Unknown names among weights are an error.
    """
    told = COMPONENTS | (weights or {})
    if set(told) - set(COMPONENTS):
        raise ValueError(f"no such components: {sorted(set(told) - set(COMPONENTS))}")
    single = lambda c: F.coalesce(c.cast("float").cast("double"), F.lit(0.0))
    total = single(F.col("silo")) if "silo" in columns else F.lit(0.0)
    for name, weight in told.items():
        if name in columns:
            total = total + single(F.col(name)) * single(F.lit(weight))
    return total.cast("float")


def log_share(value: Column, least: Column, most: Column) -> Column:
    """Place of a positive value between two others on a logarithmic scale, 0 to 1; a half where they are equal."""
    lift = lambda c: F.log(c + 1e-9)
    return F.when(least == most, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (lift(value) - lift(least)) / (lift(most) - lift(least)))))


_pairs = f"{REVIEWS}, asked AS (SELECT DISTINCT destination, host FROM reviews)"
_stage2 = f"""WITH {_pairs}, m AS (SELECT destination, host, s.vec_id AS sentence, ROUND(list_cosine_similarity(CAST(s.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 9) AS semantic
  FROM asked JOIN embeddings d ON d.vec_id = destination JOIN embeddings s ON s.vec_id // 5 = host),
best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY destination ORDER BY semantic DESC, sentence) <= {SENTENCES})"""


def suggested(spark, sf_dir) -> DataFrame:
    """Reviewed pairs as candidates; five vectors in a row are a host's sentences, those of the first numbers destinations."""
    tables(spark, sf_dir)
    e = load(spark, sf_dir, "embeddings")
    sentences = e.select(F.col("vec_id").alias("sentence"), F.floor(F.col("vec_id") / 5).alias("host"), F.col("embedding").alias("vec"))
    return best_sentences(spark.sql(f"WITH {REVIEWS} SELECT host, destination FROM reviews"), sentences, e.select(F.col("vec_id").alias("destination"), F.col("embedding").alias("vec")))


@query("v4_second_stage", _stage2 + " SELECT destination, host, sentence, semantic FROM best")
def v4(spark, sf_dir):
    return suggested(spark, sf_dir)


_tokens = "list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z0-9]+)?')), lambda w: w NOT IN ({}))".format(", ".join("'" + w.replace("'", "''") + "'" for w in X.STOPWORDS))
_node = "CASE WHEN hc.c_nationkey = dc.c_nationkey THEN 1.0e0 WHEN hn.n_regionkey = dn.n_regionkey THEN 0.6e0 WHEN hc.c_mktsegment = dc.c_mktsegment THEN 0.3e0 ELSE 0.0e0 END"
_facts = """SELECT o_custkey AS item, SUM(CAST(FLOOR(o_totalprice) AS BIGINT)) AS authority, AVG(CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' THEN 1e0 ELSE 0e0 END) AS recent FROM orders GROUP BY o_custkey"""
_log = "CASE WHEN b.least = b.most THEN 0.5e0 ELSE GREATEST(0e0, LEAST(1e0, (LN({0} + 1e-9) - LN(b.least + 1e-9)) / (LN(b.most + 1e-9) - LN(b.least + 1e-9)))) END"
_r1 = f"""{_stage2}, t AS (SELECT doc_id, {_tokens} AS w FROM documents), f AS ({_facts}), b AS (SELECT CAST(MIN(authority) AS DOUBLE) AS least, CAST(MAX(authority) AS DOUBLE) AS most FROM f),
v AS (SELECT user_id AS item, SUM(CASE WHEN event_type = 'purchase' THEN 1e0 ELSE 0e0 END) / COUNT(*) AS worth FROM events GROUP BY user_id),
c AS (SELECT best.*, CASE WHEN len(list_distinct(list_concat(ht.w, dt.w))) > 0 THEN CAST(len(list_intersect(ht.w, dt.w)) AS DOUBLE) / len(list_distinct(list_concat(ht.w, dt.w))) END AS keyword, {_node} AS node,
  {_log.format('hf.authority')} AS quality, {_log.format('df.authority')} AS authority, 2 * (df.recent - 0.5e0) AS freshness, v.worth AS content_value, CASE WHEN hn.n_regionkey = dn.n_regionkey THEN 0.05e0 ELSE -0.05e0 END AS silo
  FROM best LEFT JOIN t ht ON ht.doc_id = sentence LEFT JOIN t dt ON dt.doc_id = destination LEFT JOIN customer hc ON hc.c_custkey = host LEFT JOIN customer dc ON dc.c_custkey = destination
  LEFT JOIN nation hn ON hn.n_nationkey = hc.c_nationkey LEFT JOIN nation dn ON dn.n_nationkey = dc.c_nationkey LEFT JOIN f hf ON hf.item = host LEFT JOIN f df ON df.item = destination LEFT JOIN v ON v.item = destination, b
  WHERE semantic >= 0 AND host <> destination)"""
_sum = " + ".join(f"COALESCE(CAST(CAST({c} AS FLOAT) AS DOUBLE), 0) * CAST(CAST({w} AS FLOAT) AS DOUBLE)" for c, w in (COMPONENTS | {"content_value": 0.05}).items() if c in {"semantic", "keyword", "node", "quality", "authority", "freshness", "content_value"})


def told_of(rows: DataFrame, on: str, prefix: str, facts: DataFrame, key: str) -> DataFrame:
    """rows with the facts of the item in column on, their names after a prefix; rows without facts stay."""
    return rows.join(facts.select(*(F.col(c).alias(on if c == key else prefix + c) for c in facts.columns)), on, "left")


@query("r1_composite_components", f"{_r1} SELECT destination, host, sentence, ROUND(CAST(CAST(COALESCE(CAST(CAST(silo AS FLOAT) AS DOUBLE), 0) + {_sum} AS FLOAT) AS DOUBLE), 5) AS final FROM c")
def r1(spark, sf_dir):
    """The composite score of the second stage's matches; components that no table tells of are neutral."""
    best, _ = guarded(suggested(spark, sf_dir), least_semantic=0.0)
    docs = load(spark, sf_dir, "documents").select("doc_id", X.token_set(F.col("text")).alias("w"))
    people = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.expr("n_nationkey = c_nationkey")).select("c_custkey", "c_nationkey", "n_regionkey", "c_mktsegment")
    facts = spark.sql(_facts)
    bounds = facts.agg(F.min("authority").cast("double").alias("least"), F.max("authority").cast("double").alias("most"))
    worth = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("destination")).agg((F.count_if(F.col("event_type") == "purchase") / F.count("*")).alias("content_value"))
    best = told_of(best, "sentence", "h_", docs, "doc_id")
    best = told_of(best, "destination", "d_", docs, "doc_id")
    best = told_of(best, "host", "h_", people, "c_custkey")
    best = told_of(best, "destination", "d_", people, "c_custkey")
    best = told_of(best, "host", "h_", facts, "item")
    best = told_of(best, "destination", "d_", facts, "item")
    rows = best.join(worth, "destination", "left").crossJoin(F.broadcast(bounds))  # one row of bounds
    union = F.size(F.array_union("h_w", "d_w"))
    same = lambda c: F.col(f"h_{c}") == F.col(f"d_{c}")
    rows = rows.withColumns({
        "keyword": F.when(union > 0, F.size(F.array_intersect("h_w", "d_w")) / union),
        "node": F.when(same("c_nationkey"), 1.0).when(same("n_regionkey"), 0.6).when(same("c_mktsegment"), 0.3).otherwise(0.0),
        "quality": log_share(F.col("h_authority"), F.col("least"), F.col("most")),
        "authority": log_share(F.col("d_authority"), F.col("least"), F.col("most")),
        "freshness": 2 * (F.col("d_recent") - 0.5),
        "silo": F.when(same("n_regionkey"), 0.05).otherwise(-0.05),
    })
    score = composite(rows.columns, {"content_value": 0.05})
    return rows.select("destination", "host", "sentence", F.round(score.cast("double"), 5).alias("final"))
