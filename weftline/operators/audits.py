"""Audits: verdicts on new vectors, comparison of providers of vectors, odd anchors, and forms that must come out alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators.vectors import dot, norm, normalise
from weftline.plans.registry import load, query

#: A new vector may come from a provider that ranks so much lower; is unchanged above a cosine; must repeat above another.
RANK_DELTA, UNCHANGED, STABLE = -0.05, 0.9999, 0.99
#: The rank of a provider that has none.
UNRANKED = 0.5


def quality_gate(old: Column, old_rank: Column, new: Column, new_rank: Column, again: Column) -> Column:
    """verdict, reason and value of a new vector of length 1 against the stored one; the first gate that decides counts.

    again is a second vector of the same text by the new provider, null if there is none. The value is the rank delta
    or the cosine that decided, 0 where nothing was compared.
    """
    delta = F.coalesce(new_rank, F.lit(UNRANKED)) - F.coalesce(old_rank, F.lit(UNRANKED))
    told = lambda verdict, reason, value: F.struct(F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason"), value.cast("double").alias("value"))
    return (
        F.when(old.isNull(), told("ACCEPT_NEW", "first_embed", F.lit(0.0)))
        .when(delta < RANK_DELTA, told("REJECT", "lower_quality_provider", delta))
        .when(F.size(old) != F.size(new), told("ACCEPT_NEW", "dimension_upgrade", F.lit(0.0)))
        .when(dot(old, new) > UNCHANGED, told("NOOP", "unchanged", dot(old, new)))
        .when(again.isNull(), told("REPLACE", "passed_without_stability_check", delta))
        .when(F.size(again) != F.size(new), told("REJECT", "stability_dimension_mismatch", delta))
        .when(dot(new, again) < STABLE, told("REJECT", "unstable_new_vector", dot(new, again)))
        .otherwise(told("REPLACE", "passed_all_gates", delta))
    )


_unit = "list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(list_transform(embedding, lambda y: CAST(y AS DOUBLE)), list_transform(embedding, lambda y: CAST(y AS DOUBLE)))))"


@query(
    "v8_gate_verdicts",
    f"""WITH e AS (SELECT vec_id, label, {_unit} AS v FROM embeddings), ranks AS (SELECT label, CAST(COUNT(*) AS DOUBLE) / MAX(COUNT(*)) OVER () AS rank FROM embeddings GROUP BY label),
stored AS (SELECT e.vec_id, e.label, CASE WHEN e.label = 1 THEN v[1:32] ELSE v END AS old, rank AS old_rank FROM e LEFT JOIN ranks ON ranks.label = e.label WHERE e.label <> 0),
paired AS (SELECT n.vec_id, n.v AS new, r.rank AS new_rank, s.old, s.old_rank, a.v AS again FROM e n LEFT JOIN ranks r ON r.label = n.label LEFT JOIN stored s ON s.vec_id = n.vec_id - n.vec_id % 3 LEFT JOIN e a ON a.vec_id = n.vec_id - n.vec_id % 2),
told AS (SELECT *, new_rank - old_rank AS delta, CASE WHEN len(old) = len(new) THEN list_dot_product(old, new) END AS same, list_dot_product(new, again) AS sure FROM paired),
named AS (SELECT vec_id, delta, same, sure, CASE WHEN old IS NULL THEN 'first_embed' WHEN delta < -0.05e0 THEN 'lower_quality_provider' WHEN same IS NULL THEN 'dimension_upgrade' WHEN same > 0.9999e0 THEN 'unchanged' WHEN sure < 0.99e0 THEN 'unstable_new_vector' ELSE 'passed_all_gates' END AS reason FROM told)
SELECT vec_id, reason, CASE reason WHEN 'first_embed' THEN 'ACCEPT_NEW' WHEN 'dimension_upgrade' THEN 'ACCEPT_NEW' WHEN 'unchanged' THEN 'NOOP' WHEN 'passed_all_gates' THEN 'REPLACE' ELSE 'REJECT' END AS verdict,
CAST(ROUND(1e6 * CASE reason WHEN 'unchanged' THEN same WHEN 'unstable_new_vector' THEN sure WHEN 'lower_quality_provider' THEN delta WHEN 'passed_all_gates' THEN delta ELSE 0e0 END) AS BIGINT) AS millionths FROM named""",
)
def v8_verdicts(spark, sf_dir):
    """Every vector against a stored one: that of its id rounded down to a third, none for label 0, a shorter one for label 1.

    A label is a provider, ranked by its share of the largest; the second sample is the vector of the id rounded down to an even one.
    """
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "label", normalise(F.col("embedding")).alias("new"))
    counts = rows.groupBy("label").agg(F.count("*").cast("double").alias("n"))
    most = counts.agg(F.max("n")).first()[0]
    ranked = rows.join(counts.select("label", (F.col("n") / F.lit(most)).alias("rank")), "label", "left")
    old = ranked.where("label <> 0").select(F.col("vec_id").alias("old_id"), F.when(F.col("label") == 1, F.slice("new", 1, 32)).otherwise(F.col("new")).alias("old"), F.col("rank").alias("old_rank"))
    again = rows.select(F.col("vec_id").alias("again_id"), F.col("new").alias("again"))
    both = ranked.withColumns({"old_id": F.col("vec_id") - F.col("vec_id") % 3, "again_id": F.col("vec_id") - F.col("vec_id") % 2}).join(old, "old_id", "left").join(again, "again_id", "left")
    told = both.select("vec_id", quality_gate(F.col("old"), F.col("old_rank"), F.col("new"), F.col("rank"), F.col("again")).alias("t"))
    return told.select("vec_id", "t.reason", "t.verdict", F.round(F.col("t.value") * 1e6).cast("long").alias("millionths"))


#: Labelled pairs of either kind that a comparison asks at most, and the depth of its lists.
ASKED, DEPTH = 1000, 10


def drawn(pairs: DataFrame, most: int = ASKED) -> DataFrame:
    """host and dest of at most so many pairs, in the order of a hash."""
    return pairs.select("host", "dest").orderBy(F.md5(F.concat_ws(":", "host", "dest").cast("binary")), "host", "dest").limit(most)


def bake_off(vectors: DataFrame, positives: DataFrame, negatives: DataFrame, most: int = ASKED, depth: int = DEPTH) -> DataFrame:
    """One row for each provider of vectors (provider, id, vec): how it ranks the known destination of each positive pair.

    MRR, NDCG and recall at a depth, over a pool of all destinations that the drawn pairs name; mean cosines of both
    kinds of pairs and their separation; ranking, the NDCG as a share of the best one; and the winner by half the separation and
    half the NDCG, the first by name if several are best. Pairs are drawn (at most most of each kind), so the pool and
    the pairs that are compared are bounded, and both are broadcast to the vectors. A pair of which a provider lacks a
    vector counts as not found. Equal cosines are ranked by id. No pair gives no row.
    """
    sure, unsure = drawn(positives, most), drawn(negatives, most)
    n = sure.count()
    if not n:
        sure = sure.limit(0)
    unit = vectors.select("provider", "id", normalise(F.col("vec")).alias("vec"))
    named = sure.select(F.col("host").alias("id")).union(sure.select("dest")).union(unsure.select("host")).union(unsure.select("dest")).distinct()
    near = unit.join(F.broadcast(named), "id")  # four times most ids
    cosine = F.round(dot(F.col("q"), F.col("t")), 12)
    host, dest = (near.select("provider", F.col("id").alias(side), F.col("vec").alias(v)) for side, v in (("host", "q"), ("dest", "t")))
    met = lambda pairs: pairs.join(host, "host").join(dest, ["provider", "dest"])
    asked = met(sure).select("provider", "host", "dest", "q", cosine.alias("target"))
    pool = sure.select("dest").union(unsure.select("dest")).distinct().join(dest, "dest").select("provider", F.col("dest").alias("other"), "t")
    better = (cosine > F.col("target")) | ((cosine == F.col("target")) & (F.col("other") < F.col("dest")))
    ranks = asked.join(F.broadcast(pool), "provider").groupBy("provider", "host", "dest", "target").agg((F.sum(better.cast("long")) + 1).alias("rank"))
    share = lambda gain: F.sum(F.when(F.col("rank") <= depth, gain).otherwise(0.0)) / max(n, 1)
    found = ranks.groupBy("provider").agg(share(1 / F.col("rank")).alias("mrr"), share(1 / F.log2(F.col("rank") + 1)).alias("ndcg"), share(F.lit(1.0)).alias("recall"), F.avg("target").alias("positive"))
    against = met(unsure).groupBy("provider").agg(F.avg(cosine).alias("negative"))
    told = found.join(against, "provider", "left").withColumn("separation", F.col("positive") - F.coalesce("negative", F.lit(0.0)))
    every = Window.partitionBy(F.lit(0))  # a row for each provider
    place = F.row_number().over(every.orderBy(F.desc(F.round(0.5 * F.col("separation") + 0.5 * F.col("ndcg"), 12)), "provider"))
    best = F.max("ndcg").over(every)
    return told.select("provider", F.lit(n).cast("long").alias("pairs"), "mrr", "ndcg", "recall", "positive", F.coalesce("negative", F.lit(0.0)).alias("negative"), "separation", F.when(best > 0, F.col("ndcg") / best).otherwise(F.col("ndcg")).alias("ranking"), (place == 1).alias("winner"))


_kinds = ("mrr", "ndcg", "recall", "positive", "negative", "separation", "ranking")


@query(
    "v9_provider_bake_off",
    f"""WITH e AS (SELECT vec_id, label, embedding FROM embeddings), half AS (SELECT vec_id, embedding[1:32] AS embedding FROM embeddings),
unit AS (SELECT 'whole' AS provider, vec_id AS id, {_unit} AS v FROM e UNION ALL SELECT 'half', vec_id, {_unit} FROM half),
labelled AS (SELECT a.vec_id AS host, b.vec_id AS dest, a.label = b.label AS good FROM e a JOIN e b ON b.vec_id = a.vec_id + 7),
drawn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY good ORDER BY md5(CAST(host AS VARCHAR) || ':' || CAST(dest AS VARCHAR)), host, dest) AS place FROM labelled) x WHERE place <= {ASKED}),
met AS (SELECT q.provider, d.host, d.dest, d.good, q.v, ROUND(list_dot_product(q.v, t.v), 12) AS cosine FROM drawn d JOIN unit q ON q.id = d.host JOIN unit t ON t.id = d.dest AND t.provider = q.provider),
pool AS (SELECT p.dest AS other, u.provider, u.v FROM (SELECT DISTINCT dest FROM drawn) p JOIN unit u ON u.id = p.dest),
close AS (SELECT m.provider, m.host, m.dest, m.cosine AS target, pool.other, ROUND(list_dot_product(m.v, pool.v), 12) AS cosine FROM met m JOIN pool ON pool.provider = m.provider WHERE m.good),
ranks AS (SELECT provider, host, dest, target, 1 + SUM(CASE WHEN cosine > target OR (cosine = target AND other < dest) THEN 1 ELSE 0 END) AS rank FROM close GROUP BY provider, host, dest, target),
found AS (SELECT provider, SUM(CASE WHEN rank <= 10 THEN 1e0 / rank ELSE 0e0 END) / n AS mrr, SUM(CASE WHEN rank <= 10 THEN LN(2e0) / LN(rank + 1) ELSE 0e0 END) / n AS ndcg, SUM(CASE WHEN rank <= 10 THEN 1e0 ELSE 0e0 END) / n AS recall, AVG(target) AS positive, n FROM ranks, (SELECT COUNT(*) AS n FROM drawn WHERE good) s GROUP BY provider, n),
told AS (SELECT found.*, x.negative, positive - x.negative AS separation, ndcg / MAX(ndcg) OVER () AS ranking FROM found JOIN (SELECT provider, AVG(cosine) AS negative FROM met WHERE NOT good GROUP BY provider) x ON x.provider = found.provider)
SELECT provider, n AS pairs, {", ".join(f"ROUND({k}, 6) AS {k}" for k in _kinds)}, separation + ndcg = MAX(separation + ndcg) OVER () AS winner FROM told""",
)
def v9_providers(spark, sf_dir):
    """Whole vectors and their first halves; the vector seven ids on is a good destination if its label is the same."""
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))
    vectors = rows.select(F.lit("whole").alias("provider"), "id", "vec").union(rows.select(F.lit("half"), "id", F.slice("vec", 1, 32)))
    labelled = rows.select(F.col("id").alias("host"), (F.col("id") + 7).alias("dest"), "label").join(rows.select(F.col("id").alias("dest"), F.col("label").alias("other")), "dest")
    told = bake_off(vectors, labelled.where("label = other"), labelled.where("label <> other"))
    return told.select("provider", "pairs", *(F.round(k, 6).alias(k) for k in _kinds), "winner")


@query("v1_normalised_values", f"SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS place, CAST(ROUND(1e6 * unnest(v)) AS BIGINT) AS millionths FROM (SELECT vec_id, {_unit} AS v FROM embeddings) x")
def v1_values(spark, sf_dir):
    """Every number of every normalised vector."""
    values = load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(normalise(F.col("embedding"))).alias("place", "value"))
    return values.select("vec_id", F.col("place").cast("long").alias("place"), F.round(F.col("value") * 1e6).cast("long").alias("millionths"))


@query("x9_nfkc_composed", "SELECT doc_id, sha256('fi1A2 キロé ' || text) AS h FROM documents")
def x9_composed(spark, sf_dir):
    """Every text after forms that have others: a ligature, circled, wide and raised signs, a square word, a mark by itself."""
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(X.nfkc(F.concat(F.lit("ﬁ①Ａ² ㌔é "), F.col("text"))), 256).alias("h"))


@query(
    "x10_url_variants",
    r"""SELECT page_id, lower(regexp_extract(url, '^([^:]*://[^/?#]*)', 1)) || CASE WHEN p = '' THEN '/' ELSE p END || '?' || array_to_string(list_sort(list_append(q, 'a+b=c%2Fd')), '&') AS canonical
FROM (SELECT page_id, url, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS p, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_|fbclid|gclid|msclkid|mc_cid|mc_eid|_ga|ref|source|yclid|igshid)')) AS q FROM pages) x""",
)
def x10_variants(spark, sf_dir):
    """Every URL in another guise: case, port, dot segments, needless codes, tracking parameters and a fragment."""
    url = F.col("url")
    host, rest = F.regexp_extract(url, r"^([^:]*://[^/?#]*)", 1), F.regexp_extract(url, r"^[^:]*://[^/?#]*([^?#]*)", 1)
    asked = F.regexp_extract(url, r"\?([^#]*)", 1)
    port = F.when(host.startswith("https"), ":443").otherwise(":80")
    guise = F.concat(F.upper(host), port, F.lit("/./%78/.."), F.when(rest == "", "/").otherwise(rest), F.lit("?_ga=1&a%20b=c%2fd&&UTM_x=2&yclid=&"), asked, F.lit("&source=s#end"))
    return load(spark, sf_dir, "pages").select("page_id", X.canonical_url(guise).alias("canonical"))


#: The share of a normal deviation that a median deviation is, and the modified z beyond which an anchor is odd.
SCALE, ODD = 0.6745, 3.5


def bigram_bits(rows: DataFrame, text: str) -> DataFrame:
    """text, distinct and without blank ones, and bits: the entropy of its pairs of neighbouring characters in lower case; 0 below two characters."""
    names = rows.select(text).where(F.trim(text) != "").distinct()
    lower = F.lower(text)
    grams = names.select(text, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(lower) - 1)), lambda i: F.substring(lower, i, F.lit(2)))).alias("gram"))
    counts = grams.groupBy(text, "gram").agg(F.count("*").cast("double").alias("n"))
    # sum of -(n / t) log2(n / t) = log2 t - (sum of n log2 n) / t
    return counts.groupBy(text).agg(F.round(F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n"), 6).alias("bits"))


def anchor_oddity(rows: DataFrame, text: str, odd: float = ODD) -> DataFrame:
    """rows with bits, z, flagged and penalty: how far an anchor's entropy is from the median, in median deviations of all anchors.

    The penalty rises from 0 at the limit to 1 at twice the limit. Null and blank anchors have 0 bits and are not counted; without any
    deviation every z is 0. Repeated anchors count as often as they occur.
    """
    with_bits = rows.join(bigram_bits(rows, text), text, "left")
    middle = with_bits.agg(F.percentile("bits", F.lit(0.5))).first()[0] or 0.0
    spread = with_bits.agg(F.percentile(F.abs(F.col("bits") - F.lit(middle)), F.lit(0.5))).first()[0] or 0.0
    z = F.when(F.col("bits").isNotNull() & F.lit(spread >= 1e-9), SCALE * (F.col("bits") - F.lit(middle)) / F.lit(max(spread, 1e-9))).otherwise(0.0)
    told = with_bits.withColumn("z", z).withColumn("flagged", F.abs("z") > odd)
    return told.withColumn("penalty", F.when(F.col("flagged"), F.least(F.lit(1.0), (F.abs("z") - odd) / odd)).otherwise(0.0)).withColumn("bits", F.coalesce("bits", F.lit(0.0)))


@query(
    "x23_anchor_oddity",
    """WITH names AS (SELECT DISTINCT p_name FROM part WHERE trim(p_name) <> ''), grams AS (SELECT p_name, unnest(list_transform(range(1, greatest(2, length(p_name))), lambda i: substring(lower(p_name), i, 2))) AS g FROM names),
counts AS (SELECT p_name, g, CAST(COUNT(*) AS DOUBLE) AS n FROM grams GROUP BY p_name, g), share AS (SELECT p_name, n / SUM(n) OVER (PARTITION BY p_name) AS p FROM counts),
bits AS (SELECT p_name, ABS(ROUND(SUM(-p * LN(p) / LN(2)), 6)) AS bits FROM share GROUP BY p_name), parts AS (SELECT p_partkey, bits FROM part LEFT JOIN bits ON bits.p_name = part.p_name),
middle AS (SELECT quantile_cont(bits, 0.5) AS m FROM parts), spread AS (SELECT m, quantile_cont(ABS(bits - m), 0.5) AS d FROM parts, middle GROUP BY m), z AS (SELECT p_partkey, COALESCE(bits, 0e0) AS bits, COALESCE(0.6745e0 * (bits - m) / d, 0e0) AS z FROM parts, spread)
SELECT p_partkey, bits, CAST(ROUND(1e4 * z) AS BIGINT) AS z, ABS(z) > 3.5e0 AS flagged, CAST(ROUND(1e4 * CASE WHEN ABS(z) > 3.5e0 THEN LEAST(1e0, (ABS(z) - 3.5e0) / 3.5e0) ELSE 0e0 END) AS BIGINT) AS penalty FROM z""",
)
def x23_oddity(spark, sf_dir):
    told = anchor_oddity(load(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name")
    tenths = lambda c: F.round(F.col(c) * 1e4).cast("long").alias(c)
    return told.select("p_partkey", F.abs("bits").alias("bits"), tenths("z"), "flagged", tenths("penalty"))
