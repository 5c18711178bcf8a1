"""Text queries: the functions of weftline.functions.text over whole tables."""

from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.plans.registry import load, query, sql

_stop = ", ".join("'" + w.replace("'", "''") + "'" for w in X.STOPWORDS)
_tok = "regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z0-9]+)?')"
_set = f"list_filter(list_distinct({_tok}), lambda w: w NOT IN ({_stop}))"


def _docs(spark, sf_dir):
    return load(spark, sf_dir, "documents")


@query("x1_token_set", f"SELECT doc_id, len({_set}) AS n, array_to_string(list_sort({_set}), ' ') AS tokens FROM documents")
def x1(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.token_set(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.array_join(F.array_sort("t"), " ").alias("tokens"))


@query("x3_clean_bbcode", "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\\[/?[A-Za-z*][^\\]]*\\]', ' ', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS clean FROM documents")
def x3(spark, sf_dir):
    """Every text, wrapped in nested blocks that must go; the tables' own texts hold no blocks, so SQL strips tags alone."""
    wrapped = F.concat(F.lit("[QUOTE=a][b]x[/b] [QUOTE]y[code]z[/code][/QUOTE][/QUOTE][b]"), F.col("text"), F.lit("[/b]"))
    return _docs(spark, sf_dir).select("doc_id", X.clean_bbcode(wrapped).alias("clean"))


@query("x4_clean_html", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>[\s\S]*?</script>|<style[^>]*>[\s\S]*?</style>|<!--[\s\S]*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS body FROM pages")
def x4(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("body"))


@query("x5_content_hash", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '[ \t\n\r]+', ' ', 'g'))) AS hash FROM documents")
def x5(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.content_hash(F.col("text")).alias("hash"))


@query("x6_fingerprint", "SELECT doc_id, CASE WHEN length(text) >= 50 THEN sha256(text) END AS fp FROM documents")
def x6(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.fingerprint(F.col("text")).alias("fp"))


sql("x7_error_fingerprint", "SELECT event_id, SHA1(CONCAT_WS('|', event_type, CAST(user_id AS STRING), REGEXP_REPLACE(props, '[0-9]+', '#'))) AS fp FROM events", "SELECT event_id, SHA1(CONCAT_WS('|', event_type, CAST(user_id AS VARCHAR), REGEXP_REPLACE(props, '[0-9]+', '#', 'g'))) AS fp FROM events")


@query("x8_webhook_key", "SELECT event_id, 'forum:' || event_type || ':' || substring(sha256(props), 1, 16) AS k FROM events")
def x8(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", X.webhook_key(F.lit("forum"), F.col("event_type"), F.col("props")).alias("k"))


@query("x9_nfkc", "SELECT doc_id, sha256(text) AS h FROM documents")
def x9(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(X.nfkc(F.col("text")), 256).alias("h"))


@query("x10_canonical_url", r"SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*)', 1) || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END AS canonical FROM (SELECT page_id, lower(url) AS l, url, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_|gclid|fbclid|msclkid|mc_cid|mc_eid|ref)')) AS q FROM pages) x")
def x10(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", X.canonical_url(F.col("url")).alias("canonical"))


sql("x11_internal_url", "SELECT page_id, RTRIM('/', REGEXP_REPLACE(url, '[?#].*$', '')) AS url FROM pages", "SELECT page_id, RTRIM(REGEXP_REPLACE(url, '[?#].*$', ''), '/') AS url FROM pages")


@query("x12_url_depth", r"SELECT page_id, CAST(len(list_filter(string_split(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|[?#].*$', '', 'g'), '/'), lambda p: p <> '')) AS BIGINT) AS depth FROM pages")
def x12(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", X.url_depth(F.col("url")).cast("long").alias("depth"))


_links = "SELECT page_id, COUNT(*) AS links, COUNT(DISTINCT link) AS targets FROM ({}) x GROUP BY page_id"


@query("x13_html_links", _links.format("""SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS link FROM pages"""))
def x13(spark, sf_dir):
    links = load(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("link"))
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("link").alias("targets"))


@query(
    "x14_edge_building",
    """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS link, generate_subscripts(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), 1) AS pos FROM pages),
f AS (SELECT page_id, link, MIN(pos) AS pos FROM l GROUP BY page_id, link) SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS ordinal, COUNT(*) OVER (PARTITION BY page_id) AS total FROM f""",
)
def x14(spark, sf_dir):
    from pyspark.sql import Window

    links = load(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("pos", "link"))
    first = links.groupBy("page_id", "link").agg(F.min("pos").alias("pos"))
    page = Window.partitionBy("page_id")
    return first.select("page_id", "link", F.row_number().over(page.orderBy("pos")).cast("long").alias("ordinal"), F.count("*").over(page).alias("total"))


@query("x15_link_context", """SELECT page_id, CASE WHEN before >= 20 THEN 'contextual' WHEN before > 0 THEN 'weak_context' ELSE 'isolated' END AS context FROM (SELECT page_id, len(regexp_extract_all(regexp_replace(substring(html, greatest(1, instr(html, '<a ') - 80), 80), '<[^>]*>', ' ', 'g'), '[a-z]')) AS before FROM pages WHERE instr(html, '<a ') > 0) x""")
def x15(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").where(F.instr("html", "<a ") > 0)
    left = F.regexp_replace(F.substring(F.col("html"), F.greatest(F.lit(1), F.instr("html", "<a ") - 80), F.lit(80)), "<[^>]*>", " ")
    before = F.regexp_count(left, F.lit("[a-z]"))
    return pages.select("page_id", F.when(before >= 20, "contextual").when(before > 0, "weak_context").otherwise("isolated").alias("context"))


@query("x16_sentences", r"SELECT doc_id, COUNT(*) AS n, CAST(MAX(length(s)) AS BIGINT) AS longest FROM (SELECT doc_id, trim(unnest(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+', chr(10), 'g'), chr(10)))) AS s FROM documents) x WHERE s <> '' GROUP BY doc_id")
def x16(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(X.sentences(F.col("text"))).alias("s")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.char_length("s")).cast("long").alias("longest"))


@query("x17_passages", f"SELECT doc_id, CAST(n AS BIGINT) AS words, CASE WHEN n = 0 THEN 0 ELSE CAST(greatest(0, ceil((n - 150) / 120.0)) AS BIGINT) + 1 END AS windows FROM (SELECT doc_id, len({_tok}) AS n FROM documents) x")
def x17(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", X.tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("words"), F.size(X.passages(F.col("w"))).cast("long").alias("windows"))


@query(
    "x19_readability",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), s AS (SELECT doc_id, greatest(1, len(regexp_extract_all(text, '[.!?]+'))) AS n FROM documents),
y AS (SELECT doc_id, greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN regexp_matches(w, '[^aeiouy]e$') AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) AS syl FROM w)
SELECT y.doc_id, COUNT(*) AS words, CAST(SUM(syl) AS BIGINT) AS syllables, ROUND(0.39e0 * COUNT(*) / MAX(s.n) + 11.8e0 * SUM(syl) / COUNT(*) - 15.59e0, 6) AS grade, ROUND(0.4e0 * (CAST(COUNT(*) AS DOUBLE) / MAX(s.n) + 100e0 * SUM(CASE WHEN syl >= 3 THEN 1 ELSE 0 END) / COUNT(*)), 6) AS fog FROM y JOIN s ON y.doc_id = s.doc_id GROUP BY y.doc_id""",
)
def x19(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *X.readability(F.col("text"))).where("words > 0")


_anchors = "WITH a AS (SELECT p_partkey, p_name, p_type FROM part)"


@query("x20_trigram_jaccard", "WITH t AS (SELECT p_partkey, list_distinct(list_transform(range(1, greatest(2, length(p_name) - 1)), lambda i: substring(p_name, i, 3))) AS a, list_distinct(list_transform(range(1, greatest(2, length(p_type) - 1)), lambda i: substring(p_type, i, 3))) AS b FROM part) SELECT p_partkey, ROUND(len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE), 6) AS j FROM t")
def x20(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.round(X.jaccard(X.trigrams(F.col("p_name")), X.trigrams(F.col("p_type"))), 6).alias("j"))


@query("x21_damerau_levenshtein", "SELECT p_partkey, CAST(damerau_levenshtein(p_name, p_type) AS BIGINT) AS d FROM part")
def x21(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", X.damerau_levenshtein("p_name", "p_type").cast("long").alias("d"))


sql("x22_levenshtein", "SELECT p_partkey, CAST(LEVENSHTEIN(p_name, p_type) AS BIGINT) AS d, LEVENSHTEIN(p_brand, 'Brand#12') <= 1 AS near FROM part")


@query("x23_bigram_entropy", "WITH b AS (SELECT p_partkey, unnest(list_transform(range(1, greatest(2, length(p_name))), lambda i: substring(p_name, i, 2))) AS g FROM part), c AS (SELECT p_partkey, g, CAST(COUNT(*) AS DOUBLE) AS n FROM b GROUP BY p_partkey, g), p AS (SELECT p_partkey, n / SUM(n) OVER (PARTITION BY p_partkey) AS p FROM c) SELECT p_partkey, ABS(ROUND(SUM(-p * LN(p) / LN(2)), 6)) AS bits FROM p GROUP BY p_partkey")
def x23(spark, sf_dir):
    grams = load(spark, sf_dir, "part").select("p_partkey", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("p_name") - 1)), lambda i: F.substring(F.col("p_name"), i, F.lit(2)))).alias("g"))
    counts = grams.groupBy("p_partkey", "g").agg(F.count("*").cast("double").alias("n"))
    total = counts.groupBy("p_partkey").agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return counts.join(total, "p_partkey").groupBy("p_partkey").agg(F.abs(F.round(F.sum(-p * F.log(p) / F.log(F.lit(2.0))), 6)).alias("bits"))


_generic = ["click here", "read more", "this", "here", "the"]


@query("x24_generic_phrases", "SELECT doc_id, " + " + ".join(f"CASE WHEN contains(lower(text), '{g}') THEN 1 ELSE 0 END" for g in _generic) + " AS hits FROM documents")
def x24(spark, sf_dir):
    hits = sum((F.lower("text").contains(g).cast("int") for g in _generic), F.lit(0))
    return _docs(spark, sf_dir).select("doc_id", hits.alias("hits"))


@query("x25_descriptiveness", "WITH t AS (SELECT p_partkey, p_name, p_type, list_distinct(list_transform(range(1, greatest(2, length(p_name) - 1)), lambda i: substring(p_name, i, 3))) AS a, list_distinct(list_transform(range(1, greatest(2, length(p_type) - 1)), lambda i: substring(p_type, i, 3))) AS b FROM part) SELECT p_partkey, ROUND(0.6 * len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE) - 0.4 * levenshtein(p_name, p_type) / CAST(greatest(length(p_name), length(p_type)) AS DOUBLE), 6) AS score FROM t")
def x25(spark, sf_dir):
    j = X.jaccard(X.trigrams(F.col("p_name")), X.trigrams(F.col("p_type")))
    far = F.levenshtein("p_name", "p_type") / F.greatest(F.char_length("p_name"), F.char_length("p_type"))
    return load(spark, sf_dir, "part").select("p_partkey", F.round(0.6 * j - 0.4 * far, 6).alias("score"))


@query("x26_normalise_anchor", r"SELECT p_partkey, regexp_replace(regexp_replace(lower('  ' || p_name || ' -! '), '[ \t\n\r]+', ' ', 'g'), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g') AS anchor FROM part")
def x26(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", X.normalise_anchor(F.concat(F.lit("  "), "p_name", F.lit(" -! "))).alias("anchor"))


@query("x28_query_tokens", "SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: length(w) > 1), ' ') AS q FROM benchmark")
def x28(spark, sf_dir):
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9_]+"), lambda w: F.char_length(w) > 1)
    return load(spark, sf_dir, "benchmark").select("item_id", F.array_join(words, " ").alias("q"))


@query("a29_term_baseline", f"SELECT w AS term, COUNT(*) AS tf, COUNT(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_tok}) AS w FROM documents) x GROUP BY w")
def a29(spark, sf_dir):
    per_doc = _docs(spark, sf_dir).select("doc_id", F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


@query("a30_document_frequency", f"SELECT w AS term, COUNT(*) AS df FROM (SELECT unnest({_set}) AS w FROM documents) x GROUP BY w")
def a30(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.explode(X.token_set(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@query(
    "x33_distil",
    r"""WITH s AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents) x),
r AS (SELECT doc_id, i, (1e0 + 0.4e0 * CASE WHEN regexp_matches(s, ' [A-Z][a-z]+') THEN 1 ELSE 0 END) * exp(-0.15e0 * i) AS score FROM s) SELECT doc_id, i, ROUND(score, 6) AS score FROM (SELECT doc_id, i, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rn FROM r) x WHERE rn <= 5""",
)
def x33(spark, sf_dir):
    from pyspark.sql import Window

    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("i", "s"))
    rows = rows.select("doc_id", F.col("i").cast("long").alias("i"), ((1 + 0.4 * F.col("s").rlike(" [A-Z][a-z]+").cast("int")) * F.exp(-0.15 * F.col("i"))).alias("score"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "i"))
    return rows.withColumn("rn", place).where("rn <= 5").select("doc_id", "i", F.round("score", 6).alias("score"))
