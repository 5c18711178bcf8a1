"""Anchor texts that other pages use for a destination: variants, families, and what they say of a new anchor.

A variant is a destination's anchors with the same words (stopwords left out). Two variants belong together if the
longest run of words that both have is two words or more and 60 % of the shorter one; if one is the other with a word
more at an end; or if neither has more than two words and one edit makes them equal. Families are the components.

Components need no pairs. Every variant has keys, and each key has a hub that belongs together with all that have it:

* a run of m words, m being what a variant of the hub's length must share: the hub is such a variant, and any variant
  of its length or more that holds the run belongs to it;
* the text with one letter left out at a place, for texts of equal length: all that have it are one edit apart;
* a whole text, or a single word, as what a longer one leaves when it loses a letter or an end word: the hub is the
  variant of just that text.

So there are as many links as keys, however many variants of a destination share a word. Keys are made once for each
different text, and those that no other text has go before they meet the destinations.

Joins name the merge: a table of keys is many times its Parquet file, by whose size Spark would take it for a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import STOPWORDS
from weftline.operators import graph
from weftline.plans.registry import query, tables
from weftline.plans.rounds import written

# Fixed values.
NOISE = ("click here", "here", "read more", "this link", "link", "source", "website", "visit site")
FAMILIES = 8
LEAST_SOURCES, LEAST_SHARE = 2, 0.15


def all_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+(?:'[a-z0-9]+)?"), F.lit(0))


def content(text: Column) -> Column:
    return F.filter(all_words(text), lambda w: ~w.isin(*STOPWORDS))


def must_share(n: Column) -> Column:
    """Words in a row that a variant of n words, as the shorter one, must share."""
    return F.greatest(F.lit(2), F.ceil(n * F.lit(6) / F.lit(10)).cast("int"))


def keys(words: Column) -> Column:
    """(key, short) of a variant: short tells that it is a hub of the key's kind."""
    n, text = F.size(words), F.array_join(words, " ")
    word = lambda kind, x, short: F.struct(F.concat(F.lit(kind), x).alias("key"), short.alias("short"))
    none = F.array().cast("array<struct<key:string,short:boolean>>")
    # runs of m words for each m that a variant of this length or a shorter one must share
    lengths = F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(2), n), must_share))).otherwise(F.array().cast("array<int>"))
    runs = F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1))), lambda i: word("r", F.array_join(F.slice(words, i, m), " "), must_share(n) <= m))))
    ends = F.when(n == 2, F.array(word("w", words[0], F.lit(False)), word("w", words[1], F.lit(False)))).when(n == 1, F.array(word("w", words[0], F.lit(True)))).otherwise(none)
    size = F.char_length(text)
    without = lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, size))
    places = F.sequence(F.lit(1), F.greatest(size, F.lit(1)))
    swapped = F.transform(places, lambda i: word("s", F.concat(i.cast("string"), F.lit(":"), without(i)), F.lit(True)))
    shorter = F.transform(places, lambda i: word("d", without(i), F.lit(False)))
    edits = F.when(n <= 2, F.concat(swapped, shorter, F.array(word("d", text, F.lit(True))))).otherwise(none)
    return F.array_distinct(F.concat(F.coalesce(runs, none), ends, edits))


def variants(rows: DataFrame, noise: bool = True) -> DataFrame:
    """destination, words, sources, share, display, shown, order of rows (destination, source, anchor).

    Anchors of noise, without words, or without a source count for nothing. share: of the destination's usable sources.
    """
    shown = F.trim(F.coalesce("anchor", F.lit("")))
    rows = rows.where("destination IS NOT NULL AND source IS NOT NULL").select("destination", "source", shown.alias("anchor"), content(F.col("anchor")).alias("words"), F.array_join(all_words(F.col("anchor")), " ").alias("raw")).where(F.size("words") > 0)
    if noise:
        rows = rows.where(~F.array_join("words", " ").isin(*NOISE) & ~F.col("raw").isin(*NOISE))
    total = rows.groupBy("destination").agg(F.countDistinct("source").alias("usable"))
    sources = rows.groupBy("destination", "words").agg(F.countDistinct("source").alias("sources"))
    best = F.struct(-F.col("n"), F.lower("anchor"), "anchor")
    display = rows.groupBy("destination", "words", "anchor").agg(F.count("*").alias("n")).groupBy("destination", "words").agg(F.min_by(F.struct("anchor", "n"), best).alias("d"))
    out = sources.join(display.hint("merge"), ["destination", "words"]).join(total.hint("merge"), "destination")
    out = out.select("destination", "words", "sources", "usable", F.col("d.anchor").alias("display"), F.col("d.n").alias("shown"))
    return out.withColumn("place", F.struct((-F.col("sources")).alias("a"), (-F.size("words")).alias("b"), (-F.col("shown")).alias("c"), F.lower("display").alias("d"), F.col("words").alias("e")))


def text_keys(named: DataFrame) -> DataFrame:
    """words, key, short of the different texts in named, as a table."""
    return written(named.select("words").distinct().select("words", F.explode(keys(F.col("words"))).alias("k")).select("words", "k.key", "k.short"), "keys")


def hub_links(named: DataFrame) -> DataFrame:
    """src and dst: every variant (id) with the least hub of each of its keys."""
    of_text = text_keys(named)
    # a link is between two texts that have a key, one of them as its hub
    met = of_text.groupBy("key").agg(F.count("*").alias("n"), F.bool_or("short").alias("has_hub")).where("n > 1 AND has_hub").select("key")
    keyed = written(named.select("destination", "id", "words").join(of_text.join(met.hint("merge"), "key").hint("merge"), "words").select("destination", "id", "key", "short"), "keyed")
    hubs = keyed.where("short").groupBy("destination", "key").agg(F.min("id").alias("hub"))
    return keyed.join(hubs.hint("merge"), ["destination", "key"]).where("id <> hub").select(F.col("id").alias("src"), F.col("hub").alias("dst")).distinct()


def families(rows: DataFrame, noise: bool = True) -> tuple[DataFrame, DataFrame]:
    """(families, members) of rows (destination, source, anchor): the first eight of each destination, and their variants.

    families: destination, family, canonical, canonical_words, share, sources, n_variants, usable, rank. members: destination,
    family, words, display, sources, usable.
    """
    found = variants(rows, noise)
    named = written(found.withColumn("id", F.xxhash64(F.col("destination").cast("string"), "words")), "variants")
    joined = named.join(graph.labels(hub_links(named)).hint("merge"), F.col("id") == F.col("node"), "left").withColumn("family", F.coalesce("root", "id"))
    members = written(joined.select("destination", "family", "words", "display", "sources", "usable", "place"), "members")
    usable = rows.select("destination", "source", content(F.col("anchor")).alias("words"))
    support = usable.join(members.select("destination", "words", "family").hint("merge"), ["destination", "words"]).groupBy("destination", "family").agg(F.countDistinct("source").alias("sources"))
    told = members.groupBy("destination", "family").agg(F.min_by(F.struct("display", "words"), "place").alias("first"), F.count("*").alias("n_variants"), F.first("usable").alias("usable"))
    told = told.join(support.hint("merge"), ["destination", "family"]).select("destination", "family", F.col("first.display").alias("canonical"), F.col("first.words").alias("canonical_words"), (F.col("sources") / F.col("usable")).alias("share"), "sources", "n_variants", "usable")
    order = Window.partitionBy("destination").orderBy(F.desc("sources"), F.desc(F.size("canonical_words")), F.lower("canonical"), "family")
    kept = written(told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= FAMILIES), "families")
    return kept, members.join(kept.select("destination", "family").hint("merge"), ["destination", "family"], "left_semi").drop("place")


def corroborate(candidates: DataFrame, rows: DataFrame, least_sources: int = LEAST_SOURCES, least_share: float = LEAST_SHARE, noise: bool = True) -> DataFrame:
    """id, state, score, canonical of candidates (id, destination, anchor, sentence) against the anchors in rows.

    States: exact_variant_match, family_match, host_contains_canonical_variant, and neutral ones (no data, too few
    sources, no anchor, no family). A neutral score is 0.5.
    """
    kept, members = families(rows, noise)
    rank = F.struct((-F.col("share")).alias("a"), (-F.col("f_sources")).alias("b"), (-F.col("own")).alias("c"), F.lower("canonical").alias("d"))
    known = members.select("destination", "family", "words", (F.col("sources") / F.col("usable")).alias("own")).join(kept.select("destination", "family", "canonical", "share", F.col("sources").alias("f_sources")).hint("merge"), ["destination", "family"])
    known = written(known.select("destination", "words", "canonical", "share", "f_sources", "own", rank.alias("rank")), "known")
    asked = written(candidates.select("id", "destination", content(F.col("anchor")).alias("words"), F.concat(F.lit(" "), F.array_join(content(F.col("sentence")), " "), F.lit(" ")).alias("sentence")), "asked")
    best = lambda c: F.min_by(F.struct("canonical", "share", "f_sources", "own", "rank"), "rank").alias(c)
    exact = asked.join(known.hint("merge"), ["destination", "words"]).groupBy("id").agg(best("exact"))
    # the best variant of each key, and the best hub of it, stand for all: a candidate asks for one row a key
    theirs, ours = text_keys(known), text_keys(asked)
    theirs, ours = (x.join(y.select("key").distinct().hint("merge"), "key", "left_semi") for x, y in ((theirs, ours), (ours, theirs)))
    of_key = known.join(theirs.hint("merge"), "words").select("destination", "key", "short", "canonical", "share", "f_sources", "own", "rank")
    tops = of_key.groupBy("destination", "key").agg(best("any"), F.min_by(F.struct("canonical", "share", "f_sources", "own", "rank"), F.when(F.col("short"), F.col("rank"))).alias("hub"), F.bool_or("short").alias("has_hub"))
    mine = asked.select("id", "destination", "words").join(ours.hint("merge"), "words").select("id", "destination", "key", "short")
    near = mine.join(tops.hint("merge"), ["destination", "key"]).where("short OR has_hub").select("id", F.when(F.col("short"), F.col("any")).otherwise(F.col("hub")).alias("f"))
    family = near.select("id", "f.*").groupBy("id").agg(best("family"))
    held = asked.join(kept.select("destination", "canonical", "canonical_words", "rank").hint("merge"), "destination").where(F.contains(F.col("sentence"), F.concat(F.lit(" "), F.array_join("canonical_words", " "), F.lit(" ")))).groupBy("id").agg(F.min_by("canonical", "rank").alias("held"))
    usable = kept.groupBy("destination").agg(F.max("usable").alias("usable"))
    out = asked.join(usable.hint("merge"), "destination", "left").join(exact.hint("merge"), "id", "left").join(family.hint("merge"), "id", "left").join(held.hint("merge"), "id", "left")
    ok = lambda c: F.coalesce(F.col(f"{c}.share") >= least_share, F.lit(False))
    state = (
        F.when(F.col("usable").isNull(), "neutral_no_learned_anchor_data")
        .when(F.col("usable") < least_sources, "neutral_below_min_sources")
        .when(F.size("words") == 0, "neutral_no_anchor_candidate")
        .when(ok("exact"), "exact_variant_match")
        .when(ok("family"), "family_match")
        .when(F.col("held").isNotNull(), "host_contains_canonical_variant")
        .otherwise("neutral_no_family_match")
    )
    strength = lambda c, match, own: 0.5 + 0.5 * F.least(F.lit(1.0), match + 0.25 * F.least(F.lit(1.0), F.col(f"{c}.share")) + own + 0.15 * F.least(F.lit(1.0), F.col(f"{c}.f_sources") / 5))
    out = out.withColumn("state", state)
    score = F.when(F.col("state") == "exact_variant_match", strength("exact", 0.45, 0.15 * F.col("exact.own"))).when(F.col("state") == "family_match", strength("family", 0.45 * 0.65, F.lit(0.0))).otherwise(0.5)
    canonical = F.when(F.col("state") == "exact_variant_match", F.col("exact.canonical")).when(F.col("state") == "family_match", F.col("family.canonical")).when(F.col("state") == "host_contains_canonical_variant", F.col("held"))
    return out.select("id", "state", score.alias("score"), canonical.alias("canonical"))


def part_anchors(spark, sf_dir) -> DataFrame:
    """Line items as links: from an order to a supplier, under a form of the part's name."""
    tables(spark, sf_dir)
    return spark.sql("SELECT l_suppkey AS destination, l_orderkey AS source, CASE l_linenumber % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' ', lower(p_type)) WHEN 2 THEN concat('the ', p_name, 's') ELSE 'click here' END AS anchor FROM lineitem JOIN part ON l_partkey = p_partkey")


@query("x38_anchor_families")
def x38_families(spark, sf_dir):
    kept, _ = families(part_anchors(spark, sf_dir))
    return kept.select("destination", "rank", "canonical", F.round("share", 6).alias("share"), "sources", "n_variants")


@query("x38_anchor_corroboration")
def x38(spark, sf_dir):
    """Every part's name as an anchor for the supplier of the same number, in a sentence with the part's type."""
    rows = part_anchors(spark, sf_dir)
    suppliers = spark.sql("SELECT max(s_suppkey) + 1 AS n FROM supplier").first()[0]
    candidates = spark.sql(f"SELECT p_partkey AS id, p_partkey % {suppliers} AS destination, p_name AS anchor, concat('We have a ', p_name, ' and ', lower(p_type)) AS sentence FROM part")
    return corroborate(candidates, rows).select("id", "state", F.round("score", 6).alias("score"), "canonical")
