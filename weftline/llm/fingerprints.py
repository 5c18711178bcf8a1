"""I-Match document fingerprints with randomised lexicons, in DataFrame operations only.

A document keeps the distinct terms whose document frequency lies in a band, sorted. Each of LEXICONS randomised
lexicons keeps a hashed share of them (a half down to a thousandth), and the terms a lexicon keeps are hashed into
one signature; the signatures together are the fingerprint. Two fingerprints are compared over the lexicons in which
at least one of them keeps a few terms (1 to FEW): a change of a few terms leaves many of these as they were.

Frequencies are counted over all documents, for each term by itself (its hash of 64 bits), pre-aggregated where the
documents are read, so a frequent word costs each task one row. A term of the band is in one of RARE documents or more,
so the band holds at most RARE times the distinct terms of a mean document, however large the corpus. It is counted, and
reaches the rows as one constant with two bits set for each term, among SPREAD or more times as many bits as terms: every
term of the band is kept, and of the others those whose two bits are both set by terms of the band, at most one in 144.

Null text counts as empty; a text without a term of the band falls back on all its terms, and one without any term
on the text itself; equal texts have equal fingerprints; an empty table gives no rows; rows that repeat a doc_id are
ordered by their text; texts of any length are read whole; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import common

#: Bits for each term of the band at least, and the power of two that the band's bits begin at.
SPREAD, LEAST_BITS = 24, 20
#: Terms in fewer documents than one in RARE, or in more than a share of COMMON, are outside the band.
RARE, COMMON, LEAST = 1000, 0.2, 2
#: Each lexicon takes the terms whose hash has its bits, from an offset on, all 0: (offset, bits).
LEXICONS = tuple((13 * k % 53, 1 + k % 10) for k in range(40))
FEW = 4


def terms(text: Column) -> Column:
    """The hashes of a text's distinct terms: its runs of letters and digits in lower case."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def places(term: Column, size: int) -> list[Column]:
    """The two bits of a hashed term among 2 ** size."""
    return [F.shiftrightunsigned(term, at).bitwiseAND(F.lit((1 << size) - 1)).cast("int") for at in (0, size)]


def band_bits(terms: int) -> int:
    """The power of two that a band of so many terms takes; a band of 89 million terms fills the largest, 2 ** 31."""
    return min(31, max(LEAST_BITS, (SPREAD * terms - 1).bit_length()))


def lexicon(docs: DataFrame) -> tuple[Column, int]:
    """(bits, size): the bits of all terms whose document frequency is in the band, in an array of 2 ** size / 64 numbers."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    low, high = max(LEAST, -(-n // RARE)), max(LEAST, int(n * COMMON))
    kept = common.materialize(counts.where(F.col("df").between(low, high)).select("term"), "band")
    size = band_bits(kept.count())
    at = kept.select(F.explode(F.array(*places(F.col("term"), size))).alias("place"))
    words = at.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, place & 63)")).alias("bits"))
    found = words.collect()  # two numbers a term of the band at most, which doesn't grow with the number of documents
    common.drop_table(kept)
    # one literal; an array() of as many expressions would be analysed anew with every plan
    context = docs.sparkSession.sparkContext
    bits = context._gateway.new_array(context._jvm.long, (1 << size) // 64)
    for r in found:
        bits[r.word] = r.bits
    return Column(context._jvm.org.apache.spark.sql.functions.lit(bits)), size


def in_band(band: tuple[Column, int], term: Column) -> Column:
    bits, size = band
    first, second = (F.getbit(F.get(bits, F.shiftright(p, 6)), p.bitwiseAND(F.lit(63))) == 1 for p in places(term, size))
    return first & second


def keeps(at: int, bits: int):
    """Whether a lexicon keeps a term, by the term's hash."""
    return lambda h: F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << bits) - 1)) == 0


def with_signatures(df: DataFrame, text: str, out: str, band: tuple[Column, int]) -> DataFrame:
    """df with out: an array of (few, signature) for each lexicon, signature empty where the lexicon keeps nothing."""
    every, kept, hashes = f"{out}_every", f"{out}_kept", f"{out}_hashes"
    df = df.withColumn(every, terms(F.col(text)))
    df = df.withColumn(kept, F.filter(every, lambda t: in_band(band, t)))
    df = df.withColumn(hashes, F.array_sort(F.when(F.size(kept) > 0, F.col(kept)).otherwise(F.col(every))))
    own = F.struct(F.lit(False).alias("few"), F.lower(F.hex(F.xxhash64(F.when(F.size(hashes) > 0, F.lit("")).otherwise(F.col(text)), F.col(hashes)))).alias("signature"))
    subsets = F.array(*(F.filter(hashes, keeps(at, bits)) for at, bits in LEXICONS))
    signed = F.transform(subsets, lambda s: F.struct(F.size(s).between(1, FEW).alias("few"), F.when(F.size(s) > 0, F.substring(F.lpad(F.lower(F.hex(F.xxhash64(s))), 16, "0"), 1, 8)).otherwise("").alias("signature")))
    return df.withColumn(out, F.concat(F.array(own), signed)).drop(every, kept, hashes)


def as_string(signatures: Column) -> Column:
    return F.array_join(F.transform(signatures, lambda s: s["signature"]), "-")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal signatures among the lexicons that keep a few terms of either; else whether all are equal."""
    each = F.zip_with(a, b, lambda x, y: F.when(x["few"] | y["few"], (x["signature"] == y["signature"]).cast("int")))
    told = F.filter(each, lambda e: e.isNotNull())
    same = F.aggregate(told, F.lit(0), lambda s, e: s + e)
    return F.when(a == b, 1.0).when(F.size(told) > 0, same / F.size(told)).otherwise(0.0).cast("double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document."""
    docs = common.id_text(docs)
    band = lexicon(docs)
    return with_signatures(docs, "text", "signatures", band).select("doc_id", as_string(F.col("signatures")).alias("fingerprint"))


def in_runs(docs: DataFrame, runs: int) -> DataFrame:
    """docs with run and guest: runs of ascending doc_id of about equal size, each ended by a guest, the first row of the next run.

    So a row's successor is in its own run, and the order needs no task that sees all rows. The run's bounds are
    quantiles of doc_id; what reaches the driver is one id for each run.
    """
    spark = docs.sparkSession
    bounds = sorted(set(docs.approxQuantile("doc_id", [i / runs for i in range(1, runs)], 0.2 / runs))) if runs > 1 else []
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    padded = F.array(*(F.lit(int(b)).cast("long") for b in [*bounds, *[(1 << 63) - 1] * ((1 << len(steps)) - len(bounds))]))
    run = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when(F.get(padded, at + step - 1) < F.col("doc_id"), step).otherwise(0)) if steps else F.lit(0)
    dealt = docs.withColumn("run", run)
    firsts = sorted((r.run, r.first) for r in dealt.groupBy("run").agg(F.min("doc_id").alias("first")).collect())
    if not firsts:
        return dealt.withColumn("guest", F.lit(0))
    nexts = [(firsts[i - 1][0], doc) for i, (_, doc) in enumerate(firsts)]
    guests = F.broadcast(spark.createDataFrame(nexts, "run int, doc_id long"))  # a row for each run
    return dealt.withColumn("guest", F.lit(0)).unionByName(docs.join(guests, "doc_id").withColumn("guest", F.lit(1)))


def edited_fingerprints(docs: DataFrame, runs: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's."""
    docs = common.id_text(docs)
    runs = runs or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    band = lexicon(docs)
    order = Window.partitionBy("run").orderBy("guest", "doc_id", "text")
    rows = in_runs(docs, runs).withColumns({"next": F.lead("text").over(order), "row": F.row_number().over(order)})
    n_cut = F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - n_cut), F.substring(F.coalesce("next", F.lit("")), F.lit(1), n_cut))
    rows = rows.withColumn("edited", edited).drop("next")
    rows = rows.withColumns({"n_chars": F.char_length("text").cast("long"), "edited_sha256": F.sha2("edited", 256)})
    rows = with_signatures(with_signatures(rows, "text", "own", band), "edited", "other", band).drop("text", "edited")
    rows = rows.withColumn("after", F.lead("own").over(Window.partitionBy("run").orderBy("row")))
    return rows.where("guest = 0").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("own")).alias("fingerprint"),
        as_string(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
