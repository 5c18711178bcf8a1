"""Phrase collocations of each language, mined by growing contiguous patterns to the right (in the manner of PrefixSpan).

1. Words are counted; those met LEAST times are the prefixes of one word.
2. Each frequent word's occurrences are projected on the word that follows: the frequent prefixes of two words.
3. Each occurrence of a frequent prefix of two words is a pointer into the words that follow it, as far as these go
   on in frequent pairs. The projections are dealt out by prefix, and the task that has a prefix's pointers extends it
   word by word, depth first: it sorts the pointers by the word they point at, and goes on with each run that is
   frequent. A prefix with a large share of all occurrences (at most HOT of them can exist) is dealt out by its next
   word too; all occurrences of each longer pattern still meet in one task.
4. A phrase is scored by its weakest cut, and dropped if a longer phrase that holds it is nearly as frequent.

Words are numbers of 64 bits on the way: a hash of language and word, worked out over the bytes of a batch at once.
No two different words may share one: this is checked over the whole vocabulary, and a clash takes another seed.
So counts are exact. Filters of fixed size keep rare words and pairs from the shuffle; they let some of them through
(more on a large corpus), and the counts after the shuffle decide. Scores use decimals of 38 digits.

Null text: no words. Null lang: `und`. Repeated rows count each time. Texts of any length are read whole. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import common
from weftline.llm.shingles import mix, powers, stretches

#: Occurrences of a phrase at least; words of a phrase; phrases of each language in the result.
LEAST, MOST_WORDS, TOP = 10, 3, 2000
#: A longer phrase with this percentage of a phrase's occurrences stands for it.
HELD = 50
#: A prefix with more than this share of all pointers is dealt out by its next word as well.
HOT = 1024
#: Bits a filter has for each key it holds, and in all at least and at most.
BITS, FEWEST_BITS, MOST_BITS = 16, 20, 27
#: Bytes of text that are worked on at once; a longer text by itself.
SLICE = 1 << 20
#: Parts a language's phrases are ranked in before the last ranking.
RANK_PARTS = 32

#: A-Z to a-z, tab to space, and what ends a piece to a line end.
_bytes = bytearray(range(256))
_bytes[65:91] = bytes(range(97, 123))
_bytes[9] = 32
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _bytes[_c] = 10
_bytes = bytes(_bytes)
_inside = np.array([_bytes[c] not in b" \n" for c in range(256)])


def _values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def analysed(texts: list[bytes], lang: str, seed: int) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Of some texts of one language: each word's number, whether the next word follows in the same piece, the bytes, starts and ends."""
    whole = b"\n".join(texts).translate(_bytes)
    raw = np.frombuffer(whole, np.uint8)
    starts, ends = stretches(_inside[raw])
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_values(seed)[raw] * up[:-1], out=sums[1:])
    own = np.uint64(int.from_bytes(lang.encode()[-8:], "little") ^ len(lang))
    h = mix(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)) + mix(np.array([own + np.uint64(seed)], np.uint64)))
    piece = np.cumsum(raw == 10)[starts] if len(starts) else starts
    return h, piece[1:] == piece[:-1], whole, starts, ends


def slices(docs: DataFrame, seed: int, work, schema: str) -> DataFrame:
    """work(lang, *analysed()) of every slice of texts; returns a batch each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = b.column("lang"), b.column("text").cast(pa.binary())
            for lang in langs.unique().to_pylist():
                some, held = [], 0
                for text in texts.filter(pc.equal(langs, lang)).to_pylist():
                    if held and held + len(text) > SLICE:
                        yield work(lang, *analysed(some, lang, seed))
                        some, held = [], 0
                    some.append(text)
                    held += len(text)
                yield work(lang, *analysed(some, lang, seed))

    return docs.mapInArrow(run, schema)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different tuple of numbers stands first, and how often it stands there."""
    if len(keys) == 1:
        _, first, counts = np.unique(keys[0], return_index=True, return_counts=True)
        return first, counts
    one = keys[0]
    for k in keys[1:]:
        one = mix(one) + k
    _, first, inverse, counts = np.unique(one, return_index=True, return_inverse=True, return_counts=True)
    if all((k[first][inverse] == k).all() for k in keys):
        return first, counts
    order = np.lexsort(keys)  # two tuples share a number
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[order][1:] != k[order][:-1]
    at = np.flatnonzero(fresh)
    return order[at], np.diff(np.append(at, len(order)))


class Filter:
    """A set of numbers, one bit each among a power of two; finds all members and some others."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.mask = np.zeros(1 << (bits - 3), np.uint8)

    def of(self, x: np.ndarray) -> np.ndarray:
        at = x >> np.uint64(64 - self.bits)
        return (self.mask[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def filter_of(keys: DataFrame, n: int) -> Filter:
    """A filter of a table of numbers (key), put together from the bytes of it that tasks have set; no larger than MOST_BITS."""
    bits = min(MOST_BITS, max(FEWEST_BITS, (BITS * n - 1).bit_length()))
    part = F.shiftrightunsigned("key", 64 - bits)
    words = keys.withColumn("part", part).select(F.shiftright("part", 6).alias("word"), F.expr("shiftleft(1L, CAST(part & 63 AS INT))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # of a fixed size, whatever the corpus
    out = Filter(bits)
    longs = np.zeros(1 << (bits - 6), np.int64)
    longs[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    out.mask = longs.view(np.uint8)
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of words, for filters."""
    return mix(mix(a) + b)


def vocabulary(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, h and n of every word."""

    def work(lang, h, follows, whole, starts, ends):
        first, counts = distinct(h)
        words = pa.array([whole[a:z] for a, z in zip(starts[first].tolist(), ends[first].tolist())], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), words, signed(h[first]), pa.array(counts)], ["lang", "word", "h", "n"])

    rows = slices(docs, seed, work, "lang string, word string, h long, n long")
    return common.materialize(rows.groupBy("lang", "word", "h").agg(F.sum("n").alias("n")), "words")


def clashes(words: DataFrame) -> bool:
    """Whether two words share a number."""
    key = F.struct("lang", "word")
    return not words.groupBy("h").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a <> b").isEmpty()


def frequent_pairs(docs: DataFrame, seed: int, known: Filter, least: int) -> DataFrame:
    """h1, h2 and n of the pairs of neighbouring words that are frequent: each frequent word's projection, counted."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def work(lang, h, follows, whole, starts, ends):
        ok = sent.value.of(h)
        at = np.flatnonzero(follows & ok[:-1] & ok[1:])
        a, b = h[at], h[at + 1]
        first, counts = distinct(a, b)
        return pa.RecordBatch.from_arrays([signed(a[first]), signed(b[first]), pa.array(counts)], ["h1", "h2", "n"])

    rows = slices(docs, seed, work, "h1 long, h2 long, n long")
    return common.materialize(rows.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "pairs")


def projections(docs: DataFrame, seed: int, pairs: Filter, hot: np.ndarray, most_words: int) -> DataFrame:
    """h1, h2, part, rest (the words that follow) and n: the pointers of each frequent prefix of two words, alike ones of a slice once.

    rest goes on as long as neighbours are in pairs, up to most_words in all. part deals hot prefixes out by their next word.
    """
    sent, more = docs.sparkSession.sparkContext.broadcast((pairs, hot)), most_words - 2

    def work(lang, h, follows, whole, starts, ends):
        known, often = sent.value
        both = np.append(follows & known.of(joined(h[:-1], h[1:])), False) if len(h) else np.zeros(0, bool)
        goes = both.copy()  # whether the word before the last one in sight goes on
        length = np.zeros(len(h), np.int64)  # words of rest
        for k in range(1, more + 1):
            goes = goes[:-1] & both[k:] if k < len(h) else goes[:0]
            length[: len(goes)] += goes
        at = np.flatnonzero(length)
        columns = [h[at], h[at + 1], *(np.where(length[at] > k, h[np.minimum(at + 2 + k, len(h) - 1)], 0).astype(np.uint64) for k in range(more))]
        first, counts = distinct(*columns, length[at].astype(np.uint64))
        columns, length = [c[first] for c in columns], length[at][first]
        dealt = joined(columns[0], columns[1])
        is_hot = often[np.minimum(np.searchsorted(often, dealt), len(often) - 1)] == dealt if len(often) else np.zeros(len(dealt), bool)
        part = np.where(is_hot, columns[2] & np.uint64(1023), 0).astype(np.int32)
        flat = np.stack(columns[2:], 1)[np.arange(more)[None, :] < length[:, None]]
        rest = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), signed(flat))
        return pa.RecordBatch.from_arrays([signed(columns[0]), signed(columns[1]), pa.array(part), rest, pa.array(counts)], ["h1", "h2", "part", "rest", "n"])

    return slices(docs, seed, work, "h1 long, h2 long, part int, rest array<long>, n long")


def grow(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[list[int], int]]:
    """Every frequent extension of one prefix, and how often it stands there, depth first.

    Pointers run from starts to ends in words; n is how often each was met.
    """
    stack = [([], starts, ends, n)]
    while stack:
        grown, at, last, times = stack.pop()
        if grown:
            yield grown, int(times.sum())
        on = at < last
        at, last, times = at[on], last[on], times[on]
        if times.sum() < least:
            continue
        order = np.argsort(words[at], kind="stable")
        at, last, times = at[order], last[order], times[order]
        edges = np.flatnonzero(np.concatenate(([True], np.diff(words[at]) != 0)))
        sums = np.add.reduceat(times, edges)
        for a, z, s in zip(edges.tolist(), [*edges[1:].tolist(), len(at)], sums.tolist()):
            if s >= least:
                stack.append(([*grown, int(words[at[a]])], at[a:z] + 1, last[a:z], times[a:z]))


def extended(rows: DataFrame, least: int) -> DataFrame:
    """words and n of every frequent pattern of three words or more, grown from the projections in the task that has their prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            # a prefix's rows stand together: those of the last prefix wait for the next batch
            key = np.stack([b.column(c).to_numpy() for c in ("h1", "h2", "part")], 1)
            turns = np.flatnonzero((key[1:] != key[:-1]).any(1))
            new = bool(held) and not (key[0] == last).all()
            last = key[-1]
            if new:
                yield patterns(held, least)
                held = []
            if len(turns):
                cut = int(turns[-1]) + 1
                yield patterns([*held, b.slice(0, cut)], least)
                held, b = [], b.slice(cut)
            held.append(b)
        if held:
            yield patterns(held, least)

    dealt = rows.repartition("h1", "h2", "part").sortWithinPartitions("h1", "h2", "part")
    return dealt.mapInArrow(run, "words array<long>, n long")


def patterns(batches: list[pa.RecordBatch], least: int) -> pa.RecordBatch:
    """The frequent patterns of whole projections."""
    t = pa.Table.from_batches(batches).combine_chunks()
    h1, h2, part, n = (t.column(c).to_numpy() for c in ("h1", "h2", "part", "n"))
    rest = t.column("rest").combine_chunks()
    lengths = rest.value_lengths().to_numpy()
    words, ends = rest.flatten().to_numpy(), np.cumsum(lengths)
    starts = ends - lengths
    fresh = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (part[1:] != part[:-1]))))
    sums = np.add.reduceat(n, fresh)
    found, times = [], []
    for a, z, s in zip(fresh.tolist(), [*fresh[1:].tolist(), len(h1)], sums.tolist()):
        if s >= least:
            for grown, k in grow(words, starts[a:z], ends[a:z], n[a:z], least):
                found.append([int(h1[a]), int(h2[a]), *grown])
                times.append(k)
    return pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64())), pa.array(times, pa.int64())], ["words", "n"])


def scored(frequent: DataFrame) -> DataFrame:
    """words, a, l, r and score of every phrase of two words or more, from words and n of all frequent patterns; those held by longer ones go."""
    phrases = frequent.where(F.size("words") > 1).withColumnRenamed("n", "a")
    cuts = phrases.select("words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("head"), F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("tail"))
    cuts = cuts.join(frequent.select(F.col("words").alias("head"), F.col("n").alias("l")), "head").join(frequent.select(F.col("words").alias("tail"), F.col("n").alias("r")), "tail")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"above": big("a") * big("a") * F.lit(1000000).cast("decimal(7,0)"), "below": big("l") * big("r")})
    weakest = cuts.groupBy("words", "a").agg(F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r")).alias("cut"))
    size = F.size("words")
    inner = phrases.where(size > 2).select(F.col("a").alias("longer"), F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("words", i, m))))).alias("words"))
    held = inner.groupBy("words").agg(F.max("longer").alias("longer"))
    kept = weakest.join(held, "words", "left").where(F.coalesce(100 * F.col("longer") < HELD * F.col("a"), F.lit(True)))
    return kept.select("words", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases."""
    common.small_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text")).where("text is not null")
    seed, words = 0, vocabulary(docs, 0)
    while clashes(words):
        common.drop_table(words)
        seed += 1
        words = vocabulary(docs, seed)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    known = words.where(F.col("n") >= least)
    pairs = frequent_pairs(docs, seed, filter_of(known.select(F.col("h").alias("key")), known.count()), least)
    frequent = known.select(F.array("h").alias("words"), "n").unionByName(pairs.select(F.array("h1", "h2").alias("words"), "n"))
    if most_words > 2:
        frequent = frequent.unionByName(common.materialize(extended(pointers(docs, seed, pairs, most_words), least), "patterns"))
    told = common.materialize(scored(frequent), "phrases")
    # words back into strings
    parts = told.select("words", F.posexplode("words").alias("at", "h")).join(known.select("h", "lang", "word"), "h")
    named = parts.groupBy("words").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = told.join(named, "words").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def pointers(docs: DataFrame, seed: int, pairs: DataFrame, most_words: int) -> DataFrame:
    """The projections of the frequent pairs; those that could fill a task are told first, HOT at most."""
    key = pairs.select("h1", "h2", "n")
    total = pairs.agg(F.sum("n")).first()[0] or 0
    often = key.where(F.col("n") > total // HOT).toArrow()  # at most HOT rows
    hot = np.sort(joined(*(often.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([signed(joined(*(b.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))))], ["key"])

    keys = pairs.select("h1", "h2").mapInArrow(work, "key long")
    return projections(docs, seed, filter_of(keys, pairs.count()), hot, most_words)


#: The same by counting all phrases, for the query's check.
SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, w, unnest([1, 2, 3]) AS m FROM p WHERE len(w) > 0),
o AS (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM g WHERE len(w) >= m),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, COUNT(*) AS f FROM o GROUP BY ALL),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.m, k.phrase, k.a, k.k, x.f AS l, y.f AS r, (1000000::HUGEINT * k.a * k.a) // (x.f::HUGEINT * y.f) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT c.lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE m = 3),
t AS (SELECT lang, phrase, MAX(a) AS longer FROM h GROUP BY lang, phrase),
z AS (SELECT lang, SUM(f) AS n FROM f WHERE m = 1 GROUP BY lang),
e AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN t ON t.lang = b.lang AND t.phrase = b.phrase AND b.m = 2 WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT e.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM e JOIN z ON z.lang = e.lang WHERE rank <= 2000"""
