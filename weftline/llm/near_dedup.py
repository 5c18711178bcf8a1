"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A sketch takes the PICKED occurrence-labelled k-mers of least hash and keeps them in the order of the text, so two
texts share it if they share those k-mers and their order: collisions follow edit similarity, not only shared
content. Every sketch is a band, and documents that share one are candidates. Verification aligns the words of both
texts within the diagonals that the threshold allows; texts are near-duplicates if the aligned words are THRESHOLD or
more of all (aligned, or in one of the texts only). A pair at the threshold, a ninth of its words replaced, shares a
sketch of 5-word k-mers once in seven, so one of BANDS in all but 3 of 1,000 cases, and two in all but 2 of 100.

Copies first: texts of the same words are one class by a hash, pre-aggregated before the shuffle, and only one of
each class goes on. A bucket of at most SMALL documents is compared in full, a larger one with one member, its hub;
after a second hub the buckets that still hold several components are compared across them. Those of more than BLOCK
members are dealt anew for that by the rarest word pairs of each text, of which near-duplicates share one (see
rare_pairs()); the documents of pairs that more than BLOCK have are compared block by block, all that are not joined yet
with all. Connected documents share a class, named by the least doc_id.

A null text or one without a word is a class of its own; texts shorter than K words share one sketch, of all their
words; rows that repeat a doc_id with other texts are compared each, and the doc_id has a row for each class; rows
that are alike in doc_id and text are one; rows without a doc_id are left out; an empty table gives no rows; texts of
any length are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import common, shingles

BANDS, PICKED, THRESHOLD = 40, 2, 0.8
#: Members of a bucket that is compared in full.
SMALL = 12
#: Members of a bucket that are compared across its components, and bins of a document's words that bound what two have in common.
BLOCK, BINS = 256, 512
#: Hashes of word pairs that are told apart when their documents are counted.
RARITY = 1 << 18
#: Words of the second text that are aligned with one window of the first.
ROWS = 512
#: Rows of other tables that take as long as a pair to be verified.
PAIR_ROWS = 8
_seeds = shingles.mix(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def bands(h: np.ndarray) -> np.ndarray:
    """A key for each band of a text's word hashes."""
    x = shingles.labelled(shingles.kmers(h))
    sketches = np.empty(BANDS, np.uint64)
    block = max(1, (1 << 20) // max(1, len(x)))
    for i in range(0, BANDS, block):
        ranks = x * _seeds[i : i + block, None]
        row = np.arange(len(ranks))
        at = ranks.argmin(axis=1)
        first = last = at
        for _ in range(1, min(PICKED, len(x))):
            ranks[row, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
            at = ranks.argmin(axis=1)
            first, last = np.minimum(first, at), np.maximum(last, at)
        sketches[i : i + block] = x[first] + x[last] * _PAIR
    return shingles.mix(sketches + np.arange(BANDS, dtype=np.uint64))


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Words of the best alignment of two sequences, with matches at most band (and ROWS) positions off the diagonal.

    Bit-parallel: a bit for each word of the first text in the window, 0 where the alignment grows.
    """
    least = min(len(a), len(b))
    differ = np.flatnonzero(a[:least] != b[:least])
    head = int(differ[0]) if len(differ) else least
    a, b, least = a[head:], b[head:], least - head
    differ = np.flatnonzero(a[len(a) - least :] != b[len(b) - least :])
    tail = least - 1 - int(differ[-1]) if len(differ) else least
    first, second = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    total, low, high, open_bits = head + tail, 0, 0, 0
    for r in range(0, len(second), ROWS):
        start, end = min(len(first), max(0, r - band)), min(len(first), r + ROWS + band)
        total += (start - low) - (open_bits & ((1 << (start - low)) - 1)).bit_count()
        open_bits = (open_bits >> (start - low)) | (((1 << (end - high)) - 1) << (high - start))
        low, high = start, end
        if low == high:
            break
        where: dict[int, int] = {}
        bit = 1
        for w in first[low:high]:
            where[w] = where.get(w, 0) | bit
            bit <<= 1
        every = bit - 1
        for w in second[r : r + ROWS]:
            if w in where:
                met = open_bits & where[w]
                open_bits = ((open_bits + met) | (open_bits - met)) & every
    return total + (high - low) - open_bits.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Share of the words of two texts (word hashes) that a banded alignment matches, in the order of both.

    An alignment that reaches the threshold stays within the band; below it the share may be less than the best.
    """
    n = len(a) + len(b)
    if not n:
        return 1.0
    if min(len(a), len(b)) < threshold * max(len(a), len(b)) - 1e-9:
        return 0.0
    m = aligned(a, b, max(len(a), len(b)) - int(threshold * n / (1 + threshold)))
    return m / (n - m)


def near_sizes(a: Column, b: Column, threshold: float) -> Column:
    """Whether texts of so many words can be near-duplicates."""
    return F.least(a, b) >= threshold * F.greatest(a, b) - 1e-9


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, words (hash of the word sequence; null without words), size (words) and keys (one for each band) of every document."""

    @common.task("shingles")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, keys, sizes = [], [], []
            for t in b.column("text").to_pylist():
                h = shingles.word_hashes(t)
                words.append(xxhash.xxh128_digest(h.tobytes()) if len(h) else None)
                keys.append(bands(h).view(np.int64) if len(h) else np.empty(0, np.int64))
                sizes.append(len(h))
            ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words, pa.binary()), pa.array(sizes, pa.int32()), flat], ["doc_id", "words", "size", "keys"])

    return docs.mapInArrow(run, "doc_id long, words binary, size int, keys array<long>")


def hashed(docs: DataFrame, ids: DataFrame, rows: int | None = None) -> DataFrame:
    """id and words (hashes of 32 bits, in the text's order) of the documents that ids (doc_id) names, worked out once each."""
    texts = common.texts_of(docs, common.materialize(ids.distinct(), "ids", rows))

    @common.task("shingles")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [shingles.word_hashes(t).astype(np.uint32).astype("<u4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words, pa.binary())], ["id", "words"])

    return common.materialize(texts.mapInArrow(run, "id long, words binary"), "hashes")


def verify(pairs: DataFrame, docs: DataFrame, threshold: float, rows: int) -> DataFrame:
    """Those of the pairs (a, b), of about so many rows, that are near-duplicates, as a scratch table. Only the words of documents in pairs are moved."""
    pairs = common.materialize(pairs.select("a", "b").distinct(), "pairs", rows)
    n = pairs.count()
    words = hashed(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), 2 * n)

    @common.task("shingles")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [similarity(np.frombuffer(s.as_py(), "<u4"), np.frombuffer(t.as_py(), "<u4"), threshold) >= threshold for s, t in zip(b.column("s"), b.column("t"))]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    first = words.select(F.col("id").alias("a"), F.col("words").alias("s"))
    second = words.select(F.col("id").alias("b"), F.col("words").alias("t"))
    near = pairs.join(first, "a").join(second, "b").select("a", "b", "s", "t").mapInArrow(run, "a long, b long")
    return common.materialize(near, "verified", PAIR_ROWS * n)


def linked(ids: np.ndarray, roots: np.ndarray, sides: np.ndarray, words: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Near-duplicate pairs across roots, as many as join them: a pair that those before it join is not compared.

    Two of one side (0 or more) are not either. What is left out has less in common than the threshold
    asks for, by the sizes or by the counts of words in BINS bins, which bound the alignment from above.
    """
    n = np.array([len(x) for x in words])
    bins = np.stack([np.bincount((x % np.uint32(BINS)).astype(np.int64), minlength=BINS) for x in words]).astype(np.int32)
    names, comp = np.unique(roots, return_inverse=True)
    out = []
    for i in range(len(ids)):
        other = i + 1 + np.flatnonzero((comp[i + 1 :] != comp[i]) & ((sides[i + 1 :] != sides[i]) | (sides[i] < 0)))
        both = np.minimum(n[other], n[i])
        other = other[both >= threshold * np.maximum(n[other], n[i]) - 1e-6]
        if not len(other):
            continue
        both = np.minimum(bins[other], bins[i]).sum(axis=1)
        near = both >= threshold * (n[other] + n[i] - both) - 1e-6
        for j in other[near][np.argsort(-both[near], kind="stable")]:
            if comp[i] != comp[j] and similarity(words[i], words[j], threshold) >= threshold:
                comp[comp == comp[j]] = comp[i]
                out.append((int(ids[i]), int(ids[j])))
    return out


def several(rows: DataFrame) -> DataFrame:
    """Of rows (key, id, size, root) of a scratch table those whose key has several roots, with n, the members of the key."""
    keys = mixed_keys(rows)
    return common.materialize(rows.join(keys.select("key", "n"), "key").select("key", "id", "size", "root", "n"), "several", rows.count())


def mixed_keys(rows: DataFrame) -> DataFrame:
    """key and n (its members) of the keys of rows (key, id, size, root) that have several roots."""
    return rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")


def across(rows: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that join the components within the keys of rows (key, id, root, side), of about BLOCK members on each side at most, as a scratch table."""
    n = rows.count()
    words = hashed(docs, rows.select(F.col("id").alias("doc_id")), n)

    def run(g: pa.Table) -> pa.Table:
        common.enter("shingles")
        ids, roots, sides = (g.column(c).to_numpy() for c in ("id", "root", "side"))
        pairs = linked(ids, roots, sides, [np.frombuffer(w, "<u4") for w in g.column("words").to_pylist()], threshold)
        return pa.table([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    met = rows.select("key", "id", "root", "side").join(words, "id").groupBy("key").applyInArrow(run, "a long, b long")
    return common.materialize(met, "across", BLOCK * n)


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows (id, root) as rows (key, id, root, side) in which every two documents of different roots meet, one on either side.

    The documents of the root that has most are left out on one side. Either side is dealt by a hash to blocks of about
    BLOCK, and a key holds a block of each.
    """
    main = rows.groupBy("root").count().orderBy(F.desc("count"), "root").first().root
    others = rows.where(F.col("root") != main)
    ours, theirs = (-(-x.count() // BLOCK) for x in (others, rows))
    if not ours:
        return rows.limit(0).select(F.lit(0).cast("long").alias("key"), "id", "root", F.lit(0).alias("side"))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    along = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    first = others.select("id", "root", block(ours).alias("mine"), along(theirs).alias("other")).select((F.col("mine") * theirs + F.col("other")).alias("key"), "id", "root", F.lit(0).alias("side"))
    second = rows.select("id", "root", block(theirs).alias("mine"), along(ours).alias("other")).select((F.col("other") * theirs + F.col("mine")).alias("key"), "id", "root", F.lit(1).alias("side"))
    return first.unionByName(second)


def neighbours(words: np.ndarray) -> np.ndarray:
    """A hash of every two words in a row."""
    w = words.astype(np.uint64)
    return shingles.mix(w[:-1] * _PAIR + w[1:])


def rare_pairs(rows: DataFrame, docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The documents in rows (id, size, root) by the rarest word pairs of each, in place of the keys they had.

    The first table has several() of them by the pairs that BLOCK of them have at most; the second has (id, size,
    root) of the documents that share the other pairs, each once, to be compared by in_blocks().

    Of two texts of n words or more whose alignment reaches the threshold t, at most (1 - t) * n words on either side
    are left over, and each parts one pair of aligned neighbours; so (2 * t - 1) * n - 1 neighbouring pairs of words
    at least are in both. In any one order of all pairs, then, the first ones of each text, as many as may differ and
    one more, hold a common one. Ordered by rarity they have few documents, and are not those of a passage that
    thousands share; only texts that frequent pairs fill to 2 * t - 1 or more have some of those among the first ones.
    """
    ids = common.materialize(rows.select("id", "size", "root").distinct(), "ids", rows.count())
    members = ids.count()
    words = common.materialize(hashed(docs, ids.select(F.col("id").alias("doc_id")), members).join(ids, "id"), "rooted", members)

    @common.task("shingles")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(RARITY, np.int64)
        for b in batches:
            for w in b.column("words"):
                n[np.unique(neighbours(np.frombuffer(w.as_py(), "<u4")) % np.uint64(RARITY)).astype(np.int64)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int32()), pa.array(n[n > 0], pa.int64())], ["at", "n"])

    often = np.zeros(RARITY, np.int64)
    for r in words.mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # RARITY rows at most
        often[r.at] = r.n
    sent = docs.sparkSession.sparkContext.broadcast(often)

    @common.task("shingles")
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, counts = [np.empty(0, np.uint64)], []
            for w in b.column("words"):
                h = neighbours(np.frombuffer(w.as_py(), "<u4"))
                x = shingles.labelled(h)
                n = len(h) - max(1, int(np.ceil((2 * threshold - 1) * (len(h) + 1) - 1 - 1e-9))) + 1
                out.append(x[np.lexsort((x, sent.value[(h % np.uint64(RARITY)).astype(np.int64)]))[:n]])
                counts.append(len(out[-1]))
            each = np.repeat(np.arange(b.num_rows), counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), *(b.column(c).take(pa.array(each)) for c in ("id", "size", "root"))], ["key", "id", "size", "root"])

    rare = common.materialize(words.select("id", "size", "root", "words").mapInArrow(first, "key long, id long, size int, root long"), "rare")
    keys = common.materialize(mixed_keys(rare), "mixed", rare.count())
    few = common.materialize(rare.join(keys.where(F.col("n") <= BLOCK), "key").select("key", "id", "size", "root"), "several", rare.count())
    full = np.zeros(RARITY, bool)
    for r in keys.where(F.col("n") > BLOCK).select(F.pmod("key", F.lit(RARITY)).alias("at")).distinct().collect():  # RARITY rows at most
        full[r.at] = True
    told = docs.sparkSession.sparkContext.broadcast(full)

    @common.task("shingles")
    def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # and a few whose key shares a bit with theirs
        for b in batches:
            yield b.filter(pa.array(told.value[b.column("key").to_numpy() % RARITY])).select(["id", "size", "root"])

    crowd = rare.limit(0).select("id", "size", "root") if not full.any() else rare.mapInArrow(crowded, "id long, size int, root long").distinct()
    return few, common.materialize(crowd, "crowd", members)


def links(rows: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of the buckets in rows (key, id, size), enough to join all that are near-duplicates.

    A pair is verified, or joins a document to the least one of those that verified pairs join it to: so each
    search for components goes on from the one before.

    A bucket of at most SMALL members is compared in full, which is fewer than SMALL pairs a member. In a larger one
    all members are compared with its hub, the one with most company over all buckets: the original of a group of
    edited copies is nearer to each copy than copies are to each other. Where that leaves several components, members
    outside a second hub's are compared with it, and what is left by across().
    """
    sizes = common.materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes", rows.count())
    with common.settings(rows.sparkSession, **common.BLOOM):
        rows = common.materialize(rows.join(sizes.where("n > 1"), "key").select("key", "id", "size", "n"), "buckets", rows.count())
    n = rows.count()
    few = rows.where(F.col("n") <= SMALL)
    pairs = few.select("key", F.col("id").alias("a"), F.col("size").alias("s")).join(few.select("key", F.col("id").alias("b"), F.col("size").alias("t")), "key").where("a > b").where(near_sizes(F.col("s"), F.col("t"), threshold)).select("a", "b")
    many = rows.where(F.col("n") > SMALL)
    crowded = not many.isEmpty()
    if crowded:
        company = many.groupBy("id", "size").agg(F.sum("n").alias("company"), F.collect_list("key").alias("keys"))  # BANDS keys at most
        best = company.select("id", "size", "company", F.explode("keys").alias("key")).groupBy("key").agg(F.max(F.struct("company", (-F.col("id")).alias("less"), "size")).alias("best"))
        hubs = common.materialize(best.select("key", (-F.col("best.less")).alias("hub"), F.col("best.size").alias("hub_size")), "hubs", n)
        members = many.join(hubs, "key").where("id <> hub").where(near_sizes(F.col("size"), F.col("hub_size"), threshold))
        pairs = pairs.unionByName(members.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")))
    found = verify(pairs, docs, threshold, n)
    if not crowded:
        return found

    def starred(found: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        roots = common.materialize(common.components(found, name, n), "roots", n)
        return roots, roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))

    def rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
        # a row for each document, not for each of its keys (BANDS at most)
        once = members.groupBy("id", "size").agg(F.collect_list("key").alias("keys"))
        named = once.join(roots, once["id"] == roots["node"], "left").select(F.explode("keys").alias("key"), "id", "size", F.coalesce("root", "id").alias("root"))
        return several(common.materialize(named, "rooted", n))

    roots, found = starred(found, "hubbed")
    mixed = rooted(many, roots)
    if mixed.isEmpty():
        return found
    hubs = mixed.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", "key").alias("order"), F.col("id").alias("hub"), F.col("root").alias("hub_root"), F.col("size").alias("hub_size"))).alias("h")).select("key", "h.*")
    members = mixed.join(common.materialize(hubs, "hubs", n), "key").where("root <> hub_root").where(near_sizes(F.col("size"), F.col("hub_size"), threshold))
    found = found.unionByName(verify(members.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")), docs, threshold, n))
    roots, found = starred(found, "hubbed")
    mixed = rooted(mixed.select("key", "id", "size"), roots)  # a key of one component stays one
    large = mixed.where(F.col("n") > BLOCK)
    rest = mixed.where(F.col("n") <= BLOCK)
    crowd = None
    if not large.isEmpty():
        few, crowd = rare_pairs(large, docs, threshold)
        rest = rest.select("key", "id", "size", "root").unionByName(few)
    found = found.unionByName(across(common.materialize(rest.withColumn("side", F.lit(-1)), "rest"), docs, threshold))
    if crowd is None or crowd.isEmpty():
        return found
    roots, found = starred(found, "crossed")  # what is joined by now is not compared again
    crowd = common.materialize(crowd.join(roots, crowd["id"] == roots["node"], "left").select("id", F.coalesce(roots["root"], "id").alias("root")), "crowd", n)
    return found.unionByName(across(common.materialize(in_blocks(crowd), "blocks"), docs, threshold))


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """classes() of documents whose doc_ids all differ."""
    sketches = common.materialize(sketch(docs), "sketches")
    n = sketches.count()
    worded = sketches.where("words is not null")
    copies = common.materialize(worded.groupBy("words").agg(F.min("doc_id").alias("rep")), "copies", n)
    members = common.materialize(worded.select("doc_id", "words").join(copies, "words").select("doc_id", "rep"), "members", n)
    firsts = worded.join(copies.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    rows = common.materialize(firsts.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"), "size"), "bands")
    roots = common.components(links(rows, docs, threshold), "classes", n)
    named = members.join(roots, members["rep"] == roots["node"], "left").select("doc_id", F.coalesce("root", "rep").alias("class_id"))
    return named.unionByName(sketches.where("words is null").select("doc_id", F.col("doc_id").alias("class_id")))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id (the least doc_id of its near-duplicates) of every document."""
    one, rows = common.numbered(docs)
    found = _classes(one, threshold)
    if rows is None:
        return found
    own, of = rows.select("doc_id", "own_id"), rows.select(F.col("doc_id").alias("class_id"), F.col("own_id").alias("class_own"))
    return found.join(own, "doc_id").join(of, "class_id").select(F.col("own_id").alias("doc_id"), F.col("class_own").alias("class_id")).distinct()


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, with the first document of each class (the least doc_id, then the least text); of rows alike in both one."""
    one, rows = common.numbered(docs)
    found = common.materialize(_classes(one, threshold), "found")
    if rows is None:
        gone = common.materialize(found.where("doc_id <> class_id").select(F.col("doc_id").alias("gone_id")), "gone")
        side = F.broadcast(gone) if gone.count() <= common.BROADCAST_IDS else gone  # few are sent, so that texts aren't shuffled
        return docs.where(docs["doc_id"].cast("long").isNotNull()).join(side, docs["doc_id"].cast("long") == side["gone_id"], "left_anti")
    kept = found.where("doc_id = class_id").select("doc_id")
    mine = rows.join(kept, "doc_id", "left_semi").select(F.col("own_id").alias("kept_id"), F.col("text").alias("kept_text"))
    same = (docs["doc_id"].cast("long") == mine["kept_id"]) & (F.coalesce(docs["text"], F.lit("")) == mine["kept_text"])
    return docs.join(mine, same, "left_semi").dropDuplicates(["doc_id", "text"])
