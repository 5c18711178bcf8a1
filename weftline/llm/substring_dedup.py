"""Repeated passages across documents by paragraph MinHash banding.

Paragraphs are cut by content alone: after a sentence of at least SENTENCE words, and after tokens of locally least
hash, about every ten words, in text without sentence ends near by. So a passage that stands in the middle of two
texts is cut alike in both, whatever surrounds it. Every paragraph has BANDS keys, each the least of its word-shingle
hashes under another order (one row a band: the setting of highest recall, which misses a pair of Jaccard similarity
0.8 once in 25 and one of equal paragraphs never). Only keys that more than one paragraph has go on.

In a key's bucket the paragraphs are compared with the first one, and those that also have the SIDE words after the
key's shingle in common, or those before it, with the first of these: two texts with a run of RUN words around the
shingle share one of both, however many paragraphs in other surroundings share the shingle alone. Candidates are
verified by exact Jaccard similarity and extended word by word while both texts agree; less similar ones count where a
shingle of both stands in a common run. Runs of at least RUN words count and are followed to their ends. Verified
paragraphs are clustered by connected components, and all of a cluster but the copy in the least doc_id are removed.

Words are compared by hashes of 32 bits, in runs of 5 at least.

A null text is empty and has no passage; texts shorter than RUN words neither; repeats inside one document stay; rows
that repeat a doc_id with other texts are documents of their own, and rows alike in both are one; rows without a
doc_id lose nothing; an empty table gives no rows; texts of any length are read whole; other columns are kept by
remove() and ignored otherwise, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common, shingles

BANDS, THRESHOLD = 2, 0.8
#: Words of the shortest passage that counts, and of the shortest sentence that ends a paragraph.
RUN, SENTENCE = 50, 6
#: Words on either side of a token without a sentence end, and with larger hashes, for it to end a paragraph itself.
OPEN, NEAR = 10, 4
#: Words before or after a shingle of which a run of RUN words around it holds one side at least.
SIDE = -(-(RUN - shingles.K) // 2)
#: Words on either side of a paragraph that are compared at first; runs that go on beyond them are followed in whole texts.
CONTEXT = 64
#: Words at most between two matched paragraphs of one passage.
GAP = 2
_seeds = shingles.mix(np.arange(7, 7 + BANDS, dtype=np.uint64)) | np.uint64(1)


def paragraphs(h: np.ndarray) -> np.ndarray:
    """Where paragraphs start, and the count of words as the last number."""
    n = len(h)
    ends = h & np.uint64(1) == 1
    if n:
        near = np.cumsum(np.concatenate((np.zeros(OPEN + 1, np.int64), ends, np.zeros(OPEN, np.int64))))
        rank = shingles.mix(h)
        wide = np.full(n + 2 * NEAR, np.iinfo(np.uint64).max, np.uint64)
        wide[NEAR : NEAR + n] = rank
        least = near[2 * OPEN + 1 :] == near[:n]
        for j in range(2 * NEAR + 1):
            if j != NEAR:
                least &= rank < wide[j : j + n]
        ends = ends | least
    ends = np.flatnonzero(ends) + 1
    if len(ends):
        ends = ends[np.diff(np.concatenate(([0], ends))) >= SENTENCE]
    starts = np.concatenate(([0], ends))
    return starts if starts[-1] == n else np.append(starts, n)


def keys(h: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text with paragraphs at cuts: (paragraph numbers, keys, hashes of the SIDE words after and before the key's shingle), BANDS of each paragraph.

    Paragraphs too short for a shingle have none.
    """
    none = np.empty(0, np.int32)
    if len(h) < shingles.K:
        return none, np.empty(0, np.uint64), none, none
    of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    x = shingles.kmers(h | np.uint64(1))
    inside = np.flatnonzero(of[: len(x)] == of[shingles.K - 1 :])
    x, of = x[inside], of[inside]
    if not len(x):
        return none, np.empty(0, np.uint64), none, none
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    size = np.diff(np.append(first, len(x)))
    found, at = [], []
    for band, seed in enumerate(_seeds):
        ranks = x * seed
        least = np.minimum.reduceat(ranks, first)
        met = np.flatnonzero(ranks == np.repeat(least, size))
        at.append(inside[met[np.searchsorted(met, first)]])
        found.append(shingles.mix(least + np.uint64(band)))
    at = np.concatenate(at)
    sums = shingles.Sums(h | np.uint64(1))
    side = lambda starts, ends: (sums.of(starts, ends) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    right, left = side(at + shingles.K, np.minimum(at + shingles.K + SIDE, len(h))), side(np.maximum(at - SIDE, 0), at)
    return np.tile(of[first], BANDS).astype(np.int32), np.concatenate(found), right, left


def prepared(docs: DataFrame) -> DataFrame:
    """A row for each document, the only step that reads its text word by word: doc_id, words (hashes of 32 bits) and
    cuts (where paragraphs start), and for all its keys together key, par (number of the paragraph), right and left."""
    kinds = {"key": pa.int64(), "par": pa.int32(), "right": pa.int32(), "left": pa.int32()}

    @common.task("shingles")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, cuts, counts, rows = [], [], [0], [(np.empty(0, np.int32), np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32))]
            for t in b.column("text").to_pylist():
                h = shingles.token_hashes(t)
                words.append(short(h).astype("<u4").tobytes())
                at = paragraphs(h)
                cuts.append(at.astype("<i4").tobytes())
                rows.append(keys(h, at))
                counts.append(len(rows[-1][0]))
            par, key, right, left = (np.concatenate(c) for c in zip(*rows))
            ends = pa.array(np.cumsum(counts).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in (key.view(np.int64), par, right, left)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words, pa.binary()), pa.array(cuts, pa.binary()), *lists], ["doc_id", "words", "cuts", *kinds])

    return docs.mapInArrow(run, "doc_id long, words binary, cuts binary, key array<long>, par array<int>, right array<int>, left array<int>")


def short(h: np.ndarray) -> np.ndarray:
    """Half of each token's hash, without the bit for sentence ends: what is compared word by word."""
    return (h | np.uint64(1)) & np.uint64(0xFFFFFFFF)


def windows(cuts: np.ndarray, pars: list[int], context: int) -> list[tuple[int, int]]:
    """The word ranges of some paragraphs and context words on either side, merged."""
    out: list[tuple[int, int]] = []
    for p in sorted(set(pars)):
        lo, hi = max(0, int(cuts[p]) - context), min(int(cuts[-1]), int(cuts[p + 1]) + context)
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def common_runs(a: np.ndarray, b: np.ndarray, s: int, e: int, t: int, f: int, run_words: int) -> list[tuple[int, int, int]]:
    """(start in a, end in a, shift to b) of the exact common runs through a shingle that starts in both paragraphs."""
    x, y = (shingles.kmers(w) if len(w) >= shingles.K else w[:0] for w in (a[s : e + shingles.K - 1], b[t : f + shingles.K - 1]))
    order = np.argsort(y, kind="stable")
    lo, hi = (np.searchsorted(y[order], x, side) for side in ("left", "right"))
    out = []
    at = {}
    for i in np.flatnonzero(lo < hi).tolist():
        for j in order[lo[i] : hi[i]].tolist():
            u, v = s + i, t + j
            if u < at.get(v - u, 0):
                continue  # in a run that was followed
            n = min(u, v)
            differ = np.flatnonzero(a[u - n : u] != b[v - n : v])
            left = n - 1 - int(differ[-1]) if len(differ) else n
            n = min(len(a) - u, len(b) - v)
            differ = np.flatnonzero(a[u : u + n] != b[v : v + n])
            right = int(differ[0]) if len(differ) else n
            at[v - u] = u + max(1, right)
            if left + right >= run_words:
                out.append((u - left, u + right, v - u))
    return out


def matched(a: np.ndarray, b: np.ndarray, pairs: list[tuple[int, int, int, int, int, int]], threshold: float, run_words: int) -> list[tuple[int, int, int, int, int, int]]:
    """(paragraph of a, of b, start, end, first, last) of verified pairs that stand in a common run of at least run_words words.

    a and b are short() hashes, a pair is (paragraph of a, of b, its words in a, its words in b); start and end are
    the run's words in a, first and last those of b's paragraph that the run holds: all of them unless the run goes
    through a shingle of less similar paragraphs.
    """
    ranges = []
    followed: dict[int, tuple[int, int]] = {}
    for p, q, s, e, t, f in sorted(set(pairs)):
        start, end = followed.get(t - s, (0, 0))
        if e - s == f - t and start <= s and e <= end:  # in a run that was followed
            ranges.append((start, end, p, q, t, f))
            continue
        if not (e - s == f - t and np.array_equal(a[s:e], b[t:f])):
            if shingles.jaccard(shingles.kmers(a[s:e]), shingles.kmers(b[t:f])) < threshold:
                ranges += [(u, v, p, q, max(t, u + d), min(f, v + d)) for u, v, d in common_runs(a, b, s, e, t, f, run_words)]
                continue
        n = min(s, t)
        differ = np.flatnonzero(a[s - n : s] != b[t - n : t])
        left = n - 1 - int(differ[-1]) if len(differ) else n
        n = min(len(a) - e, len(b) - f)
        differ = np.flatnonzero(a[e : e + n] != b[f : f + n])
        right = int(differ[0]) if len(differ) else n
        ranges.append((s - left, e + right, p, q, t, f))
        if e - s == f - t and np.array_equal(a[s:e], b[t:f]):
            followed[t - s] = s - left, e + right
    ranges.sort(key=lambda r: r[:4])
    out, i = [], 0
    while i < len(ranges):
        start, end, j = ranges[i][0], ranges[i][1], i + 1
        while j < len(ranges) and ranges[j][0] <= end + GAP:
            end = max(end, ranges[j][1])
            j += 1
        if end - start >= run_words:
            out += [(p, q, start, end, first, last) for _, _, p, q, first, last in ranges[i:j]]
        i = j
    return out


def candidates(words: DataFrame) -> DataFrame:
    """a, b and pairs (of paragraphs) of every two documents of prepared() to compare, b the one of the first paragraph of a bucket."""
    found = words.select("doc_id", F.explode(F.arrays_zip("key", "par", "right", "left")).alias("k")).select("k.key", "doc_id", "k.par", "k.right", "k.left")
    # counted before the shuffle: a key that a third of all paragraphs has costs each task one row
    often = common.materialize(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    # most keys are met once, and a Bloom filter of the others, of a fixed size, keeps their rows from the shuffle
    with common.settings(found.sparkSession, **common.BLOOM):
        shared = common.materialize(found.join(often.where("n > 1"), "key"), "shared")

    def with_first(rows: DataFrame, *by: str) -> DataFrame:
        hubs = rows.groupBy(*by).agg(F.count("*").alias("rows"), F.min(F.struct("doc_id", "par")).alias("hub")).where("rows > 1")
        met = rows.join(common.materialize(hubs.select(*by, "hub"), "hubs"), list(by)).where(F.col("doc_id") != F.col("hub.doc_id"))
        return met.select(F.col("doc_id").alias("a"), F.col("par").alias("p"), F.col("hub.doc_id").alias("b"), F.col("hub.par").alias("q"))

    crowd = shared.where("n > 2")
    pairs = with_first(shared, "key").unionByName(with_first(crowd, "key", "right")).unionByName(with_first(crowd, "key", "left"))
    pairs = common.materialize(by_documents(pairs), "pairs")
    common.drop_table(shared)
    return pairs


def by_documents(pairs: DataFrame) -> DataFrame:
    """a, b and pairs (p, q) of pairs of paragraphs (a, p, b, q); the collections are bounded by the paragraphs of one document."""
    return pairs.groupBy("a", "b").agg(F.collect_set(F.struct("p", "q")).alias("pairs"))


def verified(pairs: DataFrame, words: DataFrame, threshold: float, run_words: int, context: int) -> DataFrame:
    """a, p, b, q, start, end, first, last and open of every verified pair of pairs (a, b, pairs), by the words and cuts of prepared().

    start and end are the words of the run in a, first and last those of q in it, open whether the run reaches the end of the context that was compared and not the end of the text.
    """
    ints = pa.list_(pa.int32())

    @common.task("shingles")
    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            found = batch.column("pairs")
            flat, ends = found.flatten(), (found.offsets.to_numpy() - found.offsets[0].as_py()).tolist()
            of, to = flat.field("p").to_numpy(), flat.field("q").to_numpy()
            for k, (a, b, h, cuts) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "words", "cuts")))):
                h, cuts, p, q = np.frombuffer(h, "<u4"), np.frombuffer(cuts, "<i4"), of[ends[k] : ends[k + 1]], to[ends[k] : ends[k + 1]]
                ranges = windows(cuts, p.tolist(), context)
                pairs = np.stack((p, q, cuts[p], cuts[p + 1]), axis=1).astype("<i4")
                rows.append((a, b, len(h), pairs.tobytes(), [lo for lo, _ in ranges], [hi for _, hi in ranges], b"".join(h[lo:hi].tobytes() for lo, hi in ranges)))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), ints, ints, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], ["a", "b", "size", "pairs", "lows", "highs", "held"])

    @common.task("shingles")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, g, cuts, size, pairs, lows, highs, held in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "words", "cuts", "size", "pairs", "lows", "highs", "held"))):
                g, cuts = np.frombuffer(g, "<u4").astype(np.uint64), np.frombuffer(cuts, "<i4")
                h = np.full(max(highs, default=0), 1 << 40, np.uint64)  # no token outside the windows
                found, at = np.frombuffer(held, "<u4"), 0
                for lo, hi in zip(lows, highs):
                    h[lo:hi] = found[at : at + hi - lo]
                    at += hi - lo
                pairs = np.frombuffer(pairs, "<i4").reshape(-1, 4)
                both = list(map(tuple, np.column_stack((pairs, cuts[pairs[:, 1]], cuts[pairs[:, 1] + 1])).tolist()))
                edges = {*lows, *highs} - {0, size}
                rows += [(a, p, b, q, start, end, first, last, start in edges or end in edges) for p, q, start, end, first, last in matched(h, g, both, threshold, run_words)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 9, kinds)], ["a", "p", "b", "q", "start", "end", "first", "last", "open"])

    # of the first text only the words around its paragraphs go to the second one
    first, second = (words.select(F.col("doc_id").alias(c), "words", "cuts") for c in ("a", "b"))
    cut = pairs.join(first, "a").select("a", "b", "words", "cuts", "pairs").mapInArrow(around, "a long, b long, size int, pairs binary, lows array<int>, highs array<int>, held binary")
    return cut.join(second, "b").select("a", "b", "words", "cuts", "size", "pairs", "lows", "highs", "held").mapInArrow(run, "a long, p int, b long, q int, start int, end int, first int, last int, open boolean")


def matches(docs: DataFrame, threshold: float, run_words: int) -> DataFrame:
    """a, p, b, q, start, end, first and last of every verified pair, its run followed to the end."""
    words = common.materialize(prepared(docs), "words")
    pairs = candidates(words)
    found = common.materialize(verified(pairs, words, threshold, run_words, CONTEXT), "matches")
    beyond = found.where("open").select("a", "p", "b", "q")
    if not beyond.isEmpty():
        found = found.unionByName(common.materialize(verified(by_documents(beyond), words, threshold, run_words, 1 << 30), "followed"))
    common.drop_table(words)
    return found.drop("open")


def removals(docs: DataFrame, threshold: float, run_words: int) -> DataFrame:
    """Of documents whose doc_ids all differ: doc_id, kept_in (document whose copy stays), start and end (in words) of what is to go."""
    found = matches(docs, threshold, run_words)
    own = found.groupBy(F.col("a").alias("doc_id"), F.col("p").alias("par")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    other = found.groupBy(F.col("b").alias("doc_id"), F.col("q").alias("par")).agg(F.min("first").alias("start"), F.max("last").alias("end")).join(own, ["doc_id", "par"], "left_anti")
    # a paragraph is one number from here on, fixed by the table that is written
    every = common.materialize(own.unionByName(other).withColumn("node", F.monotonically_increasing_id()), "paragraphs")
    first, second = (every.select(F.col("doc_id").alias(d), F.col("par").alias(p), F.col("node").alias(f"{d}_node")) for d, p in (("a", "p"), ("b", "q")))
    edges = found.select("a", "p", "b", "q").join(first, ["a", "p"]).join(second, ["b", "q"]).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    roots = common.materialize(common.components(edges, "passages"), "roots")
    named = common.materialize(every.join(roots, "node").select("doc_id", "par", "start", "end", "root"), "named")
    kept = common.materialize(named.groupBy("root").agg(F.min(F.struct("doc_id", "par")).alias("kept")), "kept")
    gone = named.join(kept, "root").where(F.col("doc_id") != F.col("kept.doc_id"))
    return gone.select("doc_id", F.col("kept.doc_id").alias("kept_in"), "start", "end")


def spans(text: str, gone: list[tuple[int, int]], run_words: int = RUN) -> list[tuple[int, int]]:
    """(start, end) in code points of what goes: the given ranges of words, in runs of at least run_words."""
    starts, ends = shingles.tokens(shingles.codes(text))
    runs: list[list[int]] = []
    for s, e in sorted(gone):
        if runs and s <= runs[-1][1] + GAP:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return [(int(starts[s]), int(ends[e - 1])) for s, e in runs if e - s >= run_words]


def _passages(docs: DataFrame, threshold: float, run_words: int) -> DataFrame:
    """passages() of documents whose doc_ids all differ."""
    with common.settings(docs.sparkSession, **common.DROP_SHUFFLES):
        # bounded by the paragraphs of one document
        gone = common.materialize(removals(docs, threshold, run_words).groupBy("doc_id").agg(F.collect_set("kept_in").alias("kept_in"), F.collect_set(F.struct("start", "end")).alias("gone")), "gone")
        one = common.texts_of(docs, common.materialize(gone.select("doc_id"), "ids"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    @common.task("shingles")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spans(t, [(g["start"], g["end"]) for g in gone], run_words) for t, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist())]
            kept = pa.array([sorted(k) for k in b.column("kept_in").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), kept, pa.array([[{"start": s, "end": e} for s, e in f] for f in found], span), pa.array([sum(e - s for s, e in f) for f in found], pa.int64())], ["doc_id", "kept_in", "spans", "n_chars_removed"])

    cut = one.join(gone, "doc_id").select("doc_id", "text", "kept_in", "gone").mapInArrow(run, "doc_id long, kept_in array<long>, spans array<struct<start:int,end:int>>, n_chars_removed long")
    return cut.where(F.size("spans") > 0)


def passages(docs: DataFrame, threshold: float = THRESHOLD, run_words: int = RUN) -> DataFrame:
    """doc_id, kept_in (ids of the documents whose copies stay), spans (in code points) and n_chars_removed of every document that loses a passage."""
    one, rows = common.numbered(docs)
    found = _passages(one, threshold, run_words)
    if rows is None:
        return found
    kept = found.select("doc_id", F.explode("kept_in").alias("at")).join(rows.select(F.col("doc_id").alias("at"), "own_id"), "at").groupBy("doc_id").agg(F.sort_array(F.collect_set("own_id")).alias("kept_in"))
    return found.drop("kept_in").join(kept, "doc_id").join(rows.select("doc_id", "own_id"), "doc_id").select(F.col("own_id").alias("doc_id"), "kept_in", "spans", "n_chars_removed")


def remove(docs: DataFrame, threshold: float = THRESHOLD, run_words: int = RUN) -> DataFrame:
    """docs, all columns, without the passages that stay elsewhere; documents with nothing left go."""
    one, rows = common.numbered(docs)
    id_, spans_ = common.fresh(docs, "lost_id"), common.fresh(docs, "lost_spans")
    # (a span moves left by the length of those before it that are gone already)
    lost = common.materialize(_passages(one, threshold, run_words).select(F.col("doc_id").alias(id_), F.reverse("spans").alias(spans_)), "lost")
    same = docs["doc_id"].cast("long") == lost[id_]
    if rows is not None:
        text_ = common.fresh(docs, "lost_text")
        lost = lost.join(rows.select(F.col("doc_id").alias(id_), F.col("own_id"), F.col("text").alias(text_)), id_).select(F.col("own_id").alias(id_), text_, spans_)
        same = (docs["doc_id"].cast("long") == lost[id_]) & (docs["text"] == lost[text_])
    text = F.aggregate(spans_, docs["text"], lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.substring(t, s["end"] + 1, F.char_length(t))))
    joined = docs.join(lost, same, "left")
    new = [F.when(F.col(spans_).isNull(), docs[c]).otherwise(text).alias(c) if c == "text" else docs[c] for c in docs.columns]
    return joined.where(F.col(spans_).isNull() | (F.trim(text) != "")).select(*new)
