"""The training-data operators against brute force, on small tables with every awkward row."""

import hashlib
import io
import time
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from weftline.llm import byte_bpe, common, fingerprints, language, media, near_dedup, packing, quality, substring_dedup, token_counts, token_files, tokens  # noqa: E402

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "to", "su", "vi", "pe") for c in ("n", "s", "", "lt", "m")]
ODD = [None, "", " ", "  a  b ", "<|endoftext|> x", "İstanbul É́ é x y", "Σας ΣΑΣ", "a\n b\n\n c", "'s don't WE'LL", "½ ² x² a²b", "日本 語 テスト", "a" * 3000 + " b", " .,;", "été...", "ẞ ß SS", "x\x1c y\x85z", "🙂 🙃🙂", "word " * 3000, "same text", "same text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, words string"


def table(spark, texts, first=0):
    rows = [(first + i, t, "en" if i % 3 else None, f"s{i % 2}", None if t is None else len(t), "k", 7, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n):
    r = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        k = int(r.integers(7, 12))
        out += [*r.choice(WORDS, k - 1), str(r.choice(WORDS)) + "."]
    return " ".join(out)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD).union(table(spark, ["same text"], first=18))  # a row that is repeated


def by_id(df):
    return sorted(df.collect(), key=lambda r: r[0])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_encoding_is_the_librarys(name):
    t, encode = Tokenizer.from_file(P.path(name)), tokens.PieceEncoder(P.path(name), tokens.as_bytes, b"".join)
    texts = [x or "" for x in ODD] + [prose(k, 200) for k in range(5)] + [prose(9, 50).upper(), prose(8, 50).title()]
    for _ in range(2):  # without and with a cache
        for text, ids in zip(texts, encode(texts)):
            assert list(array("I", ids)) == t.encode(text, add_special_tokens=False).ids


def test_full_cache_keeps_what_recurs():
    path = P.path("byte_bpe_50k.json")
    t, encode = Tokenizer.from_file(path), tokens.PieceEncoder(path, tokens.as_bytes, b"".join, key="few", kept=30)
    calls, encode.tokenizer = [], type("Counted", (), {"encode_batch_fast": lambda _, x, **k: calls.append(x) or t.encode_batch_fast(x, **k)})()
    for k in range(4):
        text = "all of the usual words here" + "".join(f" rare{k}x{i}" for i in range(40))
        assert list(array("I", encode([text])[0])) == t.encode(text, add_special_tokens=False).ids
        assert "usual" in encode.tail and sum("usual" in x for c in calls for x in c) == 1
    assert len(encode.tail) < 4 * 40


def test_token_counts(odd):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = by_id(token_counts.token_counts(odd, P.path("byte_bpe_50k.json"), limit=512))
    assert len(rows) == len(ODD) + 1
    for r in rows:
        text = ODD[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(t.encode(text, add_special_tokens=False).ids))
        assert r.over_limit == (r.n_tokens > 512)
    assert token_counts.token_counts(odd.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_byte_bpe_is_tiktokens(odd):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {w: i for i, w in enumerate(byte_bpe.read_ranks(path))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = byte_bpe.coder(path, P.PATTERN)
    texts = [x or "" for x in ODD] + [prose(k, 100) for k in range(3)]
    for text, ids in zip(texts, coder.encode(texts)):
        assert list(ids) == enc.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()
    for r in by_id(byte_bpe.round_trip(odd, path, P.PATTERN)):
        ids = enc.encode_ordinary(ODD[r.doc_id] or "")
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((ODD[r.doc_id] or "").encode()).hexdigest()
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(odd, path, P.PATTERN), path, P.PATTERN)
    assert all(bytes(r.content).decode() == (ODD[r.doc_id] or "") for r in back.collect())


@pytest.mark.parametrize("ids", [[], [0], [5] * 1000, list(range(50_000)), [2**32 - 1, 1, 2**31, 3], [0, 2**20, 0] * 99])
def test_simple8b_round_trip(ids):
    ids = np.array(ids, "<u4")
    assert np.array_equal(token_files.unpack_words(token_files.pack_words(ids)), ids)
    sink = io.BytesIO()
    writer = token_files.Writer(sink, 50_000, block_ids=64)
    parts = np.array_split(ids, 5)
    for k, part in enumerate(parts):
        writer.add(k - 2, part.tobytes())
    writer.close()
    reader = token_files.Reader(sink, sink.tell())
    got = [(d, np.concatenate([np.empty(0, "<u4"), *runs])) for d, runs in reader.documents()]
    assert [d for d, _ in got] == [k - 2 for k in range(5)]
    assert all(np.array_equal(a, b) for (_, a), b in zip(got, parts))


def test_token_files(spark, odd):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    folder = common.scratch(spark, "t")
    token_files.write(odd, folder, P.path("word_bpe_49k.json"))
    at, rows = 0, sorted(token_files.read(spark, folder).collect(), key=lambda r: r.start)
    assert len(rows) == len(ODD) + 1 and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    for r in rows:
        ids = [*t.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    folder = common.scratch(spark, "t")
    token_files.write(odd.limit(0), folder, P.path("word_bpe_49k.json"))
    assert token_files.read(spark, folder).count() == 0


@pytest.mark.parametrize("sizes", [[], [1], [1024] * 3, [600, 400, 24, 1000, 24], [512] * 7, list(range(1, 400))])
def test_packing_search(sizes):
    first = packing.best_fit(sizes, 1024)
    bins = packing.local_search(sizes, first, 1024)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 1024 for b in bins) and len(bins) <= len(first)


def test_local_search_empties_a_bin():
    sizes = [6, 4, 5, 5, 7, 3]
    assert len(packing.local_search(sizes, [[0, 5], [1, 2], [3], [4]], 10)) == 3


def test_packing(odd):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert packing.cut(1024, 1024) == [(0, 1024)] and packing.cut(1030, 1024) == [(0, 6), (6, 1024)] and packing.cut(1, 1024) == [(0, 1)]
    rows = packing.pack(odd.where("doc_id <> 18"), P.path("byte_bpe_50k.json")).collect()
    for doc in range(len(ODD)):
        mine = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece)
        ids = [*t.encode(ODD[doc] or "", add_special_tokens=False).ids, 2]
        if doc != 18:
            assert [(r.start, r.length) for r in mine] == packing.cut(len(ids), 1024)
            assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in mine)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(odd.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_fingerprints(spark, odd):
    texts = [*ODD[:17], *(prose(k, 150) for k in range(30)), prose(3, 150)]
    rows = by_id(fingerprints.edited_fingerprints(table(spark, texts), runs=5))
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    seen = {}
    for r, text, after in zip(rows, texts, [*texts[1:], texts[0]]):
        text, after = text or "", after or ""
        n = len(text) // 4
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest())
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert np.mean([r.near_edited for r in rows[17:]]) > np.mean([r.near_next for r in rows[17:]])
    assert fingerprints.edited_fingerprints(odd.limit(0)).count() == 0
    assert fingerprints.edited_fingerprints(odd).count() == len(ODD) + 1
    one = fingerprints.edited_fingerprints(table(spark, ["abcd efgh"])).first()
    assert one.near_next == 1.0


def test_media(spark, odd):
    for r in by_id(media.digests(odd)):
        payload = media.pad((ODD[r.doc_id] or "").encode())
        assert len(payload) % 64 == 0 and len(payload) > 0
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.to_wave(payload)).hexdigest()
    assert media.digests(odd.limit(0)).count() == 0
    assert media.from_wave(media.to_wave(b"abc", 44100)) == (b"abc", 44100)
    tone = np.sin(np.arange(16000) * 2 * np.pi * 440 / 16000)
    assert np.abs(media.resample(tone, 16000, 8000) - np.sin(np.arange(8000) * 2 * np.pi * 440 / 8000))[99:-99].max() < 0.01
    loud = (128 + 100 * tone).astype(np.uint8)
    _, spans = media.features(np.concatenate((np.full(16000, 128, np.uint8), loud, np.full(16000, 128, np.uint8))).tobytes(), 16000)
    assert len(spans) == 1 and abs(spans[0][0] - 1) < 0.1 and abs(spans[0][1] - 2) < 0.1
    stored = media.store(odd.where("doc_id in (11, 17)"), common.scratch(spark, "m"))
    measured = media.measure(stored, common.scratch(spark, "f"))
    tensors = media.as_tensors(media.windows(measured).toArrow())
    assert tensors.schema.field("mel").type.shape == [media.WINDOW, media.MELS]
    for r in media.describe(measured).collect():
        mel, spans = media.features(media.pad(ODD[r.doc_id].encode()), media.RATE)
        want = media.digest(mel, spans).split()
        got = r.feature.split()
        assert got[:6] == want[:6] and np.allclose([float(x) for x in got[6:]], [float(x) for x in want[6:]], atol=0.02)
        assert [(x.start_s, x.end_s) for x in r.spans] == spans
        mine = tensors.filter(np.array(tensors.column("doc_id")) == r.doc_id)
        assert mine.num_rows == -(-len(mel) // media.WINDOW) and np.allclose(np.concatenate(mine.column("mel").combine_chunks().to_numpy_ndarray())[: len(mel)], mel, atol=0.501 / media.STEPS)


def test_band_is_sized_by_its_terms(spark, monkeypatch):
    assert [fingerprints.band_bits(n) for n in (0, 43_690, 43_691, 200_000)] == [20, 20, 21, 23]
    texts = [prose(k, 40) for k in range(40)]
    small = [r.fingerprint for r in by_id(fingerprints.fingerprints(table(spark, texts)))]
    monkeypatch.setattr(fingerprints, "SPREAD", 1 << 20)  # more bits tell no term of the band apart from itself
    assert fingerprints.lexicon(common.id_text(table(spark, texts)))[1] > fingerprints.LEAST_BITS
    assert [r.fingerprint for r in by_id(fingerprints.fingerprints(table(spark, texts)))] == small


def test_fingerprints_are_those_of_brute_force(spark):
    import re
    from collections import Counter

    import xxhash

    texts = [prose(k, 40) for k in range(40)] + ["", "Some other Words, other words", "x1"]
    words = [{xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[\W_]+", t.lower()) if w} for t in texts]
    df, n, mask = Counter(h for w in words for h in w), len(texts), (1 << fingerprints.LEAST_BITS) - 1
    low, high = max(fingerprints.LEAST, -(-n // fingerprints.RARE)), max(fingerprints.LEAST, int(n * fingerprints.COMMON))
    band = {h for h, c in df.items() if low <= c <= high}
    bits = {(h >> at) & mask for h in band for at in (0, fingerprints.LEAST_BITS)}
    kept = lambda h: h & mask in bits and (h >> fingerprints.LEAST_BITS) & mask in bits
    assert 0 < len(band) < len(df) and {h for h in df if kept(h)} == band

    def chain(hashes, seed):
        for h in hashes:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
        return seed

    for r in fingerprints.fingerprints(table(spark, texts)).collect():
        hashes = sorted([h for h in words[r.doc_id] if h in band] or words[r.doc_id], key=lambda h: h - (h >> 63 << 64))
        want = [format(chain(hashes, xxhash.xxh64_intdigest(b"" if hashes else texts[r.doc_id].encode(), 42)), "x")]
        for at, count in fingerprints.LEXICONS:
            some = [h for h in hashes if (h >> at) & ((1 << count) - 1) == 0]
            want.append(format(chain(some, 42), "016x")[:8] if some else "")
        assert r.fingerprint == "-".join(want)


def test_language(spark, odd):
    train = [("der die das und nicht über schön " * 5, "de"), ("the and of with that this when " * 5, "en"), ("это не так как мы все " * 5, "ru")]
    label = language.Labeller(language.fit(train)).label
    assert label("und das schön nicht")[0] == "de" and label("that when this")[0] == "en" and label("мы не все")[0] == "ru"
    assert label("123 !")[0] == "und" and label("")[0] == "und" and label("½ ² Ⅷ ٣")[:2] == ("und", 0.0)
    assert language.words_of("a²b x ½ 日本") == ["a", "b", "x", "日本"]
    sliced = language.Labeller(language.fit(train))
    assert sliced.spans("½ das²und x", *sliced.label("½ das²und x")[2:])[0][:2] == (2, 11)
    mixed = "the and of with that this when the and of with " + "это не так как мы все не так это " * 2
    who = language.Labeller(language.fit(train))
    spans = who.spans(mixed, *who.label(mixed)[2:])
    assert [s[2] for s in spans] == ["en", "ru"] and mixed[spans[1][0] :].startswith("это") and spans[0][0] == 0
    found = language.languages(odd, language.fit(train)).collect()
    assert all(len(r.spans) == r.n_spans for r in found)
    s = np.random.default_rng(1).normal(size=(60, 3)) * 6
    path = language.Labeller(language.fit(train)).path(s)
    cost = lambda p: s[np.arange(60), p].sum() - language.SWITCH * (np.diff(p) != 0).sum()
    best = s[0].copy()
    for row in s[1:]:  # brute force over the best last label
        best = np.maximum(best, best.max() - language.SWITCH) + row
    assert np.isclose(cost(path), best.max())
    rows = by_id(language.identify(odd))
    assert len(rows) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in rows)
    assert [r.lang_pred for r in rows if r.doc_id in (0, 1, 2, 12)] == ["und"] * 4
    assert language.identify(odd.limit(0)).count() == 0


def test_quality(spark, odd):
    texts = [prose(k, 60) if k % 4 else " ".join(w + "###" for w in prose(k, 60).split()) for k in range(200)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([Row(doc_id=k, quality=int(k % 4 > 0)) for k in range(120)])
    rows = by_id(quality.classify(docs, labels))
    assert sum(r.keep == bool(r.doc_id % 4) for r in rows[120:]) >= 78
    assert quality.keep(docs, labels).columns == docs.columns
    assert quality.classify(odd, labels.limit(0)).where("keep").count() == len(ODD) + 1
    assert quality.classify(odd.limit(0), labels).count() == 0


def two_views(n):
    """Texts and sources that each tell the quality of nearly all rows, with faults of their own."""
    r = np.random.default_rng(3)
    y = r.random(n) < 0.6
    texts = [prose(k, 40) if good == (r.random() > 0.05) else prose(k, 40).replace("a", "#") for k, good in enumerate(y)]
    sources = [f"{'good' if good == (r.random() > 0.05) else 'bad'}{r.integers(3)}" for good in y]
    return y, texts, sources


def test_views_teach_each_other(spark):
    y, texts, sources = two_views(600)
    docs = spark.createDataFrame([(k, t, "en", s, 100) for k, (t, s) in enumerate(zip(texts, sources))], "doc_id long, text string, lang string, source string, n_chars long")
    for n in (80, 200):
        labels = spark.createDataFrame([Row(doc_id=k, quality=int(y[k])) for k in range(n)])
        alone, _ = quality.learn(docs, labels, handed=0)
        taught, share = quality.learn(docs, labels)
        x = np.array([quality.content_features(t) for t in texts[n:]]), np.array([quality.meta_features(s, "en", 100) for s in sources[n:]])
        before, after = ([((p >= 0.5) == y[n:]).mean() for p in quality.score(m, *x)] for m in (alone, taught))
        assert abs(share - y[:n].mean()) < 1e-9
        assert after[2] > before[2] + 0.01 and after[2] >= 0.94 and after[2] >= max(after[:2]) - 0.005


def test_surest_rows_are_those_of_brute_force(spark):
    y, texts, sources = two_views(300)
    texts[200:240], sources[200:240] = [texts[100]] * 40, [sources[100]] * 40  # copies: one vote
    docs = quality.columns(spark.createDataFrame([(k, t, "en", s, 100) for k, (t, s) in enumerate(zip(texts, sources))], "doc_id long, text string, lang string, source string, n_chars long").repartition(7))
    told = spark.createDataFrame([Row(doc_id=k, quality=int(y[k])) for k in range(60)])
    content, meta, labels = quality.sample(docs, told)
    model = quality.co_train(content, meta, labels, lambda m, g: [])
    kept = [r.tobytes() for r in quality.half(np.array([quality.content_features(t) for t in texts]), np.array([quality.meta_features(s, "en", 100) for s in sources]))]
    p = quality.score(model, *quality.whole(kept))
    used = {quality.key_of(kept[70])}
    want = set()
    for view in (0, 1):
        for label, n in ((1, 24), (0, 16)):
            sure = {}
            for k in range(60, 300):
                key, s = quality.key_of(kept[k]), round(float(p[view][k] if label else 1 - p[view][k]), 6)
                if s >= quality.SURE and key not in used:
                    sure[key] = s
            want |= {(view, label, key) for key in sorted(sure, key=lambda key: (-sure[key], key))[:n]}
    got = quality.surest_rows(docs, told.select("doc_id"), model, 0.6, used, 40)
    assert want and {r[:3] for r in got} == want and all(quality.key_of(x) == key for _, _, key, x in got)
    assert quality.surest_rows(docs, docs.select("doc_id"), model, 0.6, set(), 40) == []


def test_near_dedup(spark, odd):
    base = [prose(k, 200) for k in range(12)]
    edited = [" ".join(w if i != 50 else "changed" for i, w in enumerate(t.split())) for t in base[:6]]
    texts = [*base, *edited, base[0], base[0].upper(), *ODD]
    got = dict((r.doc_id, r.class_id) for r in near_dedup.classes(table(spark, texts)).collect())
    assert len(got) == len(texts)
    for k in range(6):
        assert got[12 + k] == k
    assert got[18] == got[19] == 0 and all(got[k] == k for k in range(12))
    assert got[20] == 20 and got[21] == 21 and got[39] == 38
    h = near_dedup.shingles.word_hashes
    n = len(h(base[0]))
    assert near_dedup.similarity(h(base[0]), h(edited[0])) == (n - 1) / (n + 1)
    assert near_dedup.classes(odd.limit(0)).count() == 0
    kept = near_dedup.keep_first(odd)
    assert kept.columns == odd.columns and kept.where("text = 'same text'").count() == 1


def longest(a, b):
    """Words of the best alignment, by the table of all prefixes."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("rows", [4, 512])
def test_alignment_is_the_best_one(monkeypatch, rows):
    monkeypatch.setattr(near_dedup, "ROWS", rows)
    r = np.random.default_rng(5)
    for k in range(300):
        a = r.integers(0, 3 + k % 40, r.integers(0, 60))
        b = np.delete(a, r.integers(0, max(1, len(a)), r.integers(0, 5))) if len(a) else a
        b = np.insert(b, r.integers(0, len(b) + 1, r.integers(0, 6)), 99) if k % 2 else np.roll(b, k % 3)
        best = longest(a.tolist(), b.tolist())
        assert near_dedup.aligned(a, b, 99) == best
        want = best / (len(a) + len(b) - best) if len(a) + len(b) else 1.0
        got = near_dedup.similarity(a, b)
        assert got == want if want >= near_dedup.THRESHOLD else got < near_dedup.THRESHOLD


@pytest.mark.parametrize(("words", "edits"), [(100, 3), (100, 5), (100, 9), (300, 15), (300, 30)])
def test_recall_of_edited_copies(words, edits):
    """Of copies with so many words replaced: near-duplicates by the definition, and how many of them share a band."""
    r = np.random.default_rng(words + edits)
    met = 0
    for k in range(100):
        a = r.integers(1, 1 << 62, words).astype(np.uint64)
        b = a.copy()
        b[r.choice(words, edits, replace=False)] = r.integers(1, 1 << 62, edits).astype(np.uint64)
        assert near_dedup.similarity(a, b) >= near_dedup.THRESHOLD
        met += bool(set(near_dedup.bands(a).tolist()) & set(near_dedup.bands(b).tolist()))
    assert met >= 97


def test_near_dedup_against_all_pairs(spark):
    r = np.random.default_rng(11)
    texts = []
    for k in range(12):
        words = prose(300 + k, int(r.integers(60, 200))).split()
        texts.append(" ".join(words))
        for _ in range(6):
            copy = list(words)
            for i in r.choice(len(words), int(r.integers(1, len(words) // 8)), replace=False):
                copy[i] = f"z{r.integers(1 << 30)}"
            texts.append(" ".join(copy))
    h = [near_dedup.shingles.word_hashes(t).tolist() for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            m = longest(h[i], h[j]) if i // 7 == j // 7 else 0
            if m >= near_dedup.THRESHOLD * (len(h[i]) + len(h[j]) - m):
                root = [root[j] if x == root[i] else x for x in root]
    brute = {i: min(k for k in range(len(texts)) if root[k] == root[i]) for i in range(len(texts))}
    got = dict((x.doc_id, x.class_id) for x in near_dedup.classes(table(spark, texts)).collect())
    assert len(got) == len(texts) and sum(got[i] == brute[i] for i in brute) >= 0.95 * len(texts)
    assert len(set(got.values())) < 0.5 * len(texts)


def test_near_dedup_of_repeated_ids(spark):
    a, b = prose(1, 80), prose(2, 80)
    docs = table(spark, [a], first=3).union(table(spark, [a], first=5)).union(table(spark, [b], first=5)).union(table(spark, [b], first=5))
    assert sorted(map(tuple, near_dedup.classes(docs).collect())) == [(3, 3), (5, 3), (5, 5)]
    assert sorted((r.doc_id, r.text) for r in near_dedup.keep_first(docs).collect()) == [(3, a), (5, b)]
    nameless = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert near_dedup.classes(nameless).count() == 3 and near_dedup.keep_first(nameless).count() == 2


def test_large_group_of_copies(spark):
    base = prose(1, 120).split()
    texts = [" ".join(w if i != 20 + k % 80 else f"x{k}" for i, w in enumerate(base)) for k in range(60)]
    rows = near_dedup.classes(table(spark, [" ".join(base), *texts])).collect()
    assert {r.class_id for r in rows} == {0}


def test_chain_of_revisions_is_one_class(spark):
    """Every revision is near the next ones only, in buckets larger than SMALL, where hubs match but a part of them."""
    words, texts = prose(4, 400).split(), []
    for k in range(40):
        words[40 + 6 * k] = f"new{k}"
        words[41 + 6 * k] = f"other{k}"
        texts.append(" ".join(words))
    h = [near_dedup.shingles.word_hashes(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if near_dedup.similarity(h[i], h[j]) >= near_dedup.THRESHOLD:
                root = [root[j] if r == root[i] else r for r in root]
    brute = {i: min(k for k in range(len(texts)) if root[k] == root[i]) for i in range(len(texts))}
    assert dict((r.doc_id, r.class_id) for r in near_dedup.classes(table(spark, texts)).collect()) == brute
    rows = spark.createDataFrame([(7, i, len(h[i])) for i in range(len(texts))], "key long, id long, size int")
    got = near_dedup.links(rows, common.id_text(table(spark, texts)), near_dedup.THRESHOLD)
    assert dict((r.node, r.root) for r in common.components(got).collect()) == brute


def test_hubs_do_not_part_a_bucket(spark):
    """One bucket: 13 is near 12 only, which the hubs among 0 to 11 match."""
    base = prose(8, 200).split()
    edit = lambda at: [w if i not in at else f"e{i}" for i, w in enumerate(base)]
    first = list(range(60, 60 + 75, 5))
    hubs = [edit([100 + k]) for k in range(12)]
    middle, far = edit(first), edit([*first, *range(0, 60, 4), 140])
    texts = [" ".join(t) for t in [*hubs, middle, far]]
    h = [near_dedup.shingles.word_hashes(t) for t in texts]
    rows = spark.createDataFrame([(7, i, len(h[i])) for i in range(len(texts))], "key long, id long, size int")
    near = [i for i in range(13) if near_dedup.similarity(h[i], h[13]) >= near_dedup.THRESHOLD]
    assert near == [12] and near_dedup.similarity(h[0], h[12]) >= near_dedup.THRESHOLD
    got = near_dedup.links(rows, common.id_text(table(spark, texts)), near_dedup.THRESHOLD)
    assert dict((r.node, r.root) for r in common.components(got).collect()) == {i: 0 for i in range(14)}


def test_frequent_word_pairs_part_nothing(spark, monkeypatch):
    """One bucket of texts whose word pairs all stand in more than BLOCK of them; those of a near pair differ in one section."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    r = np.random.default_rng(5)
    sections = [f"sep {' '.join(f'w{k}x{i}' for i in range(10))} sep" for k in range(20)]
    texts = []
    for _ in range(20):
        chosen = r.permutation(20)[:13].tolist()
        texts.append(" ".join(sections[k] for k in chosen[:12]))
        texts.append(" ".join(sections[k] for k in [*chosen[:5], chosen[12], *chosen[6:12]]))
    h = [near_dedup.shingles.word_hashes(t) for t in texts]
    brute = {i: i - i % 2 for i in range(40)}
    assert all((near_dedup.similarity(h[i], h[j]) >= near_dedup.THRESHOLD) == (brute[i] == brute[j]) for i in range(40) for j in range(i))
    rows = spark.createDataFrame([(7, i, len(h[i])) for i in range(40)], "key long, id long, size int")
    got = near_dedup.links(rows, common.id_text(table(spark, texts)), near_dedup.THRESHOLD)
    assert dict((r.node, r.root) for r in common.components(got).collect()) == brute


def test_substring_dedup(spark, odd):
    passage = prose(77, 80)
    host = lambda k: prose(100 + k, 60)[:-1]
    texts = [f"{host(1)} {passage} {host(2)}", f"{host(3)}\n{passage} {host(4)}", prose(5, 120), f"{host(6)} {' '.join(passage.split()[:30])} {host(7)}", *ODD]
    docs = table(spark, texts)
    rows = substring_dedup.passages(docs).collect()
    assert [(r.doc_id, r.kept_in) for r in rows] == [(1, [0])]
    assert passage in texts[1][rows[0].spans[0].start : rows[0].spans[0].end] or texts[1][rows[0].spans[0].start : rows[0].spans[0].end] in passage
    left = {r.doc_id: r.text for r in substring_dedup.remove(docs).collect()}
    assert passage not in left[1] and "".join(left[1].split()).startswith("".join(host(3).split())) and left[0] == texts[0] and left[3] == texts[3]
    assert substring_dedup.passages(odd.limit(0)).count() == 0
    assert substring_dedup.remove(odd).columns == odd.columns


def test_passages_leave_no_shuffle_files(spark):
    """What the steps shuffle goes with them; the driver's garbage doesn't decide."""
    texts = [f"{prose(10 + k, 60)} {prose(77, 80)} {prose(30 + k, 40)}" for k in range(6)]
    docs = table(spark, texts)
    shuffles = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    count = lambda: sum(shuffles().apply(i).getName().startswith("shuffle_") for i in range(shuffles().size()))
    before = count()
    found = substring_dedup.passages(docs)
    for _ in range(100):
        if count() <= before:
            break
        time.sleep(0.05)
    assert count() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert sorted(r.doc_id for r in found.collect()) == [1, 2, 3, 4, 5]


def test_passages_without_sentences(spark):
    """Runs of 49 to 80 words in text without a full stop: what goes is what brute force over words finds."""
    r = np.random.default_rng(3)
    words = lambda n: [f"w{k}" for k in r.integers(0, 5000, n)]
    texts, long = [], []
    for n in (49, 51, 53, 56, 60, 66, 72, 80):
        run = words(n)
        long += [n >= substring_dedup.RUN] * 2
        texts += [" ".join(words(150) + run + words(70)), " ".join(words(90) + run + words(130))]
    want = {}
    for i in range(1, len(texts), 2):
        x, y = texts[i].split(), texts[i - 1].split()
        have = {tuple(y[k : k + substring_dedup.RUN]) for k in range(len(y))}
        gone = {m for k in range(len(x) - substring_dedup.RUN + 1) if tuple(x[k : k + substring_dedup.RUN]) in have for m in range(k, k + substring_dedup.RUN)}
        if gone:
            want[i] = " ".join(x[min(gone) : max(gone) + 1])
    assert list(want) == [i for i in range(1, len(texts), 2) if long[i]]
    rows = substring_dedup.passages(table(spark, texts)).collect()
    assert {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans] for r in rows} == {i: [t] for i, t in want.items()}


def test_passage_whose_sentences_also_stand_alone(spark):
    """Each sentence of the passage is in an earlier document by itself, so every bucket has another first paragraph."""
    sentences = [prose(500 + k, 9).split(".")[0] + "." for k in range(8)]
    passage = " ".join(sentences)
    assert len(passage.split()) >= substring_dedup.RUN
    alone = [f"{prose(600 + k, 40)} {s} {prose(700 + k, 40)}" for k, s in enumerate(sentences)]
    texts = [*alone, f"{prose(1, 60)} {passage} {prose(2, 60)}", f"{prose(3, 70)} {passage} {prose(4, 50)}"]
    rows = substring_dedup.passages(table(spark, texts)).collect()
    assert [(r.doc_id, r.kept_in) for r in rows] == [(9, [8])]
    assert [texts[9][s.start : s.end] for s in rows[0].spans] == [passage]
    long = " ".join(prose(900 + k, 12) for k in range(40))  # its first paragraphs are also in an older document
    parts = long.split()
    texts = [f"{prose(1, 60)} {' '.join(parts[:90])} {prose(2, 60)}", f"{prose(3, 60)} {long} {prose(4, 60)}", f"{prose(5, 60)} {long} {prose(6, 60)}"]
    lost = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans] for r in substring_dedup.passages(table(spark, texts)).collect()}
    assert lost == {1: [" ".join(parts[:90])], 2: [long]}


def test_substring_dedup_of_repeated_ids_and_clashing_names(spark):
    passage = prose(77, 80)
    texts = [f"{prose(1, 60)} {passage}", f"{prose(2, 60)} {passage}", prose(3, 120)]
    docs = spark.createDataFrame([(4, texts[0], 1, "x"), (9, texts[1], 2, "y"), (9, texts[2], 3, "z"), (9, texts[2], 3, "z"), (None, texts[1], 4, "w")], "doc_id long, text string, _id int, lost_spans string")
    assert [(r.doc_id, r.kept_in) for r in substring_dedup.passages(docs).collect()] == [(9, [4])]
    left = substring_dedup.remove(docs)
    assert left.columns == docs.columns
    rows = sorted(left.collect(), key=lambda r: r._id)
    assert [(r.doc_id, r._id, r.lost_spans) for r in rows] == [(4, 1, "x"), (9, 2, "y"), (9, 3, "z"), (9, 3, "z"), (None, 4, "w")]
    assert [r.text.strip() for r in rows] == [texts[0], prose(2, 60), texts[2], texts[2], texts[1]]


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = dict((r.node, r.root) for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 140))
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    texts = [prose(k, 120) for k in range(20)] + [prose(3, 120), None, "123", *(" ".join(w + "###" for w in prose(k, 60).split()) for k in range(20))]
    spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 20), 0) for i in range(0, 43) if i not in (20, 21, 22)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(range(20))


def test_components_of_stars_need_no_round(spark):
    """Edges that are stars of their least nodes are written once; every other set goes on to its least nodes."""
    for edges, tables in (([(5, 1), (6, 1), (7, 2)], 1), ([], 1), ([(5, 1), (1, 0)], 2), ([(5, 1), (5, 2)], 2)):
        made = []
        with common.noting(made):
            got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        want = {n: n for e in edges for n in e}
        for _ in edges:
            for a, b in edges:
                least = min(want[a], want[b])
                want = {n: least if r in (want[a], want[b]) else r for n, r in want.items()}
        assert got == want and len(made) == tables


def test_counted_tables_have_few_files(spark):
    """A small table of many shuffle partitions is written by two tasks for each core at most, whatever its rows are."""
    held = {"spark__sql__shuffle__partitions": "64", "spark__sql__adaptive__coalescePartitions__enabled": "false"}
    with common.settings(spark, **held):
        at_most = 2 * spark.sparkContext.defaultParallelism
        df = spark.range(1000).groupBy((F.col("id") % 500).alias("k")).count()
        kept = common.materialize(df, "few", 1000)
        assert len(kept.inputFiles()) <= min(at_most, 64) and kept.count() == 500
        assert len(common.materialize(df, "few", 64 * common.FILE_ROWS).inputFiles()) > at_most
        made = []
        with common.noting(made):
            common.components(spark.createDataFrame([(i, i % 7) for i in range(7, 700)], "a long, b long"), rows=700)
        assert len(spark.read.parquet(made[-1]).inputFiles()) <= at_most


def test_language_switches_are_found_in_less_time_than_by_arrays():
    """Viterbi's labels are those of a plain loop over arrays, which took most of the labeller's time."""
    who = language.Labeller(language.fit([("the cat sat on the mat", "en"), ("der hund lief im wald", "de"), ("le chat dort ici", "fr"), ("el perro come pan", "es")]))

    def plain(s):
        value, back, stay = s[0].copy(), np.empty(s.shape, np.int32), np.arange(s.shape[1])
        for i in range(1, len(s)):
            top = int(value.argmax())
            switch = value[top] - language.SWITCH
            back[i] = np.where(value >= switch, stay, top)
            value = np.maximum(value, switch) + s[i]
        out = [int(value.argmax())]
        for i in range(len(s) - 1, 0, -1):
            out.append(int(back[i, out[-1]]))
        return out[::-1]

    def seconds(f, s):
        began = time.thread_time()
        found = list(f(s))
        return found, time.thread_time() - began

    r = np.random.default_rng(5)
    s = r.normal(0, 1, (20_000, 4)) + 3 * np.eye(4)[np.repeat(r.integers(0, 4, 400), 50)]
    s[:100] = np.round(s[:100])  # with ties
    (found, ours), (want, theirs) = seconds(who.path, s), seconds(plain, s)
    assert found == want and len(set(found)) == 4 and ours < 0.6 * theirs


def test_language_grams_and_letters():
    assert language.grams("ab") == ["<", "a", "b", ">", "<a", "ab", "b>", "<ab", "ab>"]
    assert language.words_of("x² añb ½c") == [w for w in ("x", "añb", "c")]
