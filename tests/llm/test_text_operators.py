"""Line rules, fill-in-middle and collocations against brute force, with every awkward row."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tests.llm.test_operators import ODD, SCHEMA, prose, table
from weftline.llm import collocations, common, fim, line_rules


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD).union(table(spark, ["same text"], first=18))


def written(df):
    """The same rows from a table: plans of no row aren't folded away, so tasks run."""
    return common.materialize(df, "written")


# ---- fill-in-middle


def whole_text(text, key, seed=7, rate=100, spm=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("seed", range(6))
def test_ropes(seed):
    r = np.random.default_rng(seed)
    for _ in range(40):
        text = "".join(r.choice(list("ab\n\ré🙂 <PS>M"), int(r.integers(0, 60)))) + ("x" * 9000 + "\n") * int(r.integers(0, 4)) + "end" * int(r.integers(0, 2))
        got = fim.rearrange(text, str(seed), seed=3, rate=80)
        assert got == whole_text(text, str(seed), seed=3, rate=80)
        assert fim.restore(got[4], got[1]) == text
        tree = fim.rope(text)
        assert fim.written(tree) == text and tree.chars == len(text)
        k = int(r.integers(0, len(text) + 2))
        a, b = fim.split_chars(tree, k)
        assert (fim.written(a), fim.written(b)) == (text[:k], text[k:]) and a.units == fim.n_units(text[:k])


def test_fim(spark, odd):
    texts = ["a\nb\nc\n", "a\nb <P>\n", "\n\n\n", "one line " * 20000, "x\n" * 50000, "<\n<P\n>", "r\rn\x0b\n\x85z\n"]
    docs = odd.union(table(spark, texts, first=100)).union(spark.createDataFrame([(None, "n\nm", None, None, 3, "k", 7, None)], SCHEMA))
    got = fim.transform(docs).join(docs.select("doc_id", "text"), "doc_id", "left").collect()
    assert len(got) >= docs.count()
    for r in got:
        if r.doc_id is not None:
            assert tuple(r)[1:6] == whole_text(r.text or "", str(r.doc_id))
    forms = Counter(r.form for r in got)
    assert forms["psm"] and forms["spm"] and forms["plain"]
    for r in fim.digests(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        text = r.text or ""
        assert r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.output_sha256 == hashlib.sha256(whole_text(text, str(r.doc_id))[4].encode()).hexdigest()
    none = fim.digests(docs.where("doc_id is null")).collect()
    assert [r.output_sha256 for r in none] == [hashlib.sha256(whole_text("n\nm", "")[4].encode()).hexdigest()]
    assert fim.digests(written(odd.limit(0))).collect() == []


# ---- line rules


def rules(rows, least, share, left=0.5):
    """doc_id to (counts, failed, kept) by plain loops."""
    words = re.compile(r"[^\x20\x09-\x0D]+").findall
    key = lambda line: re.sub("[0-9]+", "0", " ".join(words(line)).lower())
    hosts = Counter(host for _, host, _ in rows)
    seen = Counter((host, k) for _, host, text in rows for k in {key(x) for x in (text or "").split("\n") if words(x)})
    out = []
    for doc, host, text in rows:
        text = text or ""
        w = words(text)
        solid = [x for x in text.split("\n") if words(x)]
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(windows)
        repeated = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
        lost = sum(len(words(x)) for x in solid if seen[host, key(x)] > least and seen[host, key(x)] > share * hosts[host])
        failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
        counts = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(solid) - len(set(solid)), len(repeated))
        out.append((doc, *counts, failed, not failed and len(w) - lost >= left * len(w), len(w) - lost))
    return sorted(out, key=str)


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_line_rules(spark, odd, sent):
    foot = "Read 1,024 more  pages on OUR site and follow us for news of all kinds today"
    texts = [f"{prose(k, 30)}\n{foot.replace('1,024', str(k))}\n\t" for k in range(30)] + [f"{prose(k, 9)}\n{foot}" for k in range(40, 70)] + [prose(7, 12) + " " + prose(7, 12) + " " + prose(8, 30), "a b c d e f g h i " * 5, "# * $ %& <a|b>\n" * 30]
    docs = odd.union(table(spark, texts, first=200)).withColumn("source", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("source")))
    docs = docs.union(docs.where("doc_id = 210")).union(docs.where("doc_id = 211").withColumn("doc_id", F.lit(None).cast("long")))
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    got = line_rules.rules(docs, least=4, share=0.1, sent=sent)
    mine = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.words_left) for r in got.collect()), key=str)
    brute = rules(rows, 4, 0.1)
    assert mine == brute
    assert sum(not x[7] and not x[6] for x in brute) >= 5  # some are depleted
    assert line_rules.rules(written(odd.limit(0)), sent=sent).collect() == []


def test_repeated_words_are_those_of_brute_force():
    r = np.random.default_rng(1)
    for _ in range(200):
        w = [str(x) for x in r.integers(0, int(r.integers(1, 4)), int(r.integers(0, 40)))]
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(windows)
        assert line_rules.n_repeat_words(w) == len({j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)})


# ---- collocations


def mined(rows, least=10, most=3, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for m in range(1, most + 1):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        told = []
        long = [p for p, a in f.items() if a >= least and len(p) > 1]
        held = defaultdict(int)
        for p in long:
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    held[p[i : i + m]] = max(held[p[i : i + m]], f[p])
        for p in long:
            a = f[p]
            score, k, l, r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if 100 * held[p] < 50 * a or not held[p]:
                told.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(told)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -s))
    return sorted(out)


def found(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("most", [2, 3, 5])
def test_collocations(spark, odd, most):
    r = np.random.default_rng(4)
    words = ["the", "of", "É", "big", "RED", "dog", "new", "york", "x|", "日本"]
    texts = ["".join(str(w) + str(e) for w, e in zip(r.choice(words, 300), r.choice([" ", " ", "\t", "  ", ". ", "\n", ","], 300))) + " New York city hall" * 3 for _ in range(12)] + ["a a a a a a a a"] * 3
    docs = odd.union(table(spark, texts, first=300)).union(table(spark, ["Z z Z z z"], first=900).withColumn("lang", F.lit("de")))
    rows = [(x.lang, x.text) for x in docs.collect()]
    brute = mined(rows, 5, most, 60)
    assert brute and found(collocations.collocations(docs, 5, most, 60)) == brute
    assert any(len(x[2].split()) == most for x in brute)


def test_collocations_with_hot_prefixes_and_full_filters(spark, monkeypatch):
    """Every prefix is dealt out by its next word, filters let most through, slices are short: the counts stay."""
    for name, value in (("HOT", 1 << 40), ("FEWEST_BITS", 6), ("MOST_BITS", 6), ("SLICE", 64), ("RANK_PARTS", 3)):
        monkeypatch.setattr(collocations, name, value)
    r = np.random.default_rng(5)
    texts = [" ".join(r.choice(["a", "b", "c", "d e f", "gg", "h."], 200)) for _ in range(10)]
    docs = table(spark, texts)
    assert found(collocations.collocations(docs, 8, 4, 50)) == mined([(x.lang, x.text) for x in docs.collect()], 8, 4, 50)


def test_collocations_of_nothing(spark, odd):
    assert collocations.collocations(written(odd.limit(0))).collect() == []
    assert collocations.collocations(written(table(spark, [None, "", "one two"]))).collect() == []


def test_a_clash_takes_another_seed(spark):
    words = spark.createDataFrame([Row(lang="en", word="a", h=1, n=3), Row(lang="en", word="b", h=1, n=3)])
    assert collocations.clashes(words) and not collocations.clashes(words.where("word = 'a'"))
    a, _, _, _, _ = collocations.analysed([b"x y"], "en", 0)
    b, _, _, _, _ = collocations.analysed([b"x y"], "en", 1)
    c, _, _, _, _ = collocations.analysed([b"x y"], "de", 0)
    assert not set(a.tolist()) & set(b.tolist()) and not set(a.tolist()) & set(c.tolist())


# ---- language: nothing to learn from


def test_language_where_nothing_can_be_learned(spark, odd, tmp_path):
    from weftline.llm import language

    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    for docs in (written(odd.limit(0)), written(unlabelled), written(table(spark, [None]))):
        got = language.identify(docs).collect()
        assert len(got) == docs.count() and {(r.lang_pred, r.score, r.n_spans) for r in got} <= {("und", 0.0, 0)}
        assert language.keep(docs, language.learn(docs)).collect() == []
    assert language.Labeller(language.fit([])).label("some text")[:2] == ("und", 0.0)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_packs_with_a_small_cache(spark, monkeypatch, tmp_path):
    """Its workers hold what earlier stages loaded, so the last one is told how many pieces to keep; the rows are the same."""
    import corpus_pipeline
    from weftline.llm import packing, tokens

    told, pack = [], packing.pack
    monkeypatch.setattr(packing, "pack", lambda *a, **k: told.append(k) or pack(*a, **k))
    docs = spark.createDataFrame([(i, f"one text of {i} and more {i * i}") for i in range(40)], "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()))
    assert told == [{"kept": tokens.FEW_PIECES}] and tokens.FEW_PIECES < tokens.CACHE_PIECES
    assert got == sorted(map(tuple, pack(docs, corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")).collect()))
