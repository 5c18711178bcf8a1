"""Audits against hand-made cases and plain loops."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import audits

URLS = [
    ("HTTP://User:Pw@Example.COM:80/a/./b/../c", "http://User:Pw@example.com/a/c"),
    ("https://example.com:8443", "https://example.com:8443/"),
    ("wss://h:443/x", "wss://h/x"),
    ("http://h/a/../../b/..", "http://h/"),
    ("http://h/a//b/./", "http://h/a/b/"),
    ("http://h/a/b/..", "http://h/a/"),
    ("http://h/%7Eme/%41 b/é", "http://h/~me/A%20b/%C3%A9"),
    ("http://h/a%zz+b", "http://h/a%zz+b"),
    ("http://h/p?b=2&a=1&b=1#top", "http://h/p?a=1&b=1&b=2"),
    ("http://h/p?UTM_source=x&ref=1&igshid=2&sources=3&k", "http://h/p?k="),
    ("http://h?q=a+b%20c&q=%C3%A9~*", "http://h/?q=a+b+c&q=%C3%A9~%2A"),
    ("http://h/?a=b=c&=d", "http://h/?=d&a=b%3Dc"),
    ("http://[::1]:80/x", "http://[::1]/x"),
    ("/a/b", None),
    ("mailto:a@b", None),
    ("", None),
    (None, None),
]


def test_canonical_urls(spark):
    rows = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(URLS)], "k int, url string")
    got = {r.k: r.c for r in rows.select("k", X.canonical_url(F.col("url")).alias("c")).collect()}
    assert [(URLS[k][0], got[k]) for k in range(len(URLS))] == URLS
    again = spark.createDataFrame([(w,) for _, w in URLS if w], "url string")
    assert again.where(X.canonical_url(F.col("url")) != F.col("url")).count() == 0


def test_quality_gate(spark):
    unit, near, far = [1.0, 0.0], [0.99995, 0.01], [0.6, 0.8]
    rows = [
        (None, 0.9, unit, 0.1, None, "ACCEPT_NEW", "first_embed", 0.0),
        (unit, 0.9, unit, 0.8, unit, "REJECT", "lower_quality_provider", -0.1),
        ([1.0], 0.9, unit, 0.9, far, "ACCEPT_NEW", "dimension_upgrade", 0.0),
        (near, None, unit, None, far, "NOOP", "unchanged", 0.99995),
        (far, None, unit, 0.7, None, "REPLACE", "passed_without_stability_check", 0.2),
        (far, 0.5, unit, 0.5, [1.0], "REJECT", "stability_dimension_mismatch", 0.0),
        (far, 0.5, unit, 0.5, far, "REJECT", "unstable_new_vector", 0.6),
        (far, 0.5, unit, 0.46, near, "REPLACE", "passed_all_gates", -0.04),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], "old array<double>, old_rank double, new array<double>, new_rank double, again array<double>")
    got = df.select(audits.quality_gate(*map(F.col, df.columns)).alias("t")).select("t.*").collect()
    assert [(r.verdict, r.reason, round(r.value, 6)) for r in got] == [r[5:] for r in rows]


def test_bake_off(spark):
    r = np.random.default_rng(5)
    vec = {p: {k: r.normal(size=6) for k in range(30)} for p in ("a", "b")}
    for k in range(0, 20, 2):  # provider b knows its pairs
        vec["b"][k + 1] = vec["b"][k] + r.normal(size=6) * 0.2
    del vec["a"][3]
    good, bad = [(k, k + 1) for k in range(0, 20, 2)], [(k, 29 - k) for k in range(8)]
    vectors = spark.createDataFrame([(p, k, v.tolist()) for p in vec for k, v in vec[p].items()], "provider string, id long, vec array<double>")
    pairs = lambda rows: spark.createDataFrame(rows, "host long, dest long")
    got = {x.provider: x for x in audits.bake_off(vectors, pairs(good), pairs(bad), depth=3).collect()}
    pool = sorted({d for _, d in good + bad})
    want = {}
    for p, own in vec.items():
        cos = lambda x, y: float(own[x] @ own[y] / np.linalg.norm(own[x]) / np.linalg.norm(own[y]))  # noqa: B023, E731
        ranks = [1 + sum(cos(h, o) > cos(h, d) for o in pool if o in own) for h, d in good if d in own]
        near = [k for k in ranks if k <= 3]
        pos, neg = np.mean([cos(h, d) for h, d in good if d in own]), np.mean([cos(h, d) for h, d in bad if h in own and d in own])
        want[p] = [sum(1 / k for k in near) / 10, sum(1 / math.log2(k + 1) for k in near) / 10, len(near) / 10, pos, neg, pos - neg]
    for p, w in want.items():
        assert [got[p][k] for k in ("mrr", "ndcg", "recall", "positive", "negative", "separation")] == pytest.approx(w)
    assert got["b"].winner and not got["a"].winner and got["b"].ranking == 1 and got["a"].pairs == 10
    assert audits.bake_off(vectors, pairs([]), pairs(bad)).collect() == []


def test_anchor_oddity(spark):
    names = ["red apple", "green pear", "red apple", "blue plum tree", "zzzzzzzzzzzz", "Yellow MELON", "x", "", "  ", None, "old oak table"]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, name string")
    got = {r.k: r for r in audits.anchor_oddity(rows, "name").collect()}

    def bits(name):
        grams = Counter(name.lower()[i : i + 2] for i in range(max(1, len(name) - 1)))
        return round(-sum(n / grams.total() * math.log2(n / grams.total()) for n in grams.values()), 6) + 0.0

    told = {k: bits(n) for k, n in enumerate(names) if n and n.strip()}
    middle = np.median(list(told.values()))
    spread = np.median([abs(b - middle) for b in told.values()])
    assert len(got) == len(names)
    for k in range(len(names)):
        z = 0.6745 * (told[k] - middle) / spread if k in told else 0.0
        assert (abs(got[k].bits - told.get(k, 0)) < 1e-9, got[k].z, got[k].flagged) == (True, pytest.approx(z, abs=1e-6), abs(z) > 3.5)
        assert got[k].penalty == pytest.approx(min(1, max(0, abs(z) - 3.5) / 3.5))
    assert got[4].flagged and got[6].flagged and not got[0].flagged
    assert {r.z for r in audits.anchor_oddity(rows.where("k = 0"), "name").collect()} == {0.0} and audits.anchor_oddity(rows.limit(0), "name").count() == 0
