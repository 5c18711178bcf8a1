"""Stems, spans, passages, lexicon and phrase matches against published values and plain loops."""

import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from weftline.functions import phrases as P
from weftline.functions import spans as S
from weftline.functions.stem import stem, stem_set
from weftline.operators import phrases as Q
from weftline.plans.registry import QUERIES

# Pairs of the published sample vocabulary.
STEMS = """consign consign;consigned consign;consigning consign;consignment consign;consistency consist;consistently consist;consolation consol;consolatory consolatori;consolidate consolid
consolingly consol;consonant conson;conspicuous conspicu;conspiracy conspiraci;conspirators conspir;constable constabl;constancy constanc;constant constant;knackeries knackeri;knaves knave;knavish knavish
kneaded knead;knees knee;kneeling kneel;knightly knight;knit knit;knitted knit;knives knive;knocker knocker;knots knot;generate generat;generously generous;communication communic
running run;hopping hop;hoping hope;flies fli;dies die;ties tie;cries cri;gas gas;this this;kiwis kiwi;caresses caress;happy happi;by by;say say;luxuriated luxuri;skies sky;news news;innings inning
relational relat;conditional condit;rationalization ration;vietnamization vietnam;hopefulness hope;electrical electr;triplicate triplic;goodness good;adjustment adjust;adoption adopt;controlling control;rate rate;bed bed;shed shed;beautiful beauti;youth youth"""


@pytest.mark.parametrize("pair", STEMS.replace("\n", ";").split(";"))
def test_published_stems(pair):
    word, expected = pair.split()
    assert stem(word) == expected


def test_stem_sets(spark):
    rows = spark.createDataFrame([("Running runs, the RUN!",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(stem_set(F.col("t"))).collect()] == [["run"], None, []]


def test_sentence_spans(spark):
    text = "First sentence here. second goes on!  \n Third one is Long.\n\n  short.\n \nÄnd the last one of all"
    for _, a, z, s in S.sentence_spans(text):
        assert text[a:z] == s == s.strip() and len(s) >= 15
    assert [s[3] for s in S.sentence_spans(text)] == ["First sentence here. second goes on!", "Third one is Long.", "Änd the last one of all"]
    assert [s[0] for s in S.sentence_spans(text)] == [0, 1, 2]
    assert S.sentence_spans("") == [] == S.sentence_spans(" \n\n ") and len(S.sentence_spans("x " * 50_000)) == 1
    r = random.Random(2)
    for _ in range(100):
        t = "".join(r.choice(["Aa", "b", ". ", "! ", "\n\n", "\n", "?", "  "]) for _ in range(60))
        parts = [p.strip() for p in re.split(r"(?<=[.!?])\s+(?=[A-Z])|\n\s*\n", t)]
        assert [s[3] for s in S.sentence_spans(t, 3)] == [p for p in parts if len(p) >= 3]
    rows = spark.createDataFrame([(text,), (None,)], "t string").select(S.spans(F.col("t")).alias("s")).collect()
    assert [tuple(x) for x in rows[0].s] == S.sentence_spans(text) and rows[1].s is None


def grouped(sentences, target, shared):
    """By hand: sentences are put into a buffer one by one."""
    out, buffer, at = [], [], 0
    for s in (x for x in sentences if x.strip()):
        if buffer and sum(len(x.split()) for x in buffer) + len(s.split()) > target:
            out.append((at - sum(len(x.split()) for x in buffer), at, " ".join(buffer)))
            buffer = buffer[-shared:] if 0 < shared < len(buffer) else []
        buffer.append(s)
        at += len(s.split())
    return [*out, *([(at - sum(len(x.split()) for x in buffer), at, " ".join(buffer))] if buffer else [])]


def test_packed_passages():
    r = random.Random(3)
    for _ in range(200):
        sentences = ["w " * r.choice([0, 1, 3, 8, 20]) + "." * r.choice([0, 1]) for _ in range(r.randrange(15))]
        target, shared = r.choice([5, 12, 30]), r.choice([0, 1, 2])
        assert [x[1:] for x in S.packed(sentences, target, shared)] == grouped(sentences, target, shared)


def test_generic_phrases(spark):
    for anchor in ["Click here for more", "this", " Best OF the best ", "threshold", "", None, "weftline guide", "download now here", "the official site"]:
        low = (anchor or "").lower().strip()
        brute = sorted({p for p in S.GENERIC if p in low}) if low else []
        share = min(1.0, sum(len(p.split()) for p in brute) / max(1, len(low.split()))) if low else 0.0
        assert S.generic_phrases(anchor) == (brute, share)
    got = spark.createDataFrame([("click here",), (None,)], "a string").select(S.genericness(F.col("a")).alias("g")).collect()
    assert got[0].g.genericness == 1.0 and got[1].g.phrases == []


def test_inventory():
    title, distilled = "The Pacific Ocean currents", "Ocean currents carry heat. Pacific Ocean currents carry salt\nheat"
    got = P.inventory(title, distilled)
    assert got[0] == (["pacific", "ocean", "currents"], "Pacific Ocean currents", 0)
    phrases = [" ".join(w) for w, _, _ in got]
    # a beginning of a longer phrase stays only if it stands elsewhere too: "ocean currents" does
    assert "pacific" not in phrases and "pacific ocean" in phrases and "ocean currents" in phrases and "currents" in phrases and "heat" not in phrases
    assert len(phrases) == len(set(phrases)) <= 24 and [s for _, _, s in got] == sorted(s for _, _, s in got)
    assert P.inventory(None, None) == [] == P.inventory("the of", "")
    assert len(P.inventory(" ".join(f"word{i}" for i in range(60)), None)) == 24


def by_all_spans(text, phrases, context):
    """The rule as a loop over all spans and phrases."""
    ws = P.words(text)
    w = [x[0] for x in ws]
    known, wanted = {x for p, _ in phrases for x in p}, {p for p, _ in phrases}

    def hits(a, z):
        low, high = max(0, a - context), min(len(w), z + context)
        beside = {w[i] for i in range(low, high) if not a <= i < z and w[i] in known} - set(w[a:z])
        other = any(tuple(w[b:y]) in wanted and (y <= a or b >= z) and b >= low and y <= high for b in range(len(w)) for y in range(b + 1, min(len(w), b + 5) + 1))
        return (len(beside) >= 2) + other

    exact, partial, short = [], [], False
    for a in range(len(w)):
        for z in range(a + 1, min(len(w), a + 5) + 1):
            for p, source in phrases:
                s = tuple(w[a:z])
                if s == p:
                    exact.append((P.relevance(True, source, 0, z - a), source, a, z))
                    continue
                shared = max((k for k in range(1, 6) for i, j in itertools.product(range(len(s)), range(len(p))) if i + k <= len(s) and j + k <= len(p) and s[i : i + k] == p[j : j + k]), default=0)
                if shared >= 2:
                    if shared / min(len(s), len(p)) >= 0.6 and hits(a, z):
                        partial.append((P.relevance(False, source, hits(a, z), z - a), source, a, z))
                    else:
                        short = True
    told = exact or partial
    if not told:
        return ("partial_below_threshold", 0.5, 0, 0, "", 0, 0) if short else None
    score, source, a, z = min(told, key=lambda t: (-t[0], t[1], -(t[3] - t[2]), t[2]))
    return f"{'exact' if exact else 'partial'}_{('title', 'distilled')[source]}", score, ws[a][1], ws[z - 1][2], text[ws[a][1] : ws[z - 1][2]], z - a, hits(a, z)


def some(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "the", "Omega", "sigma,", "of", "kappa."]) for _ in range(n))


def test_match_is_that_of_all_spans():
    states = set()
    for seed in range(150):
        text = some(seed, 14)
        phrases = [(tuple(w), s) for w, _, s in P.inventory(some(seed + 1000, 3), some(seed + 2000, 6))]
        got = P.match(text, phrases, 4)
        assert got == by_all_spans(text, phrases, 4)
        states.add(got and got[0])
    assert len(states) >= 4


def test_no_pair_is_lost(spark):
    sentences = [(i, some(i, 9)) for i in range(40)] + [(99, ""), (98, None)]
    destinations = [(i, some(i + 500, 2), some(i + 700, 5) if i % 3 else None) for i in range(15)] + [(77, None, None)]
    got = Q.matches(spark.createDataFrame(sentences, "sentence_id long, text string"), spark.createDataFrame(destinations, "destination long, title string, distilled string"))
    brute = {}
    for (i, t), (d, title, rest) in itertools.product(sentences, destinations):
        m = by_all_spans(t or "", [(tuple(w), s) for w, _, s in P.inventory(title, rest)], P.CONTEXT)
        if m:
            brute[i, d] = m
    assert {(r[0], r[1]): tuple(r)[2:] for r in got.collect()} == brute and brute


def test_title_anchor():
    assert P.title_anchor("We sell the red steel Widget today", "Red steel widget shop") == (12, 28, "red steel Widget", "strong")
    assert P.title_anchor("A widget and a gadget", "gadget or widget") == (2, 8, "widget", "weak")
    assert P.title_anchor("a cat", "cat") is None and P.title_anchor("", "x") is None


def test_long_sentences_cost_their_matching_places_only():
    """A sentence without breaks met many destinations: of its spans only those at shared words are looked at."""
    text = " ".join(f"{some(k, 40)} lone{k}" for k in range(200))
    phrases = [((f"here{k}", "alpha", "beta", "there"), k % 2) for k in range(20)]
    began = time.process_time()
    for _ in range(5):
        got = P.match(text, phrases)
    assert time.process_time() - began < 0.5
    short = some(3, 60)
    assert got[0] == "partial_below_threshold" and P.match(short, phrases) == by_all_spans(short, phrases, P.CONTEXT)


def test_a_pair_of_titles_is_told_once(spark, tmp_path):
    """Parts of the same title, brand and size share one call, and their pairs are those of a loop."""
    names = [("red bolt", "SMALL"), ("red bolt", "SMALL"), ("red ring", "LARGE"), (None, "SMALL"), ("a", None), ("red bolt", "SMALL")]
    parts = [(i, n, f"B{i % 2 if i < 18 else None}", i % 3 if i != 19 else None, t) for i, (n, t) in enumerate(names * 4)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["x37_title_anchor"](spark, str(tmp_path))
    title = lambda p: " ".join(x for x in (p[1], p[4]) if x is not None)
    brute = [(h[0], d[0], *(P.title_anchor(f"Our new {title(h)} is here", title(d)) or (None,) * 4)) for h in parts for d in parts if h[0] != d[0] and h[2:4] == d[2:4] and h[3] is not None]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, brute)) and len(brute) > 30
    asked = spark.createDataFrame([("red bolt", "red ring")] * 9 + [("red ring", "red bolt")], "host_title string, title string")
    assert Q.title_anchors(asked).count() == 2
