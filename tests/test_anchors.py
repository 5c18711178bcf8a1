"""Anchor families by keys and hubs against all pairs of variants."""

import random
import re
from collections import Counter, defaultdict

import pytest

from weftline.functions.text import STOPWORDS
from weftline.operators import anchors as A


def tokens(text):
    return tuple(w for w in re.findall("[a-z0-9]+(?:'[a-z0-9]+)?", (text or "").lower()) if w not in STOPWORDS)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def together(a, b):
    if a == b:
        return True
    shared = max((k for k in range(1, min(len(a), len(b)) + 1) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if a[i : i + k] == b[j : j + k]), default=0)
    s, t = sorted((a, b), key=len)
    return (shared >= 2 and shared / len(s) >= 0.6) or (len(t) == len(s) + 1 and s in (t[:-1], t[1:])) or (len(t) <= 2 and edits(" ".join(a), " ".join(b)) <= 1)


def all_pairs(rows):
    """destination to (usable, families in order): (share, sources, canonical, members by words)."""
    out = {}
    for d in {r[0] for r in rows}:
        sources, shown = defaultdict(set), defaultdict(Counter)
        for _, s, anchor in (r for r in rows if r[0] == d):
            w, raw = tokens(anchor), " ".join(re.findall("[a-z0-9]+(?:'[a-z0-9]+)?", (anchor or "").lower()))
            if w and " ".join(w) not in A.NOISE and raw not in A.NOISE:
                sources[w].add(s)
                shown[w][anchor.strip()] += 1
        usable = len(set().union(*sources.values())) if sources else 0
        place = {}
        for w in sources:
            text, n = min(shown[w].items(), key=lambda x: (-x[1], x[0].lower(), x[0]))
            place[w] = (-len(sources[w]), -len(w), -n, text.lower(), w), text
        left, groups = set(sources), []
        while left:
            group, todo = set(), [left.pop()]
            while todo:
                w = todo.pop()
                group.add(w)
                near = {x for x in left if together(w, x)}
                left -= near
                todo += near
            groups.append(group)
        told = []
        for g in groups:
            first = min(g, key=lambda w: place[w][0])
            held = set().union(*(sources[w] for w in g))
            told.append((-len(held), -len(first), place[first][1].lower(), place[first][1], first, {w: len(sources[w]) / usable for w in g}))
        out[d] = usable, sorted(told, key=lambda t: t[:3])[:8]
    return out


def verdict(words, sentence, usable, told, share=0.15):
    if not usable or not told:
        return "neutral_no_learned_anchor_data", 0.5
    if usable < 2:
        return "neutral_below_min_sources", 0.5
    if not words:
        return "neutral_no_anchor_candidate", 0.5
    rank = lambda f, w: (f[0], -f[5][w], f[2])
    lift = lambda f, match, own: 0.5 + 0.5 * min(1.0, 0.45 * match + 0.25 * -f[0] / usable + 0.15 * own + 0.15 * min(1.0, -f[0] / 5))
    exact = [(rank(f, words), f) for f in told if words in f[5]]
    if exact and -min(exact)[1][0] / usable >= share:
        f = min(exact)[1]
        return "exact_variant_match", lift(f, 1.0, f[5][words])
    near = [(rank(f, w), f) for f in told for w in f[5] if w != words and together(words, w)]
    if near and -min(near, key=lambda x: x[0])[1][0] / usable >= share:
        return "family_match", lift(min(near, key=lambda x: x[0])[1], 0.65, 0.0)
    s = tokens(sentence)
    if any(s[i : i + len(f[4])] == f[4] for f in told for i in range(len(s))):
        return "host_contains_canonical_variant", 0.5
    return "neutral_no_family_match", 0.5


WORDS = ["red", "reds", "blue", "steel", "cup", "cups", "cap", "tea", "pot", "the", "of"]


@pytest.mark.parametrize("seed", [1, 2])
def test_families_are_those_of_all_pairs(spark, seed):
    r = random.Random(seed)
    rows = [(r.randrange(6), r.randrange(12), " ".join(r.choice(WORDS) for _ in range(r.choice([1, 1, 2, 2, 3, 4, 5, 7]))).replace("tea", r.choice(["tea", "Tea"]))) for _ in range(160)]
    rows += [(7, 1, "click here"), (7, 2, "of the"), (7, 3, None), (8, 1, " Lone anchor "), (9, None, "red cup"), (None, 1, "red cup"), (5, 3, "Read More")]
    brute = all_pairs([x for x in rows if x[0] is not None and x[1] is not None])
    df = spark.createDataFrame(rows, "destination long, source long, anchor string")
    kept, members = A.families(df)
    got = defaultdict(list)
    for f in sorted(kept.collect(), key=lambda f: (f.destination, f["rank"])):
        own = {tuple(m.words) for m in members.where(f"destination = {f.destination} AND family = {f.family}").collect()} if f.destination in (0, 8) else None
        got[f.destination].append((f.sources, round(f.share, 9), f.canonical.lower()))
        if own is not None:
            assert own == set(brute[f.destination][1][f["rank"] - 1][5])
    expected = {d: [(-f[0], round(-f[0] / usable, 9), f[2]) for f in told] for d, (usable, told) in brute.items() if told}
    assert dict(got) == expected and any(len(f) == 8 for f in expected.values())
    asked = [(i, r.randrange(10), " ".join(r.choice(WORDS) for _ in range(r.choice([0, 1, 2, 3, 5]))), " ".join(r.choice(WORDS) for _ in range(8))) for i in range(120)]
    answers = A.corroborate(spark.createDataFrame(asked, "id long, destination long, anchor string, sentence string"), df)
    wanted = {i: verdict(tokens(a), s, *brute.get(d, (0, []))) for i, d, a, s in asked}
    assert {x.id: (x.state, round(x.score, 9)) for x in answers.collect()} == {i: (s, round(v, 9)) for i, (s, v) in wanted.items()}
    assert len({s for s, _ in wanted.values()}) >= 5


def test_hand_made_families(spark):
    rows = [(1, 1, "steel tea pot"), (1, 2, "tea pot"), (1, 3, "tea pots"), (1, 4, "garden"), (1, 5, "gardens"), (1, 6, "wide garden"), (1, 7, "click here")]
    kept, _ = A.families(spark.createDataFrame(rows, "destination long, source long, anchor string"))
    assert [(f.canonical, f.sources, f.n_variants) for f in kept.orderBy("rank").collect()] == [("steel tea pot", 3, 3), ("wide garden", 3, 3)]


def test_keys_are_never_broadcast(spark, tmp_path):
    """A table of keys is many times its file, so its file's size says nothing of the driver's memory; and keys of one text alone stay out of joins."""
    words = [["red", "cup"], ["red", "cups"], ["wide", "garden"]]
    spark.createDataFrame([(d, 10 * d + i, w) for d in range(5) for i, w in enumerate(words)], "destination long, id long, words array<string>").write.parquet(f"{tmp_path}/named")
    links = A.hub_links(spark.read.parquet(f"{tmp_path}/named"))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(map(tuple, links.collect())) == [(10 * d + 1, 10 * d) for d in range(5)]
    keyed = [f for f in links.inputFiles() if "/keyed-" in f]
    assert spark.read.parquet(*keyed).count() == 10  # two texts have one key in common
