"""Random walks: shares of steps against the exact law, whole walks, odd edges; vectors of nodes."""

from collections import Counter
from math import sqrt

import numpy as np

from weftline.operators import walks

EDGES = [(1, 2, 4.0), (2, 3, 1.0), (3, 1, 0.3), (3, 4, 9.0), (4, 5, 1.0), (2, 4, 2.5), (1, 6, 1.0), (6, 6, 2.0)] + [(1, k, 1.0 + k % 3) for k in range(20, 60)]
P, Q = 0.5, 2.0


def law(prev, cur):
    """The share of every next node, told from the definition."""
    w = Counter()
    for a, b, x in EDGES:
        w[a, b] += x
        if a != b:
            w[b, a] += x
    near = {b: x for (a, b), x in w.items() if a == cur}
    if prev is not None:
        near = {x: v * (1 / P if x == prev else 1 if (prev, x) in w else 1 / Q) for x, v in near.items()}
    total = sum(near.values())
    return {x: v / total for x, v in near.items()}


def test_steps_follow_the_law(spark):
    links = spark.createDataFrame(EDGES, "src long, dst long, w double")
    rows = walks.random_walks(links, walks=100, length=8, p=P, q=Q, seed=7).collect()
    nodes = {n for e in EDGES for n in e[:2]}
    assert len(rows) == 100 * len(nodes) and all(len(r.path) == 8 and r.path[0] == r.start for r in rows)
    seen = Counter()
    for r in rows:
        for k in range(1, 8):
            seen[(r.path[k - 2] if k > 1 else None, r.path[k - 1]), r.path[k]] += 1
    asked = Counter()
    for (state, _), n in seen.items():
        asked[state] += n
    far = checked = 0
    for state, n in asked.items():
        exact = law(*state)
        assert {x for (s, x) in seen if s == state} <= set(exact)
        for x, share in exact.items():
            if n * share >= 10:
                checked += 1
                far += abs(seen[state, x] - n * share) > 3 * sqrt(n * share * (1 - share) + 1e-9) + 1
    assert checked > 50 and far <= 0.02 * checked


def test_walks_repeat_and_take_odd_edges(spark):
    odd = spark.createDataFrame([(1, 2, None, "x"), (1, 2, None, "x"), (None, 2, 1.0, "y"), (3, None, 1.0, "y"), (4, 5, 0.0, "z"), (6, 7, -1.0, "z"), (8, 9, 1e-300, "z"), (8, 10, 1e300, "z"), (11, 11, 1.0, "z")], "src long, dst long, w double, walk string")
    once, again = (sorted((r.start, r.walk, tuple(r.path)) for r in walks.random_walks(odd, walks=2, length=5).collect()) for _ in range(2))
    assert once == again and {s for s, _, _ in once} == {1, 2, 8, 9, 10, 11}
    assert (11, 0, (11,) * 5) in once and (1, 1, (1, 2, 1, 2, 1)) in once and (9, 0, (9, 8, 10, 8, 10)) in once
    assert {len(r.path) for r in walks.random_walks(odd.drop("w"), walks=1, length=1).collect()} == {1}


def test_no_edges(spark, tmp_path):
    spark.createDataFrame([], "src long, dst long, w double").write.parquet(str(tmp_path / "none"))
    none = spark.read.parquet(str(tmp_path / "none"))
    assert walks.random_walks(none).count() == 0 and walks.node_vectors(none).count() == 0


def test_vectors_tell_groups_apart(spark):
    groups = [(a, b) for g in (0, 100) for a in range(g, g + 8) for b in range(a + 1, g + 8)] + [(0, 100)]
    walked = walks.random_walks(spark.createDataFrame(groups, "src long, dst long"), walks=20, length=20)
    for found in (walks.by_skip_gram(walked, dimension=16), walks.by_projection(walked, dimension=64, window=5)):
        v = {r.node: np.array(r.vector) / np.linalg.norm(r.vector) for r in found.collect()}
        assert len(v) == 16
        same = np.mean([v[a] @ v[b] for a in v for b in v if a < b and (a < 100) == (b < 100)])
        other = np.mean([v[a] @ v[b] for a in v for b in v if a < 100 <= b])
        assert same > other + 0.1, (same, other)


def test_rounds_read_edges_where_they_lie(spark, monkeypatch):
    """Every round makes several draws for each walk, and shuffles no edges; the tables are gone in the end."""
    plans, made, step, table = [], [], walks.advance, walks.bucketed

    def seen(*args):
        plans.append(step(*args))
        return plans[-1]

    def kept(*args):
        made.append(table(*args))
        return made[-1]

    monkeypatch.setattr(walks, "advance", seen)
    monkeypatch.setattr(walks, "bucketed", kept)
    rows = walks.random_walks(spark.createDataFrame(EDGES, "src long, dst long, w double"), walks=2, length=4, p=P, q=Q).collect()
    assert all(len(r.path) == 4 for r in rows) and len(plans) <= 6
    text = plans[1]._jdf.queryExecution().executedPlan().toString()
    assert text.count("Bucketed: true") == 2 and text.count("ShuffledHashJoin") == 2
    assert len(made) == 2 and not any(t.name.startswith(("steps_", "known_")) for t in spark.catalog.listTables())
