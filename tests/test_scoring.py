"""The second stage, guards and the composite score against plain loops."""

import numpy as np
import pytest

from weftline.operators import scoring


def test_best_sentences(spark):
    rng = np.random.default_rng(5)
    vecs = {s: [float(x) for x in rng.integers(-3, 4, 4)] for s in range(120)}
    vecs.update({7: [0.0] * 4, 8: None, 9: [1.0, 2.0]})
    sentences = spark.createDataFrame([(s, s % 6 if s % 11 else None, v, "extra") for s, v in vecs.items()], "sentence long, host long, vec array<double>, wanted string")
    wanted = {d: [float(x) for x in rng.integers(-3, 4, 4)] for d in range(5)} | {5: None}
    destinations = spark.createDataFrame(list(wanted.items()), "destination long, vec array<double>")
    asked = [(d, h) for d in range(7) for h in range(0, 7, 1 + d % 2)] * 2 + [(None, 1), (1, None)]
    candidates = spark.createDataFrame(asked, "destination long, host long")
    got = {}
    for r in scoring.best_sentences(candidates, sentences, destinations, 6).collect():
        got.setdefault(r.destination, []).append((r.semantic, r.sentence))
    assert set(got) == set(range(5))
    for d in range(5):
        all_of = []
        for s, v in vecs.items():
            if s % 11 and v is not None and len(v) == 4 and (d, s % 6) in asked:
                a, b = np.array(v), np.array(wanted[d])
                n = np.linalg.norm(a) * np.linalg.norm(b)
                all_of.append((round(float(a @ b / n), 9) if n else 0.0, s))
        best = sorted(all_of, key=lambda x: (-x[0], x[1]))[:6]
        assert sorted(got[d], key=lambda x: (-x[0], x[1])) == [(pytest.approx(x, abs=2e-9), s) for x, s in best]
    assert scoring.best_sentences(candidates.limit(0), sentences, destinations).count() == 0


def test_guards_in_order(spark):
    rows = [(1, 2, 10, 0.9, 50, 1, 1), (1, 2, 11, 0.1, 50, 1, 1), (2, 2, 12, 0.9, 50, 1, 1), (1, 3, 13, 0.9, 50, 1, 1), (1, 4, 14, 0.9, 50, 1, 1), (1, 5, 15, 0.9, 50, 1, 2), (1, 6, 16, 0.9, 5, 1, 1), (1, 6, 17, None, 50, 1, 1), (1, 7, 18, 0.9, None, None, 1)]
    matches = spark.createDataFrame(rows, "destination long, host long, sentence long, semantic double, chars long, host_silo long, destination_silo long")
    links = spark.createDataFrame([(3, 1), (3, 1), (4, 7), (4, 8), (4, 9), (None, 1)], "host long, destination long")
    kept, gone = scoring.guarded(matches, links, strict=True)
    assert {r.sentence for r in kept.collect()} == {10, 18} and kept.columns == matches.columns
    assert {r.sentence: r.reason for r in gone.collect()} == {11: "low_semantic", 12: "self_link", 13: "already_linked", 14: "max_links_reached", 15: "cross_silo_blocked", 16: "sentence_length", 17: "low_semantic"}
    kept, gone = scoring.guarded(matches.select("destination", "host", "sentence", "semantic"))
    assert kept.count() == 6 and gone.count() == 3


def test_composite(spark):
    rng = np.random.default_rng(3)
    names = list(scoring.COMPONENTS)
    values = rng.uniform(-1, 1, (40, 16)).round(6)
    rows = [(i, *map(float, v)) for i, v in enumerate(values)] + [(40, *[None] * 16)]
    df = spark.createDataFrame(rows, "id int, silo double, " + ", ".join(f"{n} double" for n in names))
    weights = {n: round(0.01 * k, 2) for k, n in enumerate(names)}
    got = {r.id: r.f for r in df.select("id", scoring.composite(df.columns, weights).alias("f")).collect()}
    for i, v in enumerate(values.astype(np.float32)):
        total = float(v[0])
        for x, n in zip(v[1:], names):
            total += float(x) * float(np.float32(weights[n]))
        assert got[i] == float(np.float32(total))
    assert got[40] == 0.0
    few = df.select("id", "semantic")
    assert few.select(scoring.composite(few.columns).alias("f")).first().f == pytest.approx(0.4 * values[0][1], rel=1e-6)
    with pytest.raises(ValueError):
        scoring.composite(few.columns, {"other": 1.0})
