"""Weights against a search of the whole feasible set, the conformal level against a plain loop."""

from collections import deque

import numpy as np
import pytest

from weftline.operators import tuning


def plain_levels(missed, memory, rate):
    window, level, out = deque(maxlen=memory), tuning.TARGET, []
    for m in missed:
        window.append(m)
        if len(window) >= max(1, memory // 2):
            level = max(tuning.LEAST_LEVEL, min(tuning.MOST_LEVEL, level + rate * (np.mean(window) - tuning.TARGET)))
        out.append(level)
    return out


@pytest.mark.parametrize("n,memory,block,rate", [(700, 20, 32, 0.05), (5, 20, 32, 0.05), (9000, 500, 512, 0.005)])
def test_level_is_the_fold(spark, n, memory, block, rate):
    rng = np.random.default_rng(n)
    odds = np.repeat(rng.uniform(0, 0.4, n // 50 + 1) * (rng.random(n // 50 + 1) < 0.7), 50)[:n]
    missed = (rng.random(n) < odds).astype(int)
    rows = [(k // 3, k, int(m), 9) for k, m in enumerate(missed)] + [(1, -1, None, 9), (None, -2, 1, 9)]
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(None if x is None else int(x) for x in r) for r in rows], "at int, key long, missed int, block int").repartition(7)
    got = sorted(tuning.adaptive_level(df, "at", "key", "missed", rate=rate, memory=memory, block=block).collect(), key=lambda r: r.position)
    assert [r.key for r in got] == list(range(n)) and [r.position for r in got] == list(range(n))
    assert np.allclose([r.level for r in got], plain_levels(missed, memory, rate), atol=1e-12)


def test_folds_of_folds(spark):
    rng = np.random.default_rng(2)
    d, level, starts = rng.normal(0, 0.2, 100), 0.1, []
    for x in d:
        starts.append(level)
        level = min(0.5, max(0.01, level + x))
    folds = spark.createDataFrame([(k, float(x), 0.01, 0.5) for k, x in enumerate(d)], "block long, d double, low double, high double")
    got = {r.block: r.start for r in tuning.started(folds, 0.1, block=4).collect()}
    assert np.allclose([got[k] for k in range(100)], starts, atol=1e-12)


def test_no_outcomes(spark, tmp_path):
    spark.createDataFrame([], "at int, key long, missed int").write.parquet(str(tmp_path / "none"))
    assert tuning.adaptive_level(spark.read.parquet(str(tmp_path / "none")), "at", "key", "missed").count() == 0


def test_weights(spark):
    rng = np.random.default_rng(8)
    base = {"a": 0.40, "b": 0.25, "c": 0.20, "d": 0.15}
    w0 = np.array(list(base.values()))
    x = rng.random((600, 4))
    y = rng.random(600) < 1 / (1 + np.exp(-6 * (x @ [0.1, 0.7, 0.0, 0.2] - 0.5)))
    final = x @ w0 + 0.2
    rows = [(bool(t), float(f), *map(float, v)) for t, f, v in zip(y, final, x)] + [(None, 0.5, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "approved boolean, final double, a double, b double, c double, d double")
    got = tuning.tune(df, base)

    def loss(w):
        p = 1 / (1 + np.exp(-tuning.SLOPE * (x @ w + final - x @ w0 - tuning.CENTRE)))
        return -np.mean(np.where(y, np.log(p), np.log(1 - p))) + tuning.PENALTY * ((w - w0) ** 2).sum()

    assert got.rows == 600 and got.changed and abs(got.candidate.sum() - 1) < 1e-9 and (np.abs(got.candidate - w0) <= tuning.DRIFT + 1e-9).all()
    assert abs(got.candidate_loss - loss(got.candidate)) < 1e-9 and abs(got.baseline_loss - loss(w0)) < 1e-9
    grid = np.linspace(-0.05, 0.05, 21)
    best = min(loss(w0 + np.array([i, j, k, -i - j - k])) for i in grid for j in grid for k in grid if abs(i + j + k) <= 0.05 + 1e-12)
    assert got.candidate_loss <= best + 1e-9
    few = tuning.tune(df.limit(20), base)
    assert not few.changed and few.candidate.tolist() == few.baseline.tolist()
    none = tuning.tune(df.where("approved IS NULL"), base)
    assert none.rows == 0 and not none.changed
