"""Tuning from reviews: weights of the score under bounds, and the miscoverage level of conformal bands.

Weights are fitted by Newton steps whose sums (loss, gradient, curvature) are one aggregation each; only those few
numbers reach the driver. The conformal level is a fold over all reviews in order of time; a step clamps x + d to
bounds, and clamped shifts compose to clamped shifts, so blocks of rows are folded apart and then carried over.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.registry import query, tables
from weftline.plans.rounds import written
from weftline.plans.views import REVIEWS, TELEMETRY

#: Drift of a weight in one run, weight of the penalty on drift, slope and centre of quality, least rows.
DRIFT, PENALTY, SLOPE, CENTRE, LEAST_ROWS = 0.05, 0.1, 15.0, 0.7, 50
#: Fixed values of the conformal level: target, rate, window, bounds.
TARGET, RATE, MEMORY, LEAST_LEVEL, MOST_LEVEL = 0.10, 0.005, 500, 0.01, 0.50
#: Rows, or folded blocks, in one group of a fold in order.
BLOCK = 4096


def projected(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The nearest point with low <= w <= high and a sum of 1, by bisection on the shift of all."""
    a, b = float((v - high).min()), float((v - low).max())
    for _ in range(200):
        m = (a + b) / 2
        a, b = (m, b) if np.clip(v - m, low, high).sum() > 1 else (a, m)
    return np.clip(v - (a + b) / 2, low, high)


@dataclass
class Tuned:
    """The outcome of a run; changed is false where no weight moves by more than a thousandth, or rows are too few."""

    names: list[str]
    baseline: np.ndarray
    candidate: np.ndarray
    rows: int
    baseline_loss: float
    candidate_loss: float
    changed: bool


def tune(reviews: DataFrame, baseline: dict[str, float], drift: float = DRIFT, rounds: int = 30) -> Tuned:
    """Weights near the baseline under which approved reviews score above rejected ones.

    reviews: approved (boolean), final (score), and a column for each name of the baseline. The rest of a final score,
    beyond the named components, stays as it is. Rows without a verdict don't count; a null component or score is 0.
    Loss: mean cross-entropy of sigmoid(SLOPE * (score - CENTRE)), and PENALTY times the squared drift.
    """
    names = list(baseline)
    w0 = np.array([float(baseline[n]) for n in names])
    if (w0 < 0).any() or not w0.sum() > 0:
        raise ValueError("baseline weights must be 0 or more, and not all 0")
    w0 = w0 / w0.sum()
    low, high = np.maximum(0, w0 - drift), np.minimum(1, w0 + drift)
    x = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]
    dot = lambda w: sum((c * float(k) for c, k in zip(x, w)), F.lit(0.0))
    y = F.col("approved").cast("double")
    rows = reviews.where("approved IS NOT NULL").select(y.alias("y"), (F.coalesce(F.col("final").cast("double"), F.lit(0.0)) - dot(w0)).alias("rest"), *(c.alias(f"x{k}") for k, c in enumerate(x)))
    rows = written(rows, "reviews")  # read in every round
    x = [F.col(f"x{k}") for k in range(len(names))]

    def logit(w: np.ndarray) -> Column:
        return SLOPE * (dot(w) + F.col("rest") - CENTRE)

    def loss(w: np.ndarray) -> Column:
        z = logit(w)  # log(1 + exp(z)) - y z, without overflow
        return F.avg(F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("y") * z)

    def penalty(w: np.ndarray) -> float:
        return PENALTY * float(((w - w0) ** 2).sum())

    n, at = rows.agg(F.count("*"), loss(w0)).first()
    if n < LEAST_ROWS:
        return Tuned(names, w0, w0, n, at or 0.0, at or 0.0, False)
    w, started = w0, at
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-logit(w)))
        slope = [F.avg((p - F.col("y")) * c) * SLOPE for c in x]
        bend = [F.avg(p * (1 - p) * a * b) * SLOPE**2 for i, a in enumerate(x) for b in x[: i + 1]]
        got = np.array(rows.agg(*slope, *bend).first(), float)
        k = len(names)
        g = got[:k] + 2 * PENALTY * (w - w0)
        h = np.zeros((k, k))
        h[np.tril_indices(k)] = got[k:]
        h = h + np.tril(h, -1).T + 2 * PENALTY * np.eye(k)
        step, rate = w, 1 / np.linalg.eigvalsh(h)[-1]
        for _ in range(5000):  # the least of the quadratic within the bounds
            new = projected(step - rate * (g + h @ (step - w)), low, high)
            if np.abs(new - step).max() < 1e-12:
                break
            step = new
        tries = [w + (step - w) / 2**j for j in range(12)]
        told = np.array(rows.agg(*(loss(t) for t in tries)).first(), float) + [penalty(t) for t in tries]
        best = int(told.argmin())
        if told[best] >= at - 1e-12:
            break
        w, at = tries[best], float(told[best])
    return Tuned(names, w0, w, n, float(started), at, bool(np.abs(w - w0).max() > 1e-3))


def in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with position, from 0, by the keys (unique together): ranges are sorted apart, one count of each is added up."""
    parts = written(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "parts")
    counts = sorted(parts.groupBy("part").count().collect())  # one row for each range
    starts, at = [], 0
    for part, n in counts:
        starts.append((part, at))
        at += n
    starts = rows.sparkSession.createDataFrame(starts, "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*keys)) - 1
    return parts.withColumn("place", place).join(F.broadcast(starts), "part").withColumn("position", F.col("before") + F.col("place")).drop("part", "place", "before")


def trailing_mean(ordered: DataFrame, value: str, size: int = MEMORY, block: int = BLOCK) -> DataFrame:
    """ordered (with position) with seen and mean of the last size values: blocks, each with the end of the one before."""
    if size > block:
        raise ValueError("a window can't be longer than a block")
    own = ordered.withColumn("block", F.floor(F.col("position") / block)).withColumn("own", F.lit(True))
    lent = own.where(F.col("position") % block >= block - size + 1).withColumn("block", F.col("block") + 1).withColumn("own", F.lit(False))
    last = Window.partitionBy("block").orderBy("position").rowsBetween(1 - size, 0)
    told = own.unionByName(lent).withColumn("seen", F.count("*").over(last)).withColumn("mean", F.avg(value).over(last))
    return told.where("own").drop("own")


def _joined(d: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[float, float, float]:
    """One clamped shift for several in a row: x -> min(high, max(low, x + d))."""
    shift, least, most = 0.0, -np.inf, np.inf
    for a, b, c in zip(d, low, high):
        shift, least, most = shift + a, min(c, max(b, least + a)), min(c, max(b, most + a))
    return shift, least, most


def started(folds: DataFrame, first: float, block: int = BLOCK) -> DataFrame:
    """block and start: the value with which every block of folds (block, d, low, high) begins; group by group."""
    schema = "block long, start double"

    def run(start: float, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        out = []
        for d, low, high in zip(pdf["d"], pdf["low"], pdf["high"]):
            out.append(start)
            start = min(high, max(low, start + d))
        return pd.DataFrame({"block": pdf["block"].astype("int64"), "start": np.array(out, float)})

    if folds.count() <= block:
        return folds.groupBy(F.lit(0).alias("all")).applyInPandas(lambda pdf: run(first, pdf), schema)
    grouped = folds.withColumn("group", F.floor(F.col("block") / block))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        return pd.DataFrame([(pdf["group"].iloc[0], *_joined(pdf["d"], pdf["low"], pdf["high"]))], columns=["block", "d", "low", "high"])

    above = started(written(grouped.groupBy("group").applyInPandas(fold, "block long, d double, low double, high double"), "folds"), first, block)
    both = grouped.join(above.select(F.col("block").alias("group"), F.col("start").alias("given")), "group")
    return both.groupBy("group").applyInPandas(lambda pdf: run(float(pdf["given"].iloc[0]), pdf), schema)


def adaptive_level(outcomes: DataFrame, at: str, key: str, missed: str, target: float = TARGET, rate: float = RATE, memory: int = MEMORY, low: float = LEAST_LEVEL, high: float = MOST_LEVEL, block: int = BLOCK) -> DataFrame:
    """key, position, miscoverage and level after every outcome in order of at and key.

    Once half the memory is filled, level += rate * (miscoverage of the last memory outcomes - target), within low and
    high; until then it is the target. Outcomes without a verdict (missed null), time or key don't count. Keys are unique.
    """
    rows = outcomes.select(F.col(at).alias("at"), F.col(key).alias("key"), F.col(missed).cast("double").alias("missed")).dropna()
    told = trailing_mean(in_order(rows, "at", "key"), "missed", memory, block)
    moves = F.when(F.col("seen") >= max(1, memory // 2), rate * (F.col("mean") - target))
    told = written(told.select("key", "position", "block", F.col("mean").alias("miscoverage"), moves.alias("d")), "moves")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values("position")["d"].dropna()
        return pd.DataFrame([(pdf["block"].iloc[0], *_joined(d, np.full(len(d), low), np.full(len(d), high)))], columns=["block", "d", "low", "high"])

    folds = written(told.groupBy("block").applyInPandas(fold, "block long, d double, low double, high double"), "folds")
    starts = started(folds, target, block).withColumnRenamed("block", "of")

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        level, out = float(pdf["start"].iloc[0]), []
        for d in pdf["d"]:
            if d == d:
                level = min(high, max(low, level + d))
            out.append(level)
        return pd.DataFrame({"key": pdf["key"], "position": pdf["position"], "miscoverage": pdf["miscoverage"], "level": np.array(out, float)})

    kind = rows.schema["key"].dataType.simpleString()
    return told.join(starts, told["block"] == starts["of"]).drop("of").groupBy("block").applyInPandas(follow, f"key {kind}, position long, miscoverage double, level double")


_verdicts = f"WITH {REVIEWS} SELECT suggestion, reviewed_at, CASE WHEN status = 'approved' THEN 0 ELSE 1 END AS missed FROM reviews WHERE status <> 'pending'"


@query("r31_coverage_drift", f"SELECT suggestion, ROUND(AVG(CAST(missed AS DOUBLE)) OVER (ORDER BY reviewed_at, suggestion ROWS BETWEEN 499 PRECEDING AND CURRENT ROW), 6) AS miscoverage FROM ({_verdicts}) m")
def r31_drift(spark, sf_dir):
    """The share of rejected ones among the last 500 verdicts, after every verdict."""
    tables(spark, sf_dir)
    told = trailing_mean(in_order(spark.sql(_verdicts), "reviewed_at", "suggestion"), "missed")
    return told.select("suggestion", F.round("mean", 6).alias("miscoverage"))


@query("r31_adaptive_level")
def r31(spark, sf_dir):
    """The conformal level after every verdict; a rejected suggestion counts as missed."""
    tables(spark, sf_dir)
    return adaptive_level(spark.sql(_verdicts), "reviewed_at", "suggestion", "missed").select(F.col("key").alias("suggestion"), "position", F.round("level", 9).alias("level"))


@query("r35_weight_tuning")
def r35(spark, sf_dir):
    """Four weights tuned on all verdicts; components are rates of the destination and shares of scores."""
    tables(spark, sf_dir)
    rows = spark.sql(f"""WITH {REVIEWS}, {TELEMETRY}, t AS (SELECT user_id, SUM(clicks) / SUM(sessions) AS keyword, SUM(conversions) / SUM(sessions) AS quality FROM telemetry GROUP BY user_id), m AS (SELECT MAX(score) AS most FROM reviews)
    SELECT status = 'approved' AS approved, score / most AS semantic, keyword, CASE WHEN c.c_nationkey = d.c_nationkey THEN 1.0 ELSE 0.3 END AS node, quality FROM reviews LEFT JOIN t ON user_id = destination LEFT JOIN customer c ON c.c_custkey = host LEFT JOIN customer d ON d.c_custkey = destination, m WHERE status <> 'pending'""")
    baseline = {"semantic": 0.40, "keyword": 0.25, "node": 0.20, "quality": 0.15}
    final = sum((F.coalesce(F.col(n), F.lit(0.0)) * w for n, w in baseline.items()), F.lit(0.3))
    found = tune(rows.withColumn("final", final), baseline)
    return spark.createDataFrame([(n, round(float(a), 4), round(float(b), 4)) for n, a, b in zip(found.names, found.baseline, found.candidate)], "name string, baseline double, candidate double")
