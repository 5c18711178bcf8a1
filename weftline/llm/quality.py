"""Quality classification by co-training of two views.

One classifier sees a text's content only, the other the page's metadata only (source, language, length). Each is
fitted on labelled rows; over some rounds each labels the unlabelled rows it is surest of for the other one to learn
from. Both are then calibrated on labelled rows that neither learned from, and their calibrated log-odds, less the
prior that both contain, add up to the score of every document.

The models start from a bounded sample of labelled rows (LABELLED, of the least hashes of doc_id). In each round every
unlabelled document is scored where it is read, and each view hands over the HANDED documents it is surest of among
all of them; documents alike in both views count as one. Equal certainties go by the hash of the features. Every
document is scored in the end. A null text has the features of an empty one, null metadata is a value of its own. With
no label, or one class only, every document scores the share of good labels (1 without any) and is kept. An empty
table gives no rows; repeated rows are scored each; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import common

#: Labelled rows the models start from at most.
LABELLED = 4000
#: Rounds of co-training, pseudo-labels a view hands over in each at most and how sure it must be.
ROUNDS, HANDED, SURE = 4, 320, 0.9
THRESHOLD = 0.5
CONTENT, META = 1024, 160


def content_features(text: str) -> np.ndarray:
    """Square roots of hashed byte-pair shares, and four measures of shape and repetition."""
    b = np.frombuffer(text.encode(), np.uint8).astype(np.int64)
    out = np.zeros(CONTENT + 4, np.float32)
    if len(b) > 1:
        pairs = np.bincount((b[:-1] * 181 + b[1:] * 37) % CONTENT, minlength=CONTENT)
        out[:CONTENT] = np.sqrt(pairs / (len(b) - 1))
    words, lines = text.split(), text.split("\n")
    if words:
        out[CONTENT:] = len(set(words)) / len(words), min(1.0, len(words) / max(1, len(text)) * 4), 1 - len(set(lines)) / len(lines), min(1.0, np.log1p(len(words)) / 12)
    return out


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """One of 128 for the source, one of 16 for the language, one of 16 for the length."""
    out = np.zeros(META, np.float32)
    out[zlib.crc32(repr(source).encode()) % 128] = 1
    out[128 + zlib.crc32(repr(lang).encode()) % 16] = 1
    out[144 + (15 if n_chars is None or n_chars < 0 else min(14, int(np.log2(1 + n_chars))))] = 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge-penalised logistic regression, both classes weighing the same."""
    x = np.column_stack((x, np.ones(len(x), np.float32))).astype(np.float64)
    side = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    rate = 1 / (0.25 * np.max(np.sum(x * x, axis=1)) + decay)
    w = ahead = np.zeros(x.shape[1])
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -40, 40)))
        new = ahead - rate * (x.T @ (side * (p - y)) + decay * ahead * 1e-2)
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


def logits(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) of Platt scaling, log-odds a * z + b, fitted by Newton steps on smoothed targets."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    m = np.column_stack((z, np.ones(len(z))))
    c = np.array([0.0, np.log((y.sum() + 1) / (len(y) - y.sum() + 1))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(m @ c, -40, 40)))
        h = (m * (p * (1 - p))[:, None]).T @ m + 1e-3 * np.eye(2)
        c = c - np.linalg.solve(h, m.T @ (p - t) + 1e-3 * np.array([c[0], 0.0]))
    return max(0.0, float(c[0])), float(c[1])


#: A pseudo-label: the view that is sure of it, the label, the content features and the metadata features.
Handed = tuple[int, int, np.ndarray, np.ndarray]


def co_train(content: np.ndarray, meta: np.ndarray, y: np.ndarray, surest: Callable[[dict, float], list[Handed]], rounds: int = ROUNDS) -> dict | None:
    """Both views' weights and calibration from labelled rows (y 1 or 0) and the pseudo-labels of surest(model, share of good rows).

    What a view is sure of is learned by the other one. Every fourth labelled row is held back for the calibration.
    """
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        return None
    views, good = (content, meta), float((y == 1).mean())
    pools = [(x[~held], y[~held]) for x in views]

    def fitted() -> dict:
        w = [fit_logistic(*pool) for pool in pools]
        return {"weights": w, "scale": [calibrate(logits(w[v], views[v][held]), y[held]) for v in (0, 1)], "prior": float(np.log(good / (1 - good)))}

    model = fitted()
    for _ in range(rounds):
        handed = surest(model, float((y[~held] == 1).mean()))
        if not handed:
            break
        for view, label, *x in handed:
            rows, labels = pools[1 - view]
            pools[1 - view] = np.vstack((rows, x[1 - view])), np.append(labels, label)
        model = fitted()
    return model


def score(model: dict, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content view, metadata view, both) probabilities of good quality."""
    z = [a * logits(w, x) + b for w, (a, b), x in zip(model["weights"], model["scale"], (content, meta))]
    return tuple(1 / (1 + np.exp(-np.clip(s, -40, 40))) for s in (z[0], z[1], z[0] + z[1] - model["prior"]))


def columns(docs: DataFrame) -> DataFrame:
    """The columns the views read; a missing one is null."""
    common.small_batches(docs.sparkSession)
    get = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), get("source", "string"), get("lang", "string"), get("n_chars", "long"))


def _features(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text, source, lang, n = (b.column(c).to_pylist() if c in b.schema.names else [None] * b.num_rows for c in ("text", "source", "lang", "n_chars"))
    return np.array([content_features(t or "") for t in text]).reshape(-1, CONTENT + 4), np.array([meta_features(*r) for r in zip(source, lang, n)]).reshape(-1, META)


def sample(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content features, metadata features and labels of a bounded sample of labelled rows, in an order by hashes."""
    ids = docs.select("doc_id").distinct().join(labels, "doc_id")
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)

    @common.task("quality")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array([r.tobytes() for r in half(*_features(b))], pa.binary())], ["doc_id", "y", "x"])

    # a broadcast of labelled ids at most
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text", "source", "lang", "n_chars").mapInArrow(run, "doc_id long, y int, x binary")
    found = sorted(((r.doc_id, r.y, bytes(r.x)) for r in rows.orderBy(F.xxhash64("doc_id"), "x").limit(labelled).collect()), key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
    return *whole([r[2] for r in found]), np.array([r[1] for r in found], np.int64)


def half(content: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """Both views' features side by side, as they are kept."""
    return np.column_stack((content, meta)).astype(np.float16)


def whole(kept: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.array([np.frombuffer(k, np.float16) for k in kept], np.float32).reshape(-1, CONTENT + 4 + META)
    return x[:, : CONTENT + 4], x[:, CONTENT + 4 :]


def key_of(features: bytes) -> int:
    """64 bits of a row's features; rows alike in both views share it."""
    return int.from_bytes(hashlib.blake2b(features, digest_size=8).digest(), "little", signed=True)


def surest_rows(docs: DataFrame, labels: DataFrame, model: dict, good: float, used: set[int], handed: int = HANDED) -> list[tuple[int, int, int, bytes]]:
    """(view, label, key, features) of the rows that each view is surest of, among all unlabelled documents but those used.

    Scores of what a view is sure of, 40 bytes a row, are joined with the labels and grouped by their features' key; no
    text is shuffled. Each task passes on handed rows of a view and label at most, so does the driver get no more.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model, used))

    @common.task("quality")
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, used = sent.value
        for b in batches:
            content, meta = whole([r.tobytes() for r in half(*_features(b))])
            p = [np.round(x, 6) for x in score(model, content, meta)[:2]]
            near = np.flatnonzero(np.maximum(np.abs(p[0] - 0.5), np.abs(p[1] - 0.5)) >= SURE - 0.5)
            keys = np.array([key_of(r.tobytes()) for r in half(content[near], meta[near])], np.int64)
            fresh = np.array([k not in used for k in keys.tolist()], bool)
            near, keys = near[fresh], keys[fresh]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(near)), pa.array(keys), pa.array(p[0][near]), pa.array(p[1][near])], ["doc_id", "key", "content", "meta"])

    rows = docs.mapInArrow(scored, "doc_id long, key long, content double, meta double").join(labels, "doc_id", "left_anti")
    votes = F.array(*(F.struct(F.lit(v).alias("view"), F.lit(label).alias("label"), (F.col(c) if label else 1 - F.col(c)).alias("sure")) for v, c in enumerate(("content", "meta")) for label in (1, 0)))
    votes = rows.select("doc_id", "key", F.explode(votes).alias("vote")).select("doc_id", "key", "vote.*").where(F.col("sure") >= SURE)
    one = votes.groupBy("view", "label", "key").agg(F.max("sure").alias("sure"), F.min("doc_id").alias("doc_id"))
    quota = F.when(F.col("label") == 1, max(1, round(handed * good))).otherwise(max(1, round(handed * (1 - good))))
    place = F.row_number().over(Window.partitionBy("view", "label").orderBy(F.desc("sure"), "key"))
    top = one.withColumn("place", place).where(f"place <= {handed}").where(F.col("place") <= quota).collect()
    if not top:
        return []
    wanted: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(top, key=lambda r: (r.view, r.label, r.place)):
        wanted.setdefault(r.key, []).append((r.view, r.label))
    ids = docs.sparkSession.createDataFrame(sorted({(r.doc_id,) for r in top}), "doc_id long")
    asked = docs.sparkSession.sparkContext.broadcast(set(wanted))

    @common.task("quality")
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [r.tobytes() for r in half(*_features(b))]
            keys = [key_of(r) for r in x]
            at = [i for i, k in enumerate(keys) if k in asked.value]
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in at], pa.int64()), pa.array([x[i] for i in at], pa.binary())], ["key", "x"])

    # a broadcast of four times handed ids at most
    found = docs.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(features, "key long, x binary").groupBy("key").agg(F.first("x").alias("x"))
    x = {r.key: bytes(r.x) for r in found.collect()}
    return [(view, label, k, x[k]) for k, sides in wanted.items() for view, label in sides]


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, handed: int = HANDED) -> tuple[dict | None, float]:
    """(model, share of good labels); only features of bounded numbers of rows reach the driver."""
    docs = columns(docs)
    told = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    content, meta, y = sample(docs, told, labelled)
    if not len(y):
        return None, 1.0
    used: set[int] = set()

    def surest(model: dict, good: float) -> list[Handed]:
        rows = surest_rows(docs, told.select("doc_id"), model, good, used, handed)
        used.update(key for _, _, key, _ in rows)
        return [(view, label, *(x[0] for x in whole([kept]))) for view, label, _, kept in rows]

    return co_train(content, meta, y, surest), float((y == 1).mean())


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, content_score, meta_score, score and keep (score >= threshold) of every document."""
    model, share = learn(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @common.task("quality")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if sent.value is None:
                p = [np.full(b.num_rows, share)] * 3
            else:
                p = score(sent.value, *_features(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x.astype(np.float64)) for x in p)], ["doc_id", "content_score", "meta_score", "score"])

    scored = columns(docs).mapInArrow(run, "doc_id long, content_score double, meta_score double, score double")
    return scored.withColumn("keep", (F.col("score") >= threshold) if model else F.lit(True))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score below the threshold."""
    model, _ = learn(docs, labels)
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def prepare():
        common.enter("quality")
        return lambda b: (score(sent.value, *_features(b))[2] >= threshold).tolist()

    return common.keep_rows(docs, prepare)
