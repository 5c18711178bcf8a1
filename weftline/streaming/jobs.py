"""Streams: deduplication, daily rollups, sessions; each has a batch form among the queries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.registry import load, query


def dedupe(events: DataFrame, key: str, ts: str = "ts", lateness: str = "1 day") -> DataFrame:
    """The first event of every key; state is dropped as the watermark passes."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def daily_rollup(events: DataFrame, lateness: str = "3 days") -> DataFrame:
    """Events by day and kind; late ones restate their day until the watermark has passed it."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events")).select("user_id", F.col("s.start").alias("opened"), "events")


def fold_minute(ts: list, open_for=pd.Timedelta(seconds=60)) -> list[int]:
    """Number of the first event each event is counted with: a window starts at its first event and isn't extended."""
    out, first, k = [], None, -1
    for i, t in enumerate(ts):
        if first is None or t - first > open_for:
            first, k = t, i
        out.append(k)
    return out


def counted_with_state(events: DataFrame, seconds: int = 60) -> DataFrame:
    """event_id and count of every window of a key (user_id, event_type), with state in the stream; events has a watermark on ts.

    A window starts at its first event by ts and counts those of the next seconds. Events may come in any order: until
    the watermark has passed a window, a late one changes it, and its new count is told again; a window that a late
    event has merged into an earlier one is told with 0. What the watermark has passed leaves the state, by event time.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, ids, told_ids, told_counts = (list(x) for x in state.get) if state.exists else ([], [], [], [])
        for pdf in frames:
            at += pdf["ms"].tolist()
            ids += pdf["event_id"].tolist()
        order = sorted(range(len(at)), key=lambda i: (at[i], ids[i]))
        at, ids = [at[i] for i in order], [ids[i] for i in order]
        first = fold_minute(at, seconds * 1000)
        counts, told = Counter(first), dict(zip(told_ids, told_counts))
        now = {ids[i]: n for i, n in counts.items()}
        out = [(i, n) for i, n in now.items() if told.get(i) != n] + [(i, 0) for i in told if i not in now]
        passed = state.getCurrentWatermarkMs()
        keep = next((k for k, i in enumerate(first) if at[i] + seconds * 1000 >= passed), len(at))
        if keep == len(at):
            state.remove()
        else:
            here = [i for i in ids[keep:] if i in now]
            state.update((at[keep:], ids[keep:], here, [now[i] for i in here]))
            state.setTimeoutTimestamp(max(at[first[keep]] + seconds * 1000, passed) + 1)
        yield pd.DataFrame([(*key, *x) for x in out], columns=["user_id", "event_type", "event_id", "n"])

    rows = events.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    kept = "ms array<long>, ids array<long>, told_ids array<long>, told_counts array<long>"
    return rows.groupBy("user_id", "event_type").applyInPandasWithState(run, "user_id long, event_type string, event_id long, n long", kept, "update", "EventTimeTimeout")


def apart(events: DataFrame, key: list[str], gap: str) -> DataFrame:
    """events with part and size: runs of a key's events with no gap longer than gap inside, so what one run holds back can't touch the next."""
    order = Window.partitionBy(*key).orderBy("ts", "event_id")
    opens = F.when(F.lag("ts").over(order) >= F.col("ts") - F.expr(f"INTERVAL {gap}"), 0).otherwise(1)
    return events.withColumn("opens", opens).withColumn("part", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("opens").withColumn("size", F.count("*").over(Window.partitionBy(*key, "part")))


@query("m1_sixty_second_dedupe")
def m1(spark, sf_dir):
    """The windows of every key (user and type): a window starts at its first event and counts those of the next 60 seconds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"], ignore_index=True)
        first = pdf["event_id"].iloc[fold_minute(pdf["ts"].tolist())].to_numpy()
        return pd.DataFrame({"event_id": first}).groupby("event_id").size().rename("n").reset_index()

    events = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    runs = apart(events, ["user_id", "event_type"], "60 SECONDS")
    folded = runs.where("size > 1").groupBy("user_id", "event_type", "part").applyInPandas(run, "event_id long, n long")
    return folded.unionByName(runs.where("size = 1").select("event_id", F.lit(1).cast("long").alias("n")))


_next_alert = """WITH RECURSIVE e AS (SELECT user_id, ts, MIN(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY user_id, ts),
a AS (SELECT user_id, MIN(ts) AS ts FROM e GROUP BY user_id UNION ALL SELECT e.user_id, MIN(e.ts) AS ts FROM a JOIN e ON e.user_id = a.user_id AND e.ts > a.ts + INTERVAL 1 HOUR GROUP BY e.user_id, a.ts)
SELECT e.event_id, e.user_id FROM a JOIN e ON e.user_id = a.user_id AND e.ts = a.ts"""


@query("m3_cooldown", _next_alert)
def m3(spark, sf_dir):
    """Errors that alert: those more than an hour after their user's last alert."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"], ignore_index=True)
        opened = [k == i for i, k in enumerate(fold_minute(pdf["ts"].tolist(), pd.Timedelta(hours=1)))]
        return pdf.loc[opened, ["event_id", "user_id"]]

    events = load(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "ts", "user_id")
    runs = apart(events, ["user_id"], "1 HOUR")
    folded = runs.where("size > 1").groupBy("user_id", "part").applyInPandas(run, "event_id long, user_id long")
    return folded.unionByName(runs.where("size = 1").select("event_id", "user_id"))
