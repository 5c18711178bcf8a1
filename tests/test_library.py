"""The library without the training-data operators: oracles on the smallest tables, hand-made cases, sources, streams."""

import json
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline import catalogue
from weftline.functions import text as X
from weftline.operators import graph, more, ranking, vectors
from weftline.plans.registry import TABLES
from weftline.sources import readers, writers
from weftline.streaming import jobs

DATA = "/root/testdata/sf0.001"
SAMPLE = ["a1_global_aggregates", "a11_funnel_rollup", "a16_percentiles", "a18_zscore_anomaly", "a22_min_max_normalise", "a27_pair_statistics", "j8_window_full_outer", "j10_scd_reconcile", "j17_band_join", "n2_lag_rate", "n7_ema", "t6_keep_latest_n", "u4_union_all_in_order", "x1_token_set", "x5_content_hash", "x10_canonical_url", "x16_sentences", "x19_readability", "r13_rank_fusion", "r20_content_value", "g4_hits", "t2_top_k_by_cosine", "s10_page_record", "a32_bloom_membership", "v9_ranking_bake_off", "r33_reviewed_ndcg", "v4_second_stage", "r1_composite_components", "v1_normalised_values", "v8_gate_verdicts", "v9_provider_bake_off", "x9_nfkc_composed", "x10_url_variants", "x23_anchor_oddity"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, duck, name):
    if not Path(DATA).exists():
        pytest.skip("no tables")
    df = catalogue.QUERIES[name](spark, DATA)
    told = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == sorted(df.columns)
    theirs = sorted(str([r[names.index(c)] for c in sorted(names)]) for r in told.fetchall())
    assert sorted(str([r[c] for c in sorted(names)]) for r in df.collect()) == theirs


def test_hand_made_numbers(spark):
    one = spark.range(1)
    assert one.select(ranking.ema(F.array(F.lit(1.0), F.lit(0.0)), 0.1)).first()[0] == pytest.approx(0.9)
    words = F.array(*(F.lit(str(i)) for i in range(200)))
    windows = one.select(X.passages(words)).first()[0]
    assert [(w[0], w[-1]) for w in windows] == [("0", "149"), ("120", "199")]
    assert one.select(X.damerau_levenshtein(F.lit("abcd"), F.lit("acbd"))).first()[0] == 1
    assert one.select(X.nfkc(F.lit("ﬁ"))).first()[0] == "fi"
    assert one.select(X.canonical_url(F.lit("HTTP://Example.com:80?utm_source=x&b=2&a=1#top"))).first()[0] == "http://example.com/?a=1&b=2"
    assert one.select(X.clean_bbcode(F.lit("[b]hi[/b] [QUOTE]a [CODE]b[/CODE][/QUOTE] you"))).first()[0] == "hi you"


def test_elo():
    import pandas as pd

    got = ranking.elo(pd.DataFrame({"league": [0], "seq": [1], "a": [1], "b": [2], "score": [1.0]}))
    assert dict(zip(got["player"], got["rating"])) == {1: 1516.0, 2: 1484.0}


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1), (3, 4, 1), (8, 9, 1)], "src long, dst long, w long")
    rank = {r.node: r.score for r in graph.pagerank(edges, 20).collect()}
    assert sum(rank.values()) == pytest.approx(1) and min(rank.values()) > 0
    assert {r.node: r.root for r in graph.labels(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    assert {r.node: r.core for r in graph.cores(edges).collect()} == {1: 2, 2: 2, 3: 2, 4: 1, 8: 1, 9: 1}


def test_close_pairs(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.0])], "id long, vec array<float>")
    assert [tuple(r) for r in vectors.close_pairs(rows, 0.96).collect()] == [(1, 2)]


def test_no_close_pair_is_missed(spark):
    """Against all pairs, over several blocks and tiles, with copies, a zero vector and cosines about the bound."""
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 16))
    v = np.vstack([base + r.normal(size=base.shape) * x for x in (0, 0.1, 0.2, 0.25, 0.3, 0.35, 0.4)] + [base[:5], np.zeros((1, 16))]).astype(np.float32)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<float>")
    w, keep = v.astype(np.float64), sorted({tuple(x): i for i, x in reversed(list(enumerate(v.tolist())))}.values())
    for least, block in ((0.9, 100), (0.96, 10_000)):
        want = {(a, b) for a in keep for b in keep if a < b and w[a] @ w[b] >= least * np.sqrt((w[a] @ w[a]) * (w[b] @ w[b]))}
        found = [tuple(x) for x in vectors.close_pairs(rows, least, block=block, tile=32).collect()]
        assert len(found) == len(set(found)) and set(found) == want


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"thread_id": 1, "title": "x"}\n\n{broken\n{"thread_id": 2}\n')
    assert sorted(r.thread_id for r in readers.json_lines(spark, str(tmp_path / "a.jsonl")).collect()) == [1, 2]
    for n in (1, 2):
        (tmp_path / f"p{n}.json").write_text(json.dumps({"items": [{"id": n, "title": "t", "body": "b"}]}))
    spark.dataSource.register(readers.PagedSource)
    assert sorted(r.id for r in spark.read.format("paged").option("path", f"{tmp_path}/p{{page}}.json").option("pages", 2).load().collect()) == [1, 2]
    tree = json.dumps([{"label": "a", "nb_events": 1}, {"label": "b", "subtable": json.dumps([{"label": "c", "nb_events": 2}])}])
    got = readers.flatten_events(spark.createDataFrame([(tree,)], "j string"), "j").collect()
    assert sorted((r.label, r.action, r.nb_events) for r in got) == [("a", None, 1), ("c", "b", 2)]
    assert readers.decode("é".encode("latin-1"), "text/html; charset=latin-1") == "é" and readers.decode("é".encode()) == "é"
    (tmp_path / "s.xml").write_text("<urlset><url><loc>http://a/</loc></url></urlset>")
    assert [r.loc for r in readers.sitemap(spark, str(tmp_path / "s.xml")).collect()] == ["http://a/"]


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    u = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(writers.upsert(t, u, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(writers.insert_or_ignore(t, u, ["k"])) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(writers.replace(t, u, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    writers.export_csv(t, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 7, "view"), (2, "2024-01-01 00:00:30", 7, "view"), (3, "2024-01-01 00:01:10", 7, "view"), (1, "2024-01-01 00:00:00", 7, "view")]
    spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string").select("event_id", F.col("t").cast("timestamp").alias("ts"), "user_id", "event_type").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert sorted(r.event_id for r in run(jobs.dedupe(stream, "event_id"), "deduped", "append")) == [1, 2, 3]
    assert [r.n for r in run(jobs.daily_rollup(stream), "daily", "update")] == [4]
    assert sorted((r.event_id, r.n) for r in run(jobs.counted_with_state(jobs.dedupe(stream, "event_id")), "counted", "update")) == [(1, 2), (3, 1)]
    assert jobs.fold_minute([r * __import__("pandas").Timedelta(seconds=1) for r in (0, 30, 61, 70)]) == [0, 0, 2, 2]


def test_trees_of_any_depth(spark):
    tree = [{"label": "leaf", "nb_events": 5}]
    for k in range(6):
        tree = [{"label": f"level{k}", "subtable": json.dumps(tree)}]
    got = readers.flatten_events(spark.createDataFrame([(json.dumps(tree),), (None,)], "j string"), "j").collect()
    assert [(r.label, r.nb_events) for r in got] == [("leaf", 5)]


def test_bloom_filter_misses_nothing(spark):
    from weftline.operators import further

    assert further.bloom_size(1000) == (9586, 7)
    m, k = further.bloom_size(3000)
    words = further.bloom_filter(spark.range(3000), m, k)
    got = {r.id: r.member for r in further.bloom_contains(spark.range(9000), "id", words, m, k).collect()}
    assert all(got[i] for i in range(3000)) and sum(got[i] for i in range(3000, 9000)) < 0.02 * 6000
    empty = further.bloom_filter(spark.range(0), *further.bloom_size(0))
    assert not further.bloom_contains(spark.range(5), "id", empty, *further.bloom_size(0)).where("member").count()


def test_equal_vectors_share_a_cluster(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [0.01, 1.0]), (9, [0.0, 1.0])], "id long, vec array<float>")
    assert dict((r.id, r.cluster) for r in more.vector_clusters(rows, 0.9).collect()) == {1: 1, 3: 1, 4: 4, 5: 4, 9: 4}


def test_runs_of_events_apart(spark):
    """A steady stream, every 50 minutes, alerts anew an hour after its last alert, and over midnight."""
    rows = [(k, 1, f"2024-01-31 {h:02d}:{m:02d}:00") for k, (h, m) in enumerate([(20, 0), (20, 50), (21, 40), (22, 30), (23, 59)])] + [(9, 1, "2024-02-01 00:00:30"), (10, 2, "2024-02-01 00:00:30")]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    parts = {r.event_id: (r.user_id, r.part, r["size"]) for r in jobs.apart(events, ["user_id"], "1 HOUR").collect()}
    assert len({parts[k][:2] for k in (0, 1, 2, 3)}) == 1 and parts[4] == parts[9] != parts[3] and parts[10][2] == 1
    assert [i for i, k in enumerate(jobs.fold_minute([0, 50, 100, 150], 60)) if i == k] == [0, 2]


def test_readability_counts(spark):
    texts = ["The make of tree", "hmm rhythm beautiful. Area einstein table; recite agreeable", "été naïve e", "café2x mile-stone"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", *X.readability(F.col("text"))).collect()
    import re

    for r in rows:
        words = re.findall("[a-z]+", r.text.lower())
        syl = []
        for w in words:
            n = len(re.findall("[aeiouy]+", w))
            syl.append(max(1, n - (1 if re.search("[^aeiouy]e$", w) and n > 1 else 0)))
        assert (r.words, r.syllables) == (len(words), sum(syl))
        sentences = max(1, len(re.findall("[.!?]+", r.text)))
        assert abs(r.fog - 0.4 * (len(words) / sentences + 100 * sum(s >= 3 for s in syl) / len(words))) < 1e-5


def test_sentences_keep_their_digits_and_lose_all_spaces(spark, tmp_path):
    """A sentence that begins with the digits of its own number keeps them; white space is what SQL takes for it."""
    texts = ["Zero. 1 one. 2 two. 3 three 3.\n 4", "a. \u00a0\u3000b\u2003\n \n  c  ", "a.\x0bb. c!\x0b d\r\ne? \tf", "\u00a0", ". . !", "", None]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("x16_sentences", "x33_distil"):
        got = sorted(tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == sorted(c.execute(catalogue.ORACLES[name]).fetchall()) and got
    got = spark.createDataFrame([(texts[0],)], "t string").select(X.sentences(F.col("t"))).first()[0]
    assert got == ["Zero.", "1 one.", "2 two.", "3 three 3.", "4"]


def test_overlaps_count_all_but_the_usual_words(spark, tmp_path):
    texts = ["Before all that, about more of the tree", "about all of it more than before", "that is the stone", "don't"]
    spark.createDataFrame([*enumerate(texts)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.dest, r.host, r.overlap) for r in catalogue.QUERIES["t3_top_k_by_overlap"](spark, str(tmp_path)).collect())
    assert got == [(0, 1, 4), (1, 0, 4)]
    c = duckdb.connect()
    c.execute(f"create view benchmark as select * from '{tmp_path}/benchmark.parquet/*.parquet'")
    assert sorted(c.execute(catalogue.ORACLES["t3_top_k_by_overlap"]).fetchall()) == got


def test_controls_are_compared_by_place(spark, tmp_path):
    """Users of the same counts are one place; ties of rounded distances go to the least control, as in SQL."""
    rows = [(u, e) for u in range(300) for e, n in (("view", 1 + u % 3), ("click", u // 10 % 2), ("error", 1)) for _ in range(n)]
    events = spark.createDataFrame([(i, u, e) for i, (u, e) in enumerate(rows)], "event_id long, user_id long, event_type string")
    for t in TABLES:
        spark.range(1).write.parquet(f"{tmp_path}/{t}.parquet")
    events.select("event_id", F.lit("2024-01-03 00:00:00").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"), F.lit("{}").alias("props")).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    found = catalogue.QUERIES["r23_matched_controls"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert sorted((r.item, r.control, r.dist) for r in found.collect()) == sorted(c.execute(catalogue.ORACLES["r23_matched_controls"]).fetchall())
    held = [f for f in found.inputFiles() if "/controls-" in f]
    assert spark.read.parquet(*held).count() == 6


def test_state_of_windows_follows_event_time(spark, tmp_path):
    """Late events change a window, one that merges two tells the second with 0, and what the watermark passed goes."""
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string").option("maxFilesPerTrigger", 1).json(str(folder)).withWatermark("ts", "10 minutes")

    def feed(name, *rows):
        (folder / f"{name}.json").write_text("".join(json.dumps({"event_id": i, "ts": f"2024-01-01T{t}Z", "user_id": 7, "event_type": "view"}) + "\n" for i, t in rows))

    def told_after(name, *rows):
        feed(name, *rows)
        got = []
        q = jobs.counted_with_state(stream).writeStream.foreachBatch(lambda df, _: got.extend((r.event_id, r.n) for r in df.collect())).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        return sorted(got)

    assert told_after("a", (2, "10:00:50"), (3, "10:01:55")) == [(2, 1), (3, 1)]
    assert told_after("b", (1, "10:00:00")) == [(1, 2), (2, 0)]
    assert told_after("c", (9, "10:30:00")) == [(9, 1)]
    assert told_after("d", (8, "10:00:30"), (10, "10:30:20")) == [(9, 2)]
