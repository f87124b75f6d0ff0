from collections import deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.operators import admission, answers, querylog
from siltstone.streaming import log_stream

LOG = "id long, ts long, query string, result_count int, took_ms int"


def test_stats_and_terms(spark):
    now = 200_000
    log = spark.createDataFrame([(1, now - 10, "zone router", 1, 1), (1, now - 10, "zone router", 1, 1), (2, now - 5, "the Zone", 1, 1), (3, now - 90_000, "zone-id ab", 1, 1), (4, now - 4, None, 0, None)], LOG)
    r = querylog.stats(log, now).first()
    assert (r.total, r.last_hour, r.today, r.last_query_at) == (4, 3, 3, "1970-01-03T07:33:16Z")
    got = querylog.window_summary(log, now - 100, now).first()
    assert got["count"] == 3 and [(t.term, t["count"]) for t in got.top_terms] == [("zone", 2), ("router", 1)]
    empty = querylog.window_summary(log, 0, 1).first()
    assert empty["count"] == 0 and empty.top_terms == []
    assert querylog.stats(log.limit(0), now).first().total == 0
    assert log.select(querylog.entry(F.lit("x" * 900)).alias("q")).first().q == "x" * 500


def test_guard(spark):
    rows = [("show the salary", "career"), ("my coursework", "study"), ("a Private\t memory", "private"), ("tokenizer", None), ("the API  key, please", "credentials"), ("salary token", "credentials"), ("what can you use", None), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "q string, want string")
    assert all(r.got == r.want for r in df.select("want", admission.guard(F.col("q")).alias("got")).collect())
    own = {"sea": ("keel", "main mast")}
    assert [r[0] for r in spark.createDataFrame([("a keel",), ("main  mast",), ("mast",)], "q string").select(admission.guard(F.col("q"), own)).collect()] == ["sea", "sea", None]
    ips = spark.createDataFrame([("127.0.0.1",), ("10.1.2.3",), ("8.8.8.8",), ("x",), (None,)], "a string")
    assert [r[0] for r in ips.select(admission.is_local_address("a")).collect()] == [True, True, False, False, False]
    marked = spark.createDataFrame([("127.0.0.1", True), ("127.0.0.1", None), ("8.8.8.8", True)], "a string, m boolean")
    assert [r[0] for r in marked.select(admission.is_internal(F.col("a"), F.col("m"))).collect()] == [True, False, False]
    assert [r[0] for r in spark.createDataFrame([("s",), ("t",), (None,)], "g string").select(admission.authorised(F.col("g"), "s")).collect()] == [True, False, False]
    with pytest.raises(ValueError):
        admission.authorised(F.col("g"), "")
    both = spark.createDataFrame([("x", "y"), ("", "y"), (None, ""), (None, "z")], "q string, query string")
    assert [r[0] for r in both.select(admission.asked_text(F.col("q"), F.col("query"))).collect()] == ["x", "y", None, "z"]


def model(times, limit, window):
    accepted, out = [], []
    for t in times:
        ok = sum(1 for a in accepted if t - a <= window) < limit
        out.append(ok)
        if ok:
            accepted.append(t)
    return out


@given(st.lists(st.integers(0, 60), max_size=40), st.integers(1, 4), st.integers(0, 20))
def test_admit_against_model(times, limit, window):
    times = sorted(times)
    assert admission.admit(iter(times), limit, window, deque()) == model(times, limit, window)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 50)), min_size=1, max_size=40))
def test_rate_limit_table(spark, events):
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(events)], "k string, t long, i long")
    got = {r.i: r.accepted for r in admission.rate_limit(df, "k", "t", "i", 2, 10).collect()}
    for key in ("a", "b", None):
        mine = sorted((t, i) for i, (k, t) in enumerate(events) if k == key)
        assert [got[i] for _, i in mine] == model([t for t, _ in mine], 2, 10)


def test_fallback(spark):
    q = spark.createDataFrame([(1, True), (2, False), (3, False), (4, False)], "query_id int, unavailable boolean")
    h = spark.createDataFrame([(1, 1, 0.0, "<b>fact</b> &amp; more"), (2, 1, 0.1, "weak"), (3, 1, 0.9, "strong"), (3, 2, 0.2, "y" * 900)], "query_id int, rank int, score double, text string").withColumns({"source_repo": F.lit("r"), "file_path": F.lit("p")})
    got = {r.query_id: r for r in answers.fallback(q, h).collect()}
    assert got[1].answer == answers.UNAVAILABLE + "fact & more" and got[1].degraded and got[1].n_sources == 1
    assert got[2].answer == answers.UNCLEAR and got[2].n_sources == 0
    assert got[3].answer.startswith(answers.LATE + "strong yyy") and not got[3].degraded
    assert got[4].answer == answers.NOTHING


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 0), ("a", 10), ("a", 20), ("b", 5_000)], "k string, t long").withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    log_stream.run_available(log_stream.windowed_counts(log_stream.source(spark, src, schema), "ts", ["k"], late="0 seconds"), str(tmp_path / "s"), str(tmp_path / "c"))
    assert {(r.window_start, r.k, r.events) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {(0, "a", 3)}  # the last window stays open
    log_stream.run_available(log_stream.limited(log_stream.source(spark, src, schema), "k", "t", 2, 100), str(tmp_path / "s2"), str(tmp_path / "c2"))
    assert sorted((r.key, r.t, r.accepted) for r in spark.read.parquet(str(tmp_path / "s2")).collect()) == [("a", 0, True), ("a", 10, True), ("a", 20, False), ("b", 5_000, True)]


def test_update_stream_keeps_the_last_counts(spark, tmp_path):
    src = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([("a", 10 * k), ("b", 4_000)], "k string, t long").withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(src)
    counts = log_stream.windowed_counts(log_stream.source(spark, src, spark.read.parquet(src).schema, 1), "ts", ["k"])
    log_stream.keep_latest(counts, str(tmp_path / "s"), str(tmp_path / "c"))
    got = {(r.window_start, r.k, r.events) for r in log_stream.latest(spark, str(tmp_path / "s"), ["window_start", "k"], "events").collect()}
    assert got == {(0, "a", 3), (3600, "b", 3)}


def test_store_stream(spark, tmp_path):
    from siltstone.operators import convergence

    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    kind = "chunk_id string, doc_key string, chunk_index int, chunk_count int, last_updated string, text string"
    put = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
    run = lambda: log_stream.keep_store(log_stream.source(spark, src, spark.createDataFrame([], kind).schema, 1), store, str(tmp_path / "c")).awaitTermination()
    held = lambda: {(r.chunk_id, r.text) for r in convergence.current(spark, store).collect()}
    put([("c0", "d1", 0, 2, "1", "a")])  # a document whose chunks come in two micro-batches
    put([("c1", "d1", 1, 2, "1", "b"), ("e0", "d2", 0, 1, "1", "e")])
    run()
    assert held() == {("c0", "a"), ("c1", "b"), ("e0", "e")}
    put([("c0", "d1", 0, 1, "2", "c")])  # shorter now
    run()
    assert held() == {("c0", "c"), ("e0", "e")}
    put([("c1", "d1", 1, 2, "1", "b")])  # late, of the old version
    run()
    assert held() == {("c0", "c"), ("e0", "e")}


def test_windows_and_payload(spark):
    log = spark.createDataFrame([(1, 10, "zone router", 1, 1), (2, 7_300, "zone", 1, 1), (3, None, "x", 1, 1)], LOG)
    assert [tuple(r) for r in querylog.windows(log, 0, 10_900).orderBy("window_start").collect()] == [(0, 1), (3600, 0), (7200, 1)]
    got = querylog.summary_payload(log, "s", 3_600, 7_200, 7_400).first()
    assert got["count"] == 0 and got.top_terms == [] and got.queries_total == 3 and got.window_start == "1970-01-01T01:00:00Z"
    assert [r.id for r in querylog.trimmed(log, 1).collect()] == [2]
