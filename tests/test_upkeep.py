import pytest
from pyspark.sql import functions as F

from siltstone import runtime
from siltstone.operators import changes, convergence
from siltstone.sources import files

FEED = "entry_id long, source_repo string, file_path string, doc_type string, chunks int, last_updated string"
DONE = "run_id long, source_repo string, file_path string, last_updated string"
RUNS = "run_id long, run_state string"


def test_written_forms(spark):
    from siltstone.functions.versions import canonical_instant, canonical_path

    rows = [("./docs//a.md", "2026-02-15T14:49:58+05:30"), ("docs\\a.md", "1771147198"), ("/docs/./a.md ", "1771147198000"), ("x/../docs/a.md", "2026-02-15 09:19:58"), ("docs/a.md", "2026-02-15T09:19:58.000Z")]
    got = spark.createDataFrame(rows, "p string, t string").select(canonical_path(F.col("p")), canonical_instant(F.col("t"))).distinct().collect()
    assert [tuple(r) for r in got] == [("docs/a.md", 1771147198000000)]


def test_pending(spark):
    feed = spark.createDataFrame([(5, "r", "./a.md", None, 1, "100"), (3, "r", "a.md", None, 1, "1970-01-01T00:01:40Z"), (4, "r", "A.md", None, 1, "100"), (6, "r", None, None, 1, "100"), (7, "r", "b.md", None, 1, "100"), (8, "r", "c.md", None, 1, "odd"), (9, "r", "c.md", None, 2, " odd")], FEED)
    done = spark.createDataFrame([(1, "r", "/b.md", "100000000000" + "00"[:0]), (2, "r", "a.md", "100"), (1, "r", "b.md", "1970-01-01 00:01:40")], DONE)
    runs = spark.createDataFrame([(1, "success"), (2, "failed")], RUNS)
    assert {r.entry_id for r in changes.pending(feed, done, runs).collect()} == {3, 4, 8}
    assert changes.pending(feed.limit(0), done, runs).count() == 0


def test_failed_batches_are_replayed_once(spark, tmp_path):
    first = spark.createDataFrame([(1, "r", "a", None, 1, "10"), (2, "r", "b", None, 1, "10")], FEED)
    later = first.unionByName(spark.createDataFrame([(3, "r", "a", None, 1, "20"), (4, "r", "b", None, 1, "10")], FEED))
    none = changes.versioned(first.limit(0)).select(*changes.KEY)
    cap = changes.ChangeCapture(spark, str(tmp_path), partitions=4)
    lost = cap.plan(first)  # planned, then the run dies before its commit
    assert cap.sunk() is None
    again = cap.run(later, none)  # replays the plan as it was, though more has arrived
    assert again.replayed and again.end == lost.end and {r.entry_id for r in cap.sunk().collect()} == {1, 2}
    cap.sink(cap.plan(later), cap.read(later, cap.plan(later)).select(*changes.KEY, "entry_id"))  # dies between sink and commit
    assert {r.entry_id for r in cap.sunk().collect()} == {1, 2}
    cap.run(later, none)
    assert sorted(r.entry_id for r in cap.sunk().collect()) == [1, 2, 3]  # 4 is a repeat of 2
    assert cap.run(later, none).number == 2 and sorted(r.entry_id for r in cap.sunk().collect()) == [1, 2, 3]


def test_convergence(spark, tmp_path):
    old = spark.createDataFrame([("c1", "d1", "o"), ("c2", "d1", "o"), ("c3", "d2", "o"), ("c4", None, "o")], "chunk_id string, doc_key string, v string")
    new = spark.createDataFrame([("c1", "d1", "n"), ("c5", "d3", "n")], "chunk_id string, doc_key string, v string")
    ids = lambda df: sorted(r.chunk_id for r in df.collect())
    assert ids(convergence.stale(old, new)) == ["c2"] and ids(convergence.withdrawn(old, new)) == ["c3", "c4"]
    once = new
    assert {tuple(r) for r in convergence.transitions(old, new).collect()} == {("c1", "replace"), ("c5", "insert"), ("c2", "delete"), ("c3", "delete"), ("c4", "delete")}
    assert {r.action for r in convergence.transitions(new, new).collect()} == {"replace"}
    assert ids(convergence.with_metadata(old, doc_key="d1")) == ["c1", "c2"] and ids(convergence.with_metadata(old, doc_key=None)) == ["c4"]
    assert ids(convergence.upsert(old, new)) == ["c1", "c2", "c3", "c4", "c5"]
    convergence.publish(once, str(tmp_path), "v1")
    convergence.publish(new.limit(1), str(tmp_path), "v2")
    assert convergence.current(spark, str(tmp_path)).count() == 1 and convergence.current(spark, str(tmp_path / "no")) is None


def test_pointers_freshness_and_single_flight(spark, tmp_path):
    store, built = str(tmp_path), []
    rows = spark.createDataFrame([("c1",)], "chunk_id string")
    fresh = convergence.Fresh()
    build = lambda chunks: built.append(chunks and chunks.count()) or len(built)
    assert fresh.get(spark, store, build) == 1 and fresh.get(spark, store, build) == 1 and built == [None]
    for version, marker in (("v1", "a"), ("v1", "a"), ("v2", "b")):
        convergence.publish(rows, store, version, marker)
        fresh.get(spark, store, build)
    assert built == [None, 1, 1]  # the same number of rows, another marker
    assert sorted(p.name for p in (tmp_path / "pointers").iterdir() if not p.name.startswith(".")) == ["0", "1"]
    inner = []
    assert convergence.single_flight(spark, store, lambda: inner.append(convergence.single_flight(spark, store, lambda: inner.append("ran"))))
    assert inner == [False] and convergence.single_flight(spark, store, lambda: None)
    with pytest.raises(ZeroDivisionError):
        convergence.single_flight(spark, store, lambda: 1 / 0)
    assert convergence.single_flight(spark, store, lambda: None)


def test_runs_with_a_failure_between(spark):
    feed = spark.createDataFrame([(i, "r", f"f{i % 7}.md", None, 1, str(100 + i % 3)) for i in range(1, 60)], FEED)
    done = spark.createDataFrame([(1, "r", "f1.md", "100"), (2, "r", "f2.md", "100")], DONE)
    runs = spark.createDataFrame([(1, "success"), (2, "failed")], RUNS)
    want = sorted(r.entry_id for r in changes.pending(feed, done, runs).collect())
    for cut in (0, 20, 59):
        assert sorted(r.entry_id for r in changes.pending_in_runs(feed, done, runs, cut).collect()) == want


def test_a_run_reads_only_its_part_of_the_log(spark, tmp_path):
    feed = spark.createDataFrame([(i, "r", f"f{i}.md", None, 1, "100") for i in range(100)], FEED)
    feed.write.parquet(str(tmp_path / "feed"))
    log = spark.read.parquet(str(tmp_path / "feed"))
    cap = changes.ChangeCapture(spark, str(tmp_path / "state"), partitions=4)
    plan = changes.Plan(3, (90, 91, 92, 93), (99, 99, 99, 99))
    text = cap.read(log, plan)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(entry_id,90)" in text and "LessThanOrEqual(entry_id,99)" in text


def test_last_and_first_wins_and_listing(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 2, "b"), ("m", None, None)], "k string, o int, v string")
    assert {(r.k, r.v) for r in convergence.last_wins(df, ["k"], [F.col("o")]).collect()} == {("k", "b"), ("m", None)}
    assert {(r.k, r.v) for r in convergence.first_wins(df, ["k"], [F.col("o")]).collect()} == {("k", "a"), ("m", None)}
    c = spark.createDataFrame([("r:p", "r", "p", "t", 0, "a", "2026-01-01"), ("", "r", "p", "t", 1, "b", "2026-02-01")], "doc_key string, source_repo string, file_path string, doc_type string, chunk_index int, chunk_id string, last_updated string")
    assert [(r.chunks, r.last_updated) for r in convergence.listing(c).collect()] == [(2, "2026-02-01")]


def test_sources(spark, tmp_path):
    for path, text in {"alpha/README.md": "# hi", "site/work/a.html": "<p>x</p>", "rec/adrs/ADR-0001-x.md": RECORD.format(1), "rec/adrs/b.md": RECORD.format(1), "rec/adrs/README.md": "no", "rec/adrs/z.md": "bad"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = files.landed(spark, str(tmp_path))
    assert got.count() == 6
    repos = spark.createDataFrame([("alpha", False, None, False), ("fork", True, False, False)], "name string, fork boolean, archived boolean, private boolean")
    docs = files.gather(files.readmes(got, files.wanted_repos(repos, "x, y")), files.site_pages(got, "site", "work/", "case-study"), files.record_folder(got, "rec", "adrs"))
    assert {(r.source_repo, r.file_path, r.source_order) for r in docs.collect()} == {("alpha", "README.md", 0), ("site", "work/a.html", 1), ("rec", "adrs/ADR-0001-x.md", 2)}
    assert files.pinned(spark, "a:b/c.md:decision, ").collect()[0].doc_type == "decision"
    with pytest.raises(ValueError):
        files.pinned(spark, "a:b")


def test_bytes_and_listings(spark):
    got = spark.createDataFrame([(bytearray(b"a\xffb"),), (bytearray("é".encode()),), (None,)], "b binary").select(files.decoded(F.col("b"))).collect()
    assert [r[0] for r in got] == ["a\ufffdb", "é", None]
    listing = [("ADR-0001-x.md", "file", "https://h/1"), ("README.md", "file", None), ("sub", "dir", None), ("ADR-0002.md", "file", "https://h/2")]
    texts = [("ADR-0001-x.md", RECORD.format(1)), ("ADR-0002.md", "malformed")]
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    ask = lambda a, b: [r.file_path for r in files.listed_records(make(a, "name string, type string, download_url string"), make(b, "name string, text string"), "r", "/adrs/", "h").collect()]
    assert ask(listing, texts) == ["adrs/ADR-0001-x.md"]
    assert ask([*listing[:3], ("ADR-0002.md", "file", "http://h/2")], texts) == [] and ask(listing, texts[:1]) == [] and ask(listing[1:3], texts) == []


RECORD = '+++\nid = "ADR-000{}"\ndate = 2026-01-02\nstatus = "accepted"\n+++\n\nbody\n'


def test_shared_dir_is_the_sessions(spark):
    assert runtime.shared_dir(spark) == runtime.shared_dir(spark)


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace as Fake

    conf = Fake(get=lambda *_: None)
    cluster = Fake(conf=conf, sparkContext=Fake(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        runtime.shared_dir(cluster)


def test_tables_between_stages_are_deleted(spark):
    a, b = (runtime.materialise(spark.range(3), "t") for _ in range(2))
    runtime.drop(a)
    fs, p = runtime.hadoop_fs(spark, a._written)
    assert not fs.exists(p) and b.count() == 3
    runtime.release(spark)
    assert not fs.exists(runtime.hadoop_fs(spark, b._written)[1])
