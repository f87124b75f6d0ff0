import json

import pytest

from siltstone.operators import answers, convergence, embedding, service
from siltstone.settings import Settings

REQUESTS = "query_id long, t long, caller string, internal boolean, query string, top_k int"
E = embedding.HashedTerms(16)


def made():
    """Functions of their own, as tasks can't import this module."""

    def down(texts):
        raise embedding.Unavailable("no server")

    def short(texts):
        return [[0.0]] * (len(texts) - 1)

    def late(prompt):
        raise TimeoutError

    def reply(prompt):
        return "" if "empty" in prompt else "I cannot answer that." if "decline" in prompt else "It holds [1]."

    return down, short, late, reply


down, short, late, reply = made()


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("c1", 1, "the zone router of the harbour"), ("c2", 2, "backup policy and retention"), ("c3", 3, "router tables"), ("c4", 4, None)]
    c = spark.createDataFrame([(i, n, "r", f"{i}.md", "note", None, 0, t) for i, n, t in rows], "chunk_id string, vec_id long, source_repo string, file_path string, doc_type string, last_updated string, chunk_index int, text string")
    v = embedding.embed(c, E, 2, "chunk_id", "text")
    return c.join(v.withColumnRenamed("vector", "embedding"), "chunk_id")


def requests(spark, rows):
    return spark.createDataFrame(rows, REQUESTS)


def test_embedding(spark):
    df = spark.createDataFrame([(1, "zone Router"), (2, ""), (3, None), (1, "zone Router")], "id long, text string")
    got = sorted(((r.id, r.vector) for r in embedding.embed(df, E, 1).collect()), key=lambda x: x[0])
    assert got[0] == got[1] and abs(sum(v * v for v in got[0][1]) - 1) < 1e-9 and got[2][1] == [0.0] * 16 and got[3][1] is None
    assert embedding.embed(df.limit(0), E).count() == 0
    with pytest.raises(Exception, match="0 vectors for 1 texts"):
        embedding.embed(df, short, 1).collect()


def test_a_term_is_hashed_once(monkeypatch):
    seen, md5 = [], embedding.hashlib.md5
    monkeypatch.setattr(embedding.hashlib, "md5", lambda x: seen.append(x) or md5(x))
    a, b = E(["hashedonce hashedonce", "hashedonce"])
    assert a == b and sum(abs(x) for x in a) == 1 and len(seen) == 1


def test_decisions(spark):
    rows = [(1, 0, "8.8.8.8", False, "router", 5), (2, 1, "8.8.8.8", False, "my password", 5), (3, 2, "8.8.8.8", False, "backup", None), (4, 3, "8.8.8.8", False, "router", 5), (5, 3, "9.9.9.9", True, "", 5), (6, 4, "10.0.0.1", True, "my password", 50), (7, 4, "10.0.0.1", True, "my password", 2), (8, 9, None, None, None, 1)]
    s = Settings(rate_limit_per_hour=3)
    of = lambda first: {r.query_id: (r.decision, r.k) for r in service.decided(requests(spark, rows), s, first).collect()}
    search = of(False)
    assert search == {1: ("answered", 5), 2: ("refused", 5), 3: ("answered", 5), 4: ("limited", 5), 5: ("invalid", 5), 6: ("invalid", 10), 7: ("answered", 2), 8: ("invalid", 1)}
    assert of(True)[4] == ("answered", 5)  # a refused question hasn't spent the rate


def test_search(spark, chunks):
    rows = [(1, 0, "8.8.8.8", False, "zone router", 1), (2, 1, "8.8.8.8", False, "zone router", 3), (3, 2, "8.8.8.8", False, "my password", 3), (4, 2, "10.0.0.1", True, "backup", 3)]
    got = service.search(requests(spark, rows), chunks, E)
    hits = [(r.query_id, r["rank"], r.chunk_id) for r in got.hits.orderBy("query_id", "rank").collect()]
    assert [h for h in hits if h[0] == 1] == [(1, 1, "c1")] and {h[2] for h in hits if h[0] == 2} == {"c1", "c2", "c3"} and not any(h[0] == 3 for h in hits)
    assert {(r.id, r.result_count) for r in got.log.collect()} == {(1, 1), (2, 3), (3, 0)}
    bodies = {r.query_id: json.loads(r.body) for r in service.responses(got).collect()}
    assert [h["file_path"] for h in bodies[1]["hits"]] == ["c1.md"] and bodies[3] == {"query": "my password", "hits": [], "degraded": False} and len(bodies[2]["hits"]) == 3
    for embedder in (None, down):
        worse = service.search(requests(spark, rows), chunks, embedder)
        assert {(r.query_id, r.chunk_id, r.score, r.degraded) for r in worse.hits.collect()} == {(1, "c1", 0.0, True), (2, "c1", 0.0, True), (2, "c3", 0.0, True), (4, "c2", 0.0, True)}
    with pytest.raises(Exception, match="vectors for"):
        service.search(requests(spark, rows), chunks, short)
    assert service.search(requests(spark, []), chunks, E).hits.count() == 0


def test_keywords_alone_need_no_pool(spark, chunks, monkeypatch):
    asked, search = [], service.lexical.bm25
    monkeypatch.setattr(service.lexical, "bm25", lambda c, q, k: asked.append(k) or search(c, q, k))
    rows = [(i, i, "8.8.8.8", False, "zone router of the policy", k) for i, k in enumerate((1, 2, 10))]
    got = [{(r.query_id, r["rank"], r.chunk_id) for r in service.search(requests(spark, rows), chunks, e).hits.collect()} for e in (None, down)]
    assert got[0] == got[1] and {i for i, _, _ in got[0]} == {0, 1, 2} and asked == [10, 10]


def test_ask(spark, chunks):
    rows = [(1, 0, "8.8.8.8", False, "zone router", 2), (2, 1, "8.8.8.8", False, "router empty", 2), (3, 2, "8.8.8.8", False, "my password", 2), (4, 3, "8.8.8.8", False, "router decline", 2)]
    of = lambda embedder, answerer: {r.query_id: r for r in service.ask(requests(spark, rows), chunks, embedder, answerer).collect()}
    got = of(E, reply)
    assert (got[1].answer, got[1].n_sources, got[1].degraded) == ("It holds [1].", 2, False)
    assert (got[2].answer, got[2].n_sources) == (answers.UNCLEAR, 0) and got[4].n_sources == 0 and got[3].decision == "refused" and "credentials" in got[3].answer
    assert of(E, None)[1].answer.startswith(answers.UNAVAILABLE) and of(E, None)[1].degraded
    assert of(E, late)[1].answer.startswith(answers.LATE) and not of(E, late)[1].degraded
    assert of(None, reply)[1].answer.startswith(answers.UNAVAILABLE) and of(None, reply)[1].degraded


def test_ingest(spark, tmp_path):
    docs = spark.createDataFrame([("r", "a.md", "note", "# One\nalpha\n\n# Two\nbeta", 0), ("r", "b.md", "note", "", 0), ("r", "c.md", "note", "old", 0), ("r", "c.md", "note", "new", 1)], "source_repo string, file_path string, doc_type string, text string, source_order int")
    store = str(tmp_path)
    assert service.ingest(spark, docs, store, "v1", "t1", E) == {"documents": 2, "chunks": 3, "deleted": 0, "skipped": 1}
    assert service.ingest(spark, docs, store, "v2", "t2", E) == {"documents": 2, "chunks": 3, "deleted": 0, "skipped": 1}
    assert {r.text for r in convergence.current(spark, store).collect()} == {"# One\nalpha", "# Two\nbeta", "new"}
    assert service.ingest(spark, docs.where("file_path <> 'a.md'"), store, "v3", "t3", E)["deleted"] == 2
    with pytest.raises(Exception, match="vectors for"):
        service.ingest(spark, docs, store, "v4", "t4", short)
    assert {r.text for r in convergence.current(spark, store).collect()} == {"new"}
    service.ingest(spark, docs, store, "v5", "t5", E)
    said = [r.report for r in service.compare(spark, store, ["alpha one", "beta"], E).orderBy("query_id").collect()]
    assert said[0].startswith("## alpha one\n\n| # | vector | hybrid |") and said[1].count("\n| ") == 4 and "| 1 | `r/a.md`" in said[1]
    with pytest.raises(ValueError):
        service.compare(spark, str(tmp_path / "none"), ["x"], E)


def test_settings(monkeypatch):
    monkeypatch.setenv("SILTSTONE_CHUNK_WORDS", "99")
    assert Settings.from_environment().chunk_words == 99 and Settings.from_environment().top_k_max == 10
    monkeypatch.setenv("SILTSTONE_TOP_K_MAX", "many")
    with pytest.raises(ValueError, match="SILTSTONE_TOP_K_MAX"):
        Settings.from_environment()
