import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from siltstone.operators import fusion, lexical, vector

CHUNKS = "chunk_id string, vec_id long, text string, embedding array<float>, source_repo string, file_path string, doc_type string, last_updated string, chunk_index int"


def chunks(spark):
    rows = [("vector-first", 1, "general prose", [1.0, 0.0]), ("literal-zone", 2, "the zone_id column", [0.0, 1.0]), ("other", 3, "general words", [0.5, 0.5])]
    return spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], CHUNKS)


def test_exact_identifier_is_lifted_with_its_true_score(spark):
    q = spark.createDataFrame([(7, "zone_id", [1.0, 0.0])], "query_id long, query string, vector array<float>")
    top = fusion.search(chunks(spark), q, 1).collect()
    assert [(r.chunk_id, r.score, r.source_repo, r.chunk_index, r.degraded) for r in top] == [("literal-zone", 0.0, "", 0, False)]


def test_degraded(spark):
    q = spark.createDataFrame([(1, "zone_id wrangler", None), (2, "nothing shared here", None), (3, None, None)], "query_id long, query string, vector array<float>")
    got = fusion.search(chunks(spark), q).collect()
    assert [(r.query_id, r.chunk_id, r.score, r.degraded) for r in got] == [(1, "literal-zone", 0.0, True)]
    assert fusion.search(chunks(spark).limit(0), q).count() == 0


def test_terms_are_counted_once_for_both_kinds(spark, monkeypatch):
    q = spark.createDataFrame([(7, "zone_id", [1.0, 0.0]), (8, "general", None)], "query_id long, query string, vector array<float>")
    written, write = [], lexical.runtime.materialise
    monkeypatch.setattr(lexical.runtime, "materialise", lambda df, name: written.append(name) or write(df, name))
    top = {(r.query_id, r.chunk_id, r.degraded) for r in fusion.search(chunks(spark), q, 1).collect()}
    assert top == {(7, "literal-zone", False), (8, "other", True)} and written.count("counted") == 1


def test_rrf_ties(spark):
    r = spark.createDataFrame([(1, "x", "b", 1), (1, "x", "a", 2), (1, "y", "a", 1), (1, "y", "b", 2)], "query_id int, retriever string, chunk_id string, rank int")
    got = fusion.rrf(r).orderBy("rank").collect()
    assert [x.chunk_id for x in got] == ["a", "b"] and abs(got[0].score - (1 / 61 + 1 / 62)) < 1e-9


def brute(docs, query):
    toks = {k: lexical_tokens(v) for k, v in docs.items() if v}
    toks = {k: v for k, v in toks.items() if v}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {}
    for v in toks.values():
        for t in set(v):
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: (0.25 * mean if x < 0 else x) for t, x in raw.items()}
    out = {}
    for k, v in toks.items():
        if set(v) & set(lexical_tokens(query)):
            out[k] = sum(idf.get(t, 0) * v.count(t) * 2.5 / (v.count(t) + 1.5 * (0.25 + 0.75 * len(v) / avg)) for t in lexical_tokens(query))
    return sorted(((round(-s, 6), k) for k, s in out.items()))


def lexical_tokens(t):
    import re

    return re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", t).lower())


def test_bm25_against_brute_force(spark):
    docs = {"a": "tide tide harbour", "b": "the harbour wall", "c": "the the tide", "d": "copy of the harbour", "e": "copy of the harbour", "f": None, "g": "  "}
    df = spark.createDataFrame(list(docs.items()), "chunk_id string, text string")
    asked = {1: "the tide tide", 2: "harbour copy", 3: "absent", 4: "the tide tide"}
    q = spark.createDataFrame(list(asked.items()), "query_id int, query string")
    for block in (1, 100):
        got = lexical.bm25(df, q, 3, block).orderBy("query_id", "rank").collect()
        for i, text in asked.items():
            assert [(round(-r.score, 6), r.chunk_id) for r in got if r.query_id == i] == brute(docs, text)[:3]
    every = {(r.query_id, r.chunk_id): r.score for r in lexical.scores(df, q).collect()}
    assert all(abs(every[r.query_id, r.chunk_id] - r.score) < 1e-8 for r in got)


def test_bm25_bounds_leave_nothing_out(monkeypatch):
    rng = np.random.default_rng(4)
    bag = lambda: rng.choice(40, size=rng.integers(1, 9), p=(p := 1 / np.arange(1, 41)) / p.sum())
    docs = {f"c{i:04d}": bag().tolist() for i in rng.permutation(900)}
    docs |= {f"{c}-copy": t for c, t in list(docs.items())[::3]}  # ties, also where parts meet
    weights = {(q, int(t)): float(rng.uniform(0.1, 3)) for q in range(60) for t in set(bag())} | {(60, 0): 0.0, (60, 7): 1.0, (61, 1): -1.0, (61, 2): 0.5, (62, 99): 1.0}
    rows = pd.DataFrame([(q, f"t{t}", w) for (q, t), w in weights.items()], columns=["bag_no", "term", "weight"])
    cells = [(c, len(t), [f"t{x}" for x in dict.fromkeys(t)], [t.count(x) for x in dict.fromkeys(t)]) for c, t in docs.items()]
    batches = [pa.record_batch(list(map(list, zip(*cells[at : at + 170]))), ["chunk_id", "n", "terms", "tfs"]) for at in range(0, len(cells), 170)]
    want = {}
    for q in range(63):
        of = {t: w for (p, t), w in weights.items() if p == q}
        part = lambda t, x: t.count(x) * 2.5 / (t.count(x) + 1.5 * (0.25 + 0.75 * len(t) / 4))
        every = [(-round(sum(w * part(t, x) for x, w in of.items() if x in t), 7), c) for c, t in docs.items() if set(of) & set(t)]
        want[q] = [c for _, c in sorted(every)[:7]]
    for first, then in ((2_048, 16_384), (20, 130)):
        monkeypatch.setattr(lexical, "FIRST", first)
        monkeypatch.setattr(lexical, "ROWS", then)
        got = {q: [] for q in range(63)}
        for b in lexical._scored(iter(batches), lexical._packed(rows), 4, 7):
            for q, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got[q].append(c)
        assert got == want


def test_terms_are_found_once(spark):
    df = spark.createDataFrame([("a", "One two twoThree two"), ("b", None), ("c", " . "), ("d", "")], "chunk_id string, text string")
    held = lexical.counted(df)
    assert [(r.chunk_id, r.n, dict(zip(r.terms, r.tfs))) for r in held.collect()] == [("a", 5, {"one": 1, "two": 3, "three": 1})]
    assert held._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_bm25_passes(spark, monkeypatch):
    df = spark.createDataFrame([("a", "w1 w2"), ("b", "w2 w3 w4")], "chunk_id string, text string")
    q = spark.createDataFrame([(i, f"w{i} w2") for i in range(5_000)], "query_id int, query string")
    passes, write = [], lexical.runtime.materialise
    monkeypatch.setattr(lexical.runtime, "materialise", lambda df, name: passes.append(name) or write(df, name))
    assert lexical.bm25(df, q, 1).count() == 5_000 and passes.count("block") == 1


def test_exact_and_hashed_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 16))
    v[1] = v[0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(400, [0.0] * 16), (401, [1.0]), (402, None)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    q = spark.createDataFrame([(i, r) for i, r in rows[:20]] + [(999, None)], "query_id long, vector array<float>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = vector.top_k(df, q, 5, block=7).orderBy("query_id", "rank").collect()
    for i in range(20):
        s = unit @ unit[i]
        want = sorted(range(400), key=lambda j: (-round(s[j], 5), j))[:5]
        assert {r.id for r in got if r.query_id == i} == set(want)
    for group in (20_000, 30):  # whole cells, and cells in many parts
        near = vector.in_cells(df, q, 5, group=group)
        assert vector.recall(near, vector.top_k(df, q, 5)).first()[0] >= 0.9
    grouped = np.repeat(rng.normal(size=(10, 16)) * 6, 40, axis=0) + v[:400]
    index = vector.fit_cells(spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(grouped)], "id long, vector array<float>"), 5)
    assert index.probes < len(index.centroids) / 2  # what falls into groups is found in few cells
    assert vector.in_cells(df.limit(0), q, 5).count() == 0 and vector.in_cells(df, q.limit(0), 5).count() == 0
    assert vector.recall(near, vector.top_k(df, q, 5)).first()[0] >= 0.9
    assert vector.top_k(df.limit(0), q, 5).count() == 0 and vector.top_k(df, q.limit(0), 5).count() == 0


def test_vector_bounds_leave_nothing_out(monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.integers(-2, 3, size=(700, 4)).astype(float)  # many ties
    rows = [list(x) for x in v] + [[1.0], [0.0] * 4]
    ids = rng.permutation(len(rows))
    known = [list(x) for x in rng.integers(-2, 3, size=(30, 4)).astype(float)] + [[2.0], [0.0] * 4]
    unit = lambda x: np.array(x) / (np.linalg.norm(x) or 1)
    of = lambda q, x: round(float(unit(q) @ unit(x)), 8) + 0.0 if len(q) == len(x) else 0.0
    batches = [pa.record_batch([pa.array(ids[at : at + 90]), pa.array(rows[at : at + 90])], ["id", "vector"]) for at in range(0, len(rows), 90)]
    for first, then in ((1_024, 4_096), (10, 33)):
        monkeypatch.setattr(vector, "FIRST", first)
        monkeypatch.setattr(vector, "ROWS", then)
        query, near, _ = vector._scored(iter(batches), known, 6)
        for n, q in enumerate(known):
            assert near[query == n].tolist() == [i for _, i in sorted((-of(q, x), int(i)) for i, x in zip(ids, rows))[:6]]


def test_compare_is_full_outer(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "z", 1)], "query_id int, chunk_id string, rank int")
    got = fusion.compare(a, b).orderBy("rank").collect()
    assert [(r.vector_chunk, r.hybrid_chunk) for r in got] == [("x", "z"), ("y", None)]
    assert fusion.clamp_k(F.lit(99)) is not None
