import re
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from siltstone.llm import rank_fusion, term_counts

TERM = re.compile(r"[a-z0-9][a-z0-9\-]{2,}")


def test_terms_against_counter(spark):
    rows = [(1, "Tide tide tide-pool"), (1, "Tide tide tide-pool"), (-5, "tide"), (700, None), (701, ""), (702, "  "), (None, "tide"), (10**12, "x" * 400 + " Harbour"), (64, "tide ab 12a"), (63, "harbour")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, query string, term string")
    got = {r.term: (r.occurrences, r.records, r.mark) for r in term_counts.term_frequencies(df, "id", "query").collect()}
    held = {i: q for i, q in rows if i is not None and q is not None}
    occ, rec = Counter(), Counter()
    for q in held.values():
        terms = TERM.findall(q.lower())
        occ.update(terms)
        rec.update(set(terms))
    assert got == {t: (occ[t], rec[t], "rare" if rec[t] < 3 else "common" if rec[t] > 0.02 * len(held) else None) for t in occ}
    assert term_counts.term_frequencies(df.limit(0), "id", "query").count() == 0


def test_union_is_idempotent(spark):
    df = spark.createDataFrame([(1, "aaa bbb aaa"), (2, "aaa")], "id long, query string")
    one = term_counts.bitmaps(df, "id", term_counts.log_tokens(F.col("query")))
    twice = term_counts.frequencies(term_counts.union(one, one))
    assert sorted(map(tuple, twice.collect())) == [("aaa", 3, 2), ("bbb", 1, 1)]


def tail(r):
    r, n = sorted(r), len(r)
    return min(1.0, n * min(sum(comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(k, n + 1)) for k, x in enumerate(r, 1)))


def test_ranks(spark):
    rows = []
    for c in "abcd":
        for s, v in (("vector", 0.9), ("bm25", 900.0), ("age_days", 1.0)):
            rows.append((1, s, c, v - ord(c) if s != "age_days" else v + ord(c)))
    rows += [(1, "vector", "d", None), rows[0], (1, "vector", "e", float("nan")), (2, "vector", "x", 1.0), (2, "vector", "y", 1.0), (3, "vector", "z", None), (None, "vector", "a", 1.0), (1, None, "a", 1.0), (1, "clicks", None, 2.0), (1, "clicks", "b", float("inf")), (1, "clicks", "a", 5.0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "query_id long, retriever string, chunk_id string, score double, r string")
    got = {(r.query_id, r.chunk_id): r for r in rank_fusion.ranking(df).collect()}
    assert got[1, "a"].position == 1 and got[1, "e"].significance is None and got[1, "e"].position == 5
    assert abs(got[1, "a"].significance - tail([0.25, 0.25, 0.25, 1.0])) < 1e-9
    assert (got[2, "x"].position, got[2, "y"].position) == (1, 2) and got[2, "x"].significance == got[2, "y"].significance
    assert {(r.query_id, r.chunk_id) for r in rank_fusion.leaders(df).collect()} == {(1, "a"), (2, "x"), (3, "z")}
    assert rank_fusion.leaders(df.limit(0)).count() == 0


def test_grouped_rank_over_many_partitions(spark):
    df = spark.createDataFrame([("hot" if i % 3 else "cold", float(i % 50)) for i in range(600)], "g string, v double")
    got = rank_fusion.grouped_rank(df, ["g"], ["v"]).collect()
    for g in ("hot", "cold"):
        vs = sorted(r.v for r in got if r.g == g)
        assert all(r.before == vs.index(r.v) and r.equal == vs.count(r.v) and r.size == len(vs) for r in got if r.g == g)


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_scale_doesnt_matter(spark, scale):
    rows = [(1, "vector", c, s) for c, s in (("a", 0.9), ("b", 0.2))] + [(1, "bm25", c, s * scale) for c, s in (("a", 3.0), ("b", 1.0))]
    df = spark.createDataFrame(rows, "query_id long, retriever string, chunk_id string, score double")
    assert rank_fusion.leaders(df).first().chunk_id == "a"
