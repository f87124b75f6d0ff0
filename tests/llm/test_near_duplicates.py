import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from siltstone import runtime
from siltstone.llm import near_duplicates as nd

S = nd.Settings(shingle=3, threshold=0.5, min_words=12, bands=40, rows=3, min_shared=2)


def brute(rows, s):
    sets = {}
    for i, t in rows:
        w = nd.words(t) if t else []
        if i is not None and len(w) >= max(s.min_words, s.shingle):
            sets[i] = {tuple(w[k : k + s.shingle]) for k in range(len(w) - s.shingle + 1)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= s.threshold}


def corpus(seed=4, n=40):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        base = [r.choice(vocab) for _ in range(60)]
        for c in range(r.choice((1, 1, 2, 4))):
            text = list(base)
            for _ in range(c * 3):
                text[r.randrange(len(text))] = r.choice(vocab)
            rows.append((i * 10 + c, " ".join(text)))
    copies = [(1000 + k, rows[0][1].upper()) for k in range(5)]
    return rows + copies + [rows[3], (2000, None), (2001, ""), (2002, "too short"), (None, rows[0][1]), (2003, "İ" + rows[5][1]), (2004, "a b c " * 4000)]


def found(spark, rows, s):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "hit_id long, text string, id string, cls int")
    return {tuple(r) for r in nd.all_pairs(nd.near_duplicates(df, "hit_id", "text", s)).collect()}


def test_pairs_against_brute_force(spark):
    rows = corpus()
    assert found(spark, rows, S) == brute(rows, S)


def test_hot_buckets_take_the_exact_way(spark):
    rows = corpus(5, 12)
    tight = nd.Settings(shingle=3, threshold=0.5, min_words=12, bands=40, rows=3, min_shared=2, bucket_cap=1)
    assert found(spark, rows, tight) == brute(rows, tight)


def test_any_number_of_partitions_gives_the_same(spark):
    """A class counts once in a bucket, over however many tasks its copies lie, and whatever the cap."""
    rows = corpus(7, 8) + [(5000 + k, corpus(7, 8)[2][1]) for k in range(40)]
    df = spark.createDataFrame([r for r in rows if r[0] is not None], "id long, text string")
    for cap in (2, 3, 64):
        s = nd.Settings(shingle=3, threshold=0.5, min_words=12, bands=40, rows=3, min_shared=2, bucket_cap=cap, salts=3)
        for n in (1, 7):
            got = {tuple(r) for r in nd.all_pairs(nd.near_duplicates(df.repartition(n), "id", "text", s)).collect()}
            assert got == brute(rows, S), (cap, n)


def test_agreement_keeps_pairs_at_the_threshold():
    """Of pairs whose minima agree as often as at the threshold, the signature check loses fewer than one in a thousand."""
    import numpy as np

    least, r = nd.least_agreement(S), np.random.default_rng(1)
    width = S.bands * S.rows
    agree = r.binomial(width, S.threshold + (1 - S.threshold) / 256, 20_000) / width
    assert (agree < least).mean() < 1e-3 and least > 0.25


def test_groups(spark):
    rows = [r for r in corpus(6, 15) if r[0] is not None]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r for r in nd.groups(df, "id", "text", S).collect()}
    assert set(got) == {i for i, _ in rows}
    parent = {i: i for i in got}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(rows, S):
        parent[max(top(a), top(b))] = min(top(a), top(b))
    assert all(got[i].group_id == top(i) for i in got)
    assert got[2000].group_id == 2000 and got[2000].links == 0


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (3, 4), (4, 5), (9, 8)], [(i, i + 1) for i in range(30)], []])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "id_a long, id_b long")
    got = {r.node: r.component for r in nd.components(df).collect()}
    assert all(got[a] == got[b] for a, b in edges) and all(c <= n for n, c in got.items())


def test_empty(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert nd.all_pairs(nd.near_duplicates(df, "id", "text", S)).count() == 0 and nd.groups(df, "id", "text", S).count() == 0


def test_a_stock_phrase_sends_nothing_the_exact_way(spark, monkeypatch):
    """A phrase that all texts have crowds single keys; of the texts that share it only those with a second key in common
    are pairs, and the table isn't taken apart into shingles."""
    r = random.Random(11)
    rows = [(i, " ".join([f"v{r.randrange(5000)}" for _ in range(14)] + [f"s{k}" for k in range(10)] + [f"v{r.randrange(5000)}" for _ in range(14)])) for i in range(240)]
    rows += [(1000 + i, rows[i][1].replace("v", "u", 1)) for i in range(0, 60, 3)]
    s = nd.Settings(shingle=3, threshold=0.5, min_words=12, bands=40, rows=3, min_shared=2, bucket_cap=32)
    df = spark.createDataFrame(rows, "id long, text string")
    sizes = {}
    for row in nd.signatures(df, s).collect():
        for key in row["keys"] or []:
            sizes[key] = sizes.get(key, 0) + 1
    assert max(sizes.values()) > s.bucket_cap
    monkeypatch.setattr(nd, "shingle_rows", lambda *_: pytest.fail("the exact way"))
    assert {tuple(r) for r in nd.all_pairs(nd.near_duplicates(df, "id", "text", s)).collect()} == brute(rows, s)


def test_shuffles_go_with_the_table_they_were_for(spark):
    files = lambda: {f for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split() if "shuffle_" in f}
    before = files()
    held = runtime.materialise(spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).count(), "counts")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and held.count() == 97 and spark.conf.get(runtime.CLEANUP) == "false"
