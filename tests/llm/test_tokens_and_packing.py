import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import packing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")
SCHEMA = "doc_id long, text string, source string, row string, ids string, n string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i % 3}" if i % 7 else None, "clash", "clash", "clash") for i, t in enumerate(texts)], SCHEMA)


TEXTS = ["", None, "one two", "  lead\n\n\nThat isn't   it's  \t end ", "été 漢字 🙂👨‍🔧 ½", "<|endoftext|>", "x" * 3_000, "word " * 2_000, "a\n\n b\r\n\r\n\tc" * 400, "'s 're 12 345 _-_ " * 300, " " * 900 + "z"]


def test_encoding_is_exact_for_any_chunk(spark):
    plain = tokens.encoder(tokens.read_vocabulary()).encode_ordinary
    df = table(spark, TEXTS)
    for chunk, overlap in ((10**6, 10), (120, 40), (64, 8)):
        got = {r.doc_id: r.ids for r in tokens.encode(df, "doc_id", "text", chunk=chunk, overlap=overlap).collect()}
        assert len(got) == len(TEXTS)
        for i, t in enumerate(TEXTS):
            assert got[i] == plain(t or ""), (i, chunk)
    counted = {r.doc_id: r.n for r in tokens.token_counts(df, "doc_id", "text", ["source"], chunk=120, overlap=40).collect()}
    assert counted == {i: len(plain(t or "")) for i, t in enumerate(TEXTS)}


def test_round_trip_and_repeats(spark):
    df = table(spark, TEXTS)
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df, "doc_id", "text", chunk=100, overlap=30), "doc_id").collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    twice = tokens.encode(df.unionByName(df), "doc_id", "text", chunk=100, overlap=30)
    assert twice.count() == 2 * len(TEXTS) and tokens.encode(df.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 100), st.sampled_from("abc")), max_size=60))
def test_fill(items):
    sizes, sources = [n for n, _ in items], [s for _, s in items]
    total = sum(sizes) or 1
    share = {s: sum(n for n, x in items if x == s) / total for s in "abc"}
    placed = packing.fill(sizes, sources, share, {}, 100)
    assert sorted(i for i, _, _ in placed) == list(range(len(items)))
    used = {}
    for i, w, _ in placed:
        used[w] = used.get(w, 0) + sizes[i]
    assert all(u <= 100 for u in used.values())
    full = [used[w] for w in sorted(used)]
    assert all(a + b > 100 for a, b in zip(full, full[1:]))  # else what is in the later one would have fitted


def test_packing(spark):
    texts = [f"word{i} " * (i % 90 + 1) for i in range(300)] + ["token " * 5_000, "", None]
    df = table(spark, texts)
    got = packing.pack_documents(df, capacity=512, lane_tokens=20_000).collect()
    plain = tokens.encoder(tokens.read_vocabulary()).encode_ordinary
    sizes = {i: len(plain(t or "")) for i, t in enumerate(texts)}
    by_doc, by_container = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
        by_container[r.container_id] = by_container.get(r.container_id, 0) + r.n_tokens
    for i, n in sizes.items():
        spans = sorted(by_doc[i])
        assert sum(k for _, k in spans) == n and (len(spans) == 1 or n > 512)
        assert all(a + k == b for (a, k), (b, _) in zip(spans, spans[1:]))
    assert max(by_container.values()) <= 512
    assert sum(sizes.values()) / (512 * sum(v > 0 for v in by_container.values())) > 0.93
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_no_long_document_is_lost(spark, tmp_path):
    """A table of one file, its long texts over the default chunk, with adaptive execution as on a cluster."""
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    texts = [f"word{i} and so on " * (1_500 if i % 9 == 0 else 5) for i in range(60)] + [None, "", "long " * 20_000]
    table(spark, texts).unionByName(table(spark, texts[-1:])).coalesce(1).write.parquet(f"{tmp_path}/one")
    df = spark.read.parquet(f"{tmp_path}/one")
    plain = tokens.encoder(tokens.read_vocabulary()).encode_ordinary
    want = sorted([(i, len(plain(t or ""))) for i, t in enumerate(texts)] + [(0, len(plain(texts[-1])))])
    assert sorted((r.doc_id, r.n) for r in tokens.token_counts(df, "doc_id", "text", ["source"]).collect()) == want
    packed = {}
    for r in packing.pack_documents(df, lane_tokens=30_000).collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.n_tokens
    assert packed == {i: sum(n for j, n in want if j == i) for i, _ in want}


def test_what_lanes_owe(spark):
    rows = [(lane, s, 100 * (lane % 7) + k) for lane in range(50) for k, s in enumerate("abc") if (lane + k) % 4]
    total = sum(n for _, _, n in rows)
    got = {(r.lane, r.source): r.owed for r in packing.owed_by_lane(spark.createDataFrame(rows, "lane long, source string, n long"), total).collect()}
    assert set(got) == {(lane, s) for lane, s, _ in rows}
    for lane, s, _ in rows:
        share = sum(n for _, x, n in rows if x == s) / total
        owed = share * sum(n for a, _, n in rows if a < lane) - sum(n for a, x, n in rows if a < lane and x == s)
        assert abs(got[lane, s] - owed) < 1e-6


def test_mixture_is_held(spark):
    rows = [(i, "hot" if i % 3 else "rare", 40 + i % 60) for i in range(6_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    got = packing.pack(df, 2_048, 100_000).join(df.select("doc_id", "source"), "doc_id").toPandas()
    share = got.groupby("source").n_tokens.sum() / got.n_tokens.sum()
    each = got.pivot_table(index="container_id", columns="source", values="n_tokens", aggfunc="sum", fill_value=0)
    whole = each[each.sum(axis=1) > 1_900]
    assert len(whole) > 100 and ((whole["rare"] / whole.sum(axis=1)) - share["rare"]).abs().quantile(0.9) < 0.1
