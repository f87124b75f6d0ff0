import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import html
from siltstone.functions import text as tx
from siltstone.operators import chunking

texts = st.text(alphabet=st.sampled_from("aBc9Z _-.\n\r\t\x0b\x1c\x85\xa0\u2003\u2028éüſİ漢"), max_size=60)


def model_tokens(t):
    return re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", t).lower())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(texts, min_size=5, max_size=30))
def test_native_expressions_agree_with_python(spark, rows):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = df.select("i", tx.tokens(F.col("t")).alias("tokens"), tx.words(F.col("t")).alias("words"), tx.lines(F.col("t")).alias("lines"), chunking.word_windows(F.col("t"), 3, 1).alias("w")).collect()
    for r in got:
        t = rows[r.i]
        assert r.tokens == model_tokens(t)
        assert r.words == t.split()
        assert r.lines == t.splitlines()
        assert r.w == chunking.windows(t, 3, 1)


def test_excerpts(spark):
    long = "x" * 300 + " harbour " + "y " * 600
    df = spark.createDataFrame([("short", "q"), (long, "Where is the harbour"), (None, "q")], "t string, q string")
    rows = df.select(tx.display_excerpt(F.col("t")).alias("d"), tx.prompt_excerpt(tx.squeeze(F.col("t")), F.col("q")).alias("p")).collect()
    assert rows[0] == ("short", "short")
    assert rows[1].d == "x" * 259 + "..." and "harbour" in rows[1].p and rows[1].p.startswith("...") and rows[1].p.endswith("...")
    assert rows[2] == (None, None)


def test_cosine_and_declines(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(tx.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    said = spark.createDataFrame([("These Do Not Contain it",), ("yes",)], "a string")
    assert [r[0] for r in said.select(tx.declines(F.col("a"))).collect()] == [True, False]


def test_html():
    page = "<head><title>t</title></head><nav>menu</nav><p>One &amp; two</p><script>if (a</p>b) x</script><ul><li>three</li></ul>"
    assert html.body_text(page) == "One & two\nthree"
    assert html.body_text(None) is None and html.body_text("") == ""


def test_iso_suffix_and_ids(spark):
    df = spark.createDataFrame([("r", "a/b.TS", 0), ("r", "a/.bashrc", 86_399)], "r string, p string, ts long")
    rows = df.select(tx.iso_utc(F.col("ts")).alias("t"), tx.suffix(F.col("p")).alias("s"), tx.chunk_id(F.col("r"), F.col("p"), F.lit(0)).alias("c")).collect()
    import hashlib

    assert [r.t for r in rows] == ["1970-01-01T00:00:00Z", "1970-01-01T23:59:59Z"]
    assert [r.s for r in rows] == [".ts", ""]
    assert rows[0].c == hashlib.sha1(b"r:a/b.TS:0").hexdigest()


def test_html_to_text_of_all_hits(spark, tmp_path):
    from siltstone.plans import registry

    rows = [(1, "a  b\n\n c"), (2, "x<!-- gone -->y"), (3, "<!doctype html>z"), (4, "<p>p</p>"), (5, None), (6, "")]
    spark.createDataFrame(rows, "hit_id long, text string").write.parquet(f"{tmp_path}/search_hits.parquet")
    assert {r.hit_id: r.text for r in registry.html_to_text(spark, str(tmp_path)).collect()} == {1: "a b\nc", 2: "xy", 3: "z", 4: "p", 5: None, 6: ""}


def test_display_excerpt_of_all_documents(spark, tmp_path):
    """Against brute force: tags to blanks, then references, then white space, then the cut."""
    import html as references

    from siltstone.plans import registry

    rows = [(1, "plain text"), (2, "a &amp; b &lt;c&gt; <b>d</b>"), (3, "R&D stays"), (4, None), (5, ""), (6, "<p>x</p> &eacute;&nbsp;y " + "word &amp; " * 80), (7, "&#169; " * 90)]
    spark.createDataFrame([(*r, "r", "p.md") for r in rows], "doc_id long, text string, source string, file_path string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in rows:
        if t is not None:
            t = re.sub(r"\s+", " ", references.unescape(re.sub("<[^>]+>", " ", t))).strip()
            want[i] = t if len(t) <= 260 else t[:259].rstrip() + "..."
    assert {r.doc_id: r.excerpt for r in registry.display_excerpt(spark, str(tmp_path)).collect()} == want
