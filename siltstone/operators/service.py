"""Whole passes: an ingest pass over all sources, a batch of searches, and a batch of questions with answers.

Each is one plan over batches of requests or documents: nothing is done request by request.

``search`` takes requests (query_id, t, caller, internal, query, top_k) and decides, in this order, what each gets:

1. internal callers (marked, and from a local address) are neither limited, guarded nor logged;
2. a request over its caller's rate is ``limited``: no hits, not logged, as it never came in;
3. an invalid one is ``invalid``; it has spent its caller's rate;
4. a guarded one is ``refused``: logged with no hits;
5. the rest is ``answered``: by vectors and keywords, or by keywords alone where there is no vector.

``ask`` differs in one thing: the guard comes before the rate, so a refused question doesn't spend it.

Null queries and callers are ordinary: a null query is invalid, a null caller is one caller. Empty tables give no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import runtime
from siltstone.functions import html
from siltstone.functions import text as tx
from siltstone.operators import admission, answers, chunking, convergence, embedding, fusion, lexical, querylog, vector
from siltstone.settings import Settings


# -- ingest -----------------------------------------------------------------------------------
def chunked(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The chunks of the documents' last versions in order of ``source_order``."""
    last = convergence.last_wins(documents, ["source_repo", "file_path"], [F.col("source_order")])
    return chunking.chunk(last.drop("source_order"), s.chunk_words, s.chunk_overlap_words)


def ingest(spark: SparkSession, documents: DataFrame, store: str, version: str, now_iso: str, embedder: embedding.Embedder, s: Settings = Settings()) -> dict[str, int]:
    """One pass over all sources, which ``documents`` (source_repo, file_path, doc_type, text, source_order) are: chunks,
    vectors, and a new snapshot. Idempotent: the same documents give the same chunks. A failure leaves the old snapshot.
    Returns the counts of documents, chunks, deleted and skipped."""
    chunks = runtime.materialise(chunked(documents, s), "chunks")
    vectors = embedding.embed(chunks, embedder, s.embed_batch, "chunk_id", "text")
    whole = runtime.materialise(chunks.join(vectors.withColumnRenamed("vector", "embedding"), "chunk_id").withColumn("last_updated", F.lit(now_iso)), "embedded")
    before = convergence.current(spark, store)
    stats = convergence.pass_stats(whole.limit(0) if before is None else before, whole, documents).first().asDict()
    convergence.publish(whole, store, version, marker=now_iso)
    runtime.drop(chunks)
    runtime.drop(whole)
    return stats


# -- search -----------------------------------------------------------------------------------
def decided(requests: DataFrame, s: Settings = Settings(), guard_first: bool = False) -> DataFrame:
    """``requests`` with ``exempt``, ``category`` of the guard, ``decision`` and ``k``."""
    told = requests.withColumn("exempt", F.coalesce(admission.is_internal(F.col("caller"), F.col("internal")), F.lit(False)))
    told = told.withColumn("category", F.when(~F.col("exempt"), admission.guard(F.col("query"))))
    held = runtime.materialise(told, "requests")
    spends = ~F.col("exempt") & (F.col("category").isNull() if guard_first else F.lit(True))
    limits = admission.rate_limit(held.where(spends), "caller", "t", "query_id", s.rate_limit_per_hour, admission.WINDOW_S)
    met = held.join(limits.select("query_id", "accepted"), "query_id", "left")
    over, bad = ~F.coalesce("accepted", F.lit(True)), admission.invalid(F.col("query"), F.col("top_k")).isNotNull()
    refused = F.col("category").isNotNull()
    decision = F.when(refused, "refused").when(over, "limited").when(bad, "invalid") if guard_first else F.when(over, "limited").when(bad, "invalid").when(refused, "refused")
    return met.select(*requests.columns, "exempt", "category", decision.otherwise("answered").alias("decision"), fusion.clamp_k(F.col("top_k")).alias("k"))


def ranked(chunks: DataFrame, queries: DataFrame, worded_only: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank, degraded) for queries (query_id, query, vector, k), each to its own k; those
    without a vector by keywords alone. If none has one (``worded_only``) nothing is fused, so no pool beyond the largest k is
    needed."""
    pool = F.greatest(F.col("k") * fusion.POOL_FACTOR, F.lit(fusion.POOL_LEAST))
    most = fusion.K_MAX if worded_only else fusion.pool_size(fusion.K_MAX)
    wants = queries.select("query_id", "k", F.col("vector").isNull().alias("degraded"))
    worded = lexical.bm25(chunks, queries, most).select("query_id", F.lit("lexical").alias("retriever"), "chunk_id", "rank")
    near = vector.top_k(chunks.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), queries, most)
    near = near.join(chunks.select("chunk_id", F.col("vec_id").alias("id")), "id").select("query_id", F.lit("vector").alias("retriever"), "chunk_id", "rank")
    pooled = near.unionByName(worded).join(wants, "query_id").where(F.col("rank") <= F.when(F.col("degraded"), F.col("k")).otherwise(pool))
    best = fusion.rrf(pooled).join(wants, "query_id").where(F.col("rank") <= F.col("k"))
    met = best.select("query_id", "chunk_id", "rank", "degraded").join(chunks.select("chunk_id", "embedding"), "chunk_id").join(queries.select("query_id", "vector"), "query_id")
    score = F.coalesce(tx.cosine(F.col("embedding"), F.col("vector")), F.lit(0.0))
    return met.select("query_id", "chunk_id", score.alias("score"), "rank", "degraded")


@dataclass(frozen=True)
class Searched:
    """decisions: every request with its decision. hits: what was found. log: what the query log gets."""

    decisions: DataFrame
    hits: DataFrame
    log: DataFrame


def search(requests: DataFrame, chunks: DataFrame, embedder: embedding.Embedder | None, s: Settings = Settings(), guard_first: bool = False) -> Searched:
    """``chunks``: as stored, with vec_id and embedding. Without an embedder, or if it is unavailable, answers come from
    keywords alone and say so. What the log gives as ``took_ms`` is the time of the whole batch, in which all were answered
    together."""
    began = time.monotonic()
    decisions = runtime.materialise(decided(requests, s, guard_first), "decisions")
    queries = decisions.where(F.col("decision") == "answered").select("query_id", "query", "k")
    degraded = embedder is None
    if embedder is not None:
        try:  # each distinct text is embedded once
            vectors = runtime.materialise(embedding.embed(queries.select("query").distinct(), embedder, s.embed_batch, "query", "query"), "vectors")
        except Exception as gone:  # noqa: BLE001 - raised in a task, so its type is only in the message
            if "Unavailable" not in str(gone):
                raise
            degraded = True
    asked = queries.withColumn("vector", F.lit(None).cast("array<double>")) if degraded else queries.join(vectors, "query", "left")
    hits = runtime.materialise(fusion.hydrate(ranked(chunks, asked, degraded), chunks), "hits")
    counts = hits.groupBy("query_id").agg(F.count("*").cast("int").alias("result_count"))
    logged = decisions.where(~F.col("exempt") & F.col("decision").isin("answered", "refused"))
    log = logged.join(counts, "query_id", "left").select(F.col("query_id").alias("id"), F.col("t").cast("bigint").alias("ts"), querylog.entry(F.col("query")).alias("query"), F.coalesce("result_count", F.lit(0)).alias("result_count"), F.lit(int((time.monotonic() - began) * 1_000)).alias("took_ms"))
    return Searched(decisions, hits, log)


def responses(found: Searched) -> DataFrame:
    """(query_id, decision, body): the JSON of each request's response, its hits in order; none for one without any."""
    shown = F.struct("text", "source_repo", "file_path", "doc_type", "last_updated", "chunk_index", "score")
    per = found.hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", shown.alias("hit")))).alias("h"), F.max("degraded").alias("degraded"))  # at most k a request
    met = found.decisions.select("query_id", "decision", "query").join(per, "query_id", "left")
    hits = F.coalesce(F.col("h.hit"), F.array().cast(met.select("h.hit").schema[0].dataType))
    return met.select("query_id", "decision", F.to_json(F.struct("query", hits.alias("hits"), F.coalesce("degraded", F.lit(False)).alias("degraded"))).alias("body"))


# -- answers ----------------------------------------------------------------------------------
Answerer = Callable[[str], str]
LATE, GONE = "late", "gone"


def prompts(hits: DataFrame, questions: DataFrame, domain: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, prompt): the question behind numbered passages, each with its place and the part nearest the question."""
    met = hits.join(questions.select("query_id", F.col("query").alias("question")), "query_id")
    met = met.withColumn("plain", html.plain(F.col("text")))
    part = tx.prompt_excerpt(F.col("plain"), F.col("question"), domain=domain)
    passage = F.format_string("[%d] %s, %s\n%s", F.col("rank"), F.col("source_repo"), F.col("file_path"), part)
    each = met.select("query_id", "question", F.struct("rank", passage.alias("passage")).alias("p"))
    ordered = each.groupBy("query_id", "question").agg(F.sort_array(F.collect_list("p")).alias("p"))  # at most k a question
    task = "Use nothing but the numbered passages. Two sentences at most, with the numbers of the passages used in brackets. Say so if the passages do not answer the question."
    return ordered.select("query_id", F.concat(F.lit(task + "\n\n"), F.array_join("p.passage", "\n\n"), F.lit("\n\nQuestion: "), F.col("question")).alias("prompt"))


def written(prompted: DataFrame, answerer: Answerer) -> DataFrame:
    """(query_id, said, failure): what the model says to each prompt. A model that takes too long (TimeoutError) or can't
    be reached (embedding.Unavailable, OSError) fails that answer alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said, failure = [], []
            for prompt in pdf["prompt"]:
                try:
                    said.append(answerer(prompt).strip())
                    failure.append(None)
                except TimeoutError:
                    said.append(None)
                    failure.append(LATE)
                except (embedding.Unavailable, OSError):
                    said.append(None)
                    failure.append(GONE)
            yield pd.DataFrame({"query_id": pdf["query_id"], "said": pd.Series(said, dtype=object), "failure": pd.Series(failure, dtype=object)})

    return prompted.select("query_id", "prompt").mapInPandas(run, T.StructType([prompted.schema["query_id"], T.StructField("said", T.StringType()), T.StructField("failure", T.StringType())]))


def ask(requests: DataFrame, chunks: DataFrame, embedder: embedding.Embedder | None, answerer: Answerer | None, s: Settings = Settings()) -> DataFrame:
    """(query_id, decision, answer, n_sources, degraded) of each request. Without hits there is no answer; without a vector
    or a model the closest passages stand for one; an empty reply or one that declines has no sources."""
    found = search(requests, chunks, embedder, s, guard_first=True)
    questions = found.decisions.where(F.col("decision") == "answered").select("query_id", "query")
    full = found.hits.where(~F.col("degraded"))
    replies = runtime.materialise(written(prompts(full, questions), answerer), "replies") if answerer else full.select("query_id", F.lit(None).cast("string").alias("said"), F.lit(GONE).alias("failure")).distinct()
    state = questions.join(found.hits.groupBy("query_id").agg(F.max("degraded").alias("degraded"), F.count("*").alias("n")), "query_id", "left").join(replies, "query_id", "left")
    unavailable = F.coalesce("degraded", F.lit(False)) | F.coalesce(F.col("failure") == GONE, F.lit(False))
    instead = answers.fallback(state.select("query_id", unavailable.alias("unavailable")), found.hits).select("query_id", F.col("answer").alias("i_answer"), F.col("n_sources").alias("i_sources"), F.col("degraded").alias("i_degraded"))
    met = state.select("query_id", "said", "failure", "n").join(instead, "query_id")
    model: Column = F.col("said").isNotNull()
    text = F.when(model & (F.col("said") == ""), answers.UNCLEAR).when(model, F.col("said")).otherwise(F.col("i_answer"))
    cited = F.when(model, F.when(tx.declines(text), 0).otherwise(F.least(F.col("n"), F.lit(answers.SOURCES_MAX)).cast("int"))).otherwise(F.col("i_sources"))
    answered = met.select("query_id", text.alias("answer"), cited.alias("n_sources"), F.when(model, False).otherwise(F.col("i_degraded")).alias("degraded"))
    rest = F.when(F.col("decision") == "refused", admission.refusal(F.col("category")))
    out = found.decisions.select("query_id", "decision", rest.alias("refusal")).join(answered, "query_id", "left")
    return out.select("query_id", "decision", F.coalesce("refusal", "answer").alias("answer"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.coalesce("degraded", F.lit(False)).alias("degraded"))


def compare(spark: SparkSession, store: str, texts: list[str], embedder: embedding.Embedder, best: int = 3) -> DataFrame:
    """``report`` for given query texts over the current snapshot of a store (chunks with vectors)."""
    chunks = convergence.current(spark, store)
    if chunks is None:
        raise ValueError(f"{store} has no snapshot")
    chunks = chunks.withColumn("vec_id", F.xxhash64("chunk_id"))
    vectors = [list(map(float, v)) for v in embedder(texts)]
    queries = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(zip(texts, vectors))], "query_id long, query string, vector array<double>")
    near = vector.top_k(chunks.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), queries, best).join(chunks.select("chunk_id", F.col("vec_id").alias("id")), "id")
    return report(near, fusion.hybrid_ids(chunks, queries, best), chunks, queries, best)


def report(vector_ids: DataFrame, hybrid: DataFrame, chunks: DataFrame, queries: DataFrame, best: int = 3) -> DataFrame:
    """(query_id, report): a Markdown table of both rankings side by side, a query each."""
    line = F.format_string("`%s` (%.3f) %s", F.regexp_replace(F.concat_ws("/", "source_repo", "file_path"), "^/+|/+$", ""), F.col("score"), F.substring(tx.squeeze(F.col("text")), 1, 70))
    side = lambda ids, name: fusion.hydrate(ids.where(F.col("rank") <= best).select("query_id", "rank", "score", "chunk_id"), chunks).select("query_id", "rank", line.alias(name))
    both = side(vector_ids, "a").join(side(hybrid, "b"), ["query_id", "rank"], "full_outer")
    row = F.format_string("| %d | %s | %s |", F.col("rank"), F.coalesce("a", F.lit("")), F.coalesce("b", F.lit("")))
    rows = both.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", row.alias("row")))).alias("r"))  # at most ``best`` a query
    return queries.join(rows, "query_id").select("query_id", F.concat(F.lit("## "), F.col("query"), F.lit("\n\n| # | vector | hybrid |\n|---|---|---|\n"), F.array_join("r.row", "\n")).alias("report"))
