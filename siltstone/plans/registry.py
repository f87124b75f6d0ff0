"""The queries of the core and their SQL.

Each query runs over its whole tables. Where it needs a query set, that is every row whose id is divisible by 20,
against all rows. Driver tables stand in for the engine's own: documents for sources and chunks, embeddings for
vectors (paired with documents by number, a pairing of ours), queries for the log, events for requests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import runtime
from siltstone.functions import html
from siltstone.functions import text as tx
from siltstone.operators import admission, answers, changes, chunking, convergence, embedding, fusion, lexical, querylog, service, vector
from siltstone.settings import Settings
from siltstone.streaming import log_stream

Query = Callable[[SparkSession, str], DataFrame]
NOW = 1_775_000_000  # the "now" of log queries: always given, never a clock
SINCE, UNTIL = NOW - 30 * 86_400, NOW
DOMAIN = ("public", "widget", "system", "systems")  # words that an excerpt centres on only for want of others
EMBEDDER = embedding.HashedTerms(32)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumnRenamed("source", "source_repo")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of their own, one each, with the vector of the same number."""
    d = documents(spark, sf_dir).select(F.col("doc_id"), "source_repo", "file_path", "doc_type", "last_updated", "text")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    key = tx.chunk_id(F.col("source_repo"), F.col("file_path"), F.lit(0))
    return d.join(e, "doc_id", "left").select(key.alias("chunk_id"), F.col("doc_id").alias("vec_id"), "source_repo", "file_path", "doc_type", "last_updated", F.lit(0).alias("chunk_index"), "text", "embedding")


def text_chunks(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """``chunks`` without vectors, so without the join."""
    key = tx.chunk_id(F.col("source_repo"), F.col("file_path"), F.lit(0)).alias("chunk_id")
    d = documents(spark, sf_dir)
    return d.select(key, F.col("doc_id").alias("vec_id"), "source_repo", "file_path", "doc_type", "last_updated", F.lit(0).alias("chunk_index"), "text") if whole else d.select(key, "text")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): every logged query whose id is divisible by 20, once."""
    q = querylog.distinct_records(table(spark, sf_dir, "queries"))
    return q.where((F.col("id") % 20 == 0) & F.col("query").isNotNull()).select(F.col("id").alias("query_id"), "query")


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


# -- text and chunks ----------------------------------------------------------------------------
def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where(F.col("text").isNotNull()).select("doc_id", F.posexplode(tx.tokens(F.col("text"))).alias("at", "term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.min("at").alias("first_at"))


def word_window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.window_chunks(documents(spark, d).where(F.col("text").isNotNull())).select("chunk_id", "chunk_index", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def chunk_router(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).groupBy(chunking.kind_of(F.col("file_path"), F.col("doc_type")).alias("kind"), "doc_type").agg(F.count("*").alias("documents"))


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk(documents(spark, d))


def adr_records(spark: SparkSession, d: str) -> DataFrame:
    return chunking.records(documents(spark, d).where(F.col("doc_type") == "adr"))


def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "search_hits").dropDuplicates(["hit_id"])
    return hits.select("hit_id", html.html_to_text("text").alias("text"))


def display_excerpt(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where(F.col("text").isNotNull()).select("doc_id", tx.display_excerpt(html.plain(F.col("text"))).alias("excerpt"))


def prompt_excerpt(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "search_hits").dropDuplicates(["hit_id"]).where(F.col("text").isNotNull())
    q = querylog.distinct_records(table(spark, d, "queries")).select(F.col("id").alias("query_id"), "query")
    met = hits.join(q, "query_id").withColumn("plain", html.plain(F.col("text")))
    return met.select("hit_id", tx.prompt_excerpt(F.col("plain"), F.col("query"), domain=DOMAIN).alias("excerpt"))


# -- retrieval ----------------------------------------------------------------------------------
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.corpus_stats(text_chunks(spark, d))


def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    return lexical.idf(text_chunks(spark, d)).select("term", "df", F.round("idf", 9).alias("idf"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(text_chunks(spark, d), asked(spark, d), 10)


def lexical_degraded(spark: SparkSession, d: str) -> DataFrame:
    return fusion.degraded_ids(text_chunks(spark, d), asked(spark, d)).select("query_id", "chunk_id", "score", "rank")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vector.top_k(v, asked_vectors(spark, d), 10)


def cells_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vector.in_cells(v, asked_vectors(spark, d), 10)


def cells_recall(spark: SparkSession, d: str) -> DataFrame:
    return vector.recall(cells_topk(spark, d), vector_topk(spark, d))


def cells_recall_enough(spark: SparkSession, d: str) -> DataFrame:
    return cells_recall(spark, d).select((F.col("recall") >= 0.9).alias("enough"))


def hybrid_queries(spark: SparkSession, d: str) -> DataFrame:
    """Logged queries of the set, with the vector of the same number where there is one."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return asked(spark, d).join(v, "query_id")


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return fusion.hybrid_ids(chunks(spark, d), hybrid_queries(spark, d)).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


def search_hits_hydrated(spark: SparkSession, d: str) -> DataFrame:
    q = asked(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id", "left")
    return fusion.search(chunks(spark, d), q)


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of the rankings of search_hits by score and by hit_rank."""
    from pyspark.sql import Window as W

    h = table(spark, d, "search_hits").dropDuplicates(["hit_id"]).where(F.col("query_id").isNotNull() & F.col("chunk_id").isNotNull()).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.min("hit_rank").alias("hit_rank"))
    by_score = h.where(F.col("score").isNotNull()).select("query_id", F.lit("score").alias("retriever"), "chunk_id", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")).alias("rank"))
    by_rank = h.select("query_id", F.lit("rank").alias("retriever"), "chunk_id", F.row_number().over(W.partitionBy("query_id").orderBy("hit_rank", "chunk_id")).alias("rank"))
    return fusion.rrf(by_score.unionByName(by_rank))


def compare_vector_hybrid(spark: SparkSession, d: str) -> DataFrame:
    c, q = chunks(spark, d), hybrid_queries(spark, d)
    near = vector.top_k(c.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), q, 3).join(c.select("chunk_id", F.col("vec_id").alias("id")), "id")
    return fusion.compare(near, fusion.hybrid_ids(c, q, 3))


def comparison_report(spark: SparkSession, d: str) -> DataFrame:
    """The comparison of both rankings as Markdown, one table for each query that has a vector."""
    c, q = chunks(spark, d), hybrid_queries(spark, d)
    near = vector.top_k(c.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), q, 3).join(c.select("chunk_id", F.col("vec_id").alias("id")), "id")
    return service.report(near, fusion.hybrid_ids(c, q, 3), c, q)


def embed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the distinct logged queries by hashed terms, as the places that aren't zero."""
    q = table(spark, d, "queries").where(F.col("query").isNotNull()).select("query").distinct()
    v = embedding.embed(q, EMBEDDER, 16, "query", "query")
    return v.select("query", F.posexplode("vector").alias("place", "value")).where(F.col("value") != 0).select("query", "place", F.round("value", 9).alias("value"))


def _callers(spark: SparkSession, d: str) -> DataFrame:
    """The log as requests: four callers in five from outside, some marked as internal, with top_k from 0 to 12."""
    q = querylog.distinct_records(table(spark, d, "queries")).where(F.col("ts").isNotNull())
    address = F.when(F.col("id") % 5 == 0, F.concat(F.lit("10.0.0."), F.col("id") % 7)).otherwise(F.concat(F.lit("8.8.4."), F.col("id") % 7))
    return q.select(F.col("id").alias("query_id"), F.col("ts").alias("t"), address.alias("caller"), (F.col("id") % 3 == 0).alias("internal"), "query", (F.col("id") % 13).cast("int").alias("top_k"))


def request_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What each request of the log gets, at six requests an hour for each caller."""
    return service.decided(_callers(spark, d), Settings(rate_limit_per_hour=6)).select("query_id", "decision", "k", "exempt")


def _asking(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The requests whose id is divisible by 20, and the documents as chunks with vectors by hashed terms."""
    c = text_chunks(spark, d, whole=True)
    v = embedding.embed(c, EMBEDDER, 16, "chunk_id", "text").withColumnRenamed("vector", "embedding")
    return _callers(spark, d).where(F.col("query_id") % 20 == 0), runtime.materialise(c.join(v, "chunk_id"), "embedded")


def service_search(spark: SparkSession, d: str) -> DataFrame:
    """The whole search path: decisions, embedding, both rankings, hits."""
    return service.search(*_asking(spark, d), EMBEDDER).hits.select("query_id", "rank", "chunk_id", "score", "degraded")


def service_log(spark: SparkSession, d: str) -> DataFrame:
    """What the search path logs."""
    return service.search(*_asking(spark, d), None).log.drop("took_ms")


def ask_answers(spark: SparkSession, d: str) -> DataFrame:
    """The whole answer path with a model that can't be reached: refusals, and passages in place of answers."""
    return service.ask(*_asking(spark, d), EMBEDDER, None)


def ingest_pass(spark: SparkSession, d: str) -> DataFrame:
    """Two whole ingest passes into a store of their own, the second without decisions; the counts of both."""
    docs = documents(spark, d).select("source_repo", "file_path", "doc_type", "text", F.lit(0).alias("source_order"))
    store = runtime.new_path(spark, "ingested")
    first = service.ingest(spark, docs, store, "first", "2026-01-01T00:00:00Z", EMBEDDER)
    second = service.ingest(spark, docs.where(F.col("doc_type") != "decision"), store, "second", "2026-01-02T00:00:00Z", EMBEDDER)
    return spark.createDataFrame([(n, *(x[c] for c in ("documents", "chunks", "deleted", "skipped"))) for n, x in (("first", first), ("second", second))], "run string, documents long, chunks long, deleted long, skipped long")


def fallback_answer(spark: SparkSession, d: str) -> DataFrame:
    q = querylog.distinct_records(table(spark, d, "queries")).select(F.col("id").alias("query_id"), (F.col("id") % 2 == 0).alias("unavailable"))
    h = table(spark, d, "search_hits").dropDuplicates(["hit_id"]).where(F.col("text").isNotNull()).select("query_id", F.col("hit_rank").alias("rank"), F.coalesce("score", F.lit(0.0)).alias("score"), "text", "source_repo", "file_path")
    return answers.fallback(q, h)


def answer_sources(spark: SparkSession, d: str) -> DataFrame:
    q = querylog.distinct_records(table(spark, d, "queries")).select(F.col("id").alias("query_id"), "query")
    h = table(spark, d, "search_hits").dropDuplicates(["hit_id"]).where(F.col("text").isNotNull()).withColumnRenamed("hit_rank", "rank")
    return answers.sources(h, q)


# -- upkeep -------------------------------------------------------------------------------------
def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The store before (chunks of 64 words) and the new pass (chunks of 96 words, without decisions)."""
    docs = documents(spark, d).where(F.col("text").isNotNull())
    key = tx.doc_key(F.col("source_repo"), F.col("file_path")).alias("doc_key")
    old = chunking.window_chunks(docs, 64, 8).select("chunk_id", key, F.lit("old").alias("version"))
    new = chunking.window_chunks(docs.where(F.col("doc_type") != "decision"), 96, 8).select("chunk_id", key, F.lit("new").alias("version"))
    return old, new


def converge_stale(spark: SparkSession, d: str) -> DataFrame:
    return convergence.stale(*_stored(spark, d)).groupBy("doc_key").agg(F.count("*").alias("stale"))


def converge_prune(spark: SparkSession, d: str) -> DataFrame:
    old, new = _stored(spark, d)
    return convergence.withdrawn(old, new.select("doc_key").distinct()).groupBy("doc_key").agg(F.count("*").alias("withdrawn"))


def converge_stats(spark: SparkSession, d: str) -> DataFrame:
    return convergence.pass_stats(*_stored(spark, d), documents(spark, d))


def converge_store(spark: SparkSession, d: str) -> DataFrame:
    """What a pass that saw all sources inserts, replaces and deletes."""
    return convergence.transitions(*_stored(spark, d)).groupBy("action").agg(F.count("*").alias("chunks"))


def dedup_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """The last version of each file in the feed."""
    feed = changes.versioned(table(spark, d, "index_entries")).select("key_repo", "key_path", "entry_id", "chunks")
    return convergence.last_wins(feed, ["key_repo", "key_path"], [F.col("entry_id")])


def dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    feed = changes.versioned(table(spark, d, "index_entries")).select("key_repo", "key_path", "entry_id", "chunks")
    return convergence.first_wins(feed, ["key_repo", "key_path"], [F.col("entry_id")])


def _hit_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that hits show, each as its first hit has it."""
    h = table(spark, d, "search_hits").where(F.col("source_repo").isNotNull() & F.col("file_path").isNotNull() & F.col("chunk_id").isNotNull())
    return convergence.first_wins(h.select("chunk_id", "hit_id", "chunk_index", "source_repo", "file_path", "doc_type", "last_updated", F.lit(None).cast("string").alias("doc_key")), ["chunk_id"], [F.col("hit_id")])


def index_listing(spark: SparkSession, d: str) -> DataFrame:
    return convergence.listed(_hit_chunks(spark, d))


def index_totals(spark: SparkSession, d: str) -> DataFrame:
    return convergence.totals(_hit_chunks(spark, d))


# -- log and admission ----------------------------------------------------------------------------
def guard_refusals(spark: SparkSession, d: str) -> DataFrame:
    q = querylog.distinct_records(table(spark, d, "queries")).select("id", admission.guard(F.col("query")).alias("category"))
    return q.where(F.col("category").isNotNull())


def request_validation(spark: SparkSession, d: str) -> DataFrame:
    q = querylog.distinct_records(table(spark, d, "queries")).withColumn("top_k", (F.col("id") % 13).cast("int"))
    return q.groupBy(admission.invalid(F.col("query"), F.col("top_k")).alias("problem"), fusion.clamp_k(F.col("top_k")).alias("k")).agg(F.count("*").alias("requests"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "event_id")


def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Three requests in a sliding 12 hours for each user."""
    return admission.rate_limit(_requests(spark, d), "user_id", "t", "event_id", 3, 43_200).select("event_id", "user_id", "accepted")


def query_stats(spark: SparkSession, d: str) -> DataFrame:
    return querylog.stats(table(spark, d, "queries"), NOW)


def top_terms(spark: SparkSession, d: str) -> DataFrame:
    return querylog.top_terms(table(spark, d, "queries"), SINCE, UNTIL, 5)


def window_summary(spark: SparkSession, d: str) -> DataFrame:
    return querylog.window_summary(table(spark, d, "queries"), SINCE, UNTIL).select("count", F.transform("top_terms", lambda x: F.concat(x["term"], F.lit("="), x["count"])).alias("top_terms"))


def hourly_log(spark: SparkSession, d: str) -> DataFrame:
    return querylog.hourly(table(spark, d, "queries"))


def hourly_windows(spark: SparkSession, d: str) -> DataFrame:
    """Every hour of the last thirty days, also the quiet ones."""
    return querylog.windows(table(spark, d, "queries"), SINCE, UNTIL)


def summary_payload(spark: SparkSession, d: str) -> DataFrame:
    got = querylog.summary_payload(table(spark, d, "queries"), "siltstone", SINCE, UNTIL, NOW)
    return got.withColumn("top_terms", F.transform("top_terms", lambda x: F.concat(x["term"], F.lit("="), x["count"])))


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream: a folder source over the table's own files."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    fs, p = runtime.hadoop_fs(spark, path)
    if fs.getFileStatus(p).isDirectory():
        return log_stream.source(spark, path, schema)
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def hourly_summary_stream(spark: SparkSession, d: str) -> DataFrame:
    """Counts of events by hour and type, by a stream that reads the table to its end and keeps its state and
    results below the shared folder."""
    out = runtime.new_path(spark, "stream")
    log_stream.keep_latest(log_stream.windowed_counts(_event_stream(spark, d), "ts", ["event_type"]), f"{out}/sink", f"{out}/checkpoint")
    return log_stream.latest(spark, f"{out}/sink", ["window_start", "event_type"], "events")


def rate_limit_stream(spark: SparkSession, d: str) -> DataFrame:
    """The rate limit with its state in a stream: what was accepted of each user."""
    out = runtime.new_path(spark, "limit")
    e = _event_stream(spark, d).select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    log_stream.run_available(log_stream.limited(e, "user_id", "t", 3, 43_200), f"{out}/sink", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/sink").groupBy(F.col("key").alias("user_id")).agg(F.count_if("accepted").alias("accepted"), F.count("*").alias("events"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents, ranked for logged queries by BM25 and vectors together, with their provenance."""
    return search_hits_hydrated(spark, sf_dir)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return changes.pending(t("index_entries"), t("processed_versions"), t("ingest_runs"))


def p3_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over three runs with stored offsets, the second of which dies before its commit."""
    t = lambda n: table(spark, sf_dir, n)
    feed = t("index_entries")
    middle = feed.agg(F.expr("percentile_approx(entry_id, 0.5)")).first()[0] or 0
    return changes.pending_in_runs(feed, t("processed_versions"), t("ingest_runs"), middle)


TOKENS = "regexp_extract_all(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+')"
WHITE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
LOG = "(select distinct on (id) * from queries)"
CHUNKS = "(select sha1(source || ':' || file_path || ':0') as chunk_id, doc_id, source, file_path, text, e.embedding from documents d left join embeddings e on e.vec_id = d.doc_id)"
BM25 = f"""
with chunk as (select chunk_id, {TOKENS} as terms from {CHUNKS} where text is not null),
kept as (select chunk_id, terms, len(terms) as n from chunk where len(terms) > 0),
st as (select count(*) as nc, avg(n) as av from kept),
df as (select term, count(*) as df from (select unnest(list_distinct(terms)) as term from kept) group by term),
raw as (select term, df, ln(nc - df + 0.5) - ln(df + 0.5) as raw from df, st),
mean as (select avg(raw) as mean from raw),
idf as (select term, df, round(case when raw < 0 then 0.25 * mean else raw end, 12) as idf from raw, mean),
post as (select term, chunk_id, n, count(*) as tf from (select chunk_id, n, unnest(terms) as term from kept) group by all),
ask as (select id as query_id, {TOKENS.replace('text', 'query')} as q from {LOG} where id % 20 = 0 and query is not null),
want as (select query_id, term, count(*) as qf from (select query_id, unnest(q) as term from ask) group by all),
scored as (select query_id, chunk_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / av))), 9) as score
  from want join idf using (term) join post using (term), st group by all),
ranked as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from scored)
"""
COSINE = "round(list_cosine_similarity({a}::double[], {b}::double[]), 9)"
HYBRID = BM25 + f""",
hq as (select query_id, e.embedding as vector from ask join embeddings e on e.vec_id = query_id),
near as (select query_id, chunk_id, row_number() over (partition by query_id order by {COSINE.format(a='c.embedding', b='vector')} desc, doc_id) as rank
  from hq, {CHUNKS} c where c.embedding is not null),
fused as (select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 12) as score from (
  select query_id, chunk_id, rank from near where rank <= 20 union all
  select query_id, chunk_id, rank from ranked where rank <= 20 and query_id in (select query_id from hq)) group by all),
top as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from fused)
"""
KEYED = r"""
(select coalesce(source_repo, '') as key_repo, array_to_string(list_filter(string_split(replace(trim(file_path), '\', '/'), '/'), lambda x: x <> '' and x <> '.'), '/') as key_path, entry_id, chunks
 from index_entries where file_path is not null and last_updated is not null)
"""
STORED = """
with w as (select source, file_path, doc_type, list_filter(regexp_split_to_array(text, '{white}'), lambda x: x <> '') as w from documents where text is not null),
old as (select source || ':' || file_path as doc_key, sha1(source || ':' || file_path || ':' || i) as chunk_id from (
  select source, file_path, unnest(range(case when len(w) <= 64 then 1 else cast(ceil((len(w) - 64) / 56.0) as bigint) + 1 end)) as i from w where len(w) > 0)),
new as (select source || ':' || file_path as doc_key, sha1(source || ':' || file_path || ':' || i) as chunk_id from (
  select source, file_path, unnest(range(case when len(w) <= 96 then 1 else cast(ceil((len(w) - 96) / 88.0) as bigint) + 1 end)) as i from w where len(w) > 0 and doc_type <> 'decision'))
""".replace("{white}", WHITE)
RATE = """with recursive s as (select event_id, user_id, cast(epoch(date_trunc('second', ts)) as bigint) as t, row_number() over (partition by user_id order by date_trunc('second', ts), event_id) as i from events),
f as (select s.*, true as accepted, [t] as held from s where i = 1 union all
select s.event_id, s.user_id, s.t, s.i, len(list_filter(f.held, lambda x: s.t - x <= 43200)) < 3 as accepted,
  case when len(list_filter(f.held, lambda x: s.t - x <= 43200)) < 3 then list_append(list_filter(f.held, lambda x: s.t - x <= 43200), s.t) else list_filter(f.held, lambda x: s.t - x <= 43200) end as held
from f join s on s.user_id = f.user_id and s.i = f.i + 1)
"""
# The guard once more, by other means: words cut out and set between single blanks, phrases looked up in that line.
_SAID = "(' ' || array_to_string(regexp_extract_all(lower(query), '[\\pL\\pM\\pN_]+'), ' ') || ' ')"
GUARD_SQL = f"""case
  when query is null then null
  when list_has_any(string_split({_SAID}, ' '), ['password', 'passwords', 'credential', 'credentials', 'token', 'tokens', 'secret', 'secrets'])
    or regexp_matches(lower(query), 'api\\s+keys?([^\\pL\\pM\\pN_]|$)|(access\\s+token|(secret|private)\\s+key)([^\\pL\\pM\\pN_]|$)') and regexp_matches({_SAID}, ' (api key|api keys|access token|secret key|private key) ') then 'credentials'
  when list_has_any(string_split({_SAID}, ' '), ['cv', 'resume', 'salary', 'interview']) or regexp_matches({_SAID}, ' (curriculum vitae|cover letter|job application) ') then 'career'
  when list_has_any(string_split({_SAID}, ' '), ['coursework', 'grades']) or regexp_matches({_SAID}, ' (lecture notes|study notes|exam marks) ') then 'study'
  when list_has_any(string_split({_SAID}, ' '), ['employer', 'colleague', 'colleagues', 'payroll']) or regexp_matches({_SAID}, ' (work laptop|internal tickets) ') then 'workplace'
  when regexp_matches({_SAID}, ' (passport|driving licence|tax number|national insurance|social security) ') then 'identity'
  when list_has_any(string_split({_SAID}, ' '), ['diary', 'medical']) or regexp_matches({_SAID}, ' (private notes|private memory|private collections?) ') then 'private'
end"""
# The character references that the tables hold; the ampersand comes last, so that nothing is resolved twice.
REFERENCES = {"&nbsp;": 160, "&lt;": 60, "&gt;": 62, "&quot;": 34, "&mdash;": 8212, "&hellip;": 8230, "&rarr;": 8594, "&copy;": 169, "&#8216;": 8216, "&#8217;": 8217, "&acirc;": 226, "&Atilde;": 195, "&Acirc;": 194, "&amp;": 38}


def _plain_sql(text: str) -> str:
    out = f"regexp_replace({text}, '<[^>]+>', ' ', 'g')"
    for name, code in REFERENCES.items():
        out = f"replace({out}, '{name}', chr({code}))"
    return f"trim(regexp_replace({out}, '{WHITE}', ' ', 'g'))"


def _excerpt_sql(limit: int, domain: tuple[str, ...] = ()) -> str:
    """The excerpt of column t nearest to column query, as columns of (t, query) rows named x."""
    stop = ", ".join(f"'{w}'" for w in tx.FOCUS_STOPWORDS)
    special = ", ".join(f"'{w}'" for w in domain) or "''"
    return f"""(select case when length(t) <= {limit} then t else case when begin > 0 then '...' else '' end || trim(substring(t, begin + 1, {limit})) || case when begin + {limit} < length(t) then '...' else '' end end
      from (select coalesce(greatest(0, -best.before - 1 - {max(80, limit // 4)}), 0) as begin from (select list_max(list_filter(list_transform(case when len(list_filter(w, lambda a: a not in ({special}))) > 0 then list_filter(w, lambda a: a not in ({special})) else w end,
        lambda a: {{'n': length(a), 'before': -instr(lower(t), a)}}), lambda p: p.before < 0)) as best from (select list_filter(list_transform(regexp_extract_all(query, '[A-Za-z0-9_-]{{4,}}'), lambda a: lower(a)), lambda a: a not in ({stop})) as w))))"""


LISTED = """with first as (select chunk_id, arg_min(struct_pack(i := chunk_index, source_repo := source_repo, file_path := file_path, doc_type := doc_type, last_updated := last_updated), hit_id) as r
  from search_hits where source_repo is not null and file_path is not null and chunk_id is not null group by 1),
listed as (select arg_min(r, (r.i, chunk_id)) as r, count(*) as chunks, max(r.last_updated) as last_updated from first group by r.source_repo, r.file_path) """
HITS = "(select distinct on (hit_id) * from search_hits)"
DISPLAY = "case when length(t) <= 260 then t else rtrim(left(t, 259)) || '...' end"
DECIDED = f"""with recursive q as (select id as query_id, ts as t, case when id % 5 = 0 then '10.0.0.' else '8.8.4.' end || (id % 7) as caller, id % 3 = 0 and id % 5 = 0 as exempt, query, cast(id % 13 as integer) as top_k from {LOG} where ts is not null and {{which}}),
s as (select query_id, caller, t, row_number() over (partition by caller order by t, query_id) as i from q where not exempt),
f as (select s.*, true as accepted, [t] as held from s where i = 1 union all
select s.query_id, s.caller, s.t, s.i, len(list_filter(f.held, lambda x: s.t - x <= 3600)) < {{limit}},
  case when len(list_filter(f.held, lambda x: s.t - x <= 3600)) < {{limit}} then list_append(list_filter(f.held, lambda x: s.t - x <= 3600), s.t) else list_filter(f.held, lambda x: s.t - x <= 3600) end
from f join s on s.caller = f.caller and s.i = f.i + 1),
decided as (select q.query_id, q.t, q.query, case when not coalesce(f.accepted, true) then 'limited' when query is null or length(query) < 1 or length(query) > 500 or top_k < 1 or top_k > 10 then 'invalid'
  when not exempt and {GUARD_SQL} is not null then 'refused' else 'answered' end as decision, cast(least(top_k, 10) as integer) as k, exempt from q left join f using (query_id))
"""


def queries() -> dict[str, Query]:
    names = """tokenize_terms word_window_chunks chunk_router chunk_documents adr_records html_to_text display_excerpt prompt_excerpt corpus_stats bm25_idf bm25_topk lexical_degraded
    vector_topk cells_topk cells_recall hybrid_topk search_hits_hydrated rrf_fuse compare_vector_hybrid fallback_answer answer_sources converge_stale converge_prune converge_stats converge_store
    dedup_last_wins dedup_first_wins index_listing index_totals guard_refusals request_validation rate_limit query_stats top_terms window_summary hourly_log hourly_windows summary_payload hourly_summary_stream rate_limit_stream p3_found p3_runs
    cells_recall_enough comparison_report embed_texts request_decisions service_search service_log ask_answers ingest_pass"""
    return {n: globals()[n] for n in names.split()}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": P3_SQL,
        "tokenize_terms": f"select doc_id, term, count(*) as tf, min(pos) - 1 as first_at from (select doc_id, unnest(t) as term, generate_subscripts(t, 1) as pos from (select doc_id, {TOKENS} as t from documents where text is not null)) group by all",
        "word_window_chunks": f"""with w as (select source, file_path, list_filter(regexp_split_to_array(text, '{WHITE}'), lambda x: x <> '') as w from documents where text is not null),
          c as (select source, file_path, w, unnest(range(case when len(w) <= 512 then 1 else cast(ceil((len(w) - 512) / 448.0) as bigint) + 1 end)) as i from w where len(w) > 0),
          t as (select sha1(source || ':' || file_path || ':' || i) as chunk_id, cast(i as integer) as chunk_index, array_to_string(list_slice(w, i * 448 + 1, i * 448 + 512), ' ') as text from c)
          select chunk_id, chunk_index, length(text) as n_chars, md5(text) as digest from t""",
        "chunk_router": r"""select case when doc_type = 'adr' then 'adr' else coalesce(case lower(regexp_extract(file_path, '[^/](\.[^./]+)$', 1)) when '.py' then 'python' when '.js' then 'javascript' when '.mjs' then 'javascript' when '.cjs' then 'javascript'
          when '.jsx' then 'javascript' when '.ts' then 'typescript' when '.tsx' then 'typescript' when '.json' then 'json' when '.toml' then 'toml' when '.yaml' then 'yaml' when '.yml' then 'yaml' end, 'prose') end as kind, doc_type, count(*) as documents from documents group by all""",
        "display_excerpt": f"select doc_id, {DISPLAY} as excerpt from (select doc_id, {_plain_sql('text')} as t from documents where text is not null)",
        "prompt_excerpt": f"select hit_id, {_excerpt_sql(900, DOMAIN)} as excerpt from (select hit_id, q.query, {_plain_sql('h.text')} as t from {HITS} h join {LOG} q on q.id = h.query_id where h.text is not null) x",
        "answer_sources": f"select query_id, rank, source_repo as repo, file_path as file, {_excerpt_sql(260)} as excerpt from (select h.query_id, h.hit_rank as rank, h.source_repo, h.file_path, q.query, {_plain_sql('h.text')} as t from {HITS} h join {LOG} q on q.id = h.query_id where h.text is not null and h.hit_rank <= 3) x",
        "fallback_answer": f"""with h as (select query_id, hit_rank as rank, coalesce(score, 0.0) as score, {_plain_sql('text')} as t from {HITS} where text is not null),
          x as (select query_id, list({{'rank': rank, 'e': {DISPLAY}}} order by rank, {DISPLAY}) as s from h where rank <= 2 group by 1), best as (select query_id, max(score) as best from h group by 1),
          j as (select q.id as query_id, q.id % 2 = 0 as unavailable, s, coalesce(best, 0.0) as best, array_to_string(list_transform(s, lambda a: a.e), ' ') as joined from {LOG} q left join x on x.query_id = q.id left join best b on b.query_id = q.id),
          k as (select *, case when length(joined) <= 420 then joined else rtrim(left(joined, 419)) || '...' end as said from j)
          select query_id, case when s is null then '{answers.NOTHING}' when not unavailable and best < 0.5 then '{_quoted(answers.UNCLEAR)}' when unavailable then '{answers.UNAVAILABLE}' || said else '{answers.LATE}' || said end as answer,
            cast(case when s is null or not unavailable and best < 0.5 then 0 else len(s) end as integer) as n_sources, unavailable as degraded from k""",
        "search_hits_hydrated": HYBRID + """, hits as (select query_id, rank, round(coalesce(list_cosine_similarity(c.embedding::double[], hq.vector::double[]), 0.0), 4) as score, chunk_id, false as degraded from top join hq using (query_id) join """ + CHUNKS + """ c using (chunk_id) where rank <= 5
          union all select query_id, rank, 0.0 as score, chunk_id, true from ranked where rank <= 5 and query_id not in (select query_id from hq))
          select query_id, cast(rank as integer) as rank, score, chunk_id, coalesce(d.text, '') as text, d.source as source_repo, d.file_path, coalesce(d.doc_type, '') as doc_type, coalesce(d.last_updated, '') as last_updated, 0 as chunk_index, degraded from hits join documents d on sha1(d.source || ':' || d.file_path || ':0') = chunk_id""",
        "cells_recall_enough": "select true as enough",
        "embed_texts": f"""with t as (select query, unnest({TOKENS.replace('text', 'query')}) as term from (select distinct query from queries where query is not null)),
          h as (select query, cast('0x' || left(md5(term), 6) as integer) % 32 as place, case when cast('0x' || substring(md5(term), 7, 1) as integer) % 2 = 1 then 1 else -1 end as sign from t),
          v as (select query, place, sum(sign)::double as n from h group by all)
          select query, cast(place as integer) as place, round(n / sqrt(sum(n * n) over (partition by query)), 9) as value from v qualify n <> 0""",
        "request_decisions": DECIDED.replace("{limit}", "6").replace("{which}", "true") + "select query_id, decision, k, exempt from decided",
        "service_log": DECIDED.replace("{limit}", "60").replace("{which}", "id % 20 = 0") + ", " + BM25.strip().removeprefix("with ") + """select d.query_id as id, d.t as ts, left(d.query, 500) as query, cast(count(r.chunk_id) as integer) as result_count
          from decided d left join ranked r on r.query_id = d.query_id and r.rank <= d.k and d.decision = 'answered' where not d.exempt and d.decision in ('answered', 'refused') group by all""",
        "adr_records": ADR_SQL,
        "p3_runs": P3_SQL,
        "hourly_windows": f"select w.s as window_start, count(q.id) as queries from (select unnest(range({SINCE - SINCE % 3600}, {UNTIL - UNTIL % 3600}, 3600)) as s) w left join {LOG} q on cast(floor(q.ts / 3600) * 3600 as bigint) = w.s group by 1",
        "summary_payload": _terms_sql() + f"""select 'siltstone' as source, strftime(make_timestamp({SINCE}::bigint * 1000000), '%Y-%m-%dT%H:%M:%SZ') as window_start, strftime(make_timestamp({UNTIL}::bigint * 1000000), '%Y-%m-%dT%H:%M:%SZ') as window_end,
          (select count(*) from {LOG} where ts >= {SINCE} and ts < {UNTIL}) as count, (select list(term || '=' || count order by count desc, first, term) from (select * from ranked order by count desc, first, term limit 5)) as top_terms,
          (select count(*) from {LOG} where ts >= {NOW - NOW % 86400}) as queries_today, (select count(*) from {LOG}) as queries_total, (select strftime(make_timestamp(max(ts) * 1000000), '%Y-%m-%dT%H:%M:%SZ') from {LOG}) as last_query_at""",
        "corpus_stats": f"select count(*) as n_chunks, sum(len(t))::bigint as n_tokens, round(avg(len(t)), 9) as avg_length from (select {TOKENS} as t from documents where text is not null) where len(t) > 0",
        "bm25_idf": BM25 + "select term, df, round(idf, 9) as idf from idf",
        "bm25_topk": BM25 + "select query_id, chunk_id, score, rank from ranked where rank <= 10",
        "lexical_degraded": BM25 + "select query_id, chunk_id, 0.0::double as score, rank from ranked where rank <= 5",
        "vector_topk": f"select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from (select q.vec_id as query_id, v.vec_id as id, {COSINE.format(a='q.embedding', b='v.embedding')} as score from embeddings q, embeddings v where q.vec_id % 20 = 0)) where rank <= 10",
        "hybrid_topk": HYBRID + "select query_id, chunk_id, round(coalesce(list_cosine_similarity(c.embedding::double[], hq.vector::double[]), 0.0), 4) as score, rank from top join hq using (query_id) join " + CHUNKS + " c using (chunk_id) where rank <= 5",
        "rrf_fuse": """with h as (select query_id, chunk_id, max(score) as score, min(hit_rank) as hit_rank from (select distinct on (hit_id) * from search_hits) where query_id is not null and chunk_id is not null group by all),
          r as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from h where score is not null union all
          select query_id, chunk_id, row_number() over (partition by query_id order by hit_rank, chunk_id) as rank from h),
          f as (select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 12) as score from r group by all)
          select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from f""",
        "compare_vector_hybrid": HYBRID + "select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.rank, b.rank) as rank, a.chunk_id as vector_chunk, b.chunk_id as hybrid_chunk from (select * from near where rank <= 3) a full join (select * from top where rank <= 3) b on a.query_id = b.query_id and a.rank = b.rank",
        "converge_stale": STORED + "select doc_key, count(*) as stale from old where doc_key in (select doc_key from new) and chunk_id not in (select chunk_id from new) group by 1",
        "converge_prune": STORED + "select doc_key, count(*) as withdrawn from old where doc_key not in (select doc_key from new) group by 1",
        "converge_stats": STORED + "select (select count(distinct doc_key) from new) as documents, (select count(*) from new) as chunks, (select count(*) from old where chunk_id not in (select chunk_id from new)) as deleted, (select count(*) from (select distinct source || ':' || file_path as k from documents) where k not in (select doc_key from new)) as skipped",
        "converge_store": STORED + "select case when o.chunk_id is null then 'insert' when n.chunk_id is null then 'delete' else 'replace' end as action, count(*) as chunks from old o full join new n using (chunk_id) group by 1",
        "dedup_last_wins": f"select key_repo, key_path, max(entry_id) as entry_id, arg_max(chunks, entry_id) as chunks from {KEYED} group by 1, 2",
        "dedup_first_wins": f"select key_repo, key_path, min(entry_id) as entry_id, arg_min(chunks, entry_id) as chunks from {KEYED} group by 1, 2",
        "index_listing": LISTED + "select r.source_repo, r.file_path, r.doc_type, chunks, last_updated from listed",
        "index_totals": LISTED + "select count(*) as documents, cast(coalesce(sum(chunks), 0) as bigint) as chunks, max(last_updated) as last_refresh from listed",
        "guard_refusals": f"select id, category from (select id, {GUARD_SQL} as category from {LOG}) where category is not null",
        "request_validation": f"select case when query is null or length(query) < 1 then 'query is empty' when length(query) > 500 then 'query is too long' when id % 13 < 1 or id % 13 > 10 then 'top_k is out of range' end as problem, cast(least(id % 13, 10) as integer) as k, count(*) as requests from {LOG} group by all",
        "query_stats": f"select count(*) as total, count(*) filter (ts >= {NOW - 3600}) as last_hour, count(*) filter (ts >= {NOW - NOW % 86400}) as today, strftime(make_timestamp(max(ts) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as last_query_at, strftime(make_timestamp({NOW}::bigint * 1000000), '%Y-%m-%dT%H:%M:%SZ') as generated_at from {LOG}",
        "top_terms": _terms_sql() + "select term, count, row_number() over (order by count desc, first, term) as position from ranked order by position limit 5",
        "window_summary": _terms_sql() + f"select (select count(*) from {LOG} where ts >= {SINCE} and ts < {UNTIL}) as count, list(term || '=' || count order by count desc, first, term) as top_terms from (select * from ranked order by count desc, first, term limit 5)",
        "hourly_log": f"select cast(floor(ts / 3600) * 3600 as bigint) as window_start, count(*) as queries from {LOG} where ts is not null group by 1",
        "hourly_summary_stream": "select cast(epoch(time_bucket(interval 1 hour, ts)) as bigint) as window_start, event_type, count(*) as events from events group by all",
        "rate_limit": RATE + "select event_id, user_id, accepted from f",
        "rate_limit_stream": RATE + "select user_id, count(*) filter (accepted) as accepted, count(*) as events from f group by user_id",
    }


def _front(name: str) -> str:
    return f"""nullif(regexp_extract(front, '(?m)^[ \\t]*{name}[ \\t]*=[ \\t]*"?([^"\\n#]*?)"?[ \\t]*(?:#[^\\n]*)?$', 1), '')"""


# Decision records by regular expressions instead of a parser of their header: what the first failing field is, or all fields.
ADR_SQL = rf"""
with d as (select source as source_repo, file_path, regexp_extract(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?s)^\+\+\+[ \t]*\n(.*?)\n?\+\+\+[ \t]*(?:\n|$)(.*)$', ['front', 'body']) as m from documents where doc_type = 'adr'),
f as (select *, {_front('id')} as adr_id, {_front('status')} as status, {_front('date')} as date, {_front('supersedes')} as supersedes, {_front('slug')} as slug from (select source_repo, file_path, m.front as front, m.body as body from d)),
e as (select *, case when front is null or front = '' or len(list_filter(string_split(front, chr(10)), lambda l: trim(l) <> '' and not regexp_matches(l, '^[ \t]*([A-Za-z_-]+[ \t]*=[ \t]*[!-~]|#)'))) > 0 then 'frontmatter' when adr_id is null or not regexp_full_match(adr_id, 'ADR-[0-9]{{4}}') then 'id' when status is null or status not in ('accepted', 'proposed', 'superseded') then 'status'
  when date is null or not regexp_full_match(date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') or try_cast(date as date) is null then 'date' when supersedes is not null and (not regexp_full_match(supersedes, 'ADR-[0-9]{{4}}') or supersedes = adr_id) then 'supersedes'
  when slug is not null and not regexp_full_match(slug, '[a-z0-9]+(-[a-z0-9]+)*') then 'slug' when trim(body, chr(10) || ' ') = '' then 'body' end as error from f)
select source_repo, file_path, case when error is null then adr_id end as adr_id, case when error is null then status end as status, case when error is null then date end as date,
  case when error is null then supersedes end as supersedes, case when error is null then slug end as slug, error from e
"""


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _terms_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in tx.LOG_STOPWORDS)
    return f"""with t as (select ts, id, unnest(x) as term, generate_subscripts(x, 1) as pos from (select ts, id, regexp_extract_all(lower(query), '[a-z0-9][a-z0-9\\-]{{2,}}') as x from {LOG} where ts >= {SINCE} and ts < {UNTIL})),
    k as (select * from t where term not in ({stop})),
    o as (select ts, id, term, row_number() over (partition by id order by pos) as pos from k),
    ranked as (select term, count(*) as count, min({{'ts': ts, 'id': id, 'at': pos}}) as first from o group by term) """


P3_SQL = r"""
with norm as (
  select 'feed' as kind, entry_id, source_repo, file_path, last_updated from index_entries
  union all
  select 'done', null, p.source_repo, p.file_path, p.last_updated
  from processed_versions p join ingest_runs r on r.run_id = p.run_id where r.run_state = 'success'
), keyed as (
  select kind, entry_id, coalesce(source_repo, '') as repo,
    array_to_string(list_filter(string_split(replace(trim(file_path), '\', '/'), '/'), lambda x: x <> '' and x <> '.'), '/') as path,
    case when regexp_full_match(trim(last_updated), '[0-9]{1,11}') then cast(trim(last_updated) as bigint) * 1000000
         when regexp_full_match(trim(last_updated), '[0-9]{12,14}') then cast(trim(last_updated) as bigint) * 1000
         when regexp_matches(trim(last_updated), '[0-9](Z|[+-][0-9]{2}:?[0-9]{2})$') then epoch_us(cast(trim(last_updated) as timestamptz))
         else epoch_us(cast(trim(last_updated) as timestamp)) end as instant
  from norm where file_path is not null and last_updated is not null
)
select min(entry_id) as entry_id from keyed f where kind = 'feed'
and not exists (select 1 from keyed d where d.kind = 'done' and d.repo = f.repo and d.path = f.path and d.instant = f.instant)
group by repo, path, instant
"""
