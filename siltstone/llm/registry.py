"""The queries of the operators for training data, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import near_duplicates as nd
from siltstone.llm import garbled, markup, packing, page_content, personal, rank_fusion, term_counts, tokens

Query = Callable[[SparkSession, str], DataFrame]

HIT_COPIES = nd.Settings(shingle=3, threshold=0.5, min_words=12, bands=40, rows=3, min_shared=2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nd.near_duplicates(table(spark, sf_dir, "search_hits"), "hit_id", "text", HIT_COPIES)
    return nd.all_pairs(found).select(F.col("id_a").alias("hit_id_a"), F.col("id_b").alias("hit_id_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nd.groups(table(spark, sf_dir, "search_hits"), "hit_id", "text", HIT_COPIES).withColumnRenamed("id", "hit_id")


def p1_groups_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five words and a similarity of 0.8, the default of the operator."""
    return nd.groups(table(spark, sf_dir, "search_hits"), "hit_id", "text").withColumnRenamed("id", "hit_id")


# Every pair by the shingles that both have, without signatures; fast enough at the scale of the SQL check.
def _pairs_sql(words: int, threshold: float) -> str:
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return rf"""
words as (select hit_id, regexp_extract_all(lower(text), '[\pL\pN]+') as w from (select distinct hit_id, text from search_hits where hit_id is not null and text is not null)),
shingles as (select hit_id, unnest(list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: {shingle}))) as s from words where len(w) >= 12),
sizes as (select hit_id, count(*) as n from shingles group by 1),
met as (select a.hit_id as hit_id_a, b.hit_id as hit_id_b, count(*) as c from shingles a join shingles b on a.s = b.s and a.hit_id < b.hit_id group by 1, 2),
pairs as (select hit_id_a, hit_id_b from met join sizes x on x.hit_id = hit_id_a join sizes y on y.hit_id = hit_id_b where c >= {threshold} * (x.n + y.n - c) - 1e-9)"""


def _groups_sql(words: int, threshold: float) -> str:
    return f"""
with recursive {_pairs_sql(words, threshold)},
sets as (select hit_id, min(hit_id) over (partition by s) as rep from (select hit_id, list_sort(list(s)) as s from shingles group by 1)),
links as (select a.rep as a, b.rep as b from pairs join sets a on a.hit_id = hit_id_a join sets b on b.hit_id = hit_id_b where a.rep <> b.rep group by all),
degree as (select rep, count(*) as links from (select distinct rep, other from (select a as rep, b as other from links union all select b, a from links)) group by 1),
both_ways as (select hit_id_a as a, hit_id_b as b from pairs union all select hit_id_b, hit_id_a from pairs),
reach as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a)
select h.hit_id, coalesce(s.rep, h.hit_id) as rep, least(h.hit_id, coalesce(g.least, h.hit_id)) as group_id, coalesce(d.links, 0) as links
from (select distinct hit_id from search_hits where hit_id is not null) h left join sets s using (hit_id) left join (select a as hit_id, min(b) as least from reach group by 1) g using (hit_id) left join degree d on d.rep = coalesce(s.rep, h.hit_id)"""


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts.term_frequencies(table(spark, sf_dir, "queries"), "id", "query")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_terms(spark, sf_dir).where(F.col("mark").isNotNull()).select("term", "mark")


P2_SQL = r"""
with records as (select distinct id, query from queries where query is not null),
terms as (select id, unnest(regexp_extract_all(lower(query), '[a-z0-9][a-z0-9\-]{2,}')) as term from records),
counted as (select term, count(*) as occurrences, count(distinct id) as records from terms group by term),
total as (select count(distinct id) as n from records)
select term, occurrences, records,
  case when records < 3 then 'rare' when records > 0.02 * n then 'common' end as mark
from counted, total
"""


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_content.furniture_lines(table(spark, sf_dir, "search_hits"), "hit_id", "text", "file_path")


def p4_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_content.main_bodies(table(spark, sf_dir, "search_hits"), "hit_id", "text", "file_path")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.kinds(table(spark, sf_dir, "search_hits"), "hit_id", "text")


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "search_hits").dropDuplicates(["hit_id"])
    return markup.clean(hits, "hit_id", "text", F.col("source_repo"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_fusion.leaders(table(spark, sf_dir, "scored_hits"))


def p6_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_fusion.ranking(table(spark, sf_dir, "scored_hits"))


P6_SQL = r"""
with best as (
  select query_id, retriever, chunk_id, max(case when retriever = 'age_days' then -score else score end) as v
  from scored_hits where query_id is not null and retriever is not null and chunk_id is not null and score is not null and not isnan(score)
  group by all
), ranked as (
  select query_id, chunk_id, (rank() over w - 1 + (count(*) over (partition by query_id, retriever, v) + 1) / 2.0)
    / count(*) over (partition by query_id, retriever) as r
  from best window w as (partition by query_id, retriever order by v desc)
), ordered as (
  select query_id, chunk_id, r, row_number() over (partition by query_id, chunk_id order by r) as k,
    count(*) over (partition by query_id, chunk_id) as n
  from ranked
), tails as (
  select query_id, chunk_id, n, r, (select sum(cast(factorial(cast(n as integer)) as double) / (cast(factorial(cast(j as integer)) as double)
    * cast(factorial(cast(n - j as integer)) as double)) * pow(r, j) * pow(1 - r, n - j)) from range(20) t(j) where j between k and n) as p
  from ordered
), valued as (
  select query_id, chunk_id, n, round(least(1.0, min(p) * n), 12) as significance, round(avg(r), 12) as mean_rank
  from tails group by query_id, chunk_id, n
)
select e.query_id, e.chunk_id, cast(coalesce(n, 0) as integer) as n_scores, significance, mean_rank,
  row_number() over (partition by e.query_id order by coalesce(significance, 2), coalesce(mean_rank, 2), e.chunk_id) as position
from (select distinct query_id, chunk_id from scored_hits where query_id is not null and retriever is not null and chunk_id is not null) e
left join valued using (query_id, chunk_id)
"""


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.found(table(spark, sf_dir, "queries"), "id", "query", table(spark, sf_dir, "given_names"))


def p7_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.mask(table(spark, sf_dir, "queries"), "id", "query", table(spark, sf_dir, "given_names"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts decoded from their ids, beside whether they are the texts; null counts as empty."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("source_text"))
    decoded = tokens.decode(tokens.encode(documents, "doc_id", "source_text"), "doc_id")
    return decoded.join(documents, "doc_id").select("doc_id", (F.col("text") == F.col("source_text")).alias("same"), F.length("text").alias("n_chars"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fills(p9_containers(spark, sf_dir))


def p9_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document beside whether its pieces follow one another without gaps and hold all of its tokens."""
    placed = p9_containers(spark, sf_dir).groupBy("doc_id").agg(F.sum("n_tokens").alias("packed"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.max("n_tokens").alias("most"))
    encoded = p8_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("n"))
    return encoded.join(placed, "doc_id", "left").select("doc_id", F.coalesce((F.col("packed") == F.col("n")) & (F.col("end") == F.col("n")) & (F.col("most") <= packing.CAPACITY), F.lit(False)).alias("same"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_restored(spark, sf_dir).select("doc_id")


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.repair(table(spark, sf_dir, "documents"), "doc_id", "text")


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_groups": p1_groups,
        "p1_groups_strict": p1_groups_strict,
        "p2_found": p2_found,
        "p2_terms": p2_terms,
        "p4_found": p4_found,
        "p4_bodies": p4_bodies,
        "p5_found": p5_found,
        "p5_clean": p5_clean,
        "p6_found": p6_found,
        "p6_ranking": p6_ranking,
        "p7_found": p7_found,
        "p7_masked": p7_masked,
        "p8_ids": p8_ids,
        "p8_round_trip": p8_round_trip,
        "p9_containers": p9_containers,
        "p9_fill": p9_fill,
        "p9_complete": p9_complete,
        "p10_found": p10_found,
        "p10_restored": p10_restored,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"with {_pairs_sql(3, 0.5)} select hit_id_a, hit_id_b from pairs",
        "p1_groups": _groups_sql(3, 0.5),
        "p1_groups_strict": _groups_sql(5, 0.8),
        "p2_found": f"select term, mark from ({P2_SQL}) where mark is not null",
        "p2_terms": P2_SQL,
        "p6_found": f"select query_id, chunk_id from ({P6_SQL}) where position = 1",
        "p6_ranking": P6_SQL,
        "p8_round_trip": "select doc_id, true as same, length(coalesce(text, '')) as n_chars from documents",
        "p9_complete": "select doc_id, true as same from documents",
    }
