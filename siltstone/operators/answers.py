"""Extractive answers from hits, without a model: what is said when synthesis is out of time or out of reach.

A batch: hits of many queries, one answer a query, by aggregates and struct arrays of at most a few hits.
Queries without hits get the sentence that says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import html
from siltstone.functions import text as tx

NOTHING = "I could not find a passage in the collection that bears on this."
UNCLEAR = "The passages found leave this open, so it can't be answered without guessing."
UNAVAILABLE = "No model is at hand to write an answer. The closest passages by keywords: "
LATE = "No answer was written in time. The closest passages: "
LEAST_SCORE, FACTS_MAX, FACTS_FROM, SOURCES_MAX = 0.5, 420, 2, 3


def fallback(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, answer, n_sources, degraded). ``queries``: (query_id, unavailable); ``hits``: (query_id, rank, score,
    text, source_repo, file_path). Out of time, a best score under 0.5 gives no answer; out of reach the
    scores are all 0 by design and don't count."""
    shown = hits.where(F.col("rank") <= FACTS_FROM).select("query_id", "rank", tx.display_excerpt(html.plain(F.col("text"))).alias("excerpt"))
    facts = shown.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "excerpt"))).alias("s"))
    joined = F.concat_ws(" ", F.transform("s", lambda x: x["excerpt"]))
    said = F.when(F.length(joined) <= FACTS_MAX, joined).otherwise(F.concat(F.rtrim(F.substring(joined, 1, FACTS_MAX - 1)), F.lit("...")))
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    every = queries.select("query_id", "unavailable").join(facts, "query_id", "left").join(best, "query_id", "left")
    none, weak = F.col("s").isNull(), ~F.col("unavailable") & (F.coalesce("best", F.lit(0.0)) < LEAST_SCORE)
    answer = F.when(none, NOTHING).when(weak, UNCLEAR).when(F.col("unavailable"), F.concat(F.lit(UNAVAILABLE), said)).otherwise(F.concat(F.lit(LATE), said))
    return every.select("query_id", answer.alias("answer"), F.when(none | weak, 0).otherwise(F.size("s")).alias("n_sources"), (F.col("unavailable") & F.lit(True)).alias("degraded"))


def sources(hits: DataFrame, questions: DataFrame, best: int = SOURCES_MAX) -> DataFrame:
    """(query_id, rank, repo, file, excerpt) of each answer's sources, the excerpt near the question's terms."""
    met = hits.where(F.col("rank") <= best).join(questions.select("query_id", "query"), "query_id")
    plain = met.withColumn("plain", html.plain(F.col("text")))
    return plain.select("query_id", "rank", F.col("source_repo").alias("repo"), F.col("file_path").alias("file"), tx.prompt_excerpt(F.col("plain"), F.col("query"), 260).alias("excerpt"))
