"""Analytics of the query log. ``now`` is always given, never read from a clock.

Rows appended twice (same id) count once: ``distinct_records`` comes first in every query. Null queries are
records without terms. An empty log gives zeros and no last time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.functions import text as tx

QUERY_MAX, HOUR, DAY, TOP = 500, 3_600, 86_400, 5


def distinct_records(log: DataFrame) -> DataFrame:
    return log.dropDuplicates(["id"])


def entry(query: Column) -> Column:
    """What is logged of a query: its first 500 characters."""
    return F.substring(query, 1, QUERY_MAX)


def append(rows: DataFrame, path: str) -> None:
    rows.withColumn("query", entry(F.col("query"))).write.mode("append").parquet(path)


def stats(log: DataFrame, now: int) -> DataFrame:
    """One row, in one pass: all queries, those of the last hour, those since midnight UTC, and the last time."""
    return distinct_records(log).agg(
        F.count("*").alias("total"), F.count_if(F.col("ts") >= now - HOUR).alias("last_hour"), F.count_if(F.col("ts") >= now - now % DAY).alias("today"),
        tx.iso_utc(F.max("ts")).alias("last_query_at"),
    ).withColumn("generated_at", tx.iso_utc(F.lit(now)))


def window_rows(log: DataFrame, since: int, until: int) -> DataFrame:
    return distinct_records(log).where((F.col("ts") >= since) & (F.col("ts") < until))


def top_terms(log: DataFrame, since: int, until: int, k: int = TOP) -> DataFrame:
    """(term, count, position): the most frequent terms of a window, ties by first occurrence, then by term."""
    met = window_rows(log, since, until).select("ts", "id", F.posexplode(tx.log_terms(F.col("query"))).alias("at", "term"))
    counted = met.groupBy("term").agg(F.count("*").alias("count"), F.min(F.struct("ts", "id", "at")).alias("first"))
    best = counted.orderBy(F.desc("count"), "first", "term").limit(k)  # the feature: a top-k
    return best.withColumn("position", F.row_number().over(W.orderBy(F.desc("count"), "first", "term"))).select("term", "count", "position")


def window_summary(log: DataFrame, since: int, until: int, k: int = TOP) -> DataFrame:
    """One row (count, top_terms), also for an empty window."""
    counted = window_rows(log, since, until).agg(F.count("*").alias("count"))
    terms = top_terms(log, since, until, k).agg(F.sort_array(F.collect_list(F.struct("position", "term", "count"))).alias("t"))
    return counted.crossJoin(terms).select("count", F.transform("t", lambda x: F.struct(x["term"].alias("term"), x["count"].alias("count"))).alias("top_terms"))  # one row each


def hourly(log: DataFrame, seconds: int = HOUR) -> DataFrame:
    """(window_start, queries) of each window in which something was asked, aligned to the epoch."""
    start = (F.floor(F.col("ts") / seconds) * seconds).cast("bigint")
    return distinct_records(log).where(F.col("ts").isNotNull()).groupBy(start.alias("window_start")).agg(F.count("*").alias("queries"))


def windows(log: DataFrame, since: int, until: int, seconds: int = HOUR) -> DataFrame:
    """(window_start, queries) of every whole window from ``since`` to ``until``, also of those in which nothing was
    asked, aligned to the epoch."""
    spark = log.sparkSession
    first, last = since - since % seconds, until - until % seconds
    every = spark.range(first, max(first, last), seconds).select(F.col("id").alias("window_start"))
    return every.join(hourly(window_rows(log, first, last), seconds), "window_start", "left").select("window_start", F.coalesce("queries", F.lit(0)).alias("queries"))


def summary_payload(log: DataFrame, source: str, since: int, until: int, now: int, k: int = TOP) -> DataFrame:
    """One row, what a window's report says: counts and terms of the window, and totals of the log. A quiet window is
    reported too, with count 0."""
    window, total = window_summary(log, since, until, k), stats(log, now)
    return window.crossJoin(total).select(  # one row each
        F.lit(source).alias("source"), tx.iso_utc(F.lit(since)).alias("window_start"), tx.iso_utc(F.lit(until)).alias("window_end"), "count", "top_terms",
        F.col("today").alias("queries_today"), F.col("total").alias("queries_total"), "last_query_at",
    )


def trimmed(log: DataFrame, keep: int) -> DataFrame:
    """The last ``keep`` records by time and id, an option of the log's owner; a top-k."""
    return distinct_records(log).orderBy(F.desc("ts"), F.desc("id")).limit(keep)
