"""One ranking from several differently scaled scores: robust rank aggregation.

Scores become ranks within their query and retriever, normalised by the number of candidates the
retriever scored there (ties share their mean rank), so no scale or outlier survives. For each
candidate its n normalised ranks are sorted; the k-th smallest of n ranks without merit follows
Beta(k, n - k + 1), so its probability of being that small is the binomial tail
sum over j from k to n of C(n, j) r^j (1 - r)^(n - j). The least of these over k, times n, is the
candidate's significance, and the ranking is by it, from the least. Ties go to the smaller mean
rank, then to the smaller candidate.

Ranks are computed by ``grouped_rank``, which range-partitions by group and value: a query with a third
of all rows is sorted by many tasks, each knowing how many rows of the group lie before it.
Leaders are an aggregate that combines before the shuffle.

Null and NaN scores are absent: they speak neither for nor against. A candidate without any
score comes last in its query, with significance null. Null queries, retrievers and candidates are
dropped. Rows repeated count once; where one has several scores from one retriever, the best
counts. Infinite scores rank first or last. Empty tables give no rows. Up to 20 retrievers. Other
columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone import runtime

LOWER_IS_BETTER = ("age_days",)


def grouped_rank(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``before`` (rows of the group that come strictly earlier in ``order``, ascending),
    ``equal`` (rows with the same order values, itself included) and ``size`` (of the group).

    Equal keys lie in one range partition, so ranks within a partition plus what the group has in
    the partitions before are ranks in the group.
    """
    spread = rows.repartitionByRange(runtime.cores_for_shuffle(rows.sparkSession), *group, *order).withColumn("_part", F.spark_partition_id())
    kept = runtime.materialise(spread, "ranges")  # the ranges are sampled: fixed here for both uses
    here = W.partitionBy("_part", *group).orderBy(*order)
    local = kept.withColumn("_before", F.rank().over(here) - 1).withColumn("equal", F.count("*").over(W.partitionBy("_part", *group, *order)))
    parts = kept.groupBy("_part", *group).agg(F.count("*").alias("_n"))
    along = W.partitionBy(*group).orderBy("_part")
    counted = parts.withColumn("_earlier", F.coalesce(F.sum("_n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("size", F.sum("_n").over(W.partitionBy(*group)))
    joined = local.join(counted, ["_part", *group])
    return joined.withColumn("before", F.col("_before") + F.col("_earlier")).drop("_part", "_before", "_n", "_earlier")


def normalised_ranks(scored: DataFrame) -> DataFrame:
    """(query_id, chunk_id, retriever, r), r in (0, 1]: 1 / size for a sole best."""
    value = F.when(F.col("retriever").isin(*LOWER_IS_BETTER), -F.col("score")).otherwise(F.col("score"))
    named = scored.where(F.col("query_id").isNotNull() & F.col("retriever").isNotNull() & F.col("chunk_id").isNotNull())
    present = named.where(F.col("score").isNotNull() & ~F.isnan("score"))
    best = present.groupBy("query_id", "retriever", "chunk_id").agg((-F.max(value)).alias("cost"))
    ranked = grouped_rank(best, ["query_id", "retriever"], ["cost"])
    return ranked.select("query_id", "chunk_id", "retriever", ((F.col("before") + (F.col("equal") + 1) / 2) / F.col("size")).alias("r"))


def significance(ranks: Column) -> Column:
    """Of an array of normalised ranks: n times the least binomial tail, at most 1."""
    r = F.array_sort(ranks)
    n = F.size(ranks)

    def tail(x: Column, i: Column) -> Column:
        k = i + 1
        term = lambda j: F.factorial(n) / (F.factorial(j) * F.factorial(n - j)) * F.pow(x, j) * F.pow(1 - x, n - j)
        return F.aggregate(F.sequence(k, n), F.lit(0.0), lambda acc, j: acc + term(j))

    return F.least(F.lit(1.0), F.array_min(F.transform(r, tail)) * n)


def candidates(scored: DataFrame) -> DataFrame:
    """(query_id, chunk_id, n_scores, significance, mean_rank), one row for each candidate."""
    ranks = normalised_ranks(scored).groupBy("query_id", "chunk_id").agg(F.collect_list("r").alias("ranks"))
    valued = ranks.select("query_id", "chunk_id", F.size("ranks").alias("n_scores"), F.round(significance(F.col("ranks")), 12).alias("significance"), F.round(F.aggregate("ranks", F.lit(0.0), lambda a, x: a + x) / F.size("ranks"), 12).alias("mean_rank"))
    everyone = scored.where(F.col("query_id").isNotNull() & F.col("retriever").isNotNull() & F.col("chunk_id").isNotNull()).select("query_id", "chunk_id").distinct()
    return everyone.join(valued, ["query_id", "chunk_id"], "left").fillna(0, ["n_scores"])


def leaders(scored: DataFrame) -> DataFrame:
    """(query_id, chunk_id): the first of each query's ranking."""
    key = F.struct(F.coalesce("significance", F.lit(2.0)), F.coalesce("mean_rank", F.lit(2.0)), "chunk_id")
    return candidates(scored).groupBy("query_id").agg(F.min_by("chunk_id", key).alias("chunk_id"))


def ranking(scored: DataFrame) -> DataFrame:
    """``candidates`` with ``position``, from 1, in each query's ranking."""
    keyed = candidates(scored).withColumn("_s", F.coalesce("significance", F.lit(2.0))).withColumn("_m", F.coalesce("mean_rank", F.lit(2.0)))
    ranked = grouped_rank(keyed, ["query_id"], ["_s", "_m", "chunk_id"])
    return ranked.select("query_id", "chunk_id", "n_scores", "significance", "mean_rank", (F.col("before") + 1).alias("position"))
