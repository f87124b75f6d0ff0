"""BM25 over chunks: corpus statistics, inverse document frequencies, postings, and ranked answers to a batch of
queries.

The queries are a batch, so their distinct term lists are scored once, however often one is asked, and in
blocks against all chunks, each task keeping the best of its own. The chunks are tokenised once, into a table of counted
terms; frequencies and all blocks read that. A block is run, written and let go before the next one begins, so the driver
and the tasks hold one block's weights at a time.

Ranks are by the score rounded to 9 places, then by chunk_id: sums differ in the last bits by the order of
their terms. Chunks without terms don't count. Null texts have no terms. A query without terms, or
sharing none with any chunk, has no answer. A chunk_id that comes twice must be made unique before.
Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone import runtime
from siltstone.functions import text as tx

# The usual constants of Okapi BM25, and the share of the mean that stands for a negative idf.
K1, B, EPSILON = 1.5, 0.75, 0.25


def tokenised(chunks: DataFrame) -> DataFrame:
    """(chunk_id, terms, n), chunks with at least one term."""
    return chunks.select("chunk_id", tx.tokens(F.col("text")).alias("terms")).withColumn("n", F.size("terms")).where(F.col("n") > 0)


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: (n_chunks, n_tokens, avg_length)."""
    return tokenised(chunks).agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.round(F.avg("n"), 9).alias("avg_length"))


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, n): n is the chunk's length."""
    return tokenised(chunks).select("chunk_id", "n", F.explode("terms").alias("term")).groupBy("term", "chunk_id", "n").agg(F.count("*").alias("tf"))


def counted(chunks: DataFrame) -> DataFrame:
    """(chunk_id, n, terms, tfs): the distinct terms of each chunk that has some, and how often each comes in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
            code = batch.column(1).flatten().dictionary_encode()
            of, key = max(1, len(code.dictionary)), np.repeat(np.arange(len(n)), n)
            key, tf = np.unique(key * of + code.indices.to_numpy(), return_counts=True)
            some = np.flatnonzero(n)
            ends = pa.array(np.append(0, np.cumsum(np.bincount(key // of, minlength=len(n))[some])).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (code.dictionary.take(pa.array(key % of)), pa.array(tf.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(n[some], pa.int32()), *lists], ["chunk_id", "n", "terms", "tfs"])

    # What has no terms is left out here: a filter on them would have Spark find them once more.
    terms = evenly(chunks.select("chunk_id", "text")).select("chunk_id", tx.tokens(F.col("text")).alias("terms"))
    return terms.mapInArrow(run, "chunk_id string, n int, terms array<string>, tfs array<int>")


def evenly(chunks: DataFrame) -> DataFrame:
    """``chunks`` in as many partitions as there are cores, in more only if the tables have more splits, and about as many
    rows in each: splits of a file hold a whole row group or nothing, and the largest holds up every pass."""
    spark, plan = chunks.sparkSession, chunks._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():  # its partitions are known only when it has run
        leaves = plan.optimizedPlan().collectLeaves()
        held = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
        splits = min(held // SPLIT, runtime.cores_for_shuffle(spark))
    else:
        splits = plan.toRdd().getNumPartitions()
    return chunks.repartition(max(splits, spark.sparkContext.defaultParallelism), "chunk_id")


def idf_of(held: DataFrame) -> DataFrame:
    """(term, df, idf) of ``counted`` chunks; a negative idf becomes EPSILON times the mean of all."""
    df = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = held.agg(F.count("*").alias("n_chunks"))
    raw = df.crossJoin(F.broadcast(total)).select("term", "df", (F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))  # one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.round(F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")), 12).alias("idf"))  # one row


def idf(chunks: DataFrame) -> DataFrame:
    return idf_of(tokenised(chunks).select(F.array_distinct("terms").alias("terms")))


def bags(queries: DataFrame) -> DataFrame:
    """(query_id, bag) of queries (query_id, query) with a term. A bag is a query's sorted terms; queries with the same
    bag share it."""
    return queries.select("query_id", tx.tokens(F.col("query")).alias("q")).where(F.size("q") > 0).select("query_id", F.array_join(F.array_sort("q"), " ").alias("bag"))


def weights(asked: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(bag, term, weight): the term's frequency in the bag times its idf."""
    wanted = asked.select("bag").distinct().select("bag", F.explode(F.split("bag", " ")).alias("term")).groupBy("bag", "term").agg(F.count("*").alias("qf"))
    return wanted.join(frequencies.select("term", "idf"), "term").select("bag", "term", (F.col("qf") * F.col("idf")).alias("weight"))


def scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk that shares a term with a query, all of them, as a join on the term.
    For rankings ``bm25`` moves far less."""
    asked = bags(queries)
    weighted = weights(asked, idf(chunks))
    stats = tokenised(chunks).agg(F.avg("n").alias("avg"))
    hit = postings(chunks).join(weighted, "term").crossJoin(F.broadcast(stats))  # one row
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("avg")))
    by_bag = hit.groupBy("bag", "chunk_id").agg(F.round(F.sum(part), 9).alias("score"))
    return asked.join(by_bag, "bag").select("query_id", "chunk_id", "score")


def top_k(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """``scored`` with ``rank`` from 1, the best ``k`` of each query. Spark cuts each query to k rows in every
    task before the shuffle, so a query with very many hits is never gathered."""
    w = W.partitionBy(by).orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


BAGS = 32_768  # bags of a pass over the chunks
FIRST, ROWS, PLACES = 2_048, 16_384, 4_000_000  # chunks that are scored together: at first, then, and the terms they may hold
SPLIT = 128 << 20  # bytes of tables to a partition
CLOSE = 1e-7  # room for the last bits of sums


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows to be scored together: few at first, as nothing bounds the first ones, then ROWS, less if they hold many terms."""
    held, n, places, most = [], 0, 0, FIRST
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            piece = batch.slice(at, min(most - n, FIRST))
            at += piece.num_rows
            held.append(piece)
            n, places = n + piece.num_rows, places + len(piece.column(2).flatten())
            if n >= most or places >= PLACES:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n, places, most = [], 0, 0, ROWS
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class _Postings:
    """The terms of some chunks, numbered by the order of their ids: of each asked term the chunks and what it adds to
    them (times its weight in the bag), and the most it adds to one."""

    def __init__(self, part: pa.Table, known: pa.Array, average: float) -> None:
        ids, n, lists, tfs = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in part.columns)
        by_id = pc.sort_indices(ids).to_numpy()
        self.ids, self.rows = ids.take(pa.array(by_id)), len(ids)
        place = np.empty(self.rows, dtype=np.int64)
        place[by_id] = np.arange(self.rows)
        term = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(self.rows), lists.value_lengths().to_numpy())
        met = np.flatnonzero(term >= 0)
        met = met[np.argsort(term[met].astype(np.int64) * self.rows + place[row[met]])]
        term, row = term[met], row[met]
        tf, n = tfs.flatten().to_numpy()[met].astype(float), n.to_numpy()[row]
        self.gain, self.at = tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / average)), place[row].astype(np.intp)
        starts = np.searchsorted(term, np.arange(len(known) + 1))
        sizes = np.diff(starts)
        some = np.flatnonzero(sizes)
        most = np.zeros(len(known))
        if len(some):
            most[some] = np.maximum.reduceat(self.gain, starts[some])
        self.starts, self.sizes, self.most, self.full = starts.tolist(), sizes.tolist(), most.tolist(), {}
        for t in np.flatnonzero(sizes > self.rows // 8).tolist():
            self.full[t] = np.zeros(self.rows)
            self.full[t][self.at[starts[t] : starts[t + 1]]] = self.gain[starts[t] : starts[t + 1]]
        self.sums, self.spare = np.zeros(self.rows), np.empty(self.rows)

    def _list(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(self.starts[t], self.starts[t + 1])
        return self.at[span], self.gain[span]

    def _add(self, t: int, weight: float) -> None:
        if t in self.full:
            np.multiply(self.full[t], weight, out=self.spare)
            np.add(self.sums, self.spare, out=self.sums)
        else:
            at, gain = self._list(t)
            self.sums[at] += gain * weight

    def _of(self, t: int, rows: np.ndarray) -> np.ndarray:
        """What the term adds to ``rows``, nothing where it isn't in one."""
        if t in self.full:
            return self.full[t][rows]
        at, gain = self._list(t)
        self.spare.fill(0)
        self.spare[at] = gain
        return self.spare[rows]

    def best(self, bag: list[tuple[int, float]], least: float, k: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(rows, scores), in order of the rows, with the best ``k`` of those that share a term with the bag and reach ``least``;
        others may be left out, as may be, if there are more, those that come after the best."""
        asked = [(t, w) for t, w in bag if self.sizes[t]]
        if not asked:
            return None
        if any(w <= 0 for _, w in asked):  # a sum says nothing of the rows that share a term
            shared = np.zeros(self.rows, dtype=bool)
            self.sums.fill(0)
            for t, w in asked:
                self._add(t, w)
                shared[self._list(t)[0]] = True
            rows = np.flatnonzero(shared)
            scores = self.sums[rows]
        else:
            # Terms that can't lift a row to ``least`` together, as many places of them as can be: rows with no other term are out.
            late, rest, room = [], 0.0, least - CLOSE
            for bound, t, w in sorted(((w * self.most[t], t, w) for t, w in asked), key=lambda x: -self.sizes[x[1]] / x[0]):
                if rest + bound < room:
                    late.append((bound, t, w))
                    rest += bound
            first = [x for x in asked if all(x[0] != t for _, t, _ in late)] if late else asked
            if not first:
                return None
            if len(first) == 1:
                rows, gain = self._list(first[0][0])
                scores = gain * first[0][1]
                if scores.max() < room - rest:
                    return None
                kept = np.flatnonzero(scores >= room - rest)
                rows, scores = rows[kept], scores[kept]
            else:
                self.sums.fill(0)
                for t, w in first:
                    self._add(t, w)
                rows = np.flatnonzero(self.sums >= room - rest if room > rest else self.sums)
                scores = self.sums[rows]
            for bound, t, w in sorted(late, reverse=True):
                if not len(rows):
                    return None
                scores = scores + w * self._of(t, rows)
                rest -= bound
                kept = np.flatnonzero(scores >= room - rest)
                rows, scores = rows[kept], scores[kept]
        scores = np.round(scores, 9)
        if least > -np.inf:
            kept = np.flatnonzero(scores >= least)
            rows, scores = rows[kept], scores[kept]
        if len(rows) > k:
            kept = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
            if len(kept) > k:
                kept = np.sort(kept[np.argsort(-scores[kept], kind="stable")[:k]])
            rows, scores = rows[kept], scores[kept]
        return rows, scores


def _merged(found: tuple[np.ndarray, np.ndarray, np.ndarray], names: pa.Array, k: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], pa.Array]:
    """The best ``k`` of each bag among ``found`` (bag, number of a name, score), by bag and rank, and the names they need."""
    bag, row, score = found
    by_name = pc.sort_indices(names).to_numpy()
    place = np.empty(len(names), dtype=np.int64)
    place[by_name] = np.arange(len(names))
    order = np.lexsort((place[row], -score, bag))
    bag, row, score = bag[order], row[order], score[order]
    kept = np.arange(len(bag)) - np.searchsorted(bag, bag) < k
    used, row = np.unique(row[kept], return_inverse=True)
    return (bag[kept], row, score[kept]), names.take(pa.array(used))


def _scored(batches: Iterator[pa.RecordBatch], block: tuple, average: float, k: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` of a task's chunks for each bag of a ``block``: its words, the numbers of its bags, where the terms of
    each begin, terms and weights. The task goes through its chunks by thousands. What the best ``k`` of a bag so far score
    bounds what comes: of later chunks only those are looked at whose terms can reach that score, most of them through the
    bag's rare terms alone."""
    words, numbers, starts, term, weight = block
    known, pairs = pa.array(words, pa.string()), list(zip(term.tolist(), weight.tolist()))
    bags = [pairs[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
    found, names = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), pa.array([], pa.string())
    least = np.full(len(bags), -np.inf)
    for part in _parts(batches):
        held = _Postings(part, known, average)
        more = [(q, *got) for q, (bag, low) in enumerate(zip(bags, least.tolist())) if (got := held.best(bag, low, k)) and len(got[0])]
        if not more:
            continue
        sizes = [len(r) for _, r, _ in more]
        several = (np.repeat([q for q, _, _ in more], sizes), np.concatenate([r for _, r, _ in more]) + len(names), np.concatenate([s for _, _, s in more]))
        found, names = _merged(tuple(np.concatenate(x) for x in zip(found, several)), pa.concat_arrays([names, held.ids]), k)
        last = np.flatnonzero(np.arange(len(found[0])) - np.searchsorted(found[0], found[0]) == k - 1)
        least[found[0][last]] = found[2][last]
    for at in range(0, len(found[0]), 100_000):
        bag, row, score = (x[at : at + 100_000] for x in found)
        yield pa.RecordBatch.from_arrays([pa.array(numbers[bag]), names.take(pa.array(row)), pa.array(score)], ["bag_no", "chunk_id", "score"])


def _block(held: DataFrame, rows: pd.DataFrame, average: float, k: int) -> tuple[DataFrame, Broadcast]:
    """The best ``k`` chunks of each part of the table for each bag of a block ``rows`` (bag_no, term, weight): (bag_no,
    chunk_id, score); and what was sent to the tasks for it."""
    shared = held.sparkSession.sparkContext.broadcast(_packed(rows))
    return held.select("chunk_id", "n", "terms", "tfs").mapInArrow(lambda batches: _scored(batches, shared.value, average, k), "bag_no bigint, chunk_id string, score double"), shared


def _packed(rows: pd.DataFrame) -> tuple:
    """A block as ``_scored`` takes it."""
    rows = rows.sort_values("bag_no", kind="stable")
    numbers, starts = np.unique(rows["bag_no"].to_numpy(), return_index=True)
    words, term = np.unique(rows["term"].to_numpy().astype(str), return_inverse=True)
    return words.tolist(), numbers, np.append(starts, len(rows)), term, rows["weight"].to_numpy()


def indexed(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``bm25`` needs of the chunks, written down: the counted terms and their frequencies. To be dropped by the caller."""
    held = runtime.materialise(counted(chunks), "counted")
    return held, runtime.materialise(idf_of(held), "frequencies")


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 10, block: int = BAGS, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank), exact. The bags are taken in blocks of about ``block``; a block's weights (at
    most ``block`` times the terms of a query) go to all tasks, each scores its own chunks against the whole block and
    sends on the best k a bag and part. So no pair of query and chunk is shuffled that can't be in an answer. Several searches
    of the same chunks may share their ``index``."""
    asked = runtime.materialise(bags(queries).withColumn("bag_no", F.xxhash64("bag")), "bags")
    held, frequencies = index or indexed(chunks)
    weighted = runtime.materialise(weights(asked, frequencies).withColumn("bag_no", F.xxhash64("bag")).drop("bag"), "weights")
    average = held.agg(F.avg("n")).first()[0]
    blocks = -(-weighted.select("bag_no").distinct().count() // block)
    every = None
    for number in range(blocks):
        rows = weighted.where(F.pmod(F.col("bag_no"), F.lit(blocks)) == number).toPandas()  # a block
        if not len(rows):
            continue
        scored, shared = _block(held, rows, average, k)
        part = runtime.materialise(top_k(scored, k, "bag_no"), "block")
        shared.destroy()
        every = part if every is None else every.unionByName(part)
    for written in (weighted,) if index else (weighted, held, frequencies):
        runtime.drop(written)
    if every is None:
        return queries.select("query_id", F.lit("").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    return asked.drop("bag").join(every, "bag_no").select("query_id", "chunk_id", "score", "rank")
