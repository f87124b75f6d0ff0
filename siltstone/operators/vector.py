"""Nearest chunks by cosine: exact, and by an index of cells.

Exact search takes the queries in blocks of ``block``: one block's matrix (its size is ``block`` times the dimension,
whatever the data) goes to all tasks, each multiplies it with its own vectors, batch by batch, and keeps the best k of
its part, so the shuffle has k rows a query and task. More queries than a block make more passes over the
vectors; ``in_cells`` is the way for those.

Null vectors, vectors of another dimension than the query, and zero vectors have similarity 0 and take part
as such, except null ones, which are left out. Ranks are by the similarity rounded to 9 places, then by id.
Repeated ids are ranked as often as they come. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone import runtime

BLOCK = 4_096


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows in doubles; zero rows for zero vectors and for other dimensions."""
    n = len(column)
    sizes = np.asarray(column.value_lengths().fill_null(0))
    out = np.zeros((n, dim))
    right = sizes == dim
    flat = np.asarray(column.filter(pa.array(right)).flatten().fill_null(0.0), dtype=np.float64)
    if right.any():
        out[right] = flat.reshape(-1, dim)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def _best(ids: np.ndarray, similar: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query (a column) the positions of its best k, by similarity then id."""
    out = []
    for q in range(similar.shape[1]):
        s = similar[:, q]
        at = np.arange(len(s))
        if len(s) > k:
            edge = np.partition(s, len(s) - k)[len(s) - k]
            at = np.nonzero(s >= edge)[0]
        out.append(at[np.lexsort((ids[at], -s[at]))][:k])
    return out


FIRST, ROWS = 1_024, 4_096  # vectors that are compared together: at first, then
CLOSE = 1e-7  # room for the last bits of sums


def _scored(batches: Iterator[pa.RecordBatch], known: list[list[float]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, similarity) with the best ``k`` of a task's vectors for each of the ``known`` queries, by their numbers. What
    the best ``k`` so far reach bounds what comes: later similarities below it are neither rounded nor sorted."""
    sizes = np.array([len(v) for v in known])
    groups = [(cols := np.flatnonzero(sizes == dim), _matrix(pa.array([known[i] for i in cols], pa.list_(pa.float64())), int(dim))) for dim in np.unique(sizes)]
    least = np.full(len(known), -np.inf)
    query, near, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    most = FIRST
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, most)
            at, most = at + part.num_rows, ROWS
            ids, more = np.asarray(part.column(0)), [(query, near, score)]
            for cols, q in groups:
                similar = q @ _matrix(part.column(1), q.shape[1]).T
                low = least[cols]
                if len(ids) > k and np.isneginf(low).any():
                    low = np.maximum(low, np.partition(similar, len(ids) - k, axis=1)[:, len(ids) - k])
                c, r = np.nonzero(similar >= low[:, None] - CLOSE)
                more.append((cols[c], ids[r], np.round(similar[c, r], 9)))
            query, near, score = (np.concatenate(x) for x in zip(*more))
            order = np.lexsort((near, -score, query))
            query, near, score = query[order], near[order], score[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            least[query[place == k - 1]] = score[place == k - 1]
            query, near, score = query[place < k], near[place < k], score[place < k]
    return query, near, score


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score, rank) for vectors (id, vector) and queries (query_id, vector), exact."""
    spark = vectors.sparkSession
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", "vector")
    total = asked.count()
    blocks = -(-total // block)
    numbered = asked.withColumn("_n", F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks))))
    held = vectors.where(F.col("vector").isNotNull()).select(F.col("id").cast("bigint"), "vector")
    every = None
    for number in range(blocks):
        rows = numbered.where(F.col("_n") == number).select("query_id", "vector").collect()  # about ``block``
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], [list(r[1]) for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, known = shared.value
            query, near, score = _scored(batches, known, k)
            query = np.array(names, dtype=np.int64)[query]
            for at in range(0, len(query), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (query, near, score)], ["query_id", "id", "score"])

        best = ranked(held.mapInArrow(run, "query_id bigint, id bigint, score double"), k)
        if blocks > 1:  # one block at a time is run, written and let go
            best = runtime.materialise(best, "block")
            shared.destroy()
        every = best if every is None else every.unionByName(best)
    return spark.createDataFrame([], "query_id bigint, id bigint, score double, rank int") if every is None else every


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query, cut in each task before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Cells:
    """An index: unit centroids, and how many cells a query looks into."""

    centroids: np.ndarray
    probes: int


def fit_cells(vectors: DataFrame, k: int = 10, sample: int = 20_000, cells: int = 256, target: float = 0.95, rounds: int = 12, seed: int = 11) -> Cells | None:
    """Spherical k-means over a bounded ``sample`` of ``vectors`` (id, vector), chosen by a hash; ``cells`` at most, and no
    more than the root of the sample. The number of probes isn't a guess: it is the least with which vectors of the sample
    find ``target`` of their ``k`` nearest in the sample. Vectors that fall into groups need few; vectors without any order
    need about half of all cells, as nothing tells where their nearest are. Of vectors of several dimensions the most
    frequent one is indexed. None if there is no vector."""
    rows = vectors.where(F.col("vector").isNotNull() & (F.size("vector") > 0)).orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()  # the bounded sample
    if not rows:
        return None
    sizes, counts = np.unique([len(r[0]) for r in rows], return_counts=True)
    held = _matrix(pa.array([r[0] for r in rows if len(r[0]) == sizes[counts.argmax()]], pa.list_(pa.float64())), int(sizes[counts.argmax()]))
    rng, n = np.random.default_rng(seed), min(cells, max(1, int(len(held) ** 0.5)))
    centre = held[rng.choice(len(held), n, replace=False)].copy()
    for _ in range(rounds):
        at = (held @ centre.T).argmax(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, at, held)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centre)
    at, asked = (held @ centre.T).argmax(1), held[rng.choice(len(held), min(200, len(held)), replace=False)]
    near = np.argsort(-(asked @ held.T), axis=1)[:, :k]
    place = np.argsort(np.argsort(-(asked @ centre.T), axis=1), axis=1)  # of each cell in the order of each query
    needed = np.take_along_axis(place, at[near], axis=1).ravel() + 1
    return Cells(centre, int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]))


def _in_cells(rows: DataFrame, index: Cells, probes: int) -> DataFrame:
    """``rows`` (id, vector) once for each of the ``probes`` nearest cells; those of another dimension drop out."""
    dim = index.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.compute.equal(pa.compute.list_value_length(batch.column(1)), dim))
            order = np.argsort(-(_matrix(part.column(1), dim) @ index.centroids.T), axis=1, kind="stable")[:, :probes]
            again = pa.array(np.repeat(np.arange(part.num_rows), order.shape[1]))
            yield pa.RecordBatch.from_arrays([part.column(0).take(again), part.column(1).take(again), pa.array(order.ravel().astype(np.int32))], ["id", "vector", "cell"])

    return rows.mapInArrow(run, f"id bigint, vector {rows.schema['vector'].dataType.simpleString()}, cell int")


def in_cells(vectors: DataFrame, queries: DataFrame, k: int = 10, index: Cells | None = None, group: int = 20_000) -> DataFrame:
    """Approximate ``top_k`` by an index of cells: every vector lies in its nearest cell, and a query meets the vectors of
    its nearest ``probes`` cells. A cell is cut into parts of about ``group`` vectors and ``group`` queries, each pair of
    parts is one matrix product, and only the best k of a part are sent on; so a cell with a third of all rows is many
    tasks, and a vector is moved once for each part of queries of its cell."""
    index = index or fit_cells(vectors, k)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
    have = _in_cells(vectors.where(F.col("vector").isNotNull()).select(F.col("id").cast("bigint").alias("id"), "vector"), index, 1)
    ask = _in_cells(queries.where(F.col("vector").isNotNull()).select(F.col("query_id").cast("bigint").alias("id"), "vector"), index, index.probes)
    have, ask = runtime.materialise(have, "cells"), runtime.materialise(ask, "probes")
    parts = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / group).cast("int").alias(name))
    cut = F.broadcast(parts(have, "mine").join(parts(ask, "theirs"), "cell"))  # a row for each cell at most

    def spread(df: DataFrame, own: str, other: str) -> DataFrame:
        met = df.join(cut, "cell").withColumn(f"{own}_part", F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
        return met.withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("cell", "mine_part", "theirs_part", "id", "vector").groupBy("cell", "mine_part", "theirs_part")

    def meet(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        dim = index.centroids.shape[1]
        x, q = (_matrix(pa.array(df["vector"].tolist(), pa.list_(pa.float64())), dim) for df in (mine, theirs))
        ids, out = mine["id"].to_numpy(), []
        for begin in range(0, len(q), 512):
            similar = np.round(x @ q[begin : begin + 512].T, 9)
            out += [(theirs["id"].iloc[begin + c], at, similar[at, c]) for c, at in enumerate(_best(ids, similar, k))]
        return pd.DataFrame({"query_id": np.repeat([i for i, _, _ in out], [len(at) for _, at, _ in out]), "id": np.concatenate([ids[at] for _, at, _ in out]), "score": np.concatenate([s for _, _, s in out])}) if len(mine) and out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    return ranked(spread(have, "mine", "theirs").cogroup(spread(ask, "theirs", "mine")).applyInPandas(meet, "query_id bigint, id bigint, score double"), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row, ``recall``: the share of the exact answers among those found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))
