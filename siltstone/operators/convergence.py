"""Keeping the stored chunks equal to what the sources hold: last version wins, upsert, removal of what is stale or
withdrawn, listings, and snapshots published as a whole.

A stored key that is null belongs to no active document, so it is removed (a left anti join, never NOT IN). All
operators are equi-joins and aggregates on document or chunk keys. Empty stores and empty batches are
ordinary cases. After a pass that saw all sources the store is the pass's chunks; ``transitions`` says what that changes.
A failed source must be told apart from an empty one before: a pass takes what it is given as all there is.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import runtime
from siltstone.functions import text as tx


def last_wins(documents: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key in ``order``; ties by all columns' hash, so that the choice is the same in every run.
    Nulls in the order come first. A hot key combines before the shuffle: it is an aggregate, no window."""
    rest = [c for c in documents.columns if c not in keys]
    rank = F.struct(*order, F.xxhash64(*documents.columns))
    return documents.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*")


def first_wins(documents: DataFrame, keys: list[str], order: list) -> DataFrame:
    rest = [c for c in documents.columns if c not in keys]
    return documents.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order, F.xxhash64(*documents.columns))).alias("_r")).select(*keys, "_r.*")


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new``, and stored rows whose chunk_id it doesn't have; metadata is replaced, not merged."""
    return stored.join(new.select("chunk_id"), "chunk_id", "left_anti").select(*new.columns).unionByName(new)


def stale(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored chunks of the documents in ``new`` that these no longer have."""
    touched = stored.join(new.select("doc_key").distinct(), "doc_key", "left_semi")
    return touched.join(new.select("chunk_id"), "chunk_id", "left_anti")


def withdrawn(stored: DataFrame, active: DataFrame) -> DataFrame:
    """Stored chunks whose document isn't active, or that name none."""
    return stored.join(active.select("doc_key"), "doc_key", "left_anti")


def transitions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(chunk_id, action) of a pass that saw all sources: what it inserts, replaces and deletes, by one join."""
    had, has = stored.select("chunk_id", F.lit(True).alias("had")), new.select("chunk_id", F.lit(True).alias("has"))
    action = F.when(F.col("had").isNull(), "insert").when(F.col("has").isNull(), "delete").otherwise("replace")
    return had.join(has, "chunk_id", "full_outer").select("chunk_id", action.alias("action"))


def merged(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The store after a batch that may hold only some chunks of a document. Each chunk says how many its version of the
    document has (``chunk_count``). Of a chunk the last version stays; a chunk goes only if the last version of its
    document, as far as it is known, has fewer chunks. So a document may come in any number of batches, in any order."""
    every = batch if stored is None else stored.select(*batch.columns).unionByName(batch)
    latest = last_wins(every, ["chunk_id"], [F.col("last_updated")])
    counts = latest.groupBy("doc_key").agg(F.max_by("chunk_count", F.struct("last_updated", "chunk_count")).alias("_count"))
    met = latest.join(counts.withColumnRenamed("doc_key", "_key"), F.col("doc_key").eqNullSafe(F.col("_key")))
    return met.where(F.coalesce(F.col("chunk_index") < F.col("_count"), F.lit(True))).select(*batch.columns)


def pass_stats(stored: DataFrame, new: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: documents and chunks indexed, chunks deleted, documents skipped for having no chunk."""
    indexed = new.agg(F.count_distinct("doc_key").alias("documents"), F.count("*").alias("chunks"))
    deleted = stored.join(new.select("chunk_id"), "chunk_id", "left_anti").agg(F.count("*").alias("deleted"))
    skipped = documents.select(tx.doc_key(F.col("source_repo"), F.col("file_path")).alias("doc_key")).distinct().join(new.select("doc_key"), "doc_key", "left_anti").agg(F.count("*").alias("skipped"))
    return indexed.crossJoin(deleted).crossJoin(skipped)  # one row each


def listing(chunks: DataFrame) -> DataFrame:
    """(source_repo, file_path, doc_type, chunks, last_updated) of each document; the key is doc_key, or repo and
    path where that is null or empty."""
    key = F.coalesce(F.when(F.col("doc_key") != "", F.col("doc_key")), tx.doc_key(F.coalesce("source_repo", F.lit("")), F.coalesce("file_path", F.lit(""))))
    first = F.min_by(F.struct("source_repo", "file_path", "doc_type"), F.struct("chunk_index", "chunk_id")).alias("f")
    return chunks.groupBy(key.alias("_k")).agg(first, F.count("*").alias("chunks"), F.max("last_updated").alias("last_updated")).select("f.*", "chunks", "last_updated")


def listed(chunks: DataFrame) -> DataFrame:
    """``listing`` in order of repository and path."""
    return listing(chunks).orderBy("source_repo", "file_path")


def with_metadata(chunks: DataFrame, **equal: object) -> DataFrame:
    """Chunks whose metadata equal the given values; pushed down to the scan. A value of None matches nulls."""
    for name, value in equal.items():
        chunks = chunks.where(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return chunks


def totals(chunks: DataFrame) -> DataFrame:
    return listing(chunks).agg(F.count("*").alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.max("last_updated").alias("last_refresh"))


# -- snapshots --------------------------------------------------------------------------------
def _versions(spark: SparkSession, store: str) -> list[int]:
    fs, p = runtime.hadoop_fs(spark, f"{store}/pointers")
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n) for n in names if n.isdigit())


def publish(chunks: DataFrame, store: str, version: str, marker: str = "") -> str:
    """Write a snapshot beside the others and point the store at it. Pointers are numbered and renamed into place, and
    none is ever deleted or replaced, so a reader finds the old snapshot or the new one, whole. One writer at a time: of
    two, one finds its number taken and fails. A version that is the current one already is not pointed at again."""
    spark = chunks.sparkSession
    place = f"{store}/snapshots/{version}"
    chunks.write.mode("overwrite").parquet(place)
    taken = _versions(spark, store)
    if taken and _pointer(spark, store, taken[-1])["version"] == version:
        return place
    number = taken[-1] + 1 if taken else 0
    fs, beside = runtime.hadoop_fs(spark, f"{store}/pointers/.{version}-{number}")
    _, pointer = runtime.hadoop_fs(spark, f"{store}/pointers/{number}")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps({"version": version, "marker": marker}).encode()))
    out.close()
    if fs.exists(pointer) or not fs.rename(beside, pointer):
        raise RuntimeError(f"snapshot {number} of {store} exists: another writer is at work")
    return place


def _pointer(spark: SparkSession, store: str, number: int) -> dict:
    fs, p = runtime.hadoop_fs(spark, f"{store}/pointers/{number}")
    stream = fs.open(p)
    try:
        reader = spark.sparkContext._jvm.java.io.BufferedReader(spark.sparkContext._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        return json.loads(reader.readLine())
    finally:
        stream.close()


def current(spark: SparkSession, store: str) -> DataFrame | None:
    taken = _versions(spark, store)
    return spark.read.parquet(f"{store}/snapshots/{_pointer(spark, store, taken[-1])['version']}") if taken else None


@dataclass
class Fresh:
    """What was built from a store, kept while neither the number of its rows nor the marker of its snapshot changes: an
    upsert may leave the number as it was, and a store without markers may change its number."""

    built: object = None
    state: tuple | None = None

    def get(self, spark: SparkSession, store: str, build) -> object:
        taken = _versions(spark, store)
        chunks = current(spark, store)
        state = (chunks.count(), _pointer(spark, store, taken[-1])["marker"]) if chunks is not None else (0, None)
        if state != self.state:
            self.built, self.state = build(chunks), state
        return self.built


def single_flight(spark: SparkSession, store: str, work, stale_after_s: float = 3_600.0) -> bool:
    """Run ``work`` unless another run is at it: the lock is a file that only one can create. A lock older than
    ``stale_after_s`` was left by a run that died. A failed run leaves the store as it was."""
    fs, lock = runtime.hadoop_fs(spark, f"{store}/refresh.lock")
    if fs.exists(lock) and time.time() * 1000 - fs.getFileStatus(lock).getModificationTime() > stale_after_s * 1000:
        fs.delete(lock, False)
    try:
        fs.create(lock, False).close()
    except Py4JJavaError:
        return False
    try:
        work()
        return True
    finally:
        fs.delete(lock, False)
