"""Processing only new or changed records.

The feed is treated as a log. Its rows fall into a fixed number of log partitions by the
hash of their key, and within one partition their offset grows in order of arrival. A run

1. plans: for every log partition the range (last committed offset, highest offset now],
   written ahead to ``plans/N.json`` before a row is touched;
2. reads exactly the rows of that plan, whatever has arrived since;
3. hands them to a sink that keeps each key once, at its smallest offset, and drops keys
   that the ledger of earlier runs already holds;
4. commits: ``commits/N.json``, after the sink's own directory ``batch=N`` is whole.

After a failure between 1 and 4 the next run finds a plan without a commit and replays that
very plan; the sink overwrites ``batch=N``, so nothing is skipped and nothing comes twice.

The plan holds two numbers per log partition, so its size follows the number of log
partitions (a parameter), never the data. Keys are hashed with the file, not the
repository alone: a repository with a third of all rows is spread over all partitions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import runtime
from siltstone.functions.versions import canonical_path, version_key

KEY = ("key_repo", "key_path", "key_version")


def versioned(df: DataFrame) -> DataFrame:
    """``df`` with the key columns of a version, whichever way it is written. Rows with null
    ``file_path`` or ``last_updated`` are left out; a null repository is a repository of its own."""
    return df.where(F.col("file_path").isNotNull() & F.col("last_updated").isNotNull()).select(
        "*",
        F.coalesce(F.col("source_repo"), F.lit("")).alias(KEY[0]),
        canonical_path(F.col("file_path")).alias(KEY[1]),
        version_key(F.col("last_updated")).alias(KEY[2]),
    )


def ledger(processed: DataFrame, runs: DataFrame) -> DataFrame:
    """The versions that a successful run recorded, as key columns; repeats are left in, as
    an anti join doesn't mind them. What failed or aborted runs recorded was rolled back."""
    done = runs.where(F.col("run_state") == "success").select(F.col("run_id").alias("done_run"))
    return versioned(processed).join(done, F.col("run_id") == F.col("done_run"), "left_semi").select(*KEY)


@dataclass(frozen=True)
class Plan:
    """Batch ``number`` covers the offsets (start, end] of each log partition."""

    number: int
    start: tuple[int, ...]
    end: tuple[int, ...]
    replayed: bool = False


class ChangeCapture:
    """Log-based change capture with a write-ahead plan for each batch.

    ``state`` is a folder on storage that all runs share. ``offset`` names the log's offset
    column, a bigint that grows in order of arrival. One writer at a time.
    """

    def __init__(self, spark: SparkSession, state: str, partitions: int = 64, offset: str = "entry_id"):
        self.spark, self.state, self.partitions, self.offset = spark, state.rstrip("/"), partitions, offset

    # -- small files of the protocol -------------------------------------------------
    def _numbers(self, kind: str) -> list[int]:
        fs, p = runtime.hadoop_fs(self.spark, f"{self.state}/{kind}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _load(self, kind: str, number: int) -> dict:
        fs, p = runtime.hadoop_fs(self.spark, f"{self.state}/{kind}/{number}.json")
        stream = fs.open(p)
        try:
            reader = self.spark.sparkContext._jvm.java.io.BufferedReader(self.spark.sparkContext._jvm.java.io.InputStreamReader(stream, "UTF-8"))
            return json.loads(reader.readLine())
        finally:
            stream.close()

    def _store(self, kind: str, number: int, what: dict) -> None:
        """Written beside its place and renamed: it is there whole or not at all."""
        fs, place = runtime.hadoop_fs(self.spark, f"{self.state}/{kind}/{number}.json")
        _, beside = runtime.hadoop_fs(self.spark, f"{self.state}/{kind}/.{number}.tmp")
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        if not fs.rename(beside, place):
            raise RuntimeError(f"{kind} {number} exists: another run is writing here")

    # -- the protocol -----------------------------------------------------------------
    def _partition(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k) for k in KEY[:2])), F.lit(self.partitions)).cast("int")

    def plan(self, log: DataFrame) -> Plan:
        """The plan of the next batch; after a failure the plan that was not committed."""
        plans, commits = self._numbers("plans"), self._numbers("commits")
        if plans and (not commits or plans[-1] > commits[-1]):
            old = self._load("plans", plans[-1])
            return Plan(plans[-1], tuple(old["start"]), tuple(old["end"]), replayed=True)
        start = self._load("commits", commits[-1])["end"] if commits else [-(1 << 62)] * self.partitions
        rows = versioned(log).groupBy(self._partition().alias("part")).agg(F.max(self.offset).alias("last")).collect()
        end = list(start)
        for r in rows:  # one row per log partition
            end[r["part"]] = max(end[r["part"]], r["last"] if r["last"] is not None else end[r["part"]])
        plan = Plan((commits[-1] + 1) if commits else 0, tuple(start), tuple(end))
        self._store("plans", plan.number, {"start": start, "end": end})
        return plan

    def read(self, log: DataFrame, plan: Plan) -> DataFrame:
        """The rows of the plan, with key columns."""
        # The bounds over all partitions reach the scan; each partition's own follow.
        log = log.where((F.col(self.offset) > min(plan.start)) & (F.col(self.offset) <= max(plan.end)))
        bounds = lambda values: F.element_at(F.array(*(F.lit(v).cast("bigint") for v in values)), self._partition() + 1)
        return versioned(log).where((F.col(self.offset) > bounds(plan.start)) & (F.col(self.offset) <= bounds(plan.end)))

    def deduplicate(self, batch: DataFrame, done: DataFrame) -> DataFrame:
        """Each key of the batch that ``done`` doesn't hold, at its smallest offset."""
        first = batch.groupBy(*KEY).agg(F.min(self.offset).alias(self.offset))
        return first.join(done.select(*KEY), list(KEY), "left_anti")

    def sink(self, plan: Plan, rows: DataFrame) -> None:
        """Write the batch's own directory; a replay overwrites it."""
        rows.write.mode("overwrite").parquet(f"{self.state}/sink/batch={plan.number}")

    def sunk(self) -> DataFrame | None:
        """What committed batches wrote; an unfinished batch doesn't show."""
        paths = [f"{self.state}/sink/batch={n}" for n in self._numbers("commits")]
        return self.spark.read.parquet(*paths) if paths else None

    def commit(self, plan: Plan) -> None:
        self._store("commits", plan.number, {"end": list(plan.end)})

    def run(self, log: DataFrame, done: DataFrame) -> Plan:
        """One whole run; ``done`` is the outer ledger, beside what this sink holds itself."""
        plan = self.plan(log)
        before = self.sunk()
        held = done.select(*KEY) if before is None else done.select(*KEY).unionByName(before.select(*KEY))
        self.sink(plan, self.deduplicate(self.read(log, plan), held))
        self.commit(plan)
        return plan


def pending(feed: DataFrame, processed: DataFrame, runs: DataFrame, partitions: int = 64) -> DataFrame:
    """``entry_id`` of every version that no successful run has processed, each once at its
    smallest entry_id: what a run starting now gets and sinks.

    A whole run: its plan is written ahead to a state folder below the shared folder, its batch goes through the sink, and
    what is committed comes out. Nulls in
    ``file_path`` or ``last_updated`` leave the feed; an empty feed gives no rows; repeated
    deliveries and repeated records of a run count once; other columns are never read.
    """
    spark = feed.sparkSession
    capture = ChangeCapture(spark, runtime.new_path(spark, "capture"), partitions)
    feed = feed.select("entry_id", "source_repo", "file_path", "last_updated")
    capture.run(feed, ledger(processed, runs))
    return capture.sunk().select("entry_id")


def pending_in_runs(feed: DataFrame, processed: DataFrame, runs: DataFrame, cut: int, partitions: int = 64) -> DataFrame:
    """The same over several runs with their offsets kept, one of them failing: the first run sees the feed up to entry
    ``cut``; the second plans the rest, sinks it and dies before its commit; the third replays that plan."""
    spark = feed.sparkSession
    state = runtime.new_path(spark, "capture")
    feed = feed.select("entry_id", "source_repo", "file_path", "last_updated")
    done = ledger(processed, runs)
    ChangeCapture(spark, state, partitions).run(feed.where(F.col("entry_id") <= cut), done)
    died = ChangeCapture(spark, state, partitions)
    plan = died.plan(feed)
    died.sink(plan, died.deduplicate(died.read(feed, plan), done.unionByName(died.sunk().select(*KEY))))
    again = ChangeCapture(spark, state, partitions)
    if not again.run(feed, done).replayed:
        raise RuntimeError("the plan of the failed run was not replayed")
    return again.sunk().select("entry_id")
