"""Filling containers of fixed capacity with documents, held to the mixture of the sources.

Mixture-controlled packing by deficit round-robin. Documents lie in lanes by a hash; the number of
lanes follows from the number of tokens (``lane_tokens`` each), so no task gets more than its
lane, however much a source holds. In a lane each source has a queue, and containers
(windows) are filled one after another:

* at the start of a window every source earns its share of the capacity, added to its deficit;
* the source with the largest deficit that has a document that still fits places the largest such
  one, and pays its tokens; this repeats until no queue has one that fits;
* deficits, paid or owed, carry over to the next window. They carry over between lanes too: what a
  source is owed at the start of lane k is its share of all tokens of the lanes before less
  its own tokens in them, known from the counts by lane and source before any lane is packed.

A document over the capacity, and only such a one, is split: into full containers and a rest,
which is packed like any other. A lane's last windows can stay partly empty, so unused space is
about one container a lane.

The packing moves (id, source, size), never texts. Null and empty texts have no tokens and lie in
the first container of their lane with size 0. A null source is a source of its own. Null
ids are kept. Rows repeated are packed as often as they come. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone import runtime
from siltstone.llm import tokens

CAPACITY, LANE_TOKENS, LANE_BLOCK = 2_048, 4_000_000, 4_096
OUT = "doc_id bigint, piece int, container_id bigint, slot int, start_token bigint, n_tokens bigint"


def fill(sizes: list[int], sources: list[str], share: dict[str, float], owed: dict[str, float], capacity: int) -> list[tuple[int, int, int]]:
    """(item, window, slot) for each item of one lane. ``owed``: the deficits at its start."""
    queues: dict[str, list[tuple[int, int]]] = {}
    placed: list[tuple[int, int, int]] = []
    for i, (n, s) in enumerate(zip(sizes, sources)):
        if n > 0:
            queues.setdefault(s, []).append((n, i))
    for q in queues.values():
        q.sort()
    deficit = {s: owed.get(s, 0.0) for s in sorted(queues)}
    window = 0
    while queues:
        for s in deficit:
            deficit[s] += share[s] * capacity
        free, slot = capacity, 0
        while queues:
            best = None
            for s, q in queues.items():
                if q[0][0] <= free and (best is None or (deficit[s], s) > (deficit[best], best)):
                    best = s
            if best is None:
                break
            q = queues[best]
            n, i = q.pop(bisect_right(q, (free, len(sizes))) - 1)
            deficit[best] -= n
            free -= n
            placed.append((i, window, slot))
            slot += 1
            if not q:
                del queues[best]
        window += 1
    empty = [i for i, n in enumerate(sizes) if n <= 0]
    first = sum(1 for p in placed if p[1] == 0)
    return placed + [(i, 0, first + k) for k, i in enumerate(empty)]


def _before(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """``rows`` (lane, *by, value) with ``out``: the sum of ``value`` over the lanes before, within ``by``. Lanes are summed
    by blocks first, so that no window holds more than a block of lanes, or a row for each block."""
    blocked = rows.withColumn("block", F.floor(F.col("lane") / LANE_BLOCK))
    sums = blocked.groupBy(*by, "block").agg(F.sum(value).alias("_sum"))
    ahead = W.partitionBy(*by).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(*by, "block", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_carried"))
    within = W.partitionBy(*by, "block").orderBy("lane").rowsBetween(W.unboundedPreceding, -1)
    return blocked.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(carried, [*by, "block"]).withColumn(out, F.col("_carried") + F.col("_within")).drop("block", "_carried", "_within")


def owed_by_lane(by_lane: DataFrame, total: int) -> DataFrame:
    """(lane, source, share, owed) of ``by_lane`` (lane, source, n): what each source that occurs in a lane is owed
    when the lane begins. Only what occurs is joined: by source, and by lane."""
    shares = by_lane.groupBy("source").agg((F.sum("n") / F.lit(max(total, 1))).alias("share"))
    lanes = _before(by_lane.groupBy("lane").agg(F.sum("n").alias("lane_n")), [], "lane_n", "all_before").select("lane", "all_before")
    own = _before(by_lane, ["source"], "n", "own_before").join(shares, "source").join(lanes, "lane")
    return own.select("lane", "source", "share", (F.col("share") * F.col("all_before") - F.col("own_before")).alias("owed"))


def pack(sized: DataFrame, capacity: int = CAPACITY, lane_tokens: int = LANE_TOKENS) -> DataFrame:
    """``sized``: (doc_id, source, n). Columns of OUT: where each piece of each document lies; its
    tokens are those from start_token on, n_tokens of them."""
    last = F.greatest(F.floor((F.col("n") - 1) / capacity), F.lit(0)).cast("int")
    items = sized.select("doc_id", F.coalesce("source", F.lit("\0null")).alias("source"), "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    items = items.select("doc_id", "source", "piece", F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    lanes = max(1, -(-total // lane_tokens))
    laned = items.withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(lanes)))
    by_lane = runtime.materialise(laned.groupBy("lane", "source").agg(F.sum("n").alias("n")), "lanes")

    def lane_of(pdf: pd.DataFrame, owed: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "doc_id", "piece"], kind="stable", ignore_index=True)
        shares, debts = dict(zip(owed.source, owed.share)), dict(zip(owed.source, owed.owed))
        placed = fill(pdf.n.tolist(), pdf.source.tolist(), shares, debts, capacity)
        at = pd.DataFrame(placed, columns=["item", "window", "slot"]).set_index("item").sort_index()
        return pd.DataFrame({
            "doc_id": pdf.doc_id, "piece": pdf.piece.astype(np.int32), "container_id": pdf.lane.to_numpy() * (1 << 32) + at.window.to_numpy(),
            "slot": at.slot.to_numpy().astype(np.int32), "start_token": pdf.piece.astype(np.int64) * capacity, "n_tokens": pdf.n,
        })

    return laned.groupBy("lane").cogroup(owed_by_lane(by_lane, total).groupBy("lane")).applyInPandas(lane_of, OUT)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, lane_tokens: int = LANE_TOKENS, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """Documents (doc_id, text, source), sized in tokens of the vocabulary, and packed."""
    sized = runtime.materialise(tokens.token_counts(documents, "doc_id", "text", ["source"], vocabulary), "sized")
    return pack(sized, capacity, lane_tokens)


def fills(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, pieces, used, unused) of each container."""
    return packed.groupBy("container_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("used")).withColumn("unused", capacity - F.col("used"))
