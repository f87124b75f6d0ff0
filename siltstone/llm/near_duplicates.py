"""Near-duplicate texts: universal hash minima, banding, signature verification, and
connected components by alternating large-star and small-star.

The stages, and what bounds each of them:

* ``signatures`` reads each text once, in Arrow batches. A text becomes its set of shingles,
  the set a 64-bit class (equal sets are one class), ``bands`` keys, each made of ``rows``
  universal hash minima, and the lowest byte of each minimum. Within a task, a class that was seen before sends no
  second set of these, so a group of copies sends one set per task, not one per copy.
* ``classes`` makes them one row per class, with its least id. All that follows counts classes, so it doesn't depend on
  how rows lie over tasks.
* ``candidates`` shuffles (key, class) once by key; each task sends on at most ``bucket_cap`` + 1 classes of a key. A
  bucket of up to ``bucket_cap`` classes gives its pairs. The classes of larger buckets, fetched over salts, are put
  into buckets of two keys, the crowded one and any other of theirs, where two shared keys are asked for: a phrase that
  much of a large table has crowds one key, seldom two. The classes of those that are still over the cap (or of all, where
  one shared key is enough) take the exact way of ``prefix_pairs``, which loses no pair: the cap chooses the way, it drops
  nothing. So a class is in at most bands * bucket_cap pairs of the first way.
* signature verification: a pair stays if at least ``min_shared`` of its band keys agree, and as many minima (by their
  lowest byte) as a pair at the threshold has with all but ``slack`` standard deviations.
* ``verified`` looks at the texts themselves of the pairs that are left, one shuffle of the
  texts, and keeps the pairs whose similarity is at least the threshold.
* ``components`` joins linked classes; its state is one row per link and round, written to the
  shared folder, and only a count of changed rows comes to the driver.

With 40 bands of 3 minima and two shared bands, a pair at similarity 0.5 is found with
probability 0.968, at 0.55 with 0.994, at 0.6 with 0.999; with 24 bands of 5 and one shared band, the default, a pair at
0.8 with 0.9999. Two classes share a 64-bit class
number by chance with a probability of about n * n / 2**65 for n different texts.

Nulls: a null id is dropped (it names no record); a null text, an empty one, and one under
``min_words`` words have no shingles and are in no link, and ``groups`` gives each a group of its
own. Rows repeated with the same id count once. Empty tables give empty results. Columns
beside id and text are never read, so their names can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from siltstone import runtime

WORD = re.compile(r"[^\W_]+")
SEEN = 1 << 18  # classes that a task remembers; forgetting one only costs a repeated row


@dataclass(frozen=True)
class Settings:
    """shingle: words in a shingle. threshold: least Jaccard similarity of a link. min_words:
    texts under so many words are in no link. bands, rows, min_shared: see the module.
    bucket_cap: larger buckets take the exact way. slack: standard deviations that the agreement of minima may stay
    behind. salts: parts of a hot group."""

    shingle: int = 5
    threshold: float = 0.8
    min_words: int = 12
    bands: int = 24
    rows: int = 5
    min_shared: int = 1
    bucket_cap: int = 64
    slack: float = 4.0
    salts: int = 16
    seed: int = 20_261


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, lower-cased."""
    if "İ" in text:  # its lower case has a mark, which would end the run
        return [w.lower() for w in WORD.findall(text)]
    return WORD.findall(text.lower())


class Shingler:
    """Sets of 64-bit shingle numbers; remembers the numbers of words."""

    def __init__(self, shingle: int):
        self.shingle, self.known = shingle, {}

    def __call__(self, text: str | None, min_words: int) -> np.ndarray | None:
        """Sorted distinct shingle numbers, or None for a text without any."""
        found = words(text) if text else []
        if len(found) < max(min_words, self.shingle):
            return None
        known = self.known
        if len(known) > 500_000:
            known.clear()
        try:
            numbers = [known[w] for w in found]
        except KeyError:
            for w in found:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            numbers = [known[w] for w in found]
        n = np.array(numbers, dtype=np.uint64)
        out = np.zeros(len(n) - self.shingle + 1, dtype=np.uint64)
        for i in range(self.shingle):
            out = (out ^ n[i : len(n) - self.shingle + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each multiply-shift function (a * x + b) >> 32 its least value."""
    least = None
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        m = (a * part[None, :] + b).min(axis=1)
        least = m if least is None else np.minimum(least, m)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(minima: np.ndarray) -> np.ndarray:
    """A 64-bit key for each text and band of (texts, bands, rows) minima, another for equal minima in another band."""
    h = np.arange(1, minima.shape[1] + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for row in range(minima.shape[2]):
        h = (h ^ minima[:, :, row].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ h >> np.uint64(32)).view(np.int64)


def signatures(texts: DataFrame, s: Settings) -> DataFrame:
    """(id, cls, keys, bits): keys and the minima's lowest bytes are null where this task has sent those of the class
    before. ``texts`` has the columns id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(s.seed)
        a = rng.integers(0, 1 << 63, (s.bands * s.rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 1 << 63, (s.bands * s.rows, 1), dtype=np.uint64)
        shingler, seen = Shingler(s.shingle), set()
        for batch in batches:
            ids, classes, fresh, minimal = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shingles = shingler(text.as_py(), s.min_words)
                if shingles is None:
                    continue
                cls = xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)
                ids.append(i)
                classes.append(cls)
                fresh.append(cls not in seen)
                if fresh[-1]:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(cls)
                    minimal.append(minima(shingles, a, b))
            sig = np.array(minimal, dtype=np.uint32).reshape(-1, s.bands, s.rows)
            keys, low = iter(band_keys(sig)), iter(sig.astype(np.uint8))
            lists, bits = [next(keys) if f else None for f in fresh], [next(low).tobytes() if f else None for f in fresh]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(classes, pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["id", "cls", "keys", "bits"])

    held = texts.select("id", "text").where(F.col("id").isNotNull() & F.col("text").isNotNull())
    return runtime.spread(held).mapInArrow(run, "id bigint, cls bigint, keys array<bigint>, bits binary")


def shingle_rows(texts: DataFrame, s: Settings) -> DataFrame:
    """(id, n, shingle), a row for each distinct shingle; for the exact way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(s.shingle)
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = shingler(text.as_py(), s.min_words)
                if x is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i)), pa.array(np.full(len(x), len(x), np.int32)), pa.array(x.view(np.int64))], ["id", "n", "shingle"])

    return texts.mapInArrow(run, "id bigint, n int, shingle bigint")


def prefix_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Exact: every pair of ids whose sets reach the threshold, with its similarity.

    Shingles are ordered from the rarest; two sets that reach the threshold share one of the
    first n - ceil(threshold * n) + 1 of theirs, and their sizes are within the threshold.
    """
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"))
    order = W.partitionBy("id").orderBy("often", "shingle")
    prefix = rows.join(often, "shingle").withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("id", "n", "shingle")
    left, right = (prefix.select(*(F.col(c).alias(f"{c}_{x}") for c in ("id", "n")), "shingle") for x in "ab")
    pairs = left.join(right, "shingle").where((F.col("id_a") < F.col("id_b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9)).select("id_a", "id_b").distinct()
    sets = rows.groupBy("id").agg(F.collect_list("shingle").alias("set"))
    both = pairs.join(sets.select(F.col("id").alias("id_a"), F.col("set").alias("set_a")), "id_a").join(sets.select(F.col("id").alias("id_b"), F.col("set").alias("set_b")), "id_b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.select("id_a", "id_b", (common / (F.size("set_a") + F.size("set_b") - common)).alias("similarity")).where(F.col("similarity") >= threshold)


def verified(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """(id_a, id_b, similarity) of the pairs whose texts reach the threshold. The texts are
    shuffled once: each id of a pair fetches its text, then the two meet by pair."""
    sides = pairs.select(F.explode(F.array(F.struct(F.col("id_a").alias("id"), F.lit(0).alias("side")), F.struct(F.col("id_b").alias("id"), F.lit(1).alias("side")))).alias("x"), "id_a", "id_b").select("x.*", "id_a", "id_b")
    met = sides.join(texts, "id").groupBy("id_a", "id_b").agg(F.max(F.when(F.col("side") == 0, F.col("text"))).alias("text_a"), F.max(F.when(F.col("side") == 1, F.col("text"))).alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(s.shingle)
        for batch in batches:
            similar = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = shingler(x.as_py(), s.min_words), shingler(y.as_py(), s.min_words)
                common = 0 if x is None or y is None else len(np.intersect1d(x, y, assume_unique=True))
                similar.append(common / (len(x) + len(y) - common) if common else 0.0)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similar, pa.float64())], ["id_a", "id_b", "similarity"])
            yield out.filter(pa.compute.greater_equal(out.column(2), s.threshold))

    return met.mapInArrow(run, "id_a bigint, id_b bigint, similarity double")


def classes(signed: DataFrame) -> DataFrame:
    """(cls, rep, keys, bits): one row per class, rep its least id."""
    return signed.groupBy("cls").agg(F.min("id").alias("rep"), F.first("keys", ignorenulls=True).alias("keys"), F.first("bits", ignorenulls=True).alias("bits"))


def crowds(keyed: DataFrame, cap: int) -> DataFrame:
    """(key, c): the keys of ``keyed`` (cls, key) that several classes have, with at most ``cap`` + 1 of these in order."""
    place = F.row_number().over(W.partitionBy("key").orderBy("cls"))
    few = keyed.withColumn("place", place).where(F.col("place") <= cap + 1)  # cut in each task, before the shuffle
    return few.groupBy("key").agg(F.sort_array(F.collect_list("cls")).alias("c")).where(F.size("c") > 1)


def pairs_in(buckets: DataFrame, s: Settings) -> DataFrame:
    """(cls_a, cls_b, shared): the pairs of the buckets up to the cap, and how many of these both are in."""
    ahead = buckets.where(F.size("c") <= s.bucket_cap).select("c", F.posexplode("c").alias("at", "cls_a"))
    return ahead.select("cls_a", F.explode(F.expr("slice(c, at + 2, size(c))")).alias("cls_b")).groupBy("cls_a", "cls_b").agg(F.count("*").alias("shared"))


def crowded(keyed: DataFrame, buckets: DataFrame, s: Settings) -> DataFrame:
    """(cls, key) of the buckets over the cap, all their classes."""
    hot = buckets.where(F.size("c") > s.bucket_cap).select("key", F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1))).alias("salt"))
    return keyed.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(s.salts)).cast("int")).join(hot, ["key", "salt"], "left_semi").select("cls", "key")


def twofold(hot: DataFrame, held: DataFrame) -> DataFrame:
    """(cls, key), a key for each two band keys of a class of which at least one is among ``hot`` (cls, key)."""
    mine = hot.groupBy("cls").agg(F.collect_set("key").alias("hot")).join(held.select("cls", "keys"), "cls")
    two = F.transform("hot", lambda h: F.transform(F.filter("keys", lambda k: k != h), lambda k: F.xxhash64(F.least(h, k), F.greatest(h, k))))
    return mine.select("cls", F.explode(F.array_distinct(F.flatten(two))).alias("key"))


def candidates(held: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(cls_a, cls_b) that share enough band keys, and the (cls) of buckets that take the exact way."""
    keyed = held.select("cls", F.explode("keys").alias("key"))
    buckets = runtime.materialise(crowds(keyed, s.bucket_cap), "buckets")
    likely = runtime.materialise(pairs_in(buckets, s).where(F.col("shared") >= s.min_shared).select("cls_a", "cls_b"), "likely")
    hot = runtime.materialise(crowded(keyed, buckets, s), "hot")
    runtime.drop(buckets)
    if s.min_shared > 1 and not hot.isEmpty():
        keyed = runtime.materialise(twofold(hot, held), "twofold")
        buckets = runtime.materialise(crowds(keyed, s.bucket_cap), "buckets")
        cold, likely = likely, runtime.materialise(likely.unionByName(pairs_in(buckets, s).select("cls_a", "cls_b")).distinct(), "likely")
        runtime.drop(hot)
        hot = runtime.materialise(crowded(keyed, buckets, s), "hot")
        for done in (cold, keyed, buckets):
            runtime.drop(done)
    return likely, hot.select("cls").distinct()


def least_agreement(s: Settings) -> float:
    """Of the minima's lowest bytes, at the threshold: by chance one in 256 agrees anyway."""
    p = s.threshold + (1 - s.threshold) / 256
    return p - s.slack * (p * (1 - p) / (s.bands * s.rows)) ** 0.5


def agreeing(pairs: DataFrame, s: Settings) -> DataFrame:
    """(rep_a, rep_b) of the pairs (rep_a, bits_a, rep_b, bits_b) whose signatures agree enough."""
    width, least = s.bands * s.rows, least_agreement(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, width) for k in (1, 3))
            kept = pa.array((x == y).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["rep_a", "rep_b"]).filter(kept)

    return pairs.select("rep_a", "bits_a", "rep_b", "bits_b").mapInArrow(run, "rep_a bigint, rep_b bigint")


@dataclass(frozen=True)
class Found:
    """links: (id_a, id_b, similarity), id_a < id_b, between representatives of classes.
    members: (id, rep), each id with shingles and the least id of its class."""

    links: DataFrame
    members: DataFrame


def near_duplicates(table: DataFrame, id_col: str, text_col: str, s: Settings = Settings()) -> Found:
    """Links between different texts, and the members of each class of equal shingle sets."""
    texts = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = runtime.materialise(signatures(texts, s), "signatures")
    held = runtime.materialise(classes(signed), "classes")
    members = runtime.materialise(signed.select("id", "cls").distinct().join(held.select("cls", "rep"), "cls").select("id", "rep"), "members")
    runtime.drop(signed)
    likely, large = candidates(held, s)
    of = lambda x: held.select(F.col("cls").alias(f"cls_{x}"), F.col("rep").alias(f"rep_{x}"), F.col("bits").alias(f"bits_{x}"))
    by_id = agreeing(likely.join(of("a"), "cls_a").join(of("b"), "cls_b"), s).select(F.least("rep_a", "rep_b").alias("id_a"), F.greatest("rep_a", "rep_b").alias("id_b"))
    by_id = runtime.materialise(by_id, "pairs")
    wanted = runtime.materialise(large.join(held.select("cls", "rep"), "cls").select(F.col("rep").alias("id")), "wanted")
    for done in (likely, held):
        runtime.drop(done)
    once = texts.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    links = runtime.materialise(verified(by_id, once, s), "verified")
    if not wanted.isEmpty():
        hot = runtime.materialise(shingle_rows(once.join(wanted, "id", "left_semi").dropDuplicates(["id"]), s), "shingles")
        links = runtime.materialise(links.unionByName(prefix_pairs(hot, s.threshold)).dropDuplicates(["id_a", "id_b"]), "links")
        runtime.drop(hot)
    return Found(links, members)


def all_pairs(found: Found, salts: int = 16) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the links carried over to all members, and the pairs within
    each class. As many rows as the answer has; ask for ``groups`` where that is too many."""
    rep_of = lambda x: found.members.select(F.col("id").alias(f"m_{x}"), F.col("rep").alias(f"id_{x}"))
    across = found.links.join(rep_of("a"), "id_a").join(rep_of("b"), "id_b").select("m_a", "m_b")
    copies = found.members.where(F.col("id") != F.col("rep"))  # few rows, so the join below is small
    crowded = copies.select("rep").distinct()
    inside = found.members.join(crowded, "rep", "left_semi")
    # A class may be a hot group: its members are spread over salts, and each part meets all of its copies.
    parts = inside.select(F.col("id").alias("m_a"), "rep", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    others = copies.select(F.col("id").alias("m_b"), "rep", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    within = parts.join(others, ["rep", "salt"]).where(F.col("m_a") < F.col("m_b")).select("m_a", "m_b")
    both = across.unionByName(within)
    return both.select(F.least("m_a", "m_b").alias("id_a"), F.greatest("m_a", "m_b").alias("id_b"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node is linked to, directly or not, by
    alternating large-star and small-star. Nodes without a link don't come out.

    A star step never joins a group to itself: the least neighbour of each node is an aggregate
    that combines before the shuffle, and is joined back to the node's links.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        met = both.join(least, "u")
        kept = met.where(F.col("v") > F.col("u")).select("v", "m") if large else met.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
        return kept.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    edges = runtime.materialise(links.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")).where(F.col("u") != F.col("v")), "edges")
    for _ in range(rounds):
        after = runtime.materialise(star(star(edges, True), False), "edges")
        same = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        changed = after.join(same, ["u", "v"], "left_anti").limit(1).count() or same.join(after, ["u", "v"], "left_anti").limit(1).count()
        runtime.drop(edges)
        edges = after
        if not changed:
            break
    else:
        raise RuntimeError(f"the components have not settled after {rounds} rounds")
    pointed = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pointed.unionByName(pointed.select(F.col("component").alias("node"), "component").distinct())


def groups(table: DataFrame, id_col: str, text_col: str, s: Settings = Settings()) -> DataFrame:
    """One row for each id: (id, rep, group_id, links). rep is the least id with the same shingles,
    group_id the least id of the component, links the number of links of the class; a record in
    no link and without a copy is a group of its own."""
    found = near_duplicates(table, id_col, text_col, s)
    links = runtime.materialise(found.links, "links")
    settled = components(links)
    degree = links.select(F.explode(F.array("id_a", "id_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    everyone = table.select(F.col(id_col).cast("bigint").alias("id")).where(F.col("id").isNotNull()).distinct()
    rep = everyone.join(found.members, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    out = rep.join(settled.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    return out.select("id", "rep", F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
