"""Encoding a corpus with a public byte-level BPE vocabulary, whole texts, in parallel.

Overlapping chunk encoding. A text of up to ``chunk`` characters is encoded in one go. A longer
one is cut into chunks whose windows overlap; every window is split into pre-tokens in parallel,
each from its own start, and neighbours are stitched at the first boundary in their overlap that
both have. From a common boundary on, both splits are the same (the pattern looks ahead, never
back), so by induction from the start of the text every stitch is a boundary of the whole text.
If two neighbours don't resynchronise within their overlap (a run of thousands of letters
without a break), the rest of that text from the stitch before is encoded as one piece: slower, never
wrong. Then the pieces are encoded; a text's ids are its pieces' ids in order. Decoding
concatenates the raw bytes of the ids.

The vocabulary is a rank file, its path a parameter. The driver reads it (under 1 MB) and the
tasks get its bytes, so executors need no such file.

Null and empty texts give an empty list; a row with a null id keeps it; rows repeated give
repeated rows; an empty table gives none. Only the id and the text are read.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone import runtime

VOCABULARY = os.environ.get("SILTSTONE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# The published pre-token pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CHUNK, OVERLAP = 16_384, 1_024
_encoders: dict[str, object] = {}


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(ranks: bytes):
    """The encoder of a rank file's bytes; made once in each Python process."""
    name = hashlib.sha1(ranks).hexdigest()
    if name not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encoders[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[name]


def boundaries(text: str) -> list[int]:
    """Ends of the pre-tokens of ``text`` where it may be cut. The last one may be cut off and isn't
    among them; nor is one after white space, which at a piece's end would be split otherwise."""
    import regex

    return [m.end() for m in regex.finditer(PATTERN, text) if not text[m.end() - 1].isspace()][:-1]


def _id_lists(ids: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _encoded(rows: DataFrame, ranks: bytes, counts_only: bool) -> DataFrame:
    """``rows``: (row, piece, text) gives (row, piece, ids) or (row, piece, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks).encode_ordinary
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [encode(t.as_py()) if t.is_valid else [] for t in part.column(part.num_columns - 1)]
                out = pa.array([len(x) for x in ids], pa.int64()) if counts_only else _id_lists(ids)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], out], [*part.schema.names[:-1], "n" if counts_only else "ids"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*kept, "n bigint" if counts_only else "ids array<int>"]))


def pieces(texts: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, *kept, piece, text) of ``texts``: (row, *kept, text), texts longer than ``chunk``: pieces that
    may be encoded one by one. What is kept travels with every piece, so nothing is joined back later."""
    kept = texts.columns[:-1]
    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                text = batch.column(len(kept))[r].as_py()
                for at in range(0, len(text), 64 * chunk):  # a batch out holds 64 windows
                    starts = range(at, min(at + 64 * chunk, len(text)), chunk)
                    cut = [text[max(0, b - overlap) : b + chunk + overlap] for b in starts]
                    one = [pa.array([batch.column(k)[r].as_py()] * len(cut), batch.column(k).type) for k in range(len(kept))]
                    yield pa.RecordBatch.from_arrays([*one, pa.array([b // chunk for b in starts], pa.int64()), pa.array(cut, pa.string())], [*kept, "i", "window"])

    spread = texts.mapInArrow(slices, f"{held}, i bigint, window string").repartition(F.col("row"), F.col("i"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for i, window in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1)):
                begin = max(0, i * chunk - overlap)
                ends = [begin + b for b in boundaries(window.as_py())]
                heads.append([b for b in ends if i * chunk <= b < i * chunk + overlap])
                tails.append([b for b in ends if (i + 1) * chunk <= b < (i + 1) * chunk + overlap])
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, lists), pa.array(tails, lists)], [*batch.schema.names, "head", "tail"])

    split = spread.mapInArrow(run, f"{held}, i bigint, window string, head array<bigint>, tail array<bigint>")
    order = W.partitionBy("row").orderBy("i")
    common = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    first = F.greatest(F.col("i") * chunk - overlap, F.lit(0))
    cut = split.select(*kept, "i", first.alias("first"), "window", F.when(F.col("i") == 0, F.lit(0).cast("bigint")).otherwise(common).alias("cut"))
    begun = cut.withColumn("lost", F.min(F.when(F.col("cut").isNull(), F.col("i"))).over(order)).withColumn("begin", F.coalesce("cut", F.col("i") * chunk))
    ended = begun.withColumn("end", F.lead("begin").over(order))
    part = F.expr("substring(window, cast(begin - first + 1 as int), cast(coalesce(end, first + length(window)) - begin as int))")
    piece = F.least(F.col("i"), F.coalesce(F.col("lost") - 1, F.col("i")))
    parts = ended.select(*kept, piece.alias("piece"), "i", part.alias("part"))
    whole = parts.groupBy(*kept, "piece").agg(F.sort_array(F.collect_list(F.struct("i", "part"))).alias("parts"))
    return whole.select(*kept, "piece", F.concat_ws("", "parts.part").alias("text"))


def _numbered(table: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """(row, id, *keep, text). A row's number is its place in the scan, given before rows are spread. It only tells
    rows of one evaluation apart: nothing is ever joined on it."""
    keep_as = [F.col(c).alias(f"keep_{c}") for c in keep]
    rows = table.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), *keep_as, F.col(text_col).alias("text"))
    return runtime.spread(rows)


def encode(table: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id_col, ids) for every row of ``table``."""
    ranks, rows = read_vocabulary(vocabulary), _numbered(table, id_col, text_col, [])
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = _encoded(rows.where(~is_long).select("id", "text"), ranks, False)
    long = _encoded(pieces(rows.where(is_long), chunk, overlap), ranks, False)
    joined = long.groupBy("row", "id").agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("p")).select("id", F.flatten("p.ids").alias("ids"))
    return short.unionByName(joined).withColumnRenamed("id", id_col)


def token_counts(table: DataFrame, id_col: str, text_col: str, keep: list[str], vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id_col, *keep, n): the number of tokens of every row; no ids are kept."""
    ranks, rows = read_vocabulary(vocabulary), _numbered(table, id_col, text_col, keep)
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = _encoded(rows.where(~is_long).drop("row"), ranks, True)
    held = ["id", *(f"keep_{c}" for c in keep)]
    long = _encoded(pieces(rows.where(is_long), chunk, overlap), ranks, True).groupBy("row", *held).agg(F.sum("n").alias("n")).drop("row")
    return short.unionByName(long).select(F.col("id").alias(id_col), *(F.col(f"keep_{c}").alias(c) for c in keep), "n")


def decode(encoded: DataFrame, id_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, text) of (id_col, ids): the raw bytes of the ids, concatenated. Null ids give null."""
    ranks = read_vocabulary(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {int(b): base64.b64decode(a) for a, b in (line.split() for line in ranks.splitlines() if line)}
        for batch in batches:
            texts = [b"".join(map(table.__getitem__, x)).decode("utf-8", "replace") if x is not None else None for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` bigint, text string")
