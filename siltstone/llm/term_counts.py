"""How often every term occurs, and in how many records.

Vertical layout: each term has record-identifier bitmaps with parallel occurrence counters. The
identifiers are cut into words of 64; a term keeps only the words in which it occurs (a sparse
bitmap of (word, bits), so a rare term costs one word and a frequent one up to 64 records a
word). The occurrence counters stand beside the bitmap in unary planes: plane k has the records
that hold the term at least k times. Then

* merging is the union of bits, ``bit_or``, which combines before the shuffle and inside
  generated code, and a record that was delivered twice changes nothing: no de-duplication of
  the records is needed;
* the number of records of a term is the cardinality of plane 1;
* its number of occurrences is the sum of the cardinalities of all planes.

A term that is in a third of all records is spread over its words: no task gets the whole term.
The second aggregate has one partial row per term and task.

Records are the distinct ids whose text isn't null; a null id is dropped. Null texts don't
count as records; empty and blank ones do, though they hold no term. Rows repeated with the same
id and text count once; where texts of one id differ, the record holds each term as often as the
text that holds it most. Empty tables give no rows. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_TOKEN = r"[a-z0-9][a-z0-9\-]{2,}"


def log_tokens(text: Column) -> Column:
    """The reference tokens of a query log: no stop words removed."""
    return F.regexp_extract_all(F.lower(text), F.lit(LOG_TOKEN), F.lit(0))


def _runs(terms: Column) -> Column:
    """(term, n) of each distinct term of a sorted array, in one walk: where runs begin, then how long each is."""
    once = lambda value, of: F.element_at(F.transform(F.array(value), of), 1)  # noqa: E731 - what is bound is worked out once
    begins = lambda t: F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.get(t, i - 1) != F.get(t, i - 2)))
    lengths = lambda t, b: F.transform(b, lambda x, i: F.struct(F.get(t, x - 1).alias("term"), (F.coalesce(F.get(b, i + 1), F.size(t) + 1) - x).alias("n")))
    return once(terms, lambda t: once(begins(t), lambda b: lengths(t, b)))


def bitmaps(records: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """(term, plane, word, bits): the layout of the module. ``terms`` is an array column of
    ``records``; ids may be any bigint (a word holds id >> 6, arithmetic shift). The work is linear in the terms of a text."""
    full = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("_id"), F.array_sort(terms).alias("_terms")).where(F.size("_terms") > 0)
    runs = full.select("_id", F.explode(_runs(F.col("_terms"))).alias("r")).select("_id", "r.term", F.explode(F.sequence(F.lit(1), F.col("r.n"))).alias("plane"))
    rows = runs.select("term", "plane", F.shiftright("_id", 6).alias("word"), F.expr("shiftleft(1L, cast(_id & 63 as int))").alias("bit"))
    return rows.groupBy("term", "plane", "word").agg(F.bit_or("bit").alias("bits"))


def union(*layouts: DataFrame) -> DataFrame:
    """One layout of several; records in more than one count once."""
    every = layouts[0]
    for x in layouts[1:]:
        every = every.unionByName(x)
    return every.groupBy("term", "plane", "word").agg(F.bit_or("bits").alias("bits"))


def frequencies(layout: DataFrame) -> DataFrame:
    """(term, occurrences, records), read from the cardinalities."""
    n = F.bit_count("bits")
    return layout.groupBy("term").agg(F.sum(n).alias("occurrences"), F.sum(F.when(F.col("plane") == 1, n).otherwise(0)).alias("records"))


def record_count(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row, ``total``: the distinct ids whose text isn't null, by the same bitmaps."""
    ids = records.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("_id"))
    words = ids.groupBy(F.shiftright("_id", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_id & 63 as int))")).alias("bits"))
    return words.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias("total"))


def term_frequencies(records: DataFrame, id_col: str, text_col: str, rare_under: int = 3, common_share: float = 0.02) -> DataFrame:
    """(term, occurrences, records, mark): mark is ``rare`` for a term in fewer than
    ``rare_under`` records, ``common`` for one in more than ``common_share`` of all records,
    else null. Where a term is both, in a very small table, it is rare."""
    counted = frequencies(bitmaps(records, id_col, log_tokens(F.col(text_col))))
    total = record_count(records, id_col, text_col)
    mark = F.when(F.col("records") < rare_under, "rare").when(F.col("records") > F.col("total") * common_share, "common")
    return counted.crossJoin(F.broadcast(total)).select("term", "occurrences", "records", mark.alias("mark"))  # total is one row
