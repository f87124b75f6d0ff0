"""Canonical forms of repository paths and instants, as column expressions.

Both stay inside whole-stage code generation except for paths with ``..`` segments, which
take an array fold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_path(path: Column) -> Column:
    """A path relative to the repository root: ``/`` as separator, no empty or ``.`` segments,
    ``..`` resolved (it never climbs above the root). Case is kept. Null stays null."""
    slashed = F.regexp_replace(F.trim(path), r"[\\/]+", "/")
    flat = F.regexp_replace(F.regexp_replace(slashed, r"(?:^|/)(?:\.(?:/|$))+", "/"), r"^/+|/+$", "")
    folded = F.array_join(
        F.aggregate(
            F.split(flat, "/"),
            F.array().cast("array<string>"),
            lambda kept, part: F.when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(part))),
        ),
        "/",
    )
    return F.when(flat.rlike(r"(?:^|/)\.\.(?:/|$)"), folded).otherwise(flat)


def canonical_instant(written: Column) -> Column:
    """An instant in microseconds of the epoch, UTC where no zone is written.

    Reads ISO dates and date-times with or without fraction and zone (a blank may stand for
    the T), and epoch seconds (up to 11 digits) or milliseconds (12 to 14). Null for null
    and for what can't be read.
    """
    text = F.trim(written)
    # A cast takes the session's zone where none is written; the engine's rule is UTC.
    zoned = F.when(text.rlike(r"[0-9:.](?:[Zz]|[+-][0-9]{2}(?::?[0-9]{2})?)$") & text.rlike(r"[T ][0-9]{1,2}:"), text)
    dated = F.coalesce(zoned, F.when(text.rlike(r"[T ][0-9]{1,2}:"), F.concat(text, F.lit("Z"))), F.concat(text, F.lit("T00:00:00Z")))
    return (
        F.when(text.rlike(r"^[0-9]{1,11}$"), text.cast("bigint") * 1_000_000)
        .when(text.rlike(r"^[0-9]{12,14}$"), text.cast("bigint") * 1_000)
        .when(text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"), F.unix_micros(dated.try_cast("timestamp")))
    )


def version_key(written: Column) -> Column:
    """The instant as text, or the trimmed writing itself where it is no readable instant, so
    that an unreadable version still counts as one version. Null for null."""
    return F.coalesce(canonical_instant(written).cast("string"), F.concat(F.lit("text:"), F.trim(written)))
