"""Vectors of texts by a pluggable embedder, in batches.

An embedder is any function from a list of texts to as many vectors; it is called in the tasks, with at most ``batch``
texts at a time, so a model server sees batches of the size that it is best at. A reply with another number of vectors is
an error: a vector would else belong to another text. ``HashedTerms`` is the embedder that needs no model.

Null texts have a null vector and aren't sent. Empty texts are sent. Repeated rows give repeated rows; an empty table
gives none. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone import runtime

Embedder = Callable[[list[str]], list[list[float]]]
BATCH = 16
_SPLIT, _TERM = re.compile(r"(?<=[a-z0-9])(?=[A-Z])"), re.compile(r"[a-z0-9]+")


class WrongCount(RuntimeError):
    """An embedder returned more or fewer vectors than it was given texts."""


class Unavailable(RuntimeError):
    """An embedder or a model can't be reached."""


@lru_cache(65_536)
def _hashed(term: str) -> tuple[int, int]:
    digest = hashlib.md5(term.encode()).hexdigest()
    return int(digest[:6], 16), 1 if int(digest[6], 16) % 2 else -1


@dataclass(frozen=True)
class HashedTerms:
    """Search terms hashed into ``dim`` places with a sign, in unit length; zero for a text without terms."""

    dim: int = 64

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for term in _TERM.findall(_SPLIT.sub(" ", text).lower()):
                place, sign = _hashed(term)
                row[place % self.dim] += sign
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0).tolist()


def embed(texts: DataFrame, embedder: Embedder, batch: int = BATCH, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id_col, vector) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in batches:
            said = records.column(1).to_pylist()
            full = [i for i, t in enumerate(said) if t is not None]
            vectors: list = [None] * len(said)
            for at in range(0, len(full), batch):
                part = full[at : at + batch]
                got = embedder([said[i] for i in part])
                if len(got) != len(part):
                    raise WrongCount(f"{len(got)} vectors for {len(part)} texts")
                for i, v in zip(part, got):
                    vectors[i] = list(map(float, v))
            yield pa.RecordBatch.from_arrays([records.column(0), pa.array(vectors, pa.list_(pa.float64()))], [id_col, "vector"])

    kind = texts.schema[id_col].dataType.simpleString()
    return runtime.spread(texts.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))).mapInArrow(run, f"`{id_col}` {kind}, vector array<double>")
