"""The main body of site pages: a linear-chain conditional random field over leaf blocks.

Blocks are the lines of a page's text in document order, with the tags that the text still has as
ancestor-tag features, and features of shape, words and place. Nine labels (three of the article, six of
furniture) let the chain carry structure: a side item comes after a side head or another
item, a footer after a footer. The weights are trained on ``pages`` labelled pages by gradient
ascent on the penalised log-likelihood, once in each session, on the driver; the training set has a
fixed size, whatever the corpus. Each page is decoded by Viterbi, in Arrow batches, without a
shuffle.

Rows repeated with the same id count once. Null ids, null texts and empty texts have no lines. Blank
lines keep their number but are neither article nor furniture. A page of only furniture has an
empty body. An empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone import runtime
from siltstone.llm import page_lines as pl

SITE_PATH = r"(?i)(?:\.x?html?|/)$"
FURNITURE = np.array([k in pl.BOILER for k in pl.LABELS])


def is_site_page(path: Column) -> Column:
    """Paths of rendered pages: .html, .htm, or a folder of the site."""
    return F.coalesce(path.rlike(SITE_PATH), F.lit(False))


@dataclass(frozen=True)
class Crf:
    """names: column of each feature. emission: feature by label. transition: label by label.
    begin: of a first line."""

    names: dict[str, int]
    emission: np.ndarray
    transition: np.ndarray
    begin: np.ndarray


def features(lines: list[str]) -> list[list[str]]:
    own = [pl.line_features(x) for x in lines]
    cues = [cue(x, f) for x, f in zip(lines, own)]
    return [a + pl.place_features(b) for a, b in zip(own, pl.places(lines, cues))]


def cue(line: str, own: list[str]) -> tuple[bool, bool]:
    prose = pl.is_paragraph(line) and not any(f.startswith(("notice:sentence:strong", "starts:social")) for f in own)
    return prose, "starts:short:side" in own


def train(pages: int = 450, rounds: int = 90, penalty: float = 0.02, seed: int = 7) -> Crf:
    """Full-batch Adam over padded pages; forward and backward passes in the log domain."""
    drawn = pl.Pages(seed)
    data = [drawn.page() for _ in range(pages)]
    seqs = [features([x for x, _ in p]) for p in data]
    names = {f: i for i, f in enumerate(sorted({f for s in seqs for fs in s for f in fs}))}
    k, length = len(pl.LABELS), max(map(len, data))
    x = np.zeros((pages, length, len(names)), np.float32)
    y = np.zeros((pages, length), np.int64)
    real = np.zeros((pages, length), bool)
    for i, (p, s) in enumerate(zip(data, seqs)):
        for j, ((_, label), fs) in enumerate(zip(p, s)):
            x[i, j, [names[f] for f in fs]] = 1
            y[i, j], real[i, j] = pl.LABELS.index(label), True
    flat = x.reshape(-1, len(names))
    gold = np.eye(k, dtype=np.float32)[y] * real[..., None]
    pairs = np.zeros((k, k))
    for p in data:
        for a, b in zip(p, p[1:]):
            pairs[pl.LABELS.index(a[1]), pl.LABELS.index(b[1])] += 1
    begins = gold[:, 0].sum(0)
    w = [np.zeros((len(names), k)), np.zeros((k, k)), np.zeros(k)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]

    def lse(a, axis):
        top = a.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, rounds + 1):
        e = (flat @ w[0].astype(np.float32)).reshape(pages, length, k).astype(np.float64)
        alpha = np.zeros((pages, length, k))
        beta = np.zeros((pages, length, k))
        alpha[:, 0] = e[:, 0] + w[2]
        for t in range(1, length):
            new = e[:, t] + lse(alpha[:, t - 1, :, None] + w[1], 1)
            alpha[:, t] = np.where(real[:, t, None], new, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            new = lse(w[1] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(real[:, t + 1, None], new, 0)
        z = lse(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * real[..., None]
        edge = np.zeros((k, k))
        for t in range(1, length):
            joint = alpha[:, t - 1, :, None] + w[1] + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None]
            edge += (np.exp(joint) * real[:, t, None, None]).sum(0)
        grads = [flat.T @ (gold - node).reshape(-1, k).astype(np.float32) - penalty * w[0], pairs - edge - penalty * w[1], begins - node[:, 0].sum(0) - penalty * w[2]]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            w[i] = w[i] + 0.15 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Crf(names, w[0], w[1], w[2])


@lru_cache(maxsize=2)
def trained(pages: int = 450, seed: int = 7) -> Crf:
    return train(pages, seed=seed)


class Decoder:
    """Viterbi over one page at a time; remembers what lines score on their own."""

    def __init__(self, crf: Crf):
        self.crf, self.known, self.placed = crf, {}, {}

    def own(self, line: str) -> tuple[np.ndarray, tuple[bool, bool]]:
        got = self.known.get(line)
        if got is None:
            fs = pl.line_features(line)
            got = (self.crf.emission[[i for f in fs if (i := self.crf.names.get(f)) is not None]].sum(0), cue(line, fs))
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[line] = got
        return got

    def place(self, place: tuple) -> np.ndarray:
        got = self.placed.get(place)
        if got is None:
            got = self.placed[place] = self.crf.emission[[i for f in pl.place_features(place) if (i := self.crf.names.get(f)) is not None]].sum(0)
        return got

    def labels(self, lines: list[str]) -> list[int]:
        if not lines:
            return []
        own = [self.own(x) for x in lines]
        e = [a + self.place(p) for (a, _), p in zip(own, pl.places(lines, [c for _, c in own]))]
        back, score, into, every = [None], e[0] + self.crf.begin, self.crf.transition.T.copy(), np.arange(len(pl.LABELS))
        for t in range(1, len(lines)):
            via = score + into
            at = via.argmax(1)
            back.append(at)
            score = via[every, at] + e[t]
        path = [int(score.argmax())]
        for t in range(len(lines) - 1, 0, -1):
            path.append(int(back[t][path[-1]]))
        return path[::-1]

    def furniture(self, text: str) -> list[tuple[int, bool]]:
        """(line number from 1, is furniture) of each line that isn't blank."""
        numbered = [(i, x) for i, x in enumerate(text.split("\n"), 1) if x.strip()]
        return [(i, bool(FURNITURE[k])) for (i, _), k in zip(numbered, self.labels([x for _, x in numbered]))]


def _pages(hits: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    site = hits.where(is_site_page(F.col(path_col)) & F.col(id_col).isNotNull() & (F.col(text_col) != ""))
    return runtime.spread(site.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")))


def furniture_lines(hits: DataFrame, id_col: str, text_col: str, path_col: str, crf: Crf | None = None) -> DataFrame:
    """(id_col, line_no): the lines of site pages that aren't their article's."""
    crf = crf or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(crf)
        for batch in batches:
            ids, numbers = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = [n for n, boiler in decoder.furniture(text.as_py()) if boiler]
                ids.extend([i] * len(found))
                numbers.extend(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int64())], ["id", "line_no"])

    rows = _pages(hits, id_col, text_col, path_col).mapInArrow(run, "id bigint, line_no bigint")
    return rows.distinct().withColumnRenamed("id", id_col)


def main_bodies(hits: DataFrame, id_col: str, text_col: str, path_col: str, crf: Crf | None = None) -> DataFrame:
    """(id_col, body): each site page's article, its lines in order, blank lines within it kept."""
    crf = crf or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(crf)
        for batch in batches:
            bodies = []
            for text in batch.column(1):
                boiler = {n for n, b in decoder.furniture(text.as_py()) if b}
                bodies.append("\n".join(x for n, x in enumerate(text.as_py().split("\n"), 1) if n not in boiler).strip("\n"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string())], ["id", "body"])

    return _pages(hits, id_col, text_col, path_col).mapInArrow(run, "id bigint, body string").dropDuplicates(["id"]).withColumnRenamed("id", id_col)
