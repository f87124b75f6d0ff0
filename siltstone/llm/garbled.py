"""Finding texts that were decoded with a wrong character encoding, and restoring them.

Smoothed character n-gram models are trained on clean records: order 4 with back-off, counted
over every place within three characters of a non-ASCII character of a line. A line counts once, however
many copies of it there are. The first count is over all records that no strict test marks as damaged; the
second, which decides, leaves out those too that the first model finds damaged: what no strict test
sees would else train the model as sound. Every candidate encode-decode chain is scored on every line that has a
non-ASCII character, up to three times in a row (text can be damaged twice), by the log-likelihood ratio of the
candidate line against the line as it is. A chain isn't summed to its end only where a bound, which holds for every
window, proves that it can't reach the margin: that saves work and changes no result. The likeliest chain is
accepted if it gains more than a margin, which is validated on all clean lines: these
must not reach it under any chain, and the same lines, damaged each by one of the known chains, must. What they gain is written
down, and the driver gets counts of ranges of it. Where there is no line to validate on, the margin is ``margin``.

Character references stand for their characters where several stand side by side or one stands by a non-ASCII
character, so damage that was escaped is read as well, also in texts that are ASCII throughout.

A sound text that quotes a garbled sequence stays: such quotations are in the training records,
so they are likely as they stand, and what they would turn into (a lone apostrophe between
blanks) is not. A replacement character marks a loss that no chain can undo; its record is
found, with the text as far as it can be restored.

The texts are parsed once, into the windows of their lines, which are written beside them; the counts and both models
work on windows. Counts cover all records. An n-gram below ``least_share`` of all places is left to the back-off, so a
model has at most 1 / least_share n-grams of each order, whatever the data.

Null texts are never damaged; empty texts aren't either. Null ids are kept. Repeated rows
give repeated rows. An empty table gives none. Only id and text are read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain as chained

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone import runtime

RUN = re.compile(r"[^\x00-\x7f]+")
SPLIT = re.compile(rf"({RUN.pattern})")
REFERENCE = r"&(?:[A-Za-z]{2,8}[0-9]?|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"
ENTITY_RUN = re.compile(rf"(?:{REFERENCE}|[^\x00-\x7f])*(?:[^\x00-\x7f]|{REFERENCE}{REFERENCE})(?:{REFERENCE}|[^\x00-\x7f])*")
#: What a text must have to be looked at, as the JVM reads it.
CANDIDATE = rf"[^\x00-\x7F]|{REFERENCE}{REFERENCE}"
LOST = "\ufffd"

#: (encoding the bytes were read with, encoding they were written in)
UTF8_CHAINS = tuple((wrong, "utf-8") for wrong in ("cp1252", "cp437", "cp850", "cp852", "cp1250", "cp1251", "mac_roman", "koi8_r", "cp866", "iso8859_2"))
BYTE_CHAINS = (
    ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"),
    ("cp1252", "cp1250"), ("cp1252", "iso8859_2"), ("cp1250", "cp1252"), ("cp1250", "cp852"), ("cp1252", "cp852"), ("cp852", "cp1250"), ("cp850", "cp1250"), ("cp437", "cp1250"), ("iso8859_2", "cp1250"), ("cp1250", "iso8859_2"),
    ("cp1252", "cp1251"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp1252", "koi8_r"), ("mac_roman", "cp1251"), ("cp850", "cp1251"), ("cp437", "cp1251"), ("cp1251", "mac_cyrillic"),
)
STRICT = ("cp1252", "cp437", "cp850", "cp1250", "cp1251", "mac_roman")
#: What stands between blanks in sound text, so that its garbled form there is damage, no quotation.
STANDALONE = set("–—…€°•→©®™")


@dataclass(frozen=True)
class Settings:
    """least_share: share of all places under which an n-gram is left to the back-off. margin: the one where none can be
    validated, in nats. times: chains in a row."""

    least_share: float = 2e-6
    margin: float = 6.0
    times: int = 3


def _table(encoding: str) -> dict[str, int]:
    """Characters to bytes; the bytes that an encoding leaves free, and C1 controls, stand for
    themselves, as lax decoders have it."""
    table = {chr(b): b for b in range(128, 160)}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    return table


TABLES = {e: _table(e) for e in {w for w, _ in UTF8_CHAINS + BYTE_CHAINS}}
LATIN = {chr(b): b for b in range(128, 256)}


def _bytes(run: str, encoding: str) -> bytes | None:
    table = TABLES[encoding]
    try:
        return bytes([table[c] for c in run])
    except KeyError:
        if encoding != "cp1252":
            return None
    try:  # text read as Latin-1 keeps C1 controls beside what cp1252 would have
        return bytes([table[c] if c in table else LATIN[c] for c in run])
    except KeyError:
        return None


def _from_utf8(run: str, encoding: str) -> str | None:
    if len(run) < 2:
        return None
    b = _bytes(run, encoding)
    try:
        return b.decode("utf-8") if b else None
    except UnicodeDecodeError:
        return None


def _read_as(encoding: str) -> dict[str, int]:
    return {**{c: b for c, b in LATIN.items() if encoding == "cp1252"}, **TABLES[encoding]}


def _sequences(encoding: str) -> re.Pattern:
    """What a whole UTF-8 sequence looks like when read with the encoding."""
    chars = _read_as(encoding)
    of = lambda low, high: "[" + "".join(re.escape(c) for c, b in chars.items() if low <= b <= high) + "]"
    tail = of(0x80, 0xBF)
    return re.compile(f"{of(0xC2, 0xDF)}{tail}|{of(0xE0, 0xEF)}{tail}{{2}}|{of(0xF0, 0xF4)}{tail}{{3}}")


LOOKS = {chain: _sequences(chain[0]) for chain in UTF8_CHAINS}


class Remembered(dict):
    """What ``work`` gives for each key, worked out once; at most about ``limit`` of them are kept."""

    def __init__(self, work: Callable, limit: int):
        self.work, self.limit = work, limit

    def __missing__(self, key):
        if len(self) > self.limit:
            self.clear()
        got = self[key] = self.work(key)
        return got


def _undone(run: str, chain: tuple[str, str]) -> str:
    """Each whole sequence of a run decoded, what stands beside it as it is."""
    return LOOKS[chain].sub(lambda m: _from_utf8(m[0], chain[0]) or m[0], run)


def apply_chain(line: str, chain: tuple[str, str]) -> str | None:
    """The line with the chain undone wherever it can be, or None if nothing changes."""
    wrong, true = chain
    if true == "utf-8":
        if "&" in line:

            def fix(m: re.Match) -> str:
                run = html.unescape(m[0])
                return new if (new := _undone(run, chain)) != run else m[0]

            new = ENTITY_RUN.sub(fix, line)
        else:
            new = _undone(line, chain)
    else:
        table = TABLES[wrong]
        try:
            new = RUN.sub(lambda m: bytes([table[c] for c in m[0]]).decode(true), line)
        except (KeyError, UnicodeDecodeError):
            return None
    return new if new != line else None


def damage(line: str, chain: tuple[str, str]) -> str | None:
    """The line as the chain would have damaged it, or None if it couldn't."""
    wrong, true = chain
    try:
        return RUN.sub(lambda m: m[0].encode(true).decode("latin-1" if wrong == "cp1252" and true == "utf-8" and any(b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) for b in m[0].encode(true)) else wrong), line)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None


DIGIT = re.compile(r"[1-9]")
NEAR = re.compile(rf"{RUN.pattern}(?:[^\n\x80-\U0010ffff]{{1,2}}{RUN.pattern})*")
WORD = re.compile(r"[^ ]+ *| +")
NEXT_WINDOW = "\x00"


def _spans(t: str) -> list[tuple[int, int]]:
    """Runs of a line that may hold damage; those at most two characters apart are one."""
    if "&" not in t:
        return [m.span() for m in NEAR.finditer(t)]
    out: list[tuple[int, int]] = []
    for m in ENTITY_RUN.finditer(t):
        if not m[0].isascii() or not html.unescape(m[0]).isascii():
            if out and m.start() - out[-1][1] <= 2:
                out[-1] = out[-1][0], m.end()
            else:
                out.append(m.span())
    return out


def windows(line: str) -> list[str]:
    """The non-ASCII runs of a line with three characters before and after, in one window where these would overlap,
    so that each place that a chain bears on counts once; long ones are cut into words, each with the three characters
    before it. Digits are one digit (but not in a line with numbers of characters). The first three characters of a
    window are what its others are judged by; they belong to the window before. All scoring looks at windows, and
    whatever is worked out for a window is remembered, as they recur."""
    if line.isascii() and "&" not in line:
        return []
    t = f"\n\n\n{line}\n\n\n".replace(NEXT_WINDOW, " ")
    if "&#" not in t:
        t = DIGIT.sub("0", t)
    out: list[str] = []
    for a, b in _spans(t):
        if b - a <= 9:
            out.append(t[a - 3 : b + 3])
        else:
            out += [t[m.start() - 3 : m.end()] for m in WORD.finditer(t, a, b + 3)]
    return out


class Strict:
    """The strict test of damage; remembers windows."""

    def __init__(self):
        self.known = Remembered(self.window, 200_000)

    def window(self, w: str) -> bool:
        """A run beside a letter that is UTF-8 read wrongly."""
        got = False
        for m in (ENTITY_RUN if "&" in w else RUN).finditer(w, 3):
            run = html.unescape(m[0]) if "&" in m[0] else m[0]
            if len(run) > 1:
                beside = w[m.start() - 1 : m.start()].isalnum() or w[m.end() : m.end() + 1].isalnum()
                for e in STRICT:
                    fixed = _from_utf8(run, e)
                    if fixed is not None and all(c < "\u0250" or "\u0400" <= c < "\u0460" or "\u2010" <= c <= "\u2122" for c in fixed):
                        got = got or beside or fixed in STANDALONE
        return got

    def line(self, ws: list[str]) -> bool:
        return any(map(self.known.__getitem__, ws))


CHAINS = UTF8_CHAINS + BYTE_CHAINS
PAIRS = re.compile(r"[^\x00-\x7f]{2,}")


def _one_to_one(chain: tuple[str, str]) -> dict[str, str]:
    out = {}
    for c, b in TABLES[chain[0]].items():
        try:
            out[c] = bytes([b]).decode(chain[1])
        except UnicodeDecodeError:
            pass
    return out


MAPS = [_one_to_one(chain) for chain in BYTE_CHAINS]
TRANSLATIONS = [str.maketrans(m) for m in MAPS]
NEVER = -1e9


def _bytes_of() -> tuple[dict[str, list[int]], dict[str, int]]:
    """For a character the bits of the UTF-8 chains under which it begins a sequence of two, three or four bytes, and of
    those under which it stands within one."""
    leads: dict[str, list[int]] = {}
    tails: dict[str, int] = {}
    for k, (wrong, _) in enumerate(UTF8_CHAINS):
        for c, b in _read_as(wrong).items():
            if 0x80 <= b <= 0xBF:
                tails[c] = tails.get(c, 0) | 1 << k
            elif 0xC2 <= b <= 0xF4:
                leads.setdefault(c, [0, 0, 0])[(b >= 0xE0) + (b >= 0xF0)] |= 1 << k
    return leads, tails


LEADS, TAILS = _bytes_of()


def looks(text: str) -> int:
    """The bits of the UTF-8 chains of which ``LOOKS`` finds something in a text, all chains in one walk."""
    bits = 0
    for m in PAIRS.finditer(text):
        tails = [TAILS.get(c, 0) for c in m[0]] + [0, 0]
        for i, c in enumerate(m[0][:-1]):
            if (got := tails[i + 1]) and (lead := LEADS.get(c)):
                bits |= got & lead[0] | got & tails[i + 2] & lead[1] | got & tails[i + 2] & tails[i + 3] & lead[2]
    return bits


class Model:
    """Back-off model of order 4 over the counted n-grams. How often a context came follows from
    the n-grams that begin with it, as all are counted at the same places."""

    def __init__(self, counts: dict[str, int]):
        contexts: dict[str, int] = {}
        for g, n in counts.items():
            contexts[g[:-1]] = contexts.get(g[:-1], 0) + n
        total = max(1, contexts.get("", 1))
        self.logs = {g: math.log(n / contexts[g[:-1]]) for g, n in counts.items() if len(g) > 1}
        self.logs |= {g: math.log((n + 0.1) / total) for g, n in counts.items() if len(g) == 1}
        self.unseen = math.log(0.1 / total)
        #: For two characters the most that the second one can have behind the first one, whatever stands before.
        self.most: dict[str, float] = {}
        for g, v in self.logs.items():
            if len(g) > 1:
                v -= 4 - len(g)
                if v > self.most.get(g[-2:], NEVER):
                    self.most[g[-2:]] = v
        self.scores = Remembered(self._score, 300_000)
        self.gained = Remembered(lambda x: self._gain(*x), 500_000)
        self.grams = Remembered(self.logp, 500_000)
        self.pairs = Remembered(self._pair, 50_000)
        self.forget()

    def forget(self) -> None:
        """The rows of windows begin anew. ``at``: the row of a window, ``here`` its log-likelihood. For each chain, ``bounds``
        has the most that it can gain there and ``changes`` whether it may change the window; what it can't change it gains
        0 on. ``top``: the most of all chains, or 0."""
        self.at = Remembered(self._about, math.inf)
        self.here, self.top = np.zeros(1024), np.zeros(1024)
        self.bounds, self.changes = np.zeros((1024, len(CHAINS))), np.zeros((1024, len(CHAINS)), bool)

    def rows(self, ws: list[str]) -> np.ndarray:
        """The rows of windows, those of new ones made."""
        first = len(self.at)
        got = np.fromiter(map(self.at.__getitem__, ws), np.intp, len(ws))
        new = np.s_[first : len(self.at)]
        self.bounds[new] -= self.here[new, None]
        self.bounds[new][~self.changes[new]] = 0.0
        self.top[new] = self.bounds[new].max(axis=1, initial=0.0)
        return got

    def logp(self, gram: str) -> float:
        """Of the last character after the ones before it; a nat less for each shorter context."""
        get = self.logs.get
        if (got := get(gram)) is not None:
            return got
        if (got := get(gram[1:])) is not None:
            return got - 1.0
        if (got := get(gram[2:])) is not None:
            return got - 2.0
        if (got := get(gram[3:])) is not None:
            return got - 3.0
        return self.unseen - 4.0

    def _score(self, w: str) -> float:
        grams = self.grams
        return sum([grams[w[i - 3 : i + 1]] for i in range(3, len(w))])

    def window(self, w: str) -> float:
        """The log-likelihood of a window."""
        return self.scores[w]

    def changed(self, before: str, w: str) -> float:
        """The log-likelihood of ``w`` behind ``before``, which may have got shorter or longer than three characters."""
        return self.window(f"\n\n\n{before}"[-3:] + w)

    def score(self, line: str) -> float:
        return sum(map(self.window, windows(line)))

    def _pair(self, two: str) -> tuple[np.ndarray, np.ndarray]:
        """For each one-to-one chain the most that the second of two characters can have behind the first one under it, whatever
        stands around them, and whether it changes the second one; a chain that can't read one of them can't be meant. Of a
        character alone only the latter is used."""
        before, char, utf8 = two[:-1], two[-1], len(UTF8_CHAINS)
        most, changes = np.full(len(CHAINS), NEVER), np.ones(len(CHAINS), bool)
        most[:utf8], changes[:utf8] = 0.0, False
        for k, readable in enumerate(MAPS, utf8):
            new, ahead = readable.get(char), before if before < "\x80" else readable.get(before)
            if new is not None and ahead is not None:
                got = self.most.get(ahead + new)
                most[k] = got if got is not None else self.logs.get(new, self.unseen - 1) - 3
                changes[k] = new != char
        return most, changes

    def _about(self, w: str) -> int:
        """A row for the window: for each chain the most that the window can have, all but its non-ASCII characters taken as
        certain (under a UTF-8 chain, all). ``rows`` makes of it what can be gained."""
        n = len(self.at)
        if n == len(self.here):
            self.here, self.top, self.bounds, self.changes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.here, self.top, self.bounds, self.changes))
        self.here[n], most, changes, pairs = self.scores[w], self.bounds[n], self.changes[n], self.pairs
        if bits := looks(html.unescape(w) if "&" in w else w):
            for k in range(len(UTF8_CHAINS)):
                if bits >> k & 1:
                    changes[k] = True
        if not w[:3].isascii():  # what others are judged by may change too
            for c in w[:3]:
                if c > "\x7f":
                    changes |= pairs[c][1]
        for i in range(3, len(w)):
            if w[i] > "\x7f":
                bound, new = pairs[w[i - 1 : i + 1]]
                most += bound
                changes |= new
        return n

    def _gain(self, w: str, k: int) -> float:
        here = self.window(w)
        if k >= len(UTF8_CHAINS):
            return self.window(w.translate(TRANSLATIONS[k - len(UTF8_CHAINS)])) - here
        new = apply_chain(w[3:], CHAINS[k]) if LOOKS[CHAINS[k]].search(html.unescape(w) if "&" in w else w) else None
        return self.changed(apply_chain(w[:3], CHAINS[k]) or w[:3], new) - here if new is not None else 0.0

    def gain(self, w: str, k: int) -> float:
        """What chain ``k`` gains on a window that it can read: 0 where it changes nothing."""
        return self.gained[w, k]


LINES = 4096  # at once


def ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` numbers from each start, one after another."""
    return np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)


def best_chains(lines: list[list[str]], model: Model, least: float) -> list[tuple[float, tuple[str, str]] | None]:
    """For each line (its windows, one at least) the (gain, chain) of the likeliest of all chains over all its windows, the
    first one of equals; None where none gains ``least``. What is left out, and a sum that is left, can't reach ``least`` or
    the best so far. The bounds of many lines are summed at once, and only what they leave open is summed window by window."""
    out: list = [None] * len(lines)
    for begin in range(0, len(lines), LINES):
        if len(model.at) > 100_000:
            model.forget()
        part = lines[begin : begin + LINES]
        sizes, ws = np.fromiter(map(len, part), np.intp, len(part)), list(chained.from_iterable(part))
        rows, starts = model.rows(ws), np.cumsum(sizes) - sizes
        lively = np.nonzero(np.add.reduceat(model.top[rows], starts) >= least - 1e-9)[0]
        if not len(lively):
            continue
        n = sizes[lively]
        own = rows[ranges(starts[lively], n)]
        bounds = np.add.reduceat(model.bounds[own], np.cumsum(n) - n, axis=0)
        may, utf8 = bounds >= least - 1e-9, np.s_[:, : len(UTF8_CHAINS)]
        may[utf8] &= np.logical_or.reduceat(model.changes[utf8][own], np.cumsum(n) - n, axis=0)
        # For each line and chain that are open, the windows that the chain may change.
        line, chain = np.nonzero(may)
        rests, line = bounds[line, chain].tolist(), lively[line]
        at, of = ranges(starts[line], sizes[line]), np.repeat(chain, sizes[line])
        changes = model.changes[rows[at], of]
        at, of, ends = at[changes], of[changes], np.concatenate([[0], np.cumsum(changes)])[np.cumsum(sizes[line])].tolist()
        most, at = model.bounds[rows[at], of].tolist(), at.tolist()
        of_line, a = -1, 0
        for x, k, rest, b in zip(line.tolist(), chain.tolist(), rests, ends):
            if x != of_line:
                of_line, best, found = x, least, False
            total = 0.0
            for i in range(a, b):
                if total + rest < best - 1e-9:
                    break
                total += model.gained[ws[at[i]], k]
                rest -= most[i]
            else:
                if total > best or not found and total >= best:
                    best, found, out[begin + x] = total, True, (total, CHAINS[k])
            a = b
    return out


def best_chain(ws: list[str], model: Model, least: float) -> tuple[float, tuple[str, str]] | None:
    """``best_chains`` of one line."""
    return best_chains([ws], model, least)[0]


def restore(texts: list[str], model: Model, margin: float, times: int) -> list[tuple[bool, str]]:
    """(damaged, text as far as it can be restored) of each text, line by line."""
    damaged, lines = [LOST in t for t in texts], [t.split("\n") for t in texts]
    left = [(n, at) for n, own in enumerate(lines) for at in range(len(own))]
    for _ in range(times):
        met = [(n, at, ws) for n, at in left if (ws := windows(lines[n][at]))]
        left = []
        for (n, at, _), best in zip(met, best_chains([ws for _, _, ws in met], model, margin)):
            if best and (new := apply_chain(lines[n][at], best[1])) is not None:
                damaged[n], lines[n][at] = True, new
                left.append((n, at))
    return list(zip(damaged, map("\n".join, lines)))


_models: dict[int, tuple[dict, Model]] = {}  # with the value, so that its number isn't another's


def model_of(known: Broadcast) -> Model:
    """The model of broadcast counts, built once in a worker, with what it remembers."""
    value = known.value
    if id(value) not in _models:
        _models.clear()
        _models[id(value)] = value, Model(value)
    return _models[id(value)][1]


def are_damaged(records: list[list[str]], model: Model, margin: float) -> list[bool]:
    """Whether a chain is accepted on one of the lines of each record, given as their windows."""
    lines, found = list(dict.fromkeys(chained.from_iterable(records))), set()
    for a in range(0, len(lines), LINES):
        part = lines[a : a + LINES]
        found.update(x for x, best in zip(part, best_chains([x.split(NEXT_WINDOW) for x in part], model, margin)) if best)
    return [not found.isdisjoint(xs) for xs in records]


def parsed(texts: DataFrame) -> DataFrame:
    """(id, text, sound, hashes, lines) of ``texts`` (id, text): whether no strict test fails, and for each line with
    windows its number and the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strict = Strict()
        for batch in batches:
            sound, hashes, lines = [], [], []
            for t in batch.column(1):
                text = t.as_py()
                met = [(line, ws) for line in text.split("\n") if (ws := windows(line))]
                sound.append(LOST not in text and not any(strict.line(ws) for _, ws in met))
                hashes.append([xxhash.xxh64_intdigest(line) - (1 << 63) for line, _ in met])
                lines.append([NEXT_WINDOW.join(ws) for _, ws in met])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sound, pa.bool_()), pa.array(hashes, pa.list_(pa.int64())), pa.array(lines, pa.list_(pa.string()))], ["id", "text", "sound", "hashes", "lines"])

    return texts.mapInArrow(run, "id bigint, text string, sound boolean, hashes array<bigint>, lines array<string>")


def ngram_counts(lines: DataFrame) -> DataFrame:
    """(gram, n) of order 4 over ``lines`` (windows), each of which comes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            counts: Counter = Counter()
            for w, n in seen.items():
                for i in range(3, len(w)):
                    counts[w[i - 3 : i + 1]] += n
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["gram", "n"])

        for batch in batches:
            for x in batch.column(0).to_pylist():
                seen.update(x.split(NEXT_WINDOW))
            if len(seen) > 100_000:
                yield out()
                seen.clear()
        yield out()

    return lines.mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def model_counts(grams: DataFrame, s: Settings) -> dict[str, int]:
    """The n-grams of a model, orders 1 to 4, from counts of order 4: a shorter one came as often as all that end with it.
    At most 1 / least_share of each order come to the driver."""
    total = grams.agg(F.sum("n")).first()[0] or 0
    ends = grams.select(F.explode(F.array("gram", *(F.expr(f"substring(gram, {k}, 4)") for k in (2, 3, 4)))).alias("gram"), "n")
    kept = ends.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= F.lit(s.least_share * total)).toPandas()
    return dict(zip(kept["gram"].tolist(), kept["n"].tolist()))


KNOWN = UTF8_CHAINS[:6] + BYTE_CHAINS
NONE = 1e-8  # a gain under it is none; the bounds have room of a tenth of it


def _damaged_run(run: str, chain: tuple[str, str]) -> str | None:
    """A non-ASCII run as the UTF-8 chain would have damaged it, None where it can't, or can't be undone."""
    bad = damage(run, chain)
    return bad if bad is not None and _undone(bad, chain) == run else None


def _damaged_chars(chain: tuple[str, str]) -> dict[str, str]:
    """What a one-to-one chain makes of each character that it can damage; undoing gives the character again."""
    return {c: bad for c in _table(chain[1]) if (bad := damage(c, chain)) is not None}


DAMAGED = {chain: _damaged_chars(chain) for chain in BYTE_CHAINS}
DAMAGES = {chain: str.maketrans(chars) for chain, chars in DAMAGED.items()}
CAN_DAMAGE = [frozenset(DAMAGED[chain]).union(map(chr, range(128))) if chain in DAMAGED else None for chain in KNOWN]


class Validation:
    """What clean lines gain, wrongly and by repair; remembers windows."""

    def __init__(self, model: Model):
        self.model = model
        self.known = [Remembered(lambda w, k=k: self.repaired(w, k), 10_000) for k in range(len(KNOWN))]
        self.runs = [Remembered(lambda run, chain=chain: _damaged_run(run, chain), 10_000) for chain in KNOWN]

    def damaged(self, w: str, k: int) -> str | None:
        """A window as known chain ``k`` would have damaged it, the first three characters being the last ones before the others;
        None where it can't, or can't be undone. A one-to-one chain can damage all characters of a line, or isn't asked."""
        chain, text = KNOWN[k], w[3:]
        if chain[1] != "utf-8":
            return w.translate(DAMAGES[chain])
        if "&" in w:
            bad = damage(text, chain)
            if not bad or (apply_chain(bad, chain) or bad) != text:
                return None
        else:
            parts, runs = SPLIT.split(text), self.runs[k]
            parts[1::2] = [runs[run] for run in parts[1::2]]
            if None in parts:
                return None
            bad = "".join(parts)
        head = w[:3] if w[:3].isascii() else damage(w[:3], chain)
        return f"\n\n\n{head}"[-3:] + bad if head else None

    def repaired(self, w: str, k: int) -> tuple[bool, float] | None:
        """Whether known chain ``k`` damages a window, and what undoing it gains; None where it can't, or can't be undone."""
        bad, scores = self.damaged(w, k), self.model.scores
        return None if bad is None else (bad[3:] != w[3:], scores[w] - scores[bad])

    def repair(self, ws: list[str], k: int) -> float | None:
        """What a line, given as windows, gains by repair when known chain ``k`` has damaged it, None where it can't."""
        if (can := CAN_DAMAGE[k]) and not can.issuperset("".join(ws)):
            return None
        total, changes, known = 0.0, False, self.known[k]
        for w in ws:
            if (got := known[w]) is None:
                return None
            changes |= got[0]
            total += got[1]
        return total if changes else None

    def lines(self, numbers: list[int], lines: list[list[str]]) -> list[tuple[float, float | None]]:
        """What each clean line, given as windows, gains under a wrong chain, 0 where none gains, and what it gains by repair
        when one of the known chains has damaged it, None where that one can't. The line's number chooses the chain."""
        sound = best_chains(lines, self.model, NONE)
        return [(best[0] if best else 0.0, self.repair(ws, number % len(KNOWN))) for number, ws, best in zip(numbers, lines, sound)]

    def line(self, number: int, ws: list[str]) -> tuple[float, float | None]:
        """``lines`` of one line."""
        return self.lines([number], [ws])[0]


FEW = 10_000  # numbers that may come to the driver


def nth(values: DataFrame, n: int, count: int, low: float, high: float) -> float:
    """The ``n``-th least of ``values`` (v), from 0, exactly: ranges are counted, and the one that holds it is parted again.
    ``count``, ``low``, ``high``: how many there are, the least and the largest."""
    while low < high and count > FEW:
        part = F.floor((F.col("v") - low) / (high - low) * 1024).alias("part")
        parts = values.where(F.col("v").between(low, high)).groupBy(part).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()  # 1,025 at most
        for r in sorted(parts, key=lambda r: r["low"]):
            if n < r["n"]:
                count, low, high = r["n"], r["low"], r["high"]
                break
            n -= r["n"]
    return low if low == high else sorted(r["v"] for r in values.where(F.col("v").between(low, high)).collect())[n]  # FEW at most


def validated_margin(known: Broadcast, lines: DataFrame, s: Settings) -> float:
    """A third of the way from what all clean ``lines`` (hashes, lines) gain under a wrong chain to what they gain by
    repair when they are damaged. Where these overlap, as damage is left among the lines, what nearly all damaged ones
    gain decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Validation(model_of(known))
        for batch in batches:
            got = of.lines(batch.column(0).to_pylist(), [x.split(NEXT_WINDOW) for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.float64()), pa.array([b for _, b in got], pa.float64())], ["sound", "repaired"])

    gains = runtime.materialise(lines.select("hashes", "lines").mapInArrow(run, "sound double, repaired double"), "gains")
    n, *sound, m, low, high = gains.agg(*(f(c) for c in ("sound", "repaired") for f in (F.count, F.min, F.max))).first()
    if not n or not m:
        return s.margin
    of = lambda c: gains.select(F.col(c).alias("v"))
    high, low = nth(of("sound"), max(0, int(n * 0.995) - 1), n, *sound), nth(of("repaired"), int(m * 0.02), m, low, high)
    runtime.drop(gains)
    return min(high + (low - high) / 3, low)


def repair(table: DataFrame, id_col: str, text_col: str, s: Settings = Settings()) -> DataFrame:
    """(id_col, restored, whole) of each damaged record: the text as far as it can be restored, and
    whether no loss is left in it."""
    spark = table.sparkSession
    texts = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(CANDIDATE))
    records = runtime.materialise(parsed(runtime.spread(texts)), "records")
    of_lines = lambda df: df.select(F.explode(F.arrays_zip("hashes", "lines")).alias("x")).select("x.hashes", "x.lines")
    trusted = records.where("sound")
    lines = runtime.materialise(of_lines(trusted).groupBy("hashes").agg(F.first("lines").alias("lines"), F.count("*").alias("n")), "lines")
    grams = runtime.materialise(ngram_counts(lines.select("lines")), "grams")

    def fitted(counted: DataFrame, clean: DataFrame) -> tuple[Broadcast, float]:
        known = spark.sparkContext.broadcast(model_counts(counted, s))
        return known, validated_margin(known, clean, s)

    first, enough = fitted(grams, lines)

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(first)
        for batch in batches:
            damaged = are_damaged(batch.column(1).to_pylist(), model, enough)
            found = [h for hs, bad in zip(batch.column(0), damaged) if bad for h in hs.as_py()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["hashes"])

    # Lines that stand only in records which the first model finds damaged are taken out of the counts.
    out = trusted.select("hashes", "lines").mapInArrow(suspect, "hashes bigint").groupBy("hashes").agg(F.count("*").alias("m"))
    out = runtime.materialise(out, "suspects")
    only = lines.join(out, "hashes").where(F.col("m") >= F.col("n")).select("lines")
    left = grams.unionByName(ngram_counts(only).select("gram", (-F.col("n")).alias("n"))).groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > 0)
    known, margin = fitted(runtime.materialise(left, "grams"), lines.join(out, "hashes", "left_anti"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(known)
        for batch in batches:
            ids, restored, whole = [], [], []
            # The others are without a replacement character, and no chain is accepted on any line.
            sound = batch.column(2).to_numpy(zero_copy_only=False)
            look = ~sound
            look[sound] = are_damaged(batch.column(3).filter(batch.column(2)).to_pylist(), model, margin)
            at = pa.array(look, pa.bool_())
            for i, (damaged, text) in zip(batch.column(0).filter(at).to_pylist(), restore(batch.column(1).filter(at).to_pylist(), model, margin, s.times)):
                if damaged:
                    ids.append(i)
                    restored.append(text)
                    whole.append(LOST not in text)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(restored, pa.string()), pa.array(whole, pa.bool_())], ["id", "restored", "whole"])

    return records.select("id", "text", "sound", "lines").mapInArrow(run, "id bigint, restored string, whole boolean").withColumnRenamed("id", id_col)
