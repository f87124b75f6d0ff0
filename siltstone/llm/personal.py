"""Personal information in free text: e-mail addresses, phone numbers, identity numbers, street addresses
and names of persons, found by weak supervision and replaced by typed placeholders.

1. Candidates: generous patterns propose spans of each kind.
2. Labelers vote on each candidate, for, against or not at all: formats (regular expressions), gazetteers (the given
   names of a reference list; words so frequent in this log that they are no names; affixes of surnames,
   learnt from what follows listed given names and titles), and context: words that stand by spans of sure form far more
   often than in the log, learnt for each kind from all candidates.
3. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is for
   each kind, and the probability of each pattern. A vote for must speak for a span at least as strongly as against it,
   and a vote against the other way round, so that no labeler changes sides and a decoy can't become a kind of its own.
   There are at most 3 ** labelers patterns a kind, so what the driver sees doesn't grow with the data. Word
   pairs for which nothing speaks aren't candidates, but the estimation counts them too, each of them.
4. A span classifier (logistic, over hashed features of the span, its affixes, its neighbours and its votes) is
   trained on those probabilities, on all candidates of all texts (``rounds`` passes, each of which brings the driver the
   sum of their gradients), and decides every candidate of every text.

Each distinct text is read three times, for the lexicon, for its candidates, which are written down with their
votes and features, and for the pairs that are counted only: training and decisions read what is written down. Decisions go back to the records by the text's
128-bit number, spread over salts, as one text may be a third of the log.

Counts cover all distinct texts. Rows repeated (same id and text) count once. Null ids are dropped, null texts stay
null and hold nothing, empty ones are empty. An empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone import runtime

PARTICLES = frozenset("von van de der den da dos del di du la le ter zu zur bin al el".split())
KINDS = ("email", "phone", "id_number", "address", "person")

# Titles, kinds of streets, names of identity numbers, and what else a number may count.
TITLES = frozenset("mr mrs ms miss dr prof professor frau herr mme mlle monsieur madame señor señora sr sra sir dame".split())
STREETS = "street st lane ln close row road rd avenue ave boulevard blvd court ct way drive square sq place crescent terrace gardens mews hill walk quay".split()
TEL_WORDS = frozenset("tel phone telephone telefon téléphone teléfono fax mobile cell".split())
ID_WORDS = frozenset("passport passeport pasaporte reisepass ausweisnummer ausweis personalausweis licence license tax steuernummer ssn national dni nif nie identity identification insurance nino pesel cpf sin".split())
NUMBER_DECOYS = frozenset("build range rows columns port took issue chunk error version release sha commit since factor size days retries row column v ms kb mb line rev ticket order invoice".split())

MAIL = re.compile(
    r"(?:mailto:)?[A-Za-z0-9][\w.%+-]*(?:\s?@\s?|\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+(?=[\w-]+(?:\s+dot\s+|\s*[\[(]dot[\])]\s*)))"
    r"[A-Za-z0-9][\w-]*(?:(?:\.|\s+dot\s+|\s*[\[(]\s*dot\s*[\])]\s*)[A-Za-z0-9-]+)+", re.I,
)
AT = re.compile(r"[\s\[({<]at[\s\])}>]", re.I)
PHONE = re.compile(r"(?<![\w.@/:-])(?:\+|\(|00)?\d(?:[\d().\s/-]| ){5,24}\d(?:\s*(?:ext|x|dw)\.?\s*\d{1,5})?(?![\w@]|[.:/-]\d)", re.I)
ID_NUMBER = re.compile(
    r"(?<![\w@./-])(?:[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Z]|[A-Z]{1,3}[- ]?\d{2,3}(?:[- ]?\d{3}){1,3}|[A-Z]{1,2}\s?\d{6,9}[A-Z]?|[A-Z]\d{2}[A-Z]\d{4,6}|\d{8}-?[A-Z]|[XYZ]\d{7}-?[A-Z]"
    r"|\d{3}[- ]\d{2}[- ]\d{4}|\d{2,3}/\d{3}/\d{4,5}|\d{6,8}-\d{4}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{11})(?![\w@]|[./:-]\d)", re.I,
)
ADDRESS = re.compile(
    rf"(?:flat\s+\d+\w?,?\s+)?(?<![\w.])\d{{1,5}}[a-z]?,?\s+[^\W\d_][\w'’-]*(?:\s+[^\W\d_][\w'’-]*)?\s+(?:{'|'.join(STREETS)})\b\.?(?:\s+(?:apt|suite|unit|flat)\s*\w+)?"
    r"|[^\W\d_]{3,}(?:straße|strasse|str\.|weg|allee|gasse|platz|ufer)\s+\d{1,3}[a-z]?\b|(?:[^\W\d_]+\s+)(?:straße|strasse|allee|platz|weg)\s+\d{1,3}\b"
    r"|\d{1,4}(?:\s?(?:bis|ter))?,?\s+(?:rue|avenue|impasse|boulevard|place|chemin|quai|allée|route)\s+(?:(?:de|des|du|la|le|les|l'|d')\s*)*[^\W\d_][\w'’-]*"
    r"|(?:calle|avenida|avda\.?|plaza|paseo|rua|via|piazza|ulica|ul\.)\s+(?:(?:de|del|la|las|los|do|da|di)\s+)*[^\W\d_][\w'’-]*,?\s+\d{1,4}\b", re.I,
)
POSTCODE = re.compile(r"^[,\s]*(?:[^\W\d_]+[,\s]+)?(?:[A-Z]{2}\d{1,2}\s?\d[A-Z]{2}\b|(?:[A-Z]{2}[ ,]+)?\d{5}\b|\d{4,5}-\d{3}\b)", re.I)
TOWN = re.compile(r"^\s*,\s+[^\W\d_]{3,}|^\s+[A-ZÄÖÜ][a-zäöüßéèà]+\b")
TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*|\d+|[^\w\s]|\n")
LABELERS = {"email": ("format", "top", "context"), "phone": ("format", "digits", "context", "decoy"), "id_number": ("format", "keyword", "context", "decoy"), "address": ("format", "place", "context"), "person": ("given", "affix", "context", "frequent", "shape")}
CONTEXT = 2  # the place of its vote in each


#: What is believed beforehand of the votes (against, none, for) on spans that are personal, and on those that aren't. A
#: decoy is a word that says what a number counts, so its vote is seldom wrong.
BELIEFS = {"": ((0.05, 0.35, 0.6), (0.5, 0.45, 0.05)), "decoy": ((0.002, 0.988, 0.01), (0.5, 0.49, 0.01))}


@dataclass(frozen=True)
class Settings:
    """rounds, rate: passes over all candidates that the classifier is trained in, and its first step. frequent: share of distinct texts from which a word
    is rather no name. affix_share: share of all names behind given names under which a beginning or an end is no affix of
    surnames (so there are at most 5 / affix_share of them). context_share, lift: see ``contexts_of``. buckets: hashed features. salts: parts of a hot text."""

    rounds: int = 40
    rate: float = 0.5
    frequent: float = 0.001
    affix_share: float = 1e-5
    context_share: float = 0.005
    lift: float = 3.0
    buckets: int = 1 << 15
    threshold: float = 0.5
    salts: int = 16


@dataclass
class Lexicon:
    given: frozenset
    frequent: frozenset
    affixes: dict
    contexts: dict = field(default_factory=dict)
    scores: dict = field(default_factory=dict)


@dataclass
class Candidate:
    kind: str
    start: int
    end: int
    votes: tuple
    features: list
    near: list


def around(text: str, start: int, end: int, n: int = 3) -> tuple[list[str], list[str]]:
    before = TOKEN.findall(text[max(0, start - 40) : start].lower())[-n:]
    return before, TOKEN.findall(text[end : end + 40].lower())[:n]


def _phone_votes(span: str, before: list[str], after: list[str]) -> tuple:
    digits = re.sub(r"\D", "", re.sub(r"(?i)(?:ext|x|dw).*", "", span))
    good = bool(
        re.match(r"(?:\+|00)\d{1,3}[\s(/-]?", span) and 9 <= len(digits) <= 15
        or re.fullmatch(r"\(\d{3}\)\s?\d{3}[-.\s]\d{4}", span.strip()) or re.fullmatch(r"\d{3}([-.\s])\d{3}\1\d{4}", span.strip())
        or re.match(r"0\d{1,4}[\s/-]", span) and 9 <= len(digits) <= 12
    )
    bad = bool(re.match(r"\d{4}-\d{2}-\d{2}|\d{1,3}(?:\.\d{1,3}){3}$", span))
    said = len(digits) >= 9 and bool(TEL_WORDS & {*before[-2:]})
    return (1 if good or said else -1 if bad else 0, 1 if 9 <= len(digits) <= 15 else -1, 0, -1 if set(before[-2:]) & NUMBER_DECOYS or bad else 0)


def _id_votes(span: str, before: list[str], after: list[str]) -> tuple:
    compact = re.sub(r"[\s./-]", "", span)
    letters = re.sub(r"[^A-Za-z]", "", compact)
    mixed = bool(letters and letters.isupper() and sum(c.isdigit() for c in compact) >= 6)
    if re.fullmatch(r"[0-9A-Fa-f]{7,12}", compact):
        mixed = False  # as likely a hash
    shaped = bool(re.fullmatch(r"(?i:[a-z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[a-z])|9\d{2}[- ]\d{2}[- ]\d{4}|[0-8]\d{2} \d{2} \d{4}|\d{2,3}/\d{3}/\d{4,5}|\d{8}-\d{4}|\d{8}-?[A-Za-z]", span))
    keyword = set(before) & ID_WORDS
    decoy = set(before[-2:]) & NUMBER_DECOYS
    return (1 if mixed or shaped else 0, 1 if keyword else 0, 0, -1 if decoy and not keyword else 0)


def _address_votes(text: str, start: int, end: int) -> tuple:
    local = bool(re.search(r"(?i)straße|strasse|str\.|weg|allee|rue|calle|impasse|avenue|flat|apt|gasse", text[start:end]))
    behind = text[end : end + 40]
    return (1 if local else 0, 1 if POSTCODE.match(behind) or TOWN.match(behind) else 0, 0)


def affixes_of(name: str) -> list[str]:
    name = name.lower()
    return [f"^{name[:k]}" for k in (3, 4)] + [f"{name[-k:]}$" for k in (4, 5, 6)] if len(name) >= 6 else []


def surname_score(name: str, lexicon: Lexicon) -> float:
    """Over 0 where the beginning and the end of a name (of each part, if it has a hyphen) are those of surnames."""
    got = lexicon.scores.get(name)
    if got is None:
        out = []
        for part in [p for p in re.split(r"[-'’]", name) if len(p) > 2] or [name]:
            known = affixes_of(part)
            ahead = max((lexicon.affixes.get(a, -1.0) for a in known if a[0] == "^"), default=-1.0)
            end = max((lexicon.affixes.get(a, -1.0) for a in known if a[0] != "^"), default=-1.0)
            out.append(ahead + end)
        if len(lexicon.scores) > 300_000:
            lexicon.scores.clear()
        got = lexicon.scores[name] = min(out)
    return got


def names_in(text: str, taken: list[tuple[int, int]], lexicon: Lexicon, ordinary: bool = False) -> list[tuple[int, int, str, str, str, bool]]:
    """(start, end, first, last, form, nothing speaks for it) of what may be a person. ``taken``: spans of other kinds. With
    ``ordinary``, also the word pairs for which nothing speaks: without them the estimation would see no pair that isn't
    a name."""
    tokens = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(text)]
    free = [t[0].isalpha() and not (taken and any(a < e and s < b for a, b in taken)) for t, s, e in tokens]
    out = []

    surname = lambda w: max(map(len, re.split(r"[-'’]", w))) >= 4
    likely = lambda w: surname_score(w, lexicon)

    for i, (t, s, e) in enumerate(tokens):
        if not free[i]:
            continue
        low = t.lower()
        nxt = tokens[i + 1] if i + 1 < len(tokens) else None
        if nxt is None:
            continue
        if low in TITLES or len(t) == 1:
            j = i + 2 if nxt[0] == "." and i + 2 < len(tokens) else i + 1
            gap = text[e : tokens[j][1]]
            if free[j] and surname(tokens[j][0]) and "\n" not in gap and (low in TITLES or likely(tokens[j][0]) > 0):
                out.append((s, tokens[j][2], low, tokens[j][0], "title" if low in TITLES else "initial" if nxt[0] == "." else "letter", False))
            continue
        if nxt[0] == "," and i + 2 < len(tokens) and free[i + 2] and text[nxt[2] : tokens[i + 2][1]] == " ":
            first = tokens[i + 2]
            if first[0].lower() in lexicon.given and likely(t) > -1 or likely(t) > 0 and (len(first[0]) == 1 or first[0][:1].isupper()) and first[0].lower() not in lexicon.frequent:
                out.append((s, first[2], first[0].lower(), t, "reversed", False))
                continue
        j = i + 1
        if len(nxt[0]) == 1 and nxt[0].isalpha() and i + 3 < len(tokens):
            j = i + 3 if tokens[i + 2][0] == "." else i + 2
        while j + 1 < len(tokens) and tokens[j][0].lower() in PARTICLES:
            j += 1
        last = tokens[j]
        if not free[j] or len(last[0]) < 2 or last[1] - e > 12 or "\n" in text[e : last[1]]:
            continue
        speaks = low in lexicon.given or likely(last[0]) > 0 and len(t) > 1
        if speaks or ordinary:
            out.append((s, last[2], low, last[0], "plain", not speaks))
    return out


def _person_votes(text: str, first: str, last: str, form: str, before: list[str], after: list[str], lexicon: Lexicon) -> tuple:
    score = surname_score(last, lexicon)
    given = 1 if first in lexicon.given or form in ("title", "initial") else 0
    frequent = -1 if last.lower() in lexicon.frequent or form == "plain" and first in lexicon.frequent and first not in lexicon.given else 0
    shape = -1 if last.islower() and before and not set(before) & {".", "\n"} and not text.islower() and form != "reversed" else 0
    return (given, 1 if score > 0 else -1, 0, frequent, shape)


def features(kind: str, span: str, before: list[str], after: list[str], votes: tuple, extra: list[str]) -> list[str]:
    shape = re.sub(r"[A-Z]+", "A", re.sub(r"[a-zà-ÿ]+", "a", re.sub(r"\d", "9", span)))
    out = [f"{kind}", f"{kind}:shape:{shape[:24]}", f"{kind}:len:{min(len(span) // 4, 12)}"]
    out += [f"{kind}:vote:{name}:{v}" for name, v in zip(LABELERS[kind], votes) if name != "context"]
    out += [f"{kind}:before:{w}" for w in before[-1:]] + [f"{kind}:near:{w}" for w in before[:-1]] + [f"{kind}:after:{w}" for w in after[:1]]
    return out + [f"{kind}:{x}" for x in extra]


def formed(text: str) -> tuple[list[tuple[str, int, int, tuple]], list[tuple[int, int]]]:
    """(kind, start, end, votes) of the candidates that have a form of their own, which names have not, and the spans that
    are taken; a span that an earlier kind took whole isn't proposed again."""
    out: list[tuple[str, int, int, tuple]] = []
    taken: list[tuple[int, int]] = []
    digits = sum(map(text.count, "0123456789"))
    for m in MAIL.finditer(text) if "@" in text or AT.search(text) else ():
        top = re.split(r"\.|\bdot\b", m[0])[-1].strip(" ])")
        strict = bool(re.fullmatch(r"(?:mailto:)?[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}", m[0]))
        out.append(("email", *m.span(), (1 if strict else 0, 1 if top.isalpha() and len(top) >= 2 else -1, 0)))
        taken.append(m.span())
    inside = lambda s, e: any(a < e and s < b for a, b in taken)
    spans = []
    for m in ADDRESS.finditer(text) if digits else ():
        if not inside(*m.span()):
            votes = _address_votes(text, *m.span())
            out.append(("address", *m.span(), votes))
            if max(votes) > 0:
                spans.append(m.span())
    taken += spans
    for m in ID_NUMBER.finditer(text) if digits > 4 else ():
        if not inside(*m.span()):
            before, after = around(text, *m.span(), 4)
            votes = _id_votes(m[0], before, after)
            if any(v > 0 for v in votes[:2]):
                out.append(("id_number", *m.span(), votes))
                taken.append(m.span())
    for m in PHONE.finditer(text) if digits > 2 else ():
        if not inside(*m.span()):
            before, after = around(text, *m.span(), 4)
            out.append(("phone", *m.span(), _phone_votes(m[0].strip(), before, after)))
    return out, taken


def near_words(before: list[str], after: list[str]) -> set[str]:
    return {w for w in (*before, *after[:2]) if w.isalpha()}


def candidates(text: str, lexicon: Lexicon) -> list[Candidate]:
    """Candidates of a text, by kind."""
    out: list[Candidate] = []

    def add(kind, s, e, votes, before, after, extra=()):
        out.append(Candidate(kind, s, e, votes, features(kind, text[s:e], before, after, votes, list(extra)), sorted(near_words(before, after))))

    spans, taken = formed(text)
    for kind, s, e, votes in spans:
        add(kind, s, e, votes, *around(text, s, e))
    for s, e, first, last, form, _ in names_in(text, taken, lexicon):
        before, after = around(text, s, e)
        add("person", s, e, _person_votes(text, first, last, form, before, after, lexicon), before, after, [f"form:{form}", f"given:{first in lexicon.given}", *affixes_of(last.split("-")[-1]), f"last:{last.lower()}"])
    return out


def ordinary_votes(text: str, lexicon: Lexicon, said: re.Pattern | None) -> list[tuple]:
    """The votes, with the context's, on each pair of words for which nothing speaks. ``said`` finds words of the context
    anywhere: a text without any, and without capitals, needs no look around its pairs."""
    out, context = [], set(lexicon.contexts.get("person", ()))
    spoken, plain = bool(said and said.search(text.lower())), text.islower()
    for s, e, first, last, form, nothing in names_in(text, formed(text)[1], lexicon, True):
        if nothing:
            before, after = around(text, s, e) if spoken or not plain and last.islower() else ([], [])
            votes = list(_person_votes(text, first, last, form, before, after, lexicon))
            votes[CONTEXT] = int(spoken and not context.isdisjoint(near_words(before, after)))
            out.append(tuple(votes))
    return out


# -- estimation ------------------------------------------------------------------------------
def reliabilities(patterns: dict[tuple, int], labelers: tuple[str, ...], rounds: int = 60) -> dict[tuple, float]:
    """Expectation-maximisation: the probability of each vote pattern, given how often each came. Labelers
    are taken to err independently; a vote is -1, 0 or 1."""
    if not patterns:
        return {}
    rows, n = np.array(list(patterns)), np.array(list(patterns.values()), float)
    q = 1 / (1 + np.exp(-1.5 * rows.sum(1)))  # to begin with: each vote counts alike
    belief = 2.0 + 0.1 * n.sum()  # that labelers are better than chance, worth a tenth of the data
    for _ in range(rounds):
        prior = np.clip((q * n).sum() / n.sum(), 0.02, 0.98)
        like = np.tile(np.log([prior, 1 - prior]), (len(rows), 1))
        for j in range(rows.shape[1]):
            logs = np.zeros((2, 3))
            for c, w in enumerate((q * n, (1 - q) * n)):
                share = np.array([w[rows[:, j] == v].sum() for v in (-1, 0, 1)]) + belief * np.array(BELIEFS.get(labelers[j], BELIEFS[""])[c])
                logs[c] = np.log(share / share.sum())
            # No labeler changes sides: what it says for a span isn't held against it, nor the other way round.
            odds = logs[0] - logs[1]
            odds = np.array([min(odds[0], 0.0), odds[1], max(odds[2], 0.0)])
            like[:, 0] += odds[rows[:, j] + 1]
        new = 1 / (1 + np.exp(np.clip(like[:, 1] - like[:, 0], -30, 30)))
        new = np.where(rows.max(1) > 0, new, np.minimum(new, 0.1))  # where no labeler speaks for a span, others can't carry it
        done = np.abs(new - q).max() < 1e-6
        q = new
        if done:
            break
    return {tuple(int(v) for v in r): float(p) for r, p in zip(rows, q)}


def bucket(feature: str, buckets: int) -> int:
    return zlib.crc32(feature.encode()) % buckets


@dataclass
class Model:
    """What is learnt."""

    lexicon: Lexicon
    weights: np.ndarray
    settings: Settings
    patterns: dict


def chosen(spans: list[tuple[int, int, str]], z: list[float], threshold: float) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what is personal, in order; where spans meet, the surer stays."""
    least = np.log(threshold / (1 - threshold))
    out: list[tuple[int, int, str]] = []
    for _, s, e, k in sorted((-v, *x) for v, x in zip(z, spans) if v >= least):
        if not any(a < e and s < b for a, b, _ in out):
            out.append((s, e, k))
    return sorted(out)


KEY = ("text_a", "text_b")


def numbers(text: Column) -> list[Column]:
    """The 128-bit number of a text."""
    return [F.xxhash64(text).alias(KEY[0]), F.xxhash64(F.lit("second"), text).alias(KEY[1])]


def counted_words(distinct: DataFrame, given: frozenset) -> DataFrame:
    """(word, before, n): how many distinct texts hold a word (before null), and how often a word of six letters or more
    follows a given name or a title."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        ahead = given | TITLES

        def out():
            rows = list(counts.items())
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.int64())], ["word", "before", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = [w for w in TOKEN.findall(text.lower()) if w.isalpha() or "-" in w]
                counts.update((w, None) for w in set(words))
                for a, b in zip(words, words[1:]):
                    if a in ahead and len(b) >= 6:
                        counts[b.split("-")[0], a] += 1
            if len(counts) > 200_000:
                yield out()
                counts.clear()
        yield out()

    return distinct.mapInArrow(count, "word string, before string, n bigint").groupBy("word", "before").agg(F.sum("n").alias("n"))


def lexicon_of(distinct: DataFrame, given_names: DataFrame, s: Settings) -> tuple[Lexicon, DataFrame, int]:
    """The lexicon but for its contexts, the counted words, and the number of distinct texts."""
    given = frozenset(r[0].lower() for r in given_names.select("given_name").where(F.col("given_name").isNotNull()).distinct().collect())  # a fixed reference list
    counted = runtime.materialise(counted_words(distinct, given), "words")
    total = distinct.count()
    # A word in a share of at least s.frequent of the distinct texts: at most (words a text / share) of them.
    frequent = frozenset(r["word"] for r in counted.where(F.col("before").isNull() & (F.col("n") >= max(3.0, s.frequent * total))).select("word").collect()) - given
    # An affix of surnames follows several given names; what follows one alone is as likely a phrase ("Rose Chart"), so the
    # name that an affix follows most often isn't counted.
    low, size = F.col("word"), F.length("word")
    ends = [F.concat(F.lit("^"), F.substring(low, 1, k)) for k in (3, 4)] + [F.concat(F.substring(low, -k, k), F.lit("$")) for k in (4, 5, 6)]
    sides = counted.where(size >= 6).select(F.explode(F.array(*ends)).alias("affix"), "before", "n").groupBy("affix", "before").agg(F.sum("n").alias("n"))
    behind = F.when(F.col("before").isNotNull(), F.col("n"))
    phrase = F.coalesce(F.max(behind), F.lit(0))
    sums = sides.groupBy("affix").agg((F.coalesce(F.sum(behind), F.lit(0)) - phrase).alias("named"), (F.coalesce(F.sum(F.when(F.col("before").isNull(), F.col("n"))), F.lit(0)) - phrase).alias("any"), F.count(behind).alias("givens"))
    names = counted.where(F.col("before").isNotNull()).agg(F.sum("n")).first()[0] or 0
    least = max(5.0, s.affix_share * names)
    kept = sums.where((F.col("named") >= least) & (F.col("named") >= 0.15 * F.col("any")) & (F.col("givens") >= 3)).collect()  # at most 5 / affix_share
    affixes = {r["affix"]: float(np.clip(np.log(r["named"] / max(r["any"] - r["named"] + 0.02 * r["any"] + 2, 1e-9)) + 1.0, -1, 3)) for r in kept}
    return Lexicon(given, frequent, affixes), counted, total


def sure(each: DataFrame) -> Column:
    """Candidates whose form alone is nearly proof: the first labeler speaks for them, and for a person also the second."""
    return each["votes"].startswith("1,") & ((each["kind"] != "person") | each["votes"].startswith("1,1,"))


def contexts_of(proposed: DataFrame, words: DataFrame, total: int, s: Settings) -> dict[str, list[str]]:
    """For each kind the words that stand by its sure spans in at least ``context_share`` of them, and ``lift`` times as
    often as they stand in texts at all: at most 5 / context_share a kind."""
    each = proposed.select(F.explode("met").alias("c")).select("c.kind", "c.votes", "c.near")
    held = each.where(sure(each))
    sums = held.groupBy("kind").agg(F.count("*").alias("seeds"))
    met = held.select("kind", F.explode("near").alias("word")).groupBy("kind", "word").agg(F.count("*").alias("met")).join(F.broadcast(sums), "kind")  # a row a kind
    met = met.where(F.col("met") >= F.greatest(F.lit(5.0), s.context_share * F.col("seeds")))
    often = met.join(words.where(F.col("before").isNull()).select("word", "n"), "word")
    kept = often.where(F.col("met") * total >= s.lift * F.col("seeds") * F.col("n")).select("kind", "word").collect()
    out: dict[str, list[str]] = {k: [] for k in KINDS}
    for r in sorted(kept):
        out[r["kind"]].append(r["word"])
    return out


PROPOSED = "kind string, start int, end int, votes string, feats array<int>, near array<string>"


def proposals(distinct: DataFrame, lexicon: Lexicon, s: Settings) -> DataFrame:
    """(text_a, text_b, met): the candidates of each distinct text (text, text_a, text_b) that has some."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.string()), ("feats", pa.list_(pa.int32())), ("near", pa.list_(pa.string()))]))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = [[(c.kind, c.start, c.end, ",".join(map(str, c.votes)), [bucket(f, s.buckets) for f in c.features], c.near) for c in candidates(text, lexicon)] for text in batch.column(0).to_pylist()]
            some = pa.array([bool(m) for m in met], pa.bool_())
            rows = pa.array([[dict(zip(("kind", "start", "end", "votes", "feats", "near"), c)) for c in m] for m in met if m], kind)
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(some), batch.column(2).filter(some), rows], [*KEY, "met"])

    return distinct.select("text", *KEY).mapInArrow(propose, f"{KEY[0]} bigint, {KEY[1]} bigint, met array<struct<{PROPOSED.replace(' string', ':string').replace(' int', ':int').replace(' array', ':array')}>>")


def context_feature(kind: str, vote: int, buckets: int) -> int:
    return bucket(f"{kind}:vote:context:{vote}", buckets)


def with_contexts(proposed: DataFrame, lexicon: Lexicon, s: Settings) -> DataFrame:
    """``proposed`` with the context's vote among the votes and features, and no words."""

    def one(c: Column) -> Column:
        said, feature = F.lit(False), F.lit(0)
        for k in KINDS:
            mine = F.arrays_overlap(c["near"], F.array(*map(F.lit, lexicon.contexts.get(k) or [""])))
            said = F.when(c["kind"] == k, mine).otherwise(said)
            feature = F.when(c["kind"] == k, F.when(mine, context_feature(k, 1, s.buckets)).otherwise(context_feature(k, 0, s.buckets))).otherwise(feature)
        votes = F.regexp_replace(c["votes"], r"^(-?\d,-?\d),0", F.concat(F.lit("$1,"), F.when(said, "1").otherwise("0")))
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), votes.alias("votes"), F.array_append(c["feats"], feature).alias("feats"))

    return proposed.select(*KEY, F.transform("met", one).alias("met"))


def ordinary_patterns(distinct: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(votes, n): how often each pattern of votes came on pairs of words for which nothing speaks, in all texts."""
    words = lexicon.contexts.get("person", ())
    said = re.compile("|".join(map(re.escape, words))) if words else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(ordinary_votes(text, lexicon, said))
        yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, k)) for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["votes", "n"])

    return distinct.mapInArrow(count, "votes string, n bigint").groupBy("votes").agg(F.sum("n").alias("n"))


def flat_scores(lists: pa.ListArray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, places, how many each row has) of rows of features; the last weight is the bias."""
    sizes, places = np.asarray(lists.value_lengths()), np.asarray(lists.flatten())
    if not len(sizes):
        return np.zeros(0), places, sizes
    return np.add.reduceat(weights[places], np.concatenate(([0], np.cumsum(sizes)[:-1]))) + weights[-1], places, sizes


WHOLE = 1 << 24  # gradients are summed as whole numbers, so that no order of rows or tasks changes the sum


def gradient(voted: DataFrame, patterns: dict, weights: np.ndarray) -> np.ndarray:
    """The gradient of the log-likelihood of the probabilities ``patterns``, over all candidates of ``voted``."""
    labels = {f"{k}:{','.join(map(str, p))}": q for (k, p), q in patterns.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(weights), np.int64)
        for batch in batches:
            flat = batch.column(0).flatten()
            z, places, sizes = flat_scores(flat.field("feats"), weights)
            seen = pa.compute.binary_join_element_wise(flat.field("kind"), flat.field("votes"), ":").dictionary_encode()
            label = np.array([labels[v] for v in seen.dictionary.to_pylist()], float)[np.asarray(seen.indices)]
            d = np.rint((label - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) * WHOLE)
            total += np.bincount(places, np.repeat(d, sizes), len(weights)).astype(np.int64)
            total[-1] += int(d.sum())
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["place", "n"])

    with runtime.cleaning(voted.sparkSession):
        sums = voted.select("met").mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # a row a weight
    out = np.zeros(len(weights))
    out[sums["place"].to_numpy(int)] = sums["n"].to_numpy(float) / WHOLE
    return out


def fit(voted: DataFrame, patterns: dict, s: Settings) -> np.ndarray:
    """Weights of a logistic classifier by AdaGrad over all candidates, on soft labels; the last one is the bias."""
    w, g = np.zeros(s.buckets + 1), np.full(s.buckets + 1, 1e-6)
    for _ in range(s.rounds if patterns else 0):
        step = gradient(voted, patterns, w)
        g += step * step
        w += s.rate * step / np.sqrt(g)
    return w


def learn(voted: DataFrame, ordinary: DataFrame, lexicon: Lexicon, s: Settings) -> Model:
    """Reliabilities from all candidates and the pairs ``ordinary`` (votes, n), and the classifier from all candidates;
    what comes to the driver is bounded by the settings."""
    counts: dict = {k: Counter() for k in KINDS}
    for r in voted.select(F.explode("met").alias("c")).groupBy("c.kind", "c.votes").agg(F.count("*").alias("n")).collect():  # at most 3 ** labelers a kind
        counts[r["kind"]][tuple(map(int, r["votes"].split(",")))] += r["n"]
    for r in ordinary.collect():  # as many at most
        counts["person"][tuple(map(int, r["votes"].split(",")))] += r["n"]
    patterns = {(k, p): q for k in KINDS for p, q in reliabilities(counts[k], LABELERS[k]).items()}
    return Model(lexicon, fit(voted, patterns, s), s, patterns)


def decided(proposed: DataFrame, model: Model) -> DataFrame:
    """(text_a, text_b, spans) of the texts in which something personal is found."""
    weights, threshold = model.weights, model.settings.threshold
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten()
            z = flat_scores(flat.field("feats"), weights)[0]
            starts, ends, kinds = (flat.field(c).to_pylist() for c in ("start", "end", "kind"))
            out, at = [], 0
            for n in np.asarray(batch.column(2).value_lengths()).tolist():
                here = z[at : at + n]
                spans = chosen(list(zip(starts[at : at + n], ends[at : at + n], kinds[at : at + n])), here.tolist(), threshold) if (here >= -30).any() else []
                out.append([dict(zip(("start", "end", "kind"), x)) for x in spans])
                at += n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], [*KEY, "spans"])

    return proposed.mapInArrow(run, f"{KEY[0]} bigint, {KEY[1]} bigint, spans array<struct<start:int,end:int,kind:string>>").where(F.size("spans") > 0)


def spans_of(table: DataFrame, text_col: str, given_names: DataFrame, s: Settings) -> DataFrame:
    """(text_a, text_b, spans) for the distinct texts of ``table``."""
    held = table.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.col("text") != "")).distinct()
    distinct = runtime.materialise(runtime.wide(held.select("text", *numbers(F.col("text"))), *KEY), "texts")
    lexicon, words, total = lexicon_of(distinct.select("text"), given_names, s)
    proposed = runtime.materialise(proposals(distinct, lexicon, s), "proposals")
    lexicon.contexts = contexts_of(proposed, words, total, s)
    voted = runtime.materialise(with_contexts(proposed, lexicon, s), "voted")
    runtime.drop(proposed)
    return decided(voted, learn(voted, ordinary_patterns(distinct.select("text"), lexicon), lexicon, s))


def _salted(spans: DataFrame, s: Settings) -> DataFrame:
    return spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1))))


def found(table: DataFrame, id_col: str, text_col: str, given_names: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(id_col, kind): one row for each kind of personal information in each record."""
    salt = F.pmod(F.xxhash64("id"), F.lit(s.salts)).cast("int").alias("salt")
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    kinds = _salted(spans_of(table, text_col, given_names, s).select(*KEY, F.array_distinct("spans.kind").alias("kinds")), s)
    met = rows.select("id", salt, *numbers(F.col("text"))).join(kinds, [*KEY, "salt"])
    return met.select(F.col("id").alias(id_col), F.explode("kinds").alias("kind")).distinct()


def mask(table: DataFrame, id_col: str, text_col: str, given_names: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(id_col, text): every distinct record with its personal information replaced by placeholders."""
    salt = F.pmod(F.xxhash64("id"), F.lit(s.salts)).cast("int").alias("salt")
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull()).distinct()
    met = rows.select("id", "text", salt, *numbers(F.col("text"))).join(_salted(spans_of(table, text_col, given_names, s), s), [*KEY, "salt"], "left")
    begun = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    step = lambda acc, x: F.struct(F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("done"), x["end"].alias("at"))
    masked = F.aggregate("spans", begun, step, lambda acc: F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return met.select(F.col("id").alias(id_col), F.coalesce(masked, F.col("text")).alias("text"))
