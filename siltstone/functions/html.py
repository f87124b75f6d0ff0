"""HTML to text: Arrow functions, as only a parser gets script bodies and references right."""

from __future__ import annotations

import html
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import text as tx

# Elements whose text is no content, and elements that end a line.
HIDDEN = frozenset("script style nav footer noscript svg head".split())
BREAKING = frozenset("p div section article li br h1 h2 h3 h4 tr".split())


class _Tokens(HTMLParser):
    """A page as a flat list of (step, tag or text): 1 opens, -1 closes, 0 is text."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, str]] = []
        self.handle_starttag = lambda tag, _: self.found.append((1, tag))
        self.handle_endtag = lambda tag: self.found.append((-1, tag))
        self.handle_data = lambda text: self.found.append((0, text))
        self.feed(source)


def body_text(source: str | None) -> str | None:
    """The text of a page, a line a block, blank lines dropped. An element that hides text and is never closed
    hides the rest."""
    if source is None:
        return None
    tokens = _Tokens(source).found
    # How many hiding elements are open at each token; closing what wasn't opened changes nothing.
    depths = accumulate((step if tag in HIDDEN else 0 for step, tag in tokens), lambda depth, step: max(0, depth + step), initial=0)
    seen = (text if not step else "\n" * (text in BREAKING) for (step, text), depth in zip(tokens, depths) if step or not depth)
    return "\n".join(filter(None, (" ".join(line.split()) for line in "".join(seen).splitlines())))


@F.pandas_udf(T.StringType())
def html_to_text(source: pd.Series) -> pd.Series:
    return source.map(body_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def unescape(source: pd.Series) -> pd.Series:
    return source.map(html.unescape, na_action="ignore")


def plain(text: Column) -> Column:
    """Tags stripped, then references resolved, then white space squeezed, in this order. Only texts with an ampersand,
    few of them, visit Python: the others reach the function as null."""
    bare = tx.without_tags(text)
    return tx.squeeze(F.coalesce(unescape(F.when(bare.contains("&"), bare)), bare))
