"""Markup residue in texts: which kinds are left, and the clean text with its structure kept.

Two stages:

* a site style tree (``style_tree``): the element trees of all texts of a host (a repository) are
  merged by their paths of tags and styles; a node's importance is the entropy of how its
  pages fill it: of the ways its children are presented, and, at leaves, of the spread of
  its contents over pages. Branches of low importance (the same furniture on every page) are
  removed from each page;
* a parser for HTML, Markdown, wiki and LaTeX markup (``kinds_of``, ``clean_text``), which recognises each
  kind, whole, cut off or escaped, and writes headings as ``# ``, list items as ``- ``, table rows as
  cells between bars, code blocks between fences, and formulas as they are.

The style tree alone can't name kinds of markup nor see Markdown, wiki or LaTeX, so the kinds come from the
parser; README says so.

Null and empty texts have no kinds and stay as they are. Null ids are kept in ``clean`` and dropped in
``kinds``. Rows repeated with the same id give one row in ``kinds``. A null host is a host of its own.
Empty tables give no rows. Other columns are never read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone import runtime

# The element names of HTML that text may still hold.
ELEMENTS = """a abbr article aside b big blockquote body br button caption center cite code col dd del details div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6
head header hr html i iframe img input ins kbd label legend li link main mark meta nav noscript object ol option p pre q s samp script section select small source span strike
strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video""".split()
_NAMES = "|".join(sorted(ELEMENTS, key=len, reverse=True))
_ATTRIBUTES = r"(?:\s+[A-Za-z_:@][-\w:.@]*(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=]+))?)*"

HTML_SIGNS = re.compile(
    rf"</?(?:{_NAMES}){_ATTRIBUTES}\s*/?>"
    rf"|<(?:{_NAMES})\s+[-\w:]+(?:\s*=\s*[\"']?[^<>\"']*[\"']?)?\s*\Z|</?(?:{_NAMES})\Z"
    r"|<!--|\A[^<>\n]{0,60}[\"']\s*/?>|<!doctype\b|<br\s*/?>"
    rf"|&lt;/?(?:{_NAMES})\b|&(?:[A-Za-z]{{2,8}}[0-9]{{0,2}}|\#[0-9]{{2,6}}|\#x[0-9a-f]{{2,5}});",
    re.I,
)
MARKDOWN_SIGNS = re.compile(
    r"^ {0,3}\#{1,6} +\S[^\n]*(?:\n[ \t]*\n|\n?\Z)"  # heading with a blank line after
    r"|^ {0,3}(?:```|~~~)"
    r"|(?<![\w\])])!?\[[^\]\[\n]*\]\([^)\s\n]*(?: +\"[^\"\n]*\")?\)"
    r"|(?<![\w\])])\[[^\]\[\n]+\]\[[^\]\[\n]*\]|^ {0,3}\[[^\]\n]+\]: +\S|\[\^[^\]\s]+\]"
    r"|(?<![\w*])\*\*(?=[^\s*])[^*\n]*(?<=[^\s*])\*\*(?![\w*])"
    r"|(?<![\w.])__(?=[^\s_])[^_\n]*(?<=[^\s_])__(?![\w(])"
    r"|~~(?=\S)[^~\n]+(?<=\S)~~"
    r"|(?<!`)`(?=[^`\s])[^`\n']*(?<=\S)`(?!`)"
    r"|^ {0,3}\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+(?:[ \t]*:?-{3,}:?)?[ \t]*$"
    r"|^[^\s|=*\#>-][^\n]*\n(?:={3,}|-{3,})[ \t]*\n[ \t]*\n"
    r"|^> \S[^\n]*(?:\n|\Z)(?=> |[ \t]*(?:\n|\Z))",
    re.M,
)
WIKI_SIGNS = re.compile(
    r"\[\[(?![\s\d\[\"'-])[^\[\]\n]+\]\]|\[\[(?:[A-Z][^\[\]\n]*)\Z"
    r"|(?<![\w'`])'''(?=[^\s'])[^'\n]+'''(?!')|(?<![\w'`])''(?=[^\s'])[^'\n]+''(?!')"
    r"|^(={2,6}) ?[^=\n]+? ?\1[ \t]*$"
    r"|\{\{[A-Za-z][^{}|\n]*\|[^{}\n]*(?:\}\}|\Z)"
    r"|^\{\|[^\n]*|^\|\}[ \t]*$|^\|-[ \t]*$|</?(?:nowiki|ref)\b",
    re.M,
)
LATEX_SIGNS = re.compile(
    r"\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{|\\(?:item|maketitle|centering|hline|toprule|midrule|bottomrule|newline|noindent|ldots|quad|par)\b(?![\\\w])"
    r"|^\\[\[\]][ \t]*$|\\\(.+?\\\)|(?<![\w$\\])\$\$"
    r"|(?<![\w$\\])\$(?=[^\s$])(?=[^$\n]*(?:\\[A-Za-z]+|[_^]))[^$\n]+(?<=[^\s$\\])\$(?![\w$])"
    r"|(?<=\w)\\[%_&#](?=[\s\w]|\Z)|(?<= )\\&(?= )|``(?=[^\s`])[^`'\n]+''",
    re.M,
)
SIGNS = {"html": HTML_SIGNS, "markdown": MARKDOWN_SIGNS, "wiki": WIKI_SIGNS, "latex": LATEX_SIGNS}
HINTS = {"html": ("<", "&", '">'), "markdown": tuple("#`~[*_|>=-"), "wiki": ("[[", "''", "==", "{{", "{|", "|-", "|}", "<"), "latex": ("\\", "$", "``")}


def kinds_of(text: str | None) -> list[str]:
    """The kinds of markup left in a text, in the order html, markdown, wiki, latex."""
    if not text:
        return []
    return [k for k, r in SIGNS.items() if any(h in text for h in HINTS[k]) and r.search(text)]


# -- clean text ------------------------------------------------------------------------------
KEPT = "\x00{}\x00"


def _fence(code: str) -> str:
    return "\n```\n" + code.strip("\n") + "\n```\n"


def clean_text(text: str | None) -> str | None:
    """The text without markup; code blocks and formulas aren't touched."""
    if not text:
        return text
    kinds = kinds_of(text)
    if not kinds:
        return text
    kept: list[str] = []

    def keep(what: str) -> str:
        kept.append(what)
        return KEPT.format(len(kept) - 1)

    if "html" in kinds:
        if re.search(rf"&lt;/?(?:{_NAMES})\b", text):  # markup that was escaped as a whole
            text = html.unescape(text)
        text = re.sub(r"(?is)<pre\b[^>]*>\s*(?:<code\b[^>]*>)?(.*?)(?:</code>)?\s*</pre>", lambda m: keep(_fence(html.unescape(re.sub(r"<[^>]+>", "", m[1])))), text)
    if "latex" in kinds:
        text = re.sub(r"(?s)\\begin\{(verbatim|lstlisting)\}(.*?)\\end\{\1\}", lambda m: keep(_fence(m[2])), text)
        text = re.sub(r"(?s)\\begin\{((?:equation|align|gather|math|displaymath)\*?)\}.*?\\end\{\1\}|\$\$.+?\$\$|\\\[.+?\\\]", lambda m: keep(m[0]), text)
        text = re.sub(r"(?<![\w$\\])\$(?=[^\s$])[^$\n]+(?<=[^\s$\\])\$(?![\w$])|\\\(.+?\\\)", lambda m: keep(m[0]), text)
    if "markdown" in kinds:
        text = re.sub(r"(?ms)^ {0,3}(```|~~~)[^\n]*\n(.*?)(?:^ {0,3}\1[ \t]*$|\Z)", lambda m: keep(_fence(m[2])), text)
        text = re.sub(r"(?<!`)`([^`\n]+)`(?!`)", lambda m: keep(m[1]), text)
    if "html" in kinds:
        text = _from_html(text)
    if "wiki" in kinds:
        text = _from_wiki(text)
    if "latex" in kinds:
        text = _from_latex(text)
    if "markdown" in kinds:
        text = _from_markdown(text)
    text = re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], text)
    text = re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], text)  # what was kept inside what was kept
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+(?=\n|\Z)", "", text)).strip("\n")


def _from_html(t: str) -> str:
    t = re.sub(r"(?s)<!--.*?(?:-->|\Z)|(?is:<(script|style)\b.*?</\1\s*>)", "", t)
    t = re.sub(r"\A[^<>\n]{0,60}[\"']\s*/?>", "", t)
    t = re.sub(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1\s*>", lambda m: "\n" + "#" * int(m[1]) + " " + " ".join(m[2].split()) + "\n", t)
    t = re.sub(r"(?i)\s*<li\b[^>]*>\s*", "\n- ", t)
    t = re.sub(r"(?i)\s*</?t[dh]\b[^>]*>\s*", " | ", t)
    t = re.sub(r"(?: \| ){2,}", " | ", t)
    t = re.sub(r"(?i)<img\b[^>]*\balt=[\"']([^\"']*)[\"'][^>]*>", r"\1", t)
    t = re.sub(r"(?i)<br\s*/?>", " ", t)
    t = re.sub(r"(?i)</?(?:p|div|section|article|blockquote|table|tr|ul|ol|dl|dt|dd|figure|header|footer|main|nav|aside|hr)\b[^>]*>", "\n", t)
    t = re.sub(rf"(?i)</?(?:{_NAMES}){_ATTRIBUTES}\s*/?>|<(?:{_NAMES})\b[^<>]*\Z", "", t)
    return html.unescape(t).replace("\xa0", " ")


def _from_wiki(t: str) -> str:
    t = re.sub(r"^(={2,6}) ?([^=\n]+?) ?\1[ \t]*$", lambda m: "#" * len(m[1]) + " " + m[2], t, flags=re.M)
    t = re.sub(r"^[ \t]*\[\[(?:Category|File|Image):[^\]\n]*\]\][ \t]*\n?", "", t, flags=re.M)
    t = re.sub(r"\[\[(?:[^\[\]\n|]*\|)?([^\[\]\n|]*)(?:\]\]|\Z)", r"\1", t)
    t = re.sub(r"\{\{[A-Za-z][^{}\n]*(?:\}\}|\Z)", "", t)
    t = re.sub(r"'{2,3}(?=\S)([^'\n]+)'{2,3}", r"\1", t)
    t = re.sub(r"^\{\|[^\n]*\n?|^\|\}[ \t]*\n?|^\|-[ \t]*\n?", "", t, flags=re.M)
    t = re.sub(r"^[|!](.*)$", lambda m: "| " + re.sub(r"\s*(?:\|\||!!)\s*", " | ", m[1].strip()) + " |", t, flags=re.M) if "||" in t or "!!" in t else t
    return re.sub(r"^\*+ +", "- ", t, flags=re.M)


def _from_latex(t: str) -> str:
    depth = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
    t = re.sub(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}\n]*)\}?", lambda m: "\n" + "#" * depth[m[1]] + " " + m[2] + "\n", t)
    t = re.sub(r"\\(?:begin|end)\{[^{}\n]*\}?(?:\[[^\]\n]*\]|\{[^{}\n]*\})*[ \t]*\n?", "", t)
    t = re.sub(r"^[ \t]*\\item\b(?:\[[^\]\n]*\])?[ \t]*", "- ", t, flags=re.M)
    t = re.sub(r"[ \t]*\\item\b(?:\[[^\]\n]*\])?[ \t]*", "\n- ", t)
    t = re.sub(r"\\(?:label|pageref|vspace|hspace|usepackage|documentclass)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}", "", t)
    t = re.sub(r"~?\\(?:cite[a-z]*|ref|eqref)\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}", r"[\1]", t)
    t = re.sub(r"\\(?:footnote)\{([^{}\n]*)\}", r" (\1)", t)
    for _ in range(3):
        t = re.sub(r"\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}?", r"\1", t)
    t = re.sub(r"\\(?:maketitle|centering|hline|toprule|midrule|bottomrule|newline|noindent|par)\b", "", t)
    t = re.sub(r"``([^`'\n]+)''", r'"\1"', t)
    t = re.sub(r"^(.*[^\\])?&.*\\\\[ \t]*$", lambda m: "| " + re.sub(r"\s*(?<!\\)&\s*", " | ", m[0].rstrip("\\ \t").strip()) + " |", t, flags=re.M)
    return re.sub(r"\\([%_&#$])", r"\1", t)


def _from_markdown(t: str) -> str:
    t = re.sub(r"^([^\s|=*#>-][^\n]*)\n(={3,}|-{3,})[ \t]*$", lambda m: ("# " if m[2][0] == "=" else "## ") + m[1], t, flags=re.M)
    t = re.sub(r"^ {0,3}\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+(?:[ \t]*:?-{3,}:?)?[ \t]*\n?", "", t, flags=re.M)
    t = re.sub(r"^ {0,3}\[\^[^\]\n]+\]: +", "", t, flags=re.M)
    t = re.sub(r"^ {0,3}\[[^\]\n]+\]: +\S[^\n]*\n?", "", t, flags=re.M)
    t = re.sub(r"!?\[([^\]\[\n]*)\]\([^)\n]*\)", r"\1", t)
    t = re.sub(r"\[\^[^\]\s]+\]", "", t)
    t = re.sub(r"\[([^\]\[\n]+)\]\[[^\]\[\n]*\]", r"\1", t)
    t = re.sub(r"(?<![\w*])\*\*(?=[^\s*])([^*\n]*)\*\*|(?<![\w.])__(?=[^\s_])([^_\n]*)__(?![\w(])|~~(?=\S)([^~\n]+)~~", lambda m: m[1] or m[2] or m[3], t)
    t = re.sub(r"^> ?", "", t, flags=re.M)
    return re.sub(r"^( {0,3})[*+-] +", r"\1- ", t, flags=re.M)


# -- site style tree -------------------------------------------------------------------------
class _Tree(HTMLParser):
    """Leaf blocks of a text with their path of tags and styles."""

    VOID = frozenset(("br", "hr", "img", "input", "meta", "link", "col", "source"))

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.stack: list[str] = []
        self.blocks: list[tuple[str, str]] = []  # (path, source)
        self.children: dict[str, list[str]] = {}

    def _add(self, source: str) -> None:
        path = "/".join(self.stack)
        if self.blocks and self.blocks[-1][0] == path:
            self.blocks[-1] = (path, self.blocks[-1][1] + source)
        else:
            self.blocks.append((path, source))

    def handle_starttag(self, tag, attrs):
        node = tag + "".join(f".{v}" for k, v in attrs if k == "class" and v)
        self.children.setdefault("/".join(self.stack), []).append(node)
        if tag in self.VOID or tag not in BLOCKS:
            self._add(self.get_starttag_text())
        else:
            self.stack.append(node)
            self._add(self.get_starttag_text())

    def handle_endtag(self, tag):
        self._add(f"</{tag}>")
        if tag in BLOCKS:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].split(".")[0] == tag:
                    del self.stack[i:]
                    break

    def handle_data(self, data):
        self._add(data)

    def handle_entityref(self, name):
        self._add(f"&{name};")

    def handle_charref(self, name):
        self._add(f"&#{name};")

    def handle_comment(self, data):
        self._add(f"<!--{data}-->")


BLOCKS = frozenset("div section article aside nav header footer main ul ol li table tr p h1 h2 h3 h4 h5 h6 blockquote form figure".split())


def blocks_of(text: str) -> tuple[list[tuple[str, str]], dict[str, list[str]]]:
    """((path, source) of each leaf block in order, children by path)."""
    tree = _Tree()
    tree.feed(text)
    if tree.rawdata:
        tree._add(tree.rawdata)
    return tree.blocks, tree.children


def style_tree(texts: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of every node of each host's merged tree. ``texts`` has the
    columns id, host, text. At a leaf of m pages, importance is 1 less the mean entropy, to base m, of
    the spread of its contents over pages; at an inner node the entropy of how its children are laid
    out. A branch has the importance of the most important node in it. A node of one page has importance 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [])
            for i, host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                blocks, children = blocks_of(text)
                rows = {("c", p, xxhash.xxh64_intdigest(" ".join(s.split())) >> 1) for p, s in blocks if s.strip() and not re.fullmatch(r"\s*(?:<[^>]*>\s*)+", s)}
                rows |= {("s", p, xxhash.xxh64_intdigest(" ".join(x)) >> 1) for p, x in children.items()}
                for kind, path, value in rows:
                    for c, v in zip(cols, (host, path, kind, value)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], ["host", "path", "kind", "value"])

    values = texts.select("id", "host", "text").mapInArrow(run, "host string, path string, kind string, value bigint").groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n"))
    # Content that is on n pages is spread evenly over them: its entropy to base m is log n / log m.
    m = F.sum("n")
    spread = F.sum(F.log("n") * F.col("n")) / m
    by_kind = values.groupBy("host", "path", "kind").agg(m.alias("m"), F.max("n").alias("most"), spread.alias("spread"), F.count("*").alias("ways"))
    # Of ways of layout with shares n / m the entropy is log m - spread.
    importance = F.when(F.col("m") <= 1, 1.0).when(F.col("kind") == "c", 1 - F.col("spread") / F.log("m")).otherwise((F.log("m") - F.col("spread")) / F.log("m"))
    # A branch is as important as the most important node in it: each node also counts for those above it.
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    nodes = by_kind.select("host", "m", importance.alias("importance"), F.explode(above).alias("path"))
    return nodes.groupBy("host", "path").agg(F.max("m").alias("pages"), F.max("importance").alias("importance"))


def without_furniture(texts: DataFrame, least: float = 0.3, pages: int = 5, salts: int = 16) -> DataFrame:
    """``texts`` (id, host, text) without the branches whose importance is under ``least`` on hosts
    where at least ``pages`` pages have them. Texts without block elements pass by."""
    has = F.col("text").rlike(r"(?i)<(?:" + "|".join(sorted(BLOCKS)) + r")\b")
    tagged = texts.where(has)
    low = style_tree(tagged).where((F.col("importance") < least) & (F.col("pages") >= pages) & (F.col("path") != "")).groupBy("host").agg(F.collect_set("path").alias("low"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                low = set(low or ())
                if low:
                    drop = lambda p: any("/".join(p.split("/")[:k]) in low for k in range(1, p.count("/") + 2))
                    text = "".join(s for p, s in blocks_of(text)[0] if not drop(p))
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["id", "host", "text"])

    # One row a host; the paths of low importance on a host are few, as each is on many pages. A host may have a third of
    # all pages, so its pages are spread over salts, and its row meets each.
    salted = tagged.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    parts = low.select(F.col("host").alias("low_host"), "low", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("low_salt"))
    met = salted.join(parts, F.col("host").eqNullSafe(F.col("low_host")) & (F.col("salt") == F.col("low_salt")), "left")
    pruned = met.select("id", "host", "text", "low").mapInArrow(run, "id bigint, host string, text string")
    return pruned.unionByName(texts.where(~has))


def _mapped(texts: DataFrame, f, out: str, kind: pa.DataType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f(t.as_py()) for t in batch.column(1)], kind)], ["id", "value"])

    return runtime.spread(texts.select("id", "text")).mapInArrow(run, f"id bigint, value {out}")


def kinds(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, markup): one row for each kind of markup left in each text."""
    texts = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").rlike(r"[<&\[\]#*_`~|>=$\\{}'-]"))
    return _mapped(texts, kinds_of, "array<string>", pa.list_(pa.string())).select(F.col("id").alias(id_col), F.explode("value").alias("markup")).distinct()


def clean(table: DataFrame, id_col: str, text_col: str, host: Column) -> DataFrame:
    """(id_col, text): every text, without furniture branches and without markup."""
    texts = table.select(F.col(id_col).cast("bigint").alias("id"), host.alias("host"), F.col(text_col).alias("text"))
    full = texts.where(F.col("text").isNotNull() & (F.col("text") != ""))
    rest = texts.where(F.col("text").isNull() | (F.col("text") == "")).select("id", "text")
    return _mapped(without_furniture(full), clean_text, "string", pa.string()).select("id", F.col("value").alias("text")).unionByName(rest).withColumnRenamed("id", id_col)
