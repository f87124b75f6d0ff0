"""Labelled site pages for training, and the features of their lines.

A page is a sequence of leaf blocks, one a line, in document order. The labelled pages are drawn from
a grammar of page layouts: which furniture stands where, in what forms, and what an article is
made of. Words of articles are random syllables, so nothing is learnt from them but their shape.
"""

from __future__ import annotations

import html
import random
import re

# The words and phrases of page furniture, by kind.
NAV = """home about contact blog archive archives search login log in sign up sign in register menu work projects project writing talks now uses lab journal gallery shop
pricing status roadmap changelog docs documentation team community support services colophon open source bench notes press careers faq help products company
startseite kontakt anmelden suche texte werkstatt arbeiten archiv über uns accueil recherche connexion écrits atelier réalisations à propos
open menu toggle navigation menu skip to main content skip to content dark mode light mode search this site theme language""".split("\n")
COOKIES = """cookie cookies consent privacy partners small files device kleine dateien témoins de connexion datenschutzerklärung politique de confidentialité
accept all reject all only necessary let me choose save choices manage preferences ok got it decline optional allow agree withdraw alle akzeptieren tout accepter personnaliser einstellungen data notice before you continue browsing on""".split("\n")
SIDE = """related reading popular this week recent posts more from the lab keep reading you may also like next in this series in this series browse by topic
categories tags latest releases other projects on this page most read read next further reading latest posts see also trending ähnliche beiträge mehr aus à lire aussi dans la même série""".split("\n")
SOCIAL = """share print save copy link e-mail email feedback helpful yes no report a problem subscribe subscription unsubscribe inbox newsletter monthly letter spam release notes enter your address
comments replies reply comment box log in to answer min read previous page next page loading more posts advertisement sponsored updates like follow us powered by""".split("\n")
FOOT = """rss feed sitemap imprint terms of use privacy policy accessibility statement rights reserved all systems operational back to top view source on the forge cookie settings follow the feed
built on made by copyright impressum mentions légales tous droits réservés nutzungsbedingungen legal shelf of servers""".split("\n")

KINDS = {"nav": NAV, "cookie": COOKIES, "side": SIDE, "social": SOCIAL, "foot": FOOT}
COMMON = frozenset("a all and as at auf aus be before by de des die du for from had has have hat how i im in into is it its la le les me no not of off on once or our over so than that the their then there they to un und une up us was we were what when which while who why will with you your zu là ihrem mehr like made".split())
WORDS = {kind: frozenset(w for line in lines for w in re.findall(r"[^\W\d_]+", line.lower()) if len(w) > 1) - COMMON for kind, lines in KINDS.items()}
STARTS = {
    "side": ("related", "popular", "recent posts", "more from", "keep reading", "you may also", "next in", "in this series", "browse by", "categories", "tags", "latest", "other projects", "on this page", "most read", "read next", "further reading", "see also", "trending", "ähnliche", "à lire", "dans la même"),
    "cookie": ("accept", "reject", "only necessary", "let me choose", "save choices", "manage preferences", "ok, got it", "decline", "allow all", "got it"),
    "social": ("share", "print this", "send feedback", "was this", "subscribe", "sign up for", "get the", "enter your", "previous page", "loading more", "advertisement", "powered by", "report a problem"),
}

ARTICLE, BOILER = "PTL", "NCHISF"
LABELS = "PTLNCHISF"  # paragraph, title, list item; navigation, cookie notice, side head, side item, social, footer
SEPARATORS = re.compile(r"\s[|·»›>/•]\s| {2,}|\]\([^)]*\)\s*\[")
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)[^>]*>?")
NOTICE = re.compile(r"cookie|privacy|consent|datenschutz|kleine dateien|témoins|confidentialit|store small files|before you continue|decline optional")
LEAD = re.compile(r"^(?:the|our|why|notes on|moving|how|what|a|an|my|on|in)\s", re.I)


def line_features(line: str) -> list[str]:
    """Features of the line alone: its shape, its words, and the tags of its ancestors where
    the text still has them."""
    out = []
    if "&" in line:  # references, also of markup that was escaped as a whole
        line = html.unescape(line)
    tags = {m[2].lower() for m in TAG.finditer(line)} if "<" in line else ()
    if "<!--" in line:
        out.append("tag:comment")
    for t in tags:
        out.append("tag:" + (t if t in ("p", "li", "ul", "ol", "nav", "a", "div", "h1", "h2", "h3", "footer", "aside", "td", "th", "tr", "table", "span", "button") else "other"))
    text = (TAG.sub(" ", line) if tags else line).strip()
    n = len(text.split())
    words = [w for w in re.findall(r"[^\W\d_]+", text.lower()) if w not in COMMON]
    out.append("n:" + ("0" if n == 0 else str(n) if n <= 4 else "5" if n <= 7 else "8" if n <= 12 else "13"))
    last = text[-1:]
    end = "." if last == "." else "?" if last in "?!" else ":" if last == ":" else "…" if last == "…" else "-"
    out.append("end:" + end)
    sentence = end in ".?" and n >= 5
    if sentence:
        out.append("sentence" + (":long" if n >= 12 else ""))
    if len(re.findall(r"[.?!;] ", text)) >= 1:
        out.append("several")
    parts = [p for p in SEPARATORS.split(text) if p and p.strip()]
    if len(parts) > 1:
        short = sum(len(p.split()) <= 3 for p in parts)
        out.append("parts:" + ("2" if len(parts) == 2 else "3" if len(parts) == 3 else "4"))
        if short == len(parts):
            out.append("parts:short")
        elif short == len(parts) - 1 and len(parts[-1].split()) > 2:
            out.append("parts:crumb")
        if re.search(r"\]\([^)]*\)\s*\[", text):
            out.append("parts:links")
    if re.match(r"(?:©|\(c\)|copyright\b|\d{4} )", text, re.I):
        out.append("mark:©")
    hits = {}
    distinct = set(words)
    for kind, known in WORDS.items():
        k = len(words) if distinct <= known else len(distinct & known)
        hits[kind] = k
        if words and k:
            share = k / len(words)
            out.append(f"{kind}:{'all' if share == 1 else 'most' if share >= 0.6 else 'some' if share >= 0.34 else 'few'}")
            if not sentence:
                out.append(f"{kind}:phrase")
    if not any(hits.values()):
        out.append("none" + (":sentence" if sentence else ""))
    low = text.lower()
    for kind, starts in STARTS.items():
        if low.startswith(starts):
            out.append("starts:" + kind)
            if n <= 5:
                out.append("starts:short:" + kind)
    if NOTICE.search(low):
        out.append("notice")
        if sentence:
            out.append("notice:sentence:" + ("strong" if re.search(r"\b(?:we|us|our|this site|your|you|wir|ihre?m?|nous|ce site|sets?)\b", low) else "weak"))
    if re.search(r"\b(?:subscribe|unsubscribe|helpful|feedback|e-?mail|inbox|share|print|reply|replies|min read)\b", low):
        out.append("social:word" + (":short" if n <= 12 else ""))
    if not sentence and 1 <= n <= 8 and len(parts) <= 1:
        first = text[:1]
        shape = "1" if n == 1 else "adj" if n == 2 and not LEAD.match(text) else "lead" if LEAD.match(text) else "and" if " and the " in low else "x"
        out.append("shape:" + shape + ("" if first.isupper() else ":low"))
        if not any(hits.values()):
            out.append("shape:plain")
            out.append("plain:" + shape)
    if re.search(r"\d", text):
        out.append("digit")
    if re.match(r"[-*+•]\s|\d+\.\s|#{1,6}\s|>\s|\||`", text):
        out.append("markup")
    if re.fullmatch(r"[\d\s…<>«»‹›.]*(?:\d+[\s…]*){2,}(?:next|older|weiter|suivant)?", low):
        out.append("paging")
    return out


def is_paragraph(line: str) -> bool:
    text = line.rstrip()
    return text[-1:] in ".?!" and line.count(" ") >= 6


def places(lines: list[str], cues: list[tuple[bool, bool]]) -> list[tuple]:
    """The place of each line that isn't blank: (part of the page, first, last, what follows, what
    precedes, is prose, lines since a side head, is the end of a trail, a trail follows). ``cues``:
    of each line (is a sentence of an article's kind, is a side head)."""
    n = len(lines)
    first = next((i for i, c in enumerate(cues) if c[0]), n)
    last = next((i for i in range(n - 1, -1, -1) if cues[i][0]), -1)
    split = [bool(SEPARATORS.search(lines[i])) if not cues[i][0] and len(lines[i]) < 400 else False for i in range(n)]
    trails = {p.strip() for i in range(first) if split[i] for p in SEPARATORS.split(lines[i])[1:][-1:] if p}
    out, since = [], 99
    for i in range(n):
        prose, side = cues[i]
        since = 0 if side else since + 1
        after = "P" if i + 1 < n and cues[i + 1][0] else "end" if i + 1 == n else "x"
        before = "P" if i and cues[i - 1][0] else "start" if i == 0 else "x"
        part = "before" if i < first else "after" if i > last else "inside"
        out.append((part, i == 0, i == n - 1, after, before, prose, min(since, 7), bool(trails) and lines[i].strip() in trails, i + 1 < n and split[i + 1]))
        if prose:
            since = 99
    return out


def place_features(place: tuple) -> list[str]:
    part, first, last, after, before, prose, since, trail, next_split = place
    out = ["prose" if prose else "not prose", f"at:{part}", f"next:{after}", f"prev:{before}", f"next:{after}:{part}", f"prev:{before}:{part}"]
    if not prose:
        out += [f"since:{since}", f"since:{since}:{after}:{part}"]
    return out + ["first"] * first + ["last"] * last + ["trail"] * trail + ["next:parts"] * next_split


PLAIN = tuple("the of and its by in with over so that on to from before while after one two each small data page files site device keep time open close next policy work read".split())
FOREIGN = (
    tuple("der die das und wenn gerät menü datei seite heute prüft öffnet nähe plan über nacht morgen weg fällt gehäuse größe einstellung suche text archiv ändert".split()),
    tuple("le la les et pourquoi fichier page mémoire accueil série étape recherche tâche déjà sans délai câble modèle règle libère écran site politique".split()),
    tuple("el la los cuando página archivo opción cambió leyó sesión menú sitio así veces error título política contacto búsqueda".split()),
    tuple("если модуль запрос читает список архив снимок сигнал ждёт поиск меню страница файл после сбоя".split()),
)


# -- labelled pages --------------------------------------------------------------------------
class Pages:
    """Draws labelled pages. ``seed`` fixes them all."""

    def __init__(self, seed: int = 7):
        self.r = random.Random(seed)
        self.foreign: tuple[str, ...] = ()
        self.nouns = [self.word(self.r.choice((2, 2, 3))) for _ in range(400)]

    def word(self, n: int) -> str:
        return "".join(self.r.choice("bcdfghklmnprstvz") + self.r.choice("aeiou") for _ in range(n))

    def noun(self) -> str:
        return self.r.choice(self.nouns)

    def title(self) -> str:
        a, b = self.noun(), self.noun()
        return self.r.choice((f"The {a} {b}", f"Our {a} {b}", f"Why the {a} is {b}", f"Notes on {a} {b}s", f"Moving {a} to the {b}", f"{a.capitalize()} and the {b}", f"How {a} became {b}", f"A {a} for the {b}"))

    def item(self, single: bool) -> str:
        return self.noun().capitalize() if single and self.r.random() < 0.5 else self.title()

    def sentence(self) -> str:
        if self.r.random() < 0.02:
            k = self.noun()
            return self.r.choice((
                f"Moving the footer links into the menu cut the page weight by {self.r.randint(9, 99)} kB, although {k} still requests them.", "Names of hosts in the examples are placeholders.",
                f"The cookie jar of {k} is cleared before each test run.", "Everything described here is public and was reviewed before release.", "All figures on this page were taken on the bench, never in production.",
                f"Subscribe and share are two verbs that {k} never had to learn.", f"Home, work and writing are three prefixes of the same tree, and {k} indexes only two.", f"The privacy notice of {k} was the longest page of the archive.",
                "The numbers below are medians of five runs with a cold cache.", f"We accept all feedback about {k}, and answer most of it.",
            ))
        if self.foreign and self.r.random() < 0.9:
            few = self.foreign
            body = " ".join(self.r.choice(few) if self.r.random() < 0.75 else self.noun() for _ in range(self.r.randint(6, 13)))
            return body.capitalize() + "."
        body = " ".join(self.noun() if self.r.random() < 0.6 else self.r.choice(PLAIN) for _ in range(self.r.randint(6, 13)))
        return body.capitalize() + self.r.choice((".", ".", ".", ".", ".", "?", "; " + self.noun() + " does not."))

    def labels(self, k: int) -> list[str]:
        names = ["Home", "About", "Contact", "Blog", "Archive", "Search", "Log in", "Sign up", "Work", "Projects", "Writing", "Talks", "Now", "Uses", "Lab", "Journal", "Gallery", "Shop", "Pricing", "Status", "Roadmap", "Changelog", "Docs", "Team", "Community", "Support", "Services", "Colophon", "Open source", "Bench notes", "Help", "Press", self.noun().capitalize()]
        if self.r.random() < 0.08:
            names = ["Startseite", "Kontakt", "Anmelden", "Suche", "Texte", "Werkstatt", "Arbeiten", "Archiv", "Über uns"]
        elif self.r.random() < 0.08:
            names = ["Accueil", "Recherche", "Connexion", "Écrits", "Atelier", "Réalisations", "À propos", "Contact", "Archives"]
        return self.r.sample(names, min(k, len(names)))

    def side(self, related: bool) -> list[tuple[str, str]]:
        head = self.r.choice(("Related reading", "Keep reading", "More from the lab", "You may also like", "Other projects", "Next in this series", "Read next") if related else ("Recent posts", "Popular this week", "Browse by topic", "Categories", "Tags", "Latest releases", "On this page", "In this series", "Most read"))
        k = self.r.randint(2, 4) if related else self.r.randint(2, 5)
        return [(head, "H")] + [(self.item(not related), "I") for _ in range(k)]

    def social(self) -> tuple[str, str]:
        return (self.r.choice((
            "Share this page: copy link, e-mail, print", "Share · Save · Print", "Print this page", "Was this page helpful? Yes / No", "Send feedback about this article", "Subscribe to updates", "Sign up for release notes in your inbox",
            "Get the monthly letter. No spam, unsubscribe whenever you like.", "Enter your e-mail address", f"{self.r.randint(2, 20)} min read · Share", "Report a problem with this page", f"Powered by a comment box, {self.r.randint(0, 30)} replies, log in to answer",
            f"{self.r.randint(2, 90)} readers online", f"You are reading version {self.r.randint(2, 50)} of this page", "Edit this page", f"Last updated by {self.noun()}", "Loading more posts…", "Previous page | Next page", f"1 2 3 … {self.r.randint(5, 40)} Next", "Advertisement", f"Join {self.r.randint(100, 9000)} readers of the bench letter", "Language: English / Deutsch / Français", "Theme: light, dark, automatic", f"{self.r.randint(1, 60)} comments",
        )), "S")

    def cookies(self) -> list[tuple[str, str]]:
        why = self.r.choice(("to measure visits", "to keep you signed in", "to remember your settings", "for statistics and embedded media", "to improve the pages you read", "so that the forms keep working", "in line with our data notice"))
        more = self.r.choice(("Accept all or manage preferences.", "Decline optional ones below.", "Read the cookie policy.", "You can withdraw consent at any time.", "Choose what to allow.", "By browsing on you agree to this."))
        site = f"{self.noun().capitalize()} {self.noun().capitalize()}"
        text = self.r.choice((f"We use cookies {why}. {more}", f"This site uses cookies {why}. {more}", f"We value your privacy {why}. {more}", f"Your privacy matters here {why}. {more}", f"Cookies help us run this site {why}. {more}", f"{site} sets a handful of cookies {why}. {more}", f"We and our partners store small files on your device {why}. {more}", f"Before you continue to {site} {why}. {more}", "Wir verwenden Cookies, um die Nutzung zu messen. Alle akzeptieren oder Einstellungen öffnen.", "Diese Website speichert kleine Dateien auf Ihrem Gerät. Mehr in der Datenschutzerklärung.", "Ce site dépose des témoins de connexion. Voir la politique de confidentialité.", "Nous utilisons des cookies pour mesurer l’audience. Tout accepter ou personnaliser."))
        buttons = self.r.sample(("Accept all", "Reject all", "Only necessary", "Let me choose", "Save choices", "OK, got it", "Manage preferences"), self.r.randint(0, 3))
        return [(text, "C")] + [(b, "C") for b in buttons]

    def footer(self) -> list[tuple[str, str]]:
        links = self.r.sample(("RSS feed", "Sitemap", "Imprint", "Terms of use", "Privacy policy", "Accessibility statement", "All systems operational", "Back to top", "View source on the forge", "Cookie settings", "Follow the feed", "Report a problem with this page"), self.r.randint(1, 5))
        out = [(" | ".join(links), "F")] if self.r.random() < 0.5 else [(x, "F") for x in links]
        site, year = f"{self.noun().capitalize()} {self.noun().capitalize()}", self.r.randint(2015, 2026)
        mark = self.r.choice((f"© {year} {site}. All rights reserved.", f"(c) {year} {site} · Built on a small shelf of servers", f"Copyright {year} {site}", f"© {year} {site} | Privacy | Terms | Imprint", f"{year} {site} — Made by the water"))
        if self.r.random() < 0.85:
            out.append((mark, "F"))
        if self.r.random() < 0.15:
            self.r.shuffle(out)
        return out

    def tagged(self, line: str, label: str) -> str:
        r = self.r.random()
        if label == "P":
            return f"<p>{line}</p>" if r < 0.6 else f"<div>{line}</div>" if r < 0.8 else f'<p class="lead">{line}</p>'
        return f"<h2>{line}</h2>" if label == "T" else f"  <li>{line}</li>" if label == "L" else line

    def page(self) -> list[tuple[str, str]]:
        r, title = self.r, self.title()
        self.foreign = r.choice(FOREIGN) if r.random() < 0.15 else ()
        if r.random() < 0.18:  # a chunk with nothing but its article
            body = [(title, "T")] if r.random() < 0.7 else []
            body += self.article(0.0)
            return [(self.tagged(x, k), k) for x, k in body] if r.random() < 0.5 else body
        top: list[list[tuple[str, str]]] = []
        if r.random() < 0.35:
            top.append([(r.choice(("Open menu", "Menu", "Toggle navigation", "Skip to main content", "Skip to content", "Dark mode", "Search this site")), "N")])
        if r.random() < 0.75:
            names = self.labels(r.randint(3, 8))
            style = r.random()
            if style < 0.45:
                top.append([(x, "N") for x in names])
            elif style < 0.55:
                top.append([(" ".join(f"[{x}](/{x.lower().replace(' ', '-')}/)" for x in names), "N")])
            else:
                top.append([(r.choice((" | ", " · ", " / ", " » ", "  ", " › ")).join(names), "N")])
        if r.random() < 0.35:
            sep = r.choice((" / ", " » ", " > ", " › ", " · "))
            top.append([(sep.join([*self.labels(r.randint(1, 2)), title]), "N")])
        if r.random() < 0.35:
            top.append(self.cookies())
        if r.random() < 0.14:
            top.append(self.side(False))
        if r.random() < 0.08:
            top.append([self.social()])
        out = [x for block in top for x in block]
        if r.random() < 0.92:
            out.append((title, "T"))
        if r.random() < 0.08:
            out.append(self.social())
        out += self.article(1.0)
        end: list[list[tuple[str, str]]] = []
        if r.random() < 0.25:
            end.append(self.cookies())
        if r.random() < 0.6:
            end.append(self.side(True))
        if r.random() < 0.3:
            end.append([self.social()])
        if r.random() < 0.1:
            end.append(self.side(False))
        r.shuffle(end)
        out += [x for block in end for x in block]
        tail = [self.footer()] if r.random() < 0.8 else []
        if r.random() < 0.2:
            tail.insert(r.choice((0, len(tail))), [(r.choice((" | ", " · ", " / ", "  ", " » ")).join(self.labels(r.randint(3, 8))), "N")])
        out += [x for block in tail for x in block]
        if r.random() < 0.12:  # cut off
            k = r.randint(1, max(1, len(out) // 2))
            out = out[:-k] if r.random() < 0.6 else out[k:]
        if not out:
            out = [(self.sentence(), "P")]
        if r.random() < 0.05:
            out = [(x.upper(), k) for x, k in out]
        for _ in range(r.choice((0, 0, 1, 2))):  # sentences that lost their end
            at = r.randrange(len(out))
            if out[at][1] == "P":
                out[at] = (" ".join(out[at][0].split()[: r.randint(6, 60)]).rstrip("."), "P")
        if r.random() < 0.06:  # a block lost its line
            k = r.randrange(len(out))
            text, label = out[k]
            out[k] = (text[: max(3, int(len(text) * 0.7))], label)
        return out

    def block(self) -> list[tuple[str, str]]:
        """Code, a table or a list with its tags, all of the article."""
        r, a, b = self.r, self.noun(), self.noun()
        return r.choice((
            [(f"<pre><code>{a} = {b}({r.randint(1, 99)})</code></pre>", "L")], [(f"{a} --{b} {r.randint(1, 99)}", "L")], [(f"<!-- {a} -->", "L")], [("```", "L"), (f"{a}_{b} = {r.randint(1, 99)}", "L"), ("```", "L")],
            [(f"{{{{{a}|{b}=3|state={b}}}}}", "L")], [(f"[1]: docs/{a}.md", "L"), (f"[^2]: {self.sentence()}", "L")], [(f"![{self.title()}](assets/{a}.png)", "L")], [(f"| {a} | {b} |", "L"), ("|---|---|", "L"), (f"| {self.noun()} | {r.randint(1, 99)} |", "L")],
            [(f"\\section{{{self.title()}}}", "L")], [(f"== {self.title()} ==", "L")], [(f"## {self.title()}", "T")], [(f"> {self.sentence()}", "L")], [(f"[[Category:{a}]]", "L")], [(html.escape(f"<p>{self.sentence()} {self.sentence()}</p>"), "P")], [(html.escape(f"<h2>{self.title()}</h2>"), "T")],
            [("<ul>", "L"), *((f"  <li>{self.sentence()}</li>", "L") for _ in range(r.randint(2, 4))), ("</ul>", "L")],
            [("<table>", "L"), (f"<tr><th>{a}</th><th>{b}</th></tr>", "L"), *((f"<tr><td>{self.noun()}</td><td>{r.randint(1, 999)}</td></tr>", "L") for _ in range(r.randint(2, 4))), ("</table>", "L")],
        ))

    def article(self, furniture: float) -> list[tuple[str, str]]:
        r, out = self.r, []
        for _ in range(r.randint(2, 9)):
            out.append((" ".join(self.sentence() for _ in range(r.choice((1, 2, 2, 3, 4, 5)))), "P"))
            x = r.random()
            if x < 0.10:
                out.append((self.title() + r.choice(("", "", "", "", f" © {self.noun()}", f" <code>{self.noun()}</code>")), "T"))
            elif x < 0.22:
                out += [(f"{self.noun().capitalize()} {self.noun()}", "L") for _ in range(r.randint(2, 3))]
            elif x < 0.26:
                out += [(r.choice(("- ", "1. ", "")) + self.sentence(), "L") for _ in range(r.randint(2, 4))]
            elif x < 0.29:
                out += self.block()
            elif x < 0.29 + 0.07 * furniture:
                out += self.side(False)
                if r.random() < 0.07:
                    out.append((self.title(), "T"))
                elif r.random() < 0.06:
                    out += [(f"{self.noun().capitalize()} {self.noun()}", "L") for _ in range(r.randint(2, 3))]
            elif x < 0.29 + 0.15 * furniture:
                out.append(self.social())
            elif x < 0.29 + 0.18 * furniture:
                out += self.cookies()
        if out[-1][1] == "T":
            out.append((self.sentence(), "P"))
        return out
