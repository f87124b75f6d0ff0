import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import garbled, markup, page_content, page_lines, personal


# -- pages -------------------------------------------------------------------------------------
def test_pages_held_out():
    decoder, drawn, right, total = page_content.Decoder(page_content.trained()), page_lines.Pages(991), 0, 0
    for _ in range(150):
        page = drawn.page()
        for (_, label), k in zip(page, decoder.labels([x for x, _ in page])):
            right += (label in page_lines.BOILER) == bool(page_content.FURNITURE[k])
            total += 1
    assert right / total > 0.98


PAGE = "Open menu\nHome | About | Contact\n\nWe use cookies to measure visits. Accept all or manage preferences.\nAccept all\nThe steady keel\nThe keel was laid in spring and it has carried the workshop ever since without a pause.\nBrass fitting\nOak plank\nWhat the footer links cost us is a question that nobody had asked before that winter began.\nRelated reading\nThe slow tide\nNotes on ropes\nRSS feed\n© 2024 Harbour Works. All rights reserved."


def test_page_table(spark):
    rows = [(1, PAGE, "work/a.html"), (1, PAGE, "work/a.html"), (2, PAGE, "docs/a.md"), (3, None, "work/b.html"), (4, "", "work/"), (5, "\n\n", "x/"), (None, PAGE, "y/"), (6, PAGE, None), (7, "Only a sentence that is long enough to be an article of its own here.\n" * 300, "z.HTML")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "hit_id long, text string, file_path string, line_no string")
    got = page_content.furniture_lines(df, "hit_id", "text", "file_path").collect()
    assert sorted(r.line_no for r in got if r.hit_id == 1) == [1, 2, 4, 5, 11, 12, 13, 14, 15] and {r.hit_id for r in got} == {1}
    bodies = {r.hit_id: r.body for r in page_content.main_bodies(df, "hit_id", "text", "file_path").collect()}
    assert bodies[1].startswith("The steady keel\nThe keel") and "Oak plank" in bodies[1] and "RSS" not in bodies[1] and bodies[5] == ""
    assert page_content.furniture_lines(df.limit(0), "hit_id", "text", "file_path").count() == 0


LONG_CONSENT = "We use cookies and similar technologies to store small files on your device and to measure visits, and our partners may use them too, with your consent, which you can withdraw at any time under cookie settings or in the privacy policy, where you can also manage preferences, accept all or reject all optional cookies before you continue browsing on this site."
LINK_FARM = " | ".join("Home;About;Contact;Blog;Archive;Search;Login;Sign up;Projects;Writing;Talks;Uses;Gallery;Shop;Pricing;Status;Roadmap;Changelog;Docs;Team;Community;Support;Services;Press;Careers;FAQ;Help;Products;Company;Register".split(";"))


def test_long_furniture():
    """Furniture of more than 40 words is no paragraph, a paragraph of that length is."""
    assert min(len(x.split()) for x in (LONG_CONSENT, LINK_FARM)) > 40
    decoder = page_content.Decoder(page_content.trained())
    lines = PAGE.replace("We use cookies to measure visits. Accept all or manage preferences.", LONG_CONSENT).replace("Home | About | Contact", LINK_FARM).split("\n")
    long = "The keel was laid in spring and it has carried the workshop ever since " + "and the boats that came after it were drawn on the same floor " * 4 + "without a pause"
    lines = [x if not x.startswith("The keel was") else long + "." for x in lines if x]
    said = dict(zip(lines, (bool(page_content.FURNITURE[k]) for k in decoder.labels(lines))))
    assert said[LONG_CONSENT] and said[LINK_FARM] and not said[long + "."]


# -- markup ------------------------------------------------------------------------------------
CASES = {
    "html": ["<p>one</p>", "a &amp; b", "&lt;div&gt;x&lt;/div&gt;", "end <div class=\"pan", "x <br/> y", "<!-- c -->", 'lass="n">rest'],
    "markdown": ["# Head\n\ntext", "a **b** c", "[x](y.md)", "```sh\nls\n```", "t\n\n| a | b |\n|---|---|\n| 1 | 2 |", "~~gone~~", "see [x][1].[^2]\n[1]: a.md", "Title\n=====\n\nx", "use `code` here"],
    "wiki": ["[[Page|label]]", "'''bold''' x", "== Head ==\nx", "{{stub|a=1}}", "{| class=\"w\"\n|-\n| a || 1\n|}"],
    "latex": ["\\section{One}", "\\textbf{b", "Here $s_i = 1 - d_i$ holds", "$$\nx\n$$", "by 5\\% for a", "we call it ``x'' now", "\\begin{table}\n\\item a"],
}
PLAIN = ["R&D at x & friends used C# in build 4", "Map<String, List<Integer>> stays", "while a < b and c > d", "costs $17 to $95 per month", "The pattern \\d+\\s\\w matches", "C:\\new\\table\\x", "ports 420 -- two dashes", "{ok: true, took: 3}", "snake_case and __init__(self)", "2**3 and 4**5", "if x<4:\n    y = z['a']['b']", "", None]


def test_kinds():
    for kind, texts in CASES.items():
        for t in texts:
            assert markup.kinds_of(t) == [kind], (kind, t, markup.kinds_of(t))
    for t in PLAIN:
        assert markup.kinds_of(t) == [], t


def test_clean_text():
    assert markup.clean_text("<h2>A</h2><p>b &amp; <em>c</em></p><ul><li>d</li></ul>") == "## A\n\nb & c\n\n- d"
    assert markup.clean_text("## A\n\n**b** [c](d) `e`\n\n```sh\nx *y*\n```") == "## A\n\nb c e\n\n```\nx *y*\n```"
    assert markup.clean_text("== A ==\n'''b''' [[c|d]] {{x|y=1}}") == "## A\nb d"
    assert markup.clean_text("\\section{A}\n\\emph{b} $x_1 + y$ 5\\% \\begin{itemize}\n\\item c\n\\end{itemize}").replace("\n\n", "\n") == "## A\nb $x_1 + y$ 5%\n- c"
    assert markup.clean_text("&lt;p&gt;a&lt;/p&gt;") == "a" and markup.clean_text(None) is None and markup.clean_text("") == ""
    assert markup.clean_text("<pre><code>a = b(1) # *x*</code></pre>") == "```\na = b(1) # *x*\n```"


def test_long_inline_formula():
    """A formula between single dollars stays whole, however long it is."""
    formula = "$" + " + ".join(f"\\frac{{a_{k}}}{{b_{k}}}" for k in range(30)) + "$"
    plain = "$" + " + ".join(f"x_{k}" for k in range(60)) + "$"
    assert len(formula) > 202 and len(plain) > 202
    assert markup.clean_text(f"\\emph{{Here}} {formula} holds") == f"Here {formula} holds"
    assert markup.kinds_of(f"Here {plain} holds") == ["latex"]


def test_markup_table_and_style_tree(spark):
    page = "<div class=\"nav\"><p>Home and about</p></div><div class=\"main\"><p>{} body</p></div>"
    rows = [(i, page.format(f"text number {i}"), "h") for i in range(8)] + [(20, None, "h"), (21, "", None), (22, "plain", "h"), (None, "<p>x</p>", "h"), (23, "<p>x</p>", None), (23, "<p>x</p>", None), (24, "<p>" + "long " * 20_000, "g")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "hit_id long, text string, host string, markup string")
    got = {(r.hit_id, r.markup) for r in markup.kinds(df, "hit_id", "text").collect()}
    assert got == {(i, "html") for i in [*range(8), 23, 24]}
    clean = {r.hit_id: r.text for r in markup.clean(df.where("hit_id <> 23 or hit_id is null"), "hit_id", "text", df["host"]).collect()}
    assert clean[3] == "text number 3 body" and clean[22] == "plain" and clean[20] is None and clean[21] == ""
    assert markup.kinds(df.limit(0), "hit_id", "text").count() == 0


# -- garbled -----------------------------------------------------------------------------------
def garbled_rows():
    r = random.Random(3)
    words = "über größe läuft café’s déjà façade naïve später tür “one” – the keel and rope of long harbour mit der die straße côté même élan être".split()
    clean = [(i, "\n".join(" ".join(r.choice(words) for _ in range(25)) for _ in range(4))) for i in range(300)]
    bad, want = [], {}
    for k, (wrong, true) in enumerate([("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp437", "utf-8"), ("mac_roman", "utf-8"), ("mac_roman", "cp1252")] * 4):
        text = clean[k][1].replace("“", "").replace("”", "")
        bad.append((1000 + k, text.encode(true).decode(wrong)))
        want[1000 + k] = text
    twice = clean[50][1].replace("“", "").replace("”", "")
    bad.append((2000, twice.encode().decode("cp1252").encode().decode("cp1252")))
    want[2000] = twice
    quotes = [(3000 + i, f"When é turns into Ã© the bytes were read with the wrong table, as k{i} shows.") for i in range(12)]
    return clean, bad, want, quotes


def test_garbled(spark):
    clean, bad, want, quotes = garbled_rows()
    rows = clean + bad + quotes + [(4000, "lost caf� x"), (4001, None), (4002, ""), (4003, "ascii only " * 30_000), (None, "caf� y")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, id string")
    got = {r.doc_id: r for r in garbled.repair(df, "doc_id", "text").collect()}
    assert set(got) == set(want) | {4000, None}
    assert sum(got[i].restored == t for i, t in want.items()) >= len(want) - 1
    assert not got[4000].whole and got[1000].whole
    assert garbled.repair(df.limit(0), "doc_id", "text").count() == 0


def test_garbled_copies(spark):
    """Copies of a text damaged by a one-to-one chain don't train the model as sound, be they whole or of all lines but one."""
    clean, _, _, _ = garbled_rows()
    text = clean[7][1].replace("“", "").replace("”", "").replace("–", "-")
    bad = text.encode("cp1252").decode("mac_roman")
    rows = clean + [(5000 + i, bad) for i in range(150)] + [(6000 + i, f"{bad}\nline {i}") for i in range(150)]
    got = {r.doc_id: r.restored for r in garbled.repair(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {5000 + i: text for i in range(150)} | {6000 + i: f"{text}\nline {i}" for i in range(150)}


def test_garbled_beside_a_rare_symbol(spark):
    """All chains are tried on all windows, not only those that mend the least likely one."""
    clean, _, _, _ = garbled_rows()
    lines = [clean[k][1].split("\n")[0].replace("“", "").replace("”", "") for k in range(6)]
    rows = clean + [(5000 + k, "seen by \u16a0\u16c7\u16bb here: " + x.encode().decode("cp1252")) for k, x in enumerate(lines) if "à" not in x]
    got = {r.doc_id: r.restored for r in garbled.repair(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got and got == {i: "seen by \u16a0\u16c7\u16bb here: " + lines[i - 5000] for i, _ in rows if i >= 5000}


def brute_best(ws, model, least):
    """All chains over all windows, none left out."""
    best, chain = least, None
    for k, c in enumerate(garbled.CHAINS):
        if k >= len(garbled.UTF8_CHAINS):
            if any(ch > "\x7f" and ch not in garbled.MAPS[k - len(garbled.UTF8_CHAINS)] for w in ws for ch in w):
                continue
        total = sum(model.gain(w, k) for w in ws)
        if total > best + 1e-9 or chain is None and total >= best:
            best, chain = total, c
    return chain and best


def test_garbled_bounds_lose_no_chain():
    clean, bad, _, quotes = garbled_rows()
    texts = [t for _, t in clean + bad + quotes]
    counts = {}
    for t in texts[:300]:
        for line in t.split("\n"):
            for w in garbled.windows(line):
                for i in range(3, len(w)):
                    for k in range(4):
                        counts[w[i - k : i + 1]] = counts.get(w[i - k : i + 1], 0) + 1
    model, checked = garbled.Model(counts), 0
    for t in texts[290:]:
        for line in t.split("\n"):
            for least in (0.5, 6.0):
                if ws := garbled.windows(line):
                    got, want = garbled.best_chain(ws, model, least), brute_best(ws, garbled.Model(counts), least)
                    assert (got and round(got[0], 6)) == (want and round(want, 6)), line
                    checked += got is not None
    assert checked > 50


def test_garbled_references(spark):
    """Damage written in references alone, beside references that are no damage, and no line to validate on."""
    clean, _, _, _ = garbled_rows()
    rows = clean + [(7000, "the caf&Atilde;&copy;&acirc;&euro;&trade;s keel"), (7001, "&lt;&lt;a&gt;&gt; &laquo;&nbsp;keel&nbsp;&raquo; &amp;&amp;"), (7002, "caf&#195;&#169;"), (None, None), (7003, "")]
    got = {r.doc_id: r.restored for r in garbled.repair(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {7000: "the café’s keel", 7002: "café"}
    one = spark.createDataFrame([(1, "cafÃ©"), (2, "lost \ufffd")], "doc_id long, text string")
    assert [r.doc_id for r in garbled.repair(one, "doc_id", "text").collect() if not r.whole] == [2]


# -- personal ----------------------------------------------------------------------------------
def personal_rows(n=900):
    r = random.Random(8)
    given = ["Hanna", "Pieter", "Rose", "Mark", "Olga", "Karim", "Lucia", "Bruno"]
    heads, tails = ["Brandt", "Kolmer", "Velder", "Stenner", "Harrow", "Quiller"], ["haven", "lockett", "strade", "morrin"]
    nouns = ["rudder", "canvas", "ledger", "switch", "beacon", "gasket"]
    rows, want = [], {}
    for i in range(n):
        name, k = f"{r.choice(given)} {r.choice(heads)}{r.choice(tails)}", r.choice(nouns)
        mail, phone, ident, street = f"{r.choice(heads).lower()}{i}@{k}.example", f"+44 1632 960 {100 + i % 900}", f"ZZ{1000000 + i}", f"{i % 90 + 1} {r.choice(['Mill', 'Netmaker'])} Lane, Grindlow"
        text, kinds = r.choice([
            (f"meeting with {name} re {k}", {"person"}), (f"notes {name} left on {k}", {"person"}), (f"reply to {mail} re {k}", {"email"}), (f"call me at {phone} about {k}", {"phone"}), (f"found passport {ident} in the {k} log", {"id_number"}),
            (f"parcel for {street} {k}", {"address"}), (f"{name} <{mail}> asked about {k}", {"person", "email"}), (f"what is {k}", set()), (f"Rose Chart legend {k} {i}", set()), (f"Mark Complete button in {k} {i}", set()), (f"range 100-{10 + i % 89}-2000 in {k}", set()),
            (f"{k}@{i % 60}.4.11 peer dependency", set()), (f"port {i % 90} refused by {k}", set()), (f"12 factor road map for {k}", set()), (f"Main Street theme {k} v{i}", set()), (f"10.0.{i % 250}.17 unreachable from {k}", set()), (f"build 2026{i:04}103000 of {k} failed", set()),
        ])
        rows.append((i, text))
        want[i] = kinds
    return given, rows, want


def test_personal(spark):
    given, rows, want = personal_rows()
    extra = [rows[0], (5000, None), (5001, ""), (None, rows[0][1]), (5002, "nothing here " * 9_000)]
    df = spark.createDataFrame([(*x, "clash") for x in rows + extra], "id long, query string, kinds string")
    names = spark.createDataFrame([(g, 1) for g in given[:-1]] + [(None, 2)], "given_name string, n_seen long")
    got: dict = {}
    for r in personal.found(df, "id", "query", names).collect():
        got.setdefault(r.id, set()).add(r.kind)
    wrong = [i for i in want if got.get(i, set()) != want[i]]
    assert len(wrong) / len(want) < 0.03, [(rows[i][1], got.get(i), want[i]) for i in wrong[:8]]
    assert not {5000, 5001, 5002} & set(got)
    masked = {r.id: r.text for r in personal.mask(df, "id", "query", names).collect()}
    assert masked[5000] is None and masked[5001] == ""
    some = next(i for i in want if want[i] == {"person", "email"} and got[i] == want[i])
    assert re.fullmatch(r"\[PERSON\] <\[EMAIL\]> asked about \w+", masked[some])
    assert personal.found(df.limit(0), "id", "query", names).count() == 0


def test_personal_name_in_a_hot_text(spark):
    """A text logged often doesn't make the surname in it an ordinary word, and an ordinary word is only a vote against."""
    given, rows, _ = personal_rows()
    rows = rows + [(7000 + i, "meeting with Dr. Harrowstrade re rudder") for i in range(60)] + [(8000, "notes Dr. Harrowstrade left on canvas"), (8001, "meeting with J. Harrowstrade re ledger")]
    names = spark.createDataFrame([(g, 1) for g in given], "given_name string, n_seen long")
    got = {r.id for r in personal.found(spark.createDataFrame(rows, "id long, query string"), "id", "query", names).where("kind = 'person'").collect()}
    assert {*range(7000, 7060), 8000, 8001} <= got
    lexicon = personal.Lexicon(frozenset(), frozenset(["harrowstrade"]), {"^har": 1.0, "trade$": 1.0})
    assert [f for *_, f, _ in personal.names_in("Dr. Harrowstrade left, J. Harrowstrade stays", [], lexicon)] == ["title", "initial"]


def test_no_labeler_changes_sides():
    """Whatever the mixture, a decoy that only a place speaks for stays one, and what formats speak for stays found."""
    for scale in (1, 10, 1_000):
        for decoys in (0.1, 1, 30):
            counts = {(1, 1, 1, 0): 834 * scale, (0, 1, 1, 0): 364 * scale, (0, 1, 0, -1): int(258 * decoys * scale), (1, 1, 0, 0): 86 * scale, (0, 1, 0, 0): 38 * scale}
            got = personal.reliabilities(counts, personal.LABELERS["phone"])
            assert got[0, 1, 0, -1] < 0.4 and got[1, 1, 1, 0] > 0.9 and got[1, 1, 0, 0] > 0.8, (scale, decoys, got)


def test_personal_in_a_scaled_log(spark):
    """Ten times the log, with the same share of decoys, finds the same and no decoy."""
    given, rows, want = personal_rows(6_000)
    names = spark.createDataFrame([(g, 1) for g in given], "given_name string, n_seen long")
    got: dict = {}
    for r in personal.found(spark.createDataFrame(rows, "id long, query string"), "id", "query", names).collect():
        got.setdefault(r.id, set()).add(r.kind)
    decoys = [i for i, k in want.items() if not k]
    assert sum(i in got for i in decoys) / len(decoys) < 0.01
    assert not any("road map" in t for i, t in rows if i in got)
    assert sum(got.get(i, set()) != k for i, k in want.items()) / len(want) < 0.03


def test_personal_counts_every_pair(spark):
    """Each pair of words for which nothing speaks is counted, in every text, however the texts lie over tasks."""
    lexicon = personal.Lexicon(frozenset(), frozenset(), {})
    words = [f"w{chr(97 + k)}{chr(97 + j)}x" for k in range(20) for j in range(5)]
    pairs = personal.names_in(" ".join(words), [], lexicon, True)
    assert [(first, last) for _, _, first, last, _, _ in pairs] == list(zip(words, words[1:]))
    texts = [" ".join(words[k : k + 4]) for k in range(0, 96, 2)]
    for n in (1, 5):
        counted = personal.ordinary_patterns(spark.createDataFrame([(t,) for t in texts], "text string").repartition(n), lexicon).collect()
        assert sum(r.n for r in counted) == 3 * len(texts)


def test_personal_is_trained_on_every_candidate(spark):
    """The gradient is that of all candidates, to the last digit the same however they lie over tasks."""
    given, rows, _ = personal_rows(400)
    s, names = personal.Settings(), spark.createDataFrame([(g, 1) for g in given], "given_name string, n_seen long")
    distinct = spark.createDataFrame(sorted({(t,) for _, t in rows if t}), "text string").select("text", *personal.numbers(F.col("text"))).cache()
    lexicon, _, _ = personal.lexicon_of(distinct.select("text"), names, s)
    voted = personal.with_contexts(personal.proposals(distinct, lexicon, s), lexicon, s).cache()
    each = [c for r in voted.collect() for c in r.met]
    keys = sorted({(c.kind, tuple(map(int, c.votes.split(",")))) for c in each})
    patterns = {k: (at + 1) / (len(keys) + 1) for at, k in enumerate(keys)}
    weights = np.random.default_rng(1).normal(size=s.buckets + 1)
    want = np.zeros(s.buckets + 1)
    for c in each:
        d = patterns[c.kind, tuple(map(int, c.votes.split(",")))] - 1 / (1 + np.exp(-np.clip(weights[c.feats].sum() + weights[-1], -30, 30)))
        np.add.at(want, c.feats, d)
        want[-1] += d
    one, five = (personal.gradient(voted.repartition(n), patterns, weights) for n in (1, 5))
    assert len(each) > 300 and np.abs(one - want).max() < 1e-4 and (one == five).all()


def test_garbled_margin_is_validated_on_all_lines(spark):
    """The margin is that of all clean lines, of which there are more than 800, however they lie over tasks."""
    texts = [t for _, t in garbled_rows()[0]]
    lines = [line for t in texts for line in t.split("\n") if garbled.windows(line)]
    counts = Counter(w[i - k : i + 1] for line in lines for w in garbled.windows(line) for i in range(3, len(w)) for k in range(4))
    of = garbled.Validation(garbled.Model(counts))
    rows = [(at * 7919, garbled.NEXT_WINDOW.join(garbled.windows(line))) for at, line in enumerate(lines)]
    sound, repaired = zip(*(of.line(h, x.split(garbled.NEXT_WINDOW)) for h, x in rows))
    sound, repaired = sorted(sound), sorted(x for x in repaired if x is not None)
    high, low = sound[int(len(sound) * 0.995) - 1], repaired[int(len(repaired) * 0.02)]
    known, df = spark.sparkContext.broadcast(dict(counts)), spark.createDataFrame(rows, "hashes long, lines string")
    assert len(rows) > 800 and len(repaired) > 100
    for n in (1, 6):
        assert abs(garbled.validated_margin(known, df.repartition(n), garbled.Settings()) - min(high + (low - high) / 3, low)) < 1e-9
    assert garbled.validated_margin(known, df.limit(0), garbled.Settings()) == garbled.Settings().margin


def test_garbled_nth_is_exact(spark, monkeypatch):
    r = random.Random(2)
    values = [r.choice([0.0, 0.0, r.gauss(0, 1), r.gauss(0, 1e-7), 1e6]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3).cache()
    monkeypatch.setattr(garbled, "FEW", 4)
    for n in (0, 7, 1400, 1500, 2100, 2999):
        assert garbled.nth(df, n, 3000, min(values), max(values)) == sorted(values)[n]


def counted(lines):
    return Counter(w[i - k : i + 1] for line in lines for w in garbled.windows(line) for i in range(3, len(w)) for k in range(4))


def test_garbled_blocks_of_lines_as_brute_force():
    """Also where only what a window is judged by changes, or where a changed window was certain."""
    r = random.Random(5)
    words = "всего года если только т. при этом over so rope für über keel 10 ли го ль".split()
    clean = [" ".join(r.choice(words) for _ in range(r.randrange(1, 30))) for _ in range(300)]
    bad = [x.encode("koi8_r", "ignore").decode("cp1251") for x in clean[:40]] + [x.encode("cp1251", "ignore").decode("cp1252") for x in clean[40:80]]
    model, rarer = garbled.Model(counted(clean + bad[::4])), garbled.Model(counted(clean[100:]))
    lines = [ws for x in clean + bad if (ws := garbled.windows(x))]
    for m in (model, rarer):
        for least in (garbled.NONE, 6.0):
            got = garbled.best_chains(lines, m, least)
            for ws, one in zip(lines, got):
                want = brute_best(ws, m, least)
                assert (one and round(one[0], 6)) == (want and round(want, 6)), ws
                assert one == garbled.best_chain(ws, m, least)
            assert sum(x is not None for x in got) > 30


def test_garbled_lines_are_damaged_by_tables(monkeypatch):
    """What repair gains is as by damaging and undoing each window; but a one-to-one chain reads a table, and a UTF-8 chain
    damages each run once, however many windows it stands in."""
    lines = [line for _, t in garbled_rows()[0] for line in t.split("\n")] + ["где été „quoi“ – нет", "R&D&eacute;é café", "�\x81 lost", "日本語 über"]
    of, calls, damage = garbled.Validation(garbled.Model(counted(lines[::2]))), [], garbled.damage
    want = []
    for n, line in enumerate(lines):
        chain, total, changes = garbled.KNOWN[n % len(garbled.KNOWN)], 0.0, False
        for w in garbled.windows(line):
            bad, head = damage(w[3:], chain), damage(w[:3], chain)
            if not bad or not head or (garbled.apply_chain(bad, chain) or bad) != w[3:]:
                total = None
                break
            changes |= bad != w[3:]
            total += of.model.window(w) - of.model.changed(head, bad)
        want.append(total if changes else None)
    monkeypatch.setattr(garbled, "damage", lambda *x: calls.append(x) or damage(*x))
    got = [x for _, x in of.lines(list(range(len(lines))), [garbled.windows(x) for x in lines])]
    assert [x and round(x, 6) for x in got] == [x and round(x, 6) for x in want]
    assert sum(x is not None for x in got) > 200
    assert all(chain[1] == "utf-8" for _, chain in calls) and len(calls) < 400, len(calls)
