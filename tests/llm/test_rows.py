"""Operators that judge or rewrite one row at a time: quality, language, URLs, HTML."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from freightloom.llm import html, langid, quality, urlfilter

ODD = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "x"), (4, "x"), (5, "word " * 20000), (6, "a b c\n" * 30), (7, "日本語 \x0bté ß")]


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def measured(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times, covered, seen, same = collections.Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered.update(range(i, i + 8))
    for line in text.split("\n"):
        if words(line):
            same += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), same, len(covered)


def test_measures_equal_brute_force(spark):
    rnd = random.Random(5)
    some = ["".join(rnd.choice(["a ", "b ", "c ", "\n", "#", " ", "dé "]) for _ in range(rnd.randint(0, 120))) for _ in range(80)]
    rows = ODD + list(enumerate(some, 100))
    got = quality.measures(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", "measures.*").collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in quality.MEASURES[:5]) == measured(r["text"]), r["doc_id"]


def test_quality_verdicts(spark):
    prose = " ".join(f"word{i} of plain prose" for i in range(40))
    rows = [(i, prose + f" end{i}", "own") for i in range(60)] + [(100 + i, " ".join(f"w{j}### $$$" for j in range(60 + i)), "own") for i in range(6)] + [(200, None, "own"), (201, "too short", "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = {r["doc_id"]: r for r in quality.judged(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["kept"] and got[i]["posterior"] > 0.5 for i in range(60))
    assert not any(got[i]["kept"] for i in range(100, 106)) and not got[100]["base_failed"]
    assert got[200]["base_failed"] and got[201]["base_failed"]
    assert quality.judged(docs.limit(0)).collect() == []


def slow_fitted(rows, rounds):
    """Expectation-maximisation row by row; the start counts as ten rows."""
    prior, right = 0.8, [[0.7, 0.98] for _ in rows[0]]
    for _ in range(rounds):
        posts = []
        for votes in rows:
            like = [1 - prior, prior]
            for k, v in enumerate(votes):
                if v is not None:
                    like = [x * (right[k][y] if v else 1 - right[k][y]) for y, x in enumerate(like)]
            posts.append([x / sum(like) for x in like])
        prior = (8 + sum(p[1] for p in posts)) / (10 + len(rows))
        for k in range(len(right)):
            for y in (0, 1):
                cast = sum(p[y] for p, votes in zip(posts, rows) if votes[k] is not None)
                right[k][y] = (10 * [0.7, 0.98][y] + sum(p[y] for p, votes in zip(posts, rows) if votes[k] == 1)) / (10 + cast)
    return prior, right


def test_estimate_equals_brute_force():
    rnd = random.Random(4)
    rows = [tuple(None if rnd.random() < 0.2 else int(rnd.random() < (0.95 if good else 0.2)) for _ in range(4)) for good in [1] * 150 + [0] * 50]
    for rounds in (1, 5, 40):
        prior, habits = quality.fitted(sorted(collections.Counter(rows).items(), key=str), rounds)
        want_prior, want = slow_fitted(rows, rounds)
        assert abs(prior - want_prior) < 1e-4 and all(abs(h[y] - w[y]) < 1e-4 for h, w in zip(habits, want) for y in (0, 1))
    assert 0.68 < prior < 0.82
    assert quality.weight(habits[0], None) == 0 and quality.weight(habits[0], 1) > 0 > quality.weight(habits[0], 0)
    assert quality.fitted([]) == (quality.START_PRIOR, [])


def test_language_id(spark):
    rnd = random.Random(2)
    stems = {"aa": ["the", "ing", "of", "and"], "bb": ["der", "sch", "ung", "ei"], "cc": ["ção", "de", "que", "os"]}
    make = lambda s, n: " ".join("".join(rnd.choice(s) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    rows = [(i, make(stems[lang], rnd.randint(5, 80)), lang) for i in range(300) for lang in [rnd.choice(list(stems))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fitted(docs, ~langid.held_out(), sample=150)
    odd = spark.createDataFrame([(i, t, "zz") for i, t in ODD] + [(9, "12 34 !", None)], docs.schema)
    got = langid.identified(docs.unionByName(odd), model).collect()
    assert len(got) == len(rows) + len(odd.collect())
    held = [r for r in got if r["lang"] in stems]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)
    bare = [r for r in got if r["text"] is None or not langid.has_letter(r["text"])]
    assert bare and all(r["lang_pred"] == "und" and r["rejected"] for r in bare)
    assert langid.fitted(docs.limit(0), ~langid.held_out()) is None
    assert {r["lang_pred"] for r in langid.identified(docs, None).collect()} == {"und"}
    counts = collections.Counter(lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2)
    few = langid.fitted(docs, ~langid.held_out(), most_languages=2)
    assert few.langs == sorted(sorted(counts, key=lambda x: (-counts[x], x))[:2])


def test_every_length_rejects():
    rnd = random.Random(6)
    stems = {"aa": ["the", "ing", "of", "and"], "bb": ["der", "sch", "ung", "ei"]}
    make = lambda s, n: " ".join("".join(rnd.choice(s) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    model = langid.learned([(lang, langid.grams(make(stems[lang], rnd.randint(20, 80)))) for _ in range(100) for lang in stems])
    letters = [chr(c) for c in range(0x3B1, 0x3C9)]
    for n in (5, 150, 5000, 20000):
        own, score, rejected = model.predict(langid.grams(make(stems["aa"], n))[None])
        assert model.langs[own[0]] == "aa" and not rejected[0], (n, score)
        assert model.predict(langid.grams(make(letters, n))[None])[2][0], n
    assert (model.floors > 0).all()


def test_grams_of_chunks_equal_grams_of_the_whole(monkeypatch):
    text = "Über die Brücke 12 gehen wir, dann weiter. " * 30
    whole = langid.grams(text)
    monkeypatch.setattr(langid, "_CHUNK", 64)
    assert (langid.grams(text) == whole).all()


@pytest.mark.parametrize("shard_keys,rows_each", [(1 << 17, 1 << 20), (100, 50)])
def test_cascade_is_exact(spark, shard_keys, rows_each):
    keys = [f"host{i}.example" for i in range(3000)]
    listed = [k for i, k in enumerate(keys) if i % 3 == 0]
    universe = spark.createDataFrame([(k,) for k in keys] + [(None,), (keys[0],)], "key string")
    levels = urlfilter.cascade(universe, spark.createDataFrame([(k,) for k in [*listed, "elsewhere", None]], "key string"), shard_keys)
    assert len(levels.n_bits) > 1 and levels.n_shards == (10 if shard_keys == 100 else 1)
    rows = spark.createDataFrame([(k, "own", 1, 2) for k in [*keys, None] + keys[:1] * 400], "host string, _n string, _shard int, _bitmap int")
    got = urlfilter.depths(rows, "host", levels, "depth", rows_each=rows_each).collect()
    assert len(got) == 3401 and got[0].asDict().keys() == {"host", "_n", "_shard", "_bitmap", "depth"}
    assert {r["host"] for r in got if r["depth"] % 2} == set(listed) and all(r["depth"] == 0 for r in got if r["host"] is None)
    flags = urlfilter.flagged(rows, "host", levels)
    assert flags.where("listed").count() == 1400 and flags.where("_n <> 'own' or _shard <> 1").isEmpty()
    none = urlfilter.cascade(universe.limit(0), universe)
    assert none.n_bits == [] and urlfilter.flagged(rows, "host", none).where("listed").isEmpty()
    assert urlfilter.flagged(rows.limit(0), "host", levels).collect() == []


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.ORG/en/12?q", "https://b.org", "x", None, "ftp://c.com/fr/1#a", "http://example.org/es/", "http://notexample.org/es/", "http://u.com?x=/fr/", ""]
    host, path = urlfilter.url_parts(F.col("url"))
    rule, verdict = urlfilter.ruled(F.col("h"), F.col("p"), urlfilter.RULES)
    got = spark.createDataFrame([(u,) for u in urls], "url string").select("url", host.alias("h"), path.alias("p")).select("*", rule.alias("r"), verdict.alias("v")).collect()
    assert [tuple(r[1:]) for r in got] == [
        ("a.example.org", "/en/12", "example.org/en/1", "block"), ("b.org", "", None, None), ("", "", None, None), ("", "", None, None),
        ("c.com", "/fr/1", "com/fr/", "allow"), ("example.org", "/es/", "example.org/es/", "block"), ("notexample.org", "/es/", "org/", "allow"),
        ("u.com", "", None, None), ("", "", None, None),
    ]


LONG = "A sentence of the article that is long enough to count as its text, with nothing special in it."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu a</a></li><li><a href="/b">Menu b</a></li></ul></nav>
<!-- ad --><div class="ad">Buy now</div><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p><b>First   part.<br><p>{LONG}</p><p>{LONG} Caf&eacute;</p>
<form><input name=q><button>Go</button></form><ul><li>One<li>Two</ul>
<section id="comments"><p>Reader says {LONG}</p></section></article>
<aside><p>Side</p></aside><footer>&copy; Footer</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == f"Title & more\nFirst part.\n{LONG}\n{LONG} Café\nOne\nTwo"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "plain text", "<div>" * 5000 + "deep", "</p></p>", "<script>x", "<a href='x", "<!-- open"])
def test_broken_pages(page):
    assert isinstance(html.main_text(page), str)


def test_text_without_an_article():
    page = f"<body><div class='menu'><a href=x>Home</a> <a href=y>About</a></div><div><div id=story><p>{LONG}</p><p>{LONG}</p></div></div></body>"
    assert html.main_text(page) == f"{LONG}\n{LONG}"


def test_text_outside_of_the_densest_node():
    half = "".join(f"<p>{LONG} {k}</p>" for k in range(10))
    page = f"<body><nav><a href=x>Home</a></nav><h1>T</h1><div>{half}</div><div>{half.replace('A sentence', 'The rest')}</div></body>"
    got = html.main_text(page).split("\n")
    assert got == ["T", *[f"{LONG} {k}" for k in range(10)], *[f"{LONG.replace('A sentence', 'The rest')} {k}" for k in range(10)]]


@pytest.mark.parametrize(
    "page,text",
    [
        (f'<article><div class="entry-header"><h1>My title</h1></div><p>{LONG}</p></article>', f"My title\n{LONG}"),
        (f'<article><header class="entry-header"><h1>My title</h1></header><p>{LONG}</p></article>', f"My title\n{LONG}"),
        (f"<p data-x=don't>First</p><p>{LONG}</p><p>It's last</p>", f"First\n{LONG}\nIt's last"),
        (f"<article><p>{LONG}<math><mi>x</mi></math></p><noscript>Plain</noscript><p>Short.</p></article>", f"{LONG}x\nPlain\nShort."),
        (f"<body><article><p>{LONG}</p></article><div class=ad>Buy</div><article><p>Second, short.</p></article></body>", f"{LONG}\nSecond, short."),
        (f'<body><form id="page"><div class="content has-sidebar"><p>{LONG}</p></div><div class="sidebar"><p>{LONG}</p></div></form></body>', LONG),
        (f'<article><p>{LONG}</p><div class="share-buttons">Share</div><div class="reader-comments"><p>{LONG}</p></div></article>', LONG),
        (f'<section id=comments><article class="comment"><p>{LONG}</p></article></section><main><p>{LONG} 1</p></main>', f"{LONG} 1"),
        (f"<div role=navigation>Menu</div><div class='widget-area'><p>x</p></div><div><p>{LONG}</p></div>", LONG),
    ],
)
def test_pages(page, text):
    assert html.main_text(page) == text


def test_main_node_has_the_largest_sum():
    rnd = random.Random(9)

    def tree(depth):
        return "".join(rnd.choice(["word " * rnd.randint(1, 30), f"<a href=x>{'link ' * rnd.randint(1, 5)}</a>", f"<div>{tree(depth - 1)}</div>" if depth else "", f"<p>{'text ' * rnd.randint(1, 40)}</p>"]) for _ in range(rnd.randint(1, 5)))

    def count(node):
        """Characters, tags, link characters and link tags, recursively."""
        c = t = lc = lt = 0
        for x in node.children:
            if isinstance(x, str):
                c += len(x.strip())
            else:
                got = count(x)
                c, t, lc, lt = c + got[0], t + got[1] + 1, lc + got[2], lt + got[3] + (x.tag == "a")
        return (c, t, c, t) if node.tag == "a" else (c, t, lc, lt)

    def nodes(node):
        yield node
        for x in node.children:
            if not isinstance(x, str):
                yield from nodes(x)

    for _ in range(40):
        root = html.parse(f"<body>{tree(3)}</body>")
        body, best, threshold = html.main_node(root)
        own = {id(x): html._density(*count(x), body) for x in nodes(body)}
        sums = {id(x): sum(html._density(len(y.strip()), 1, 0, 0, body) if isinstance(y, str) else own[id(y)] for y in x.children) for x in nodes(body)}
        assert abs(sums[id(best)] - max(sums.values())) < 1e-9
        path, x = [best], best
        while x is not body:
            x = x.parent
            path.append(x)
        assert abs(threshold - min(own[id(x)] for x in path)) < 1e-9


def test_extracted_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "own"), (1, "u", PAGE, "own"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = html.extracted(pages).collect()
    assert [r["text"].count("\n") for r in got] == [5, 5, 0] and got[2]["text"] == ""
    assert html.extracted(pages.limit(0)).collect() == []


TEXT = "This is a sentence of the article with enough words to be its main text, and it goes on for a while. " * 4


@pytest.mark.parametrize(
    "page,want",
    [
        # A state in the name, or a name that ends in a word for a text, isn't chrome.
        (f"<body><article class='post comment-enabled'><p>{TEXT}</p></article></body>", TEXT),
        (f"<body><div class='newsletter-article'><p>{TEXT}</p></div></body>", TEXT),
        # Readers' comments and notices are.
        (f"<body><article><p>{TEXT}</p></article><section class='discussion'><p>{TEXT}</p></section></body>", TEXT),
        (f"<body><article><p>{TEXT}</p></article><div id='responses'><p>{TEXT}</p></div></body>", TEXT),
        (f"<body><div id='onetrust-banner'><p>{TEXT}</p></div><article><p>{TEXT}</p></article></body>", TEXT),
        (f"<body><article><p>{TEXT}</p></article><div class='disclaimer'><p>{TEXT}</p></div></body>", TEXT),
        (f"<body><article><p>{TEXT}</p></article><div class='article-comments'><p>{TEXT}</p></div></body>", TEXT),
        (f"<body><article><p>{TEXT}</p></article><div class='sponsored-post'><p>{TEXT}</p></div></body>", TEXT),
        # A section of that name in the article is its own.
        (f"<body><article><p>{TEXT}</p><section class='discussion'><p>{TEXT}</p></section></article></body>", TEXT.strip() + "\n" + TEXT),
        # References are a part of it; what stands in a line doesn't cut it.
        (f"<body><article><p>{TEXT}</p><ol><li><a href='x'>A work that is cited here</a></li></ol></article></body>", TEXT.strip() + "\nA work that is cited here"),
        (f"<body><article><p>Before <button>Copy</button> after. {TEXT}</p></article></body>", "Before after. " + TEXT),
        (f"<body><article><p>Before<script>x()</script> after. {TEXT}</p></article></body>", "Before after. " + TEXT),
    ],
)
def test_main_text_of_pages_with_telling_names(page, want):
    assert html.main_text(page) == want.strip()
