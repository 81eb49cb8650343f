import random
import re
import time

import numpy as np
import pytest

from tests.llm.helpers import docs_of
from veilstream.llm import decontaminate, html_text, license_scan, secret_scan, toxicity
from veilstream.llm.decontaminate import Matcher, drop_contaminated, find, similarity, words
from veilstream.llm.html_text import extract, main_text
from veilstream.llm.trigram_index import query


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain  text &amp; more", "plain text & more"),
        ("<p>a<p>b<br>c", "a\n\nb c"),
        ("<div><script>x", ""),
        ("<nav><a>Home</a></nav><article><h1>T</h1><p>One&nbsp;two</p><p>S.</p></article><footer>&copy; x</footer>", "T\n\nOne two\n\nS."),
        (
            '<body><div class="menu"><a>x</a></div><div id="content"><h2>T</h2><p>A long paragraph of text that goes on and on.</p><p>S.</p></div>'
            '<div class="comments"><p>a long comment of a reader stands here</p></div><aside>side</aside></body>',
            "T\n\nA long paragraph of text that goes on and on.\n\nS.",
        ),
        ("<article><header><h1>Title</h1><span>by me</span></header><ul><li>one<li>two</ul><form>f</form></article>", "Title\n\none\n\ntwo"),
        (
            '<div class="with-sidebar"><article><p>kept</p></article><div class="sidebar">side</div></div><div class="comments"><article id="comment-1"><p>reader</p></article></div>',
            "kept",
        ),
        ("<article><p>kept</p><div class='ad'>Buy</div><p>too", "kept\n\ntoo"),
    ],
)
def test_main_text(html, text):
    assert extract(html) == text


LONG = "A long paragraph of text that goes on and on, and then a little further."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<body><div class='page has-sidebar'><div id='content'><p>{LONG}</p><p>{LONG}</p></div><div class='sidebar'>side</div></div></body>", f"{LONG}\n\n{LONG}"),
        (f"<body><div class='page-header-wrap'><div id='content'><p>{LONG}</p><p>{LONG}</p></div><div class='sidebar'>side</div></div></body>", f"{LONG}\n\n{LONG}"),
        (f"<article><p>{LONG}</p><h2 id='legal-history'>History</h2><p>{LONG}</p></article>", f"{LONG}\n\nHistory\n\n{LONG}"),
        (f"<article><p>{LONG}</p><section class='related-work'><p>{LONG}</p></section><div class='share-links'><a>x</a><a>y</a></div></article>", f"{LONG}\n\n{LONG}"),
    ],
)
def test_names_do_not_drop_content(html, text):
    assert extract(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<body><form><nav><a>x</a></nav><article><p>{LONG}</p><p>S.</p></article></form></body>", f"{LONG}\n\nS."),
        (f"<body><form><div id='main'><p>{LONG}</p><p>{LONG}</p></div></form><footer>f</footer></body>", f"{LONG}\n\n{LONG}"),
        (f"<div class='related-work'><p>{LONG}</p><p>S.</p></div>", f"{LONG}\n\nS."),
        (f"<article><p>{LONG}</p><p class='notice-board'>S.</p><p class='ad'>{LONG}</p></article>", f"{LONG}\n\nS."),
        (f"<article><header><h1>T</h1><p>A standfirst.</p><span>by me</span></header><p>{LONG}</p></article>", f"T\n\nA standfirst.\n\n{LONG}"),
        (f"<nav><a>x</a></nav><main><article><h2>A</h2><p>{LONG}</p></article><article><h2>B</h2><p>{LONG}</p></article></main>", f"A\n\n{LONG}\n\nB\n\n{LONG}"),
        (f"<article><p>Ab.</p></article><div class='ad'>{LONG}</div><div class='comments'><article><p>{LONG}</p><p>{LONG}</p></article></div>", "Ab."),
        (f"<div class='site-sidebar'><article><p>{LONG}</p></article></div><aside>x</aside>", LONG),
        (f"<article></article><div class='ad'>{LONG}</div><footer>{LONG}</footer>", ""),
        ("<nav><ul><li><a>x</a><li><a>y</a></ul></nav><footer>&copy; z</footer>", ""),
    ],
)
def test_tags_and_names_only_weigh(html, text):
    assert extract(html) == text


def test_pages_of_known_articles():
    """Articles among random other parts of a page, with and without an element that says article."""
    rng = random.Random(8)
    say = lambda n: " ".join("".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 8))) for _ in range(n))
    parts = [
        lambda: "<nav><ul>" + "".join(f"<li><a href='/{i}'>{say(1)}</a></li>" for i in range(rng.randint(2, 9))) + "</ul></nav>",
        lambda: f"<div class='{rng.choice(['ad', 'ad-box', 'sponsored', 'cookie-notice', 'newsletter', 'sidebar', 'site-footer'])}'>{say(rng.randint(3, 30))}</div>",
        lambda: f"<footer>&copy; {say(6)}</footer>",
        lambda: f"<aside><p>{say(20)}</p></aside>",
        lambda: f"<form><label>{say(2)}</label><input><button>{say(1)}</button></form>",
        lambda: f"<section id='comments'><article><p>{say(25)}</p></article><p>{say(10)}</p></section>",
        lambda: f"<script>var a='<p>{say(3)}</p>'</script><style>p {{}}</style><!-- {say(4)} -->",
    ]
    for n in range(300):
        blocks = [say(rng.choice([1, 4])), *(say(rng.choice([1, 8, 40, 90])) for _ in range(rng.randint(1, 9))), say(60)]
        tag = rng.choice(["article", "main", "div"])
        body = "".join((f"<h1>{b}</h1>" if not i else f"<p>{b}</p>") + (rng.choice(parts[1:2])() if rng.random() < 0.2 else "") for i, b in enumerate(blocks))
        chrome = [x() for x in rng.choices(parts, k=rng.randint(0, 6))]
        at = rng.randint(0, len(chrome))
        inner = "".join(chrome[:at]) + f"<{tag}>{body}</{tag}>" + "".join(chrome[at:])
        html = f"<html><head><title>{say(3)}</title></head><body>{rng.choice(['{}', '<div class=page>{}</div>']).format(inner)}</body></html>"
        if tag == "div" and sum(map(len, blocks)) < 3 * sum(len(re.sub("<[^>]*>", "", c)) for c in chrome):
            continue  # nothing says which of the texts is the article
        assert extract(html) == "\n\n".join(blocks), n


def test_the_ratios_decide(monkeypatch):
    pages = [f"<div class='ad'>{LONG}</div><article><p>{LONG}</p><p>{i}</p></article><footer>{LONG}</footer>" for i in range(40)]
    right = [extract(x) for x in pages]
    rng = np.random.default_rng(1)
    monkeypatch.setattr(html_text, "_smoothed", lambda x, sigma: rng.random(len(x)))
    assert sum(extract(x) != y for x, y in zip(pages, right, strict=True)) > 10
    monkeypatch.setattr(html_text, "clusters", lambda ratio, part: np.zeros(len(ratio), bool))
    assert {extract(x) for x in pages} == {""}


_LONG = "This is a rather long paragraph of an article that goes on and on with many words. " * 6
_NAV, _FOOT = "<nav><a href=x>Home</a><a href=y>News</a></nav>", "<footer>Copyright</footer>"


def _articles(*texts: str) -> str:
    return "".join(f"<article>{''.join(f'<p>{p}</p>' for p in t.split('|'))}</article>" for t in texts)


@pytest.mark.parametrize("around", ["{}", "<main>{}</main>", "<div>{}</div>"])
def test_articles_side_by_side(around):
    """An article stays beside one of much longer lines, in either order; four of very different lengths too."""
    short = "A short story.|Another short line."
    for texts in ((f"{_LONG}|{_LONG}|{_LONG}", short), (short, f"{_LONG}|{_LONG}"), tuple(f"{'word ' * n}|{'word ' * n}" for n in (4000, 400, 40, 5))):
        assert extract(f"<html><body>{_NAV}{around.format(_articles(*texts))}{_FOOT}</body></html>") == "\n\n".join(p.strip() for t in texts for p in t.split("|"))


def test_headings_beside_the_article():
    article, text = _articles(f"{_LONG}|{_LONG}"), "\n\n".join([_LONG.strip()] * 2)
    page = lambda head, tail="": f"<html><body>{_NAV}<main>{head}{article}{tail}</main>{_FOOT}</body></html>"
    assert extract(page("<h2>Menu</h2><div><h1>The <i>title</i></h1></div><h2>Below it</h2>")) == f"The title\n\nBelow it\n\n{text}"
    for head in ("<h2>Menu</h2>", "<nav><h1>Menu</h1></nav>", "<h1><a href=x>All news</a></h1>", '<div class="banner"><h1>Offer</h1></div>'):
        assert extract(page(head)) == text
    assert extract(page("<h1>T</h1>", "<h1>Further</h1>")) == f"T\n\n{text}"


def test_teasers_and_comments_beside_an_article_go():
    cards = '<article><h3><a href="x">Another headline to be clicked</a></h3><p>Teaser.</p></article>' * 3
    remarks = '<div class="comments"><article><p>I do not agree with this at all.</p></article></div><aside><article><p>Read us.</p></article></aside>'
    assert extract(f"<html><body>{_NAV}<main>{_articles(_LONG + '|' + _LONG)}<div>{cards}</div>{remarks}</main></body></html>") == "\n\n".join([_LONG.strip()] * 2)


def test_many_articles_take_linear_time():
    def seconds(n):
        page, start = f"<main>{_articles('long text ' * 3000, *(('w ' * (1 + i % 7)) for i in range(n)))}</main>", time.perf_counter()
        extract(page)
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16_000) < 12 * seconds(4_000) + 0.3



@pytest.mark.parametrize("piece", ["<div>x", "<div class='ad'>x", "<p>x", "<b><i>x", "</div>", "<li>x", "<ul><li>x", "<td>x<tr>", "<article>x", "<a>x", "<h1>x", "&amp;x ", "<header><h2>x", "<", "<!--", "<!", "</", "<?x", "<a href='", '<a b="c'])
def test_long_pages_take_time_in_proportion(piece):
    def took(n):
        began = time.perf_counter()
        extract(piece * n)
        return time.perf_counter() - began

    took(100)
    assert took(16_000) < 8 * took(4_000) + 0.5


def test_main_text_frame(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é</p>"), (2, None, None)], "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    assert sorted(tuple(r) for r in main_text(pages).collect()) == [(1, "u", "é", 1), (2, None, "", 0)]
    assert main_text(pages.limit(0)).count() == 0


def brute_license(doc, text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(license_scan.WORD, low)
    starts, labels = [], set()
    for label, phrase in license_scan.PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return doc, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_scan(spark):
    rows = [
        (1, "Licensed under CC BY-NC 4.0. x under the MIT License cc by nc"),
        (1, "Licensed under CC BY-NC 4.0. x under the MIT License cc by nc"),
        (2, None),
        (3, ""),
        (None, "Apache License, Version 2.0 é"),
        (5, "Permission is hereby granted, free of charge, to any new person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
        (6, "Under The MIT LİCENSE ÀÉ"),
        (7, "word " * 30_000 + "under the mit license"),
    ]
    got = license_scan.scan(docs_of(spark, rows)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((brute_license(*r) for r in rows), key=str)
    by = {r["doc_id"]: r for r in got}
    assert by[5]["labels"] == "mit" and by[5]["base_labels"] == "" and 0.75 <= by[5]["score"] < 1
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert license_scan.scan(docs_of(spark, [])).count() == 0


def brute_leaks(text, items):
    ws, out = words(text), {}
    for i, x in items:
        w = words(x)
        k = min(5, len(w))
        for s in range(0, max(0, len(ws) - len(w)) + 1) if w else ():
            window = ws[s : s + len(w)]  # a text shorter than the item is one window
            y = similarity(window, w, k)
            if y >= 0.8 and y > out.get(i, (0,))[0]:
                out[i] = (y, s, len(window))
    return [(i, *v) for i, v in sorted(out.items())]


def test_radius_loses_no_similar_window():
    """Windows changed at random to a similarity of 0.8 and more: their fingerprints stay within the radius."""
    rng, seen = random.Random(8), 0
    for _ in range(600):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 60, 120, 300]))]
        x = list(w)
        for _ in range(rng.randint(1, max(1, len(w) // 45))):
            x[rng.randrange(len(x))] = "changed"
        if similarity(x, w, 5) >= 0.8:
            a, b = (decontaminate._window_fingerprints(decontaminate._shingle_hashes(Matcher._hashes(y), 5), np.array([0]), len(y) - 4)[0] for y in (w, x))
            assert int(a ^ b).bit_count() <= decontaminate.RADIUS
            seen += 1
    assert seen > 200


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    words_ = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words_, k=rng.choice([1, 3, 8, 20, 40])))) for i in range(12)]
    matcher = Matcher([*items, (90, None), (91, "...")])
    rows = []
    for n in range(200):
        ws = rng.choices(words_, k=rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            x = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = rng.choice(words_)
            at = rng.randint(0, len(ws))
            ws[at:at] = x
        rows.append((n, " ".join(ws)))
    rows += [(1000 + n, " ".join(x.split()[n % 3 : len(x.split()) - n % 2])) for n, (_, x) in enumerate(items * 3)]  # a little shorter than an item
    assert all(sorted(matcher.hits(t)) == brute_leaks(t, items) for _, t in rows)
    assert matcher.hits(None) == matcher.hits("") == []
    benchmark = spark.createDataFrame([*items, (90, None)], "item_id long, text string")
    docs = docs_of(spark, [*rows, (None, items[4][1]), (999, None)])
    whole = sorted(map(str, find(docs, benchmark).collect()))
    for block, bits in ((1_000_000, 26), (60, 26), (5, 10)):
        found = find(docs, benchmark, block_words=block, map_bits=bits).collect()
        assert sorted(map(str, found)) == whole
        hit = {r["doc_id"] for r in found}
        assert None in hit and 999 not in hit
        kept = drop_contaminated(docs, benchmark, block_words=block, map_bits=bits)
        assert kept.columns == docs.columns
        assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - hit | {999}
    assert find(docs, benchmark.limit(0)).count() == 0


def test_trigram_queries_lose_nothing():
    rng = random.Random(2)
    pieces = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", '"', "'", " ", "=", ":", "abc123", "AKIA", "ABCDEFGH12345678", "deadbeef01234567deadbeef", "ghp_" + "a" * 36, "é", "\n", "xoxb-123456789012", "ſecret", "Bearer ", "x" * 25, "http://u:pass@h.com", "-----BEGIN RSA PRIVATE KEY-----"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(1500)]
    got = secret_scan.Scanner().scan(texts)
    assert got == [sorted((a, n, b) for n, r in enumerate(secret_scan.RULES) for a, b in r.spans(t)) for t in texts]
    assert query(secret_scan.BASE[2].pattern) is None and query(secret_scan.BASE[1].pattern) == ("all", (b"aki", b"kia"))


def test_secret_digest(spark):
    rows = [(1, 'é token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"'), (2, None), (3, "password=abc"), (4, "AKIA" + "A" * 16), (None, "")]
    got = {r["doc_id"]: r for r in secret_scan.digest(docs_of(spark, rows)).collect()}
    assert (got[1]["n_assign"], got[1]["n_hex"], got[1]["spans"]) == (1, 1, "assign:2:51,hex:11:51")
    assert got[3]["n_assign"] == 0 and got[4]["spans"] == "access:0:20" and got[2]["spans"] == ""
    assert secret_scan.digest(docs_of(spark, [])).count() == 0


def test_url_logins_of_any_length():
    texts = [f"see https://{'u' * n}:{'p' * m}@example.org now" for n, m in ((1, 3), (80, 80), (5, 93), (200, 4), (300, 5000))]
    kinds = [r.kind for r in secret_scan.RULES]
    for t, own in zip(texts, secret_scan.Scanner().scan(texts), strict=True):
        assert [t[a:b] for a, n, b in own if kinds[n] == "url_login"] == [t[4:-4]]


def test_clause_grammar():
    lexicon = toxicity._Lexicon({})
    marks = lambda t: toxicity.matches(t, lexicon)
    assert marks("a lovely day") == marks(None) == []
    assert marks("idiot") == [(toxicity.INSULT, 0)]
    assert marks("You are an idiot") == [(toxicity.INSULT, toxicity.AT_TARGET)]
    assert marks("you are not an idiot") == [(toxicity.INSULT, toxicity.AT_TARGET | toxicity.NEGATED)]
    assert marks("she said idiot") == [(toxicity.INSULT, toxicity.AT_TARGET | toxicity.REPORTED)]
    assert marks("not here. idiot") == [(toxicity.INSULT, 0)]
    assert marks("to kill time") == [] and marks("you I will kill") == [(toxicity.THREAT, toxicity.AT_TARGET)]


def test_toxicity_learns_stems_and_holds_out(spark):
    rng = random.Random(1)
    filler = ["".join(rng.choice("aeiost") for _ in range(4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        ws = rng.choices(filler, k=40)
        toxic = rng.random() < 0.3
        if toxic:
            ws[rng.randrange(40)] = "grumbf" + rng.choice(["el", "ack", "ion"])
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, int(toxic)))
    docs = docs_of(spark, [*rows, (None, "grumbfel"), (5000, None), (5001, "")])
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, known)
    assert any(s.startswith("grum") for s in model.stems)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(900) if got[i]["held_out"]]
    assert 200 < len(held) < 400
    assert sum(got[i]["predicted"] == labels[i][2] for i in held) / len(held) > 0.97
    assert got[5000]["score"] == got[5001]["score"] < 0.7 and not got[None]["held_out"] and got[None]["predicted"] == 1
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    none = toxicity.train(docs, known.limit(0))
    assert none.stems == {} and toxicity.score(docs.limit(0), none).count() == 0


def test_long_texts_share_shingles_all_along():
    rng = random.Random(9)
    item = " ".join(f"w{rng.randint(0, 50)}" for _ in range(12))
    found = Matcher([(1, item)]).hits((item + " ") * 40_000)
    assert found == [(1, 1.0, 0, 12)]
    w = item.split()
    late = " ".join(w[:5]) + " x " + "y z " * 50_000 + item
    assert Matcher([(1, item)]).hits(late)[0][:2] == (1, 1.0)
