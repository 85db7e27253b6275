"""Pages, URLs, vectors, chats and the graph helper."""

import math
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.llm import chat, embedding_dedup, graph, html_text, url_filter
from tempora.llm.common import Scratch, load
from tempora.llm.graph import components
from tempora.llm.queries import op3_chat_format, op10_url_filter


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 30)] + [(5, 5), (None, 3), (40, 41), (41, 40)]
    with Scratch() as scratch:
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
        assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 30)} | {40: 40, 41: 40}
        assert components(spark.createDataFrame([], "a long, b long"), scratch, "none").count() == 0


@pytest.mark.parametrize("hub", [1, 3, 1000])
def test_components_with_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB", hub)
    rng = np.random.default_rng(hub)
    edges = [(0, int(i)) for i in range(1, 300)] + [(int(a) + 1000, int(b) + 1000) for a, b in rng.integers(0, 400, (260, 2))]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    with Scratch() as scratch:
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><p>Site name and a tag line that is quite long, long enough to count.</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies and say so in a long long long long long long long sentence.</p></div>
{body}
<aside><p>Side text that is long long long long long long long long long long long long long.</p></aside>
<section id="comments"><p>A reader's long long long long long long long long long long long long comment.</p></section>
<form><p>Sign up for our letter <input name="x"></p></form><footer>&copy; site</footer></body></html>"""
P1, P2 = "First paragraph of the story, with some words &amp; a <a href='x'>link</a> in\n it, and more of them to follow here.", "Second paragraph, which is also of a decent length for a story of its kind."
WANT = "First paragraph of the story, with some words & a link in it, and more of them to follow here. Short. Second paragraph, which is also of a decent length for a story of its kind."


@pytest.mark.parametrize("body", [
    f"<article><h1>Head</h1><p>{P1}<p>Short.</p><div class='ad'>Buy!</div><p>{P2}</p></article>",
    f"<main><div><h1>Head</h1><p>{P1}</p><br>Short.<br>{P2}</div></main>",
    f"<div class='content'><h1>Head</h1><p>{P1}</p><div class='promo'>Buy!</div><p>Short.</p><p>{P2}</p></div>",
    f"<article><header><h1>Head</h1></header><p>{P1}</p><p>Short.<p class='share'>Share this<p>{P2}",
])
def test_main_text(body):
    assert html_text.main_text(PAGE.format(body=body)) == f"Head {WANT}"


@pytest.mark.parametrize("page,want", [("", ""), ("plain text", "plain text"), ("<p>a", "a"), ("a < b &lt; c", "a < b < c"), ("<script>x", ""), ("<!-- a", ""), ("<p>&#233;&eacute;&#x4e2d;</p>", "éé中"), ("<a href='>'>x</a>", "x"), ("<", "<"), ("<p", "<p")])
def test_odd_markup(page, want):
    assert html_text.main_text(page) == want


def test_pages_frame(spark):
    rows = [(1, None), (2, ""), (3, PAGE.format(body=f"<article><p>{P1}</p></article>") + " " * 10), (3, "<p>" + "word " * 200_000)]
    out = html_text.extracted(spark.createDataFrame([(i, h, "clash") for i, h in rows], "page_id long, html string, n_chars string"))
    got = out.collect()
    assert got[0].text == got[1].text == "" and got[2].text.startswith("First") and len(got[3].text) == 999_999


STORY = "A long story in plain text that goes on and on for many words. " * 3


@pytest.mark.parametrize("body,want", [
    (f"<div class='content has-sidebar'><p>{STORY}</p></div><div class='sidebar'>Links and more of them.</div>", STORY),
    (f"<main><div class='search-results-wrapper'><p>{STORY}</p></div></main>", STORY),
    (f"<div class='post-header'><h1>The headline</h1></div><p>{STORY}</p>", "The headline " + STORY),
    (f"<article><p>a</p></article><div><p>{STORY}</p></div>", "a " + STORY),
    (f"<article><p>{STORY}</p></article><div><p>Some other words, fewer than the story has.</p></div>", STORY),
    (f"<p>{STORY}</p><script>var x = '</q>'; <p>{STORY}</p>", STORY + STORY),
    (f"<p>{STORY}</p><iframe src='x'><p>{STORY}</p>", STORY + STORY),
    (f"<p>{STORY}</p><aside>Beside it.</aside><p>Thanks for reading.</p>", STORY + "Thanks for reading."),
    (f"<p>{STORY}</p><aside>Beside it.</aside><p>Short.</p><aside>Beside it.</aside><p>{STORY}</p>", STORY + "Short. " + STORY),
    (f"<p>{STORY}</p><br><br><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li><li><a href=4>Four</a></li></ul>", STORY),
    (f"<form id=aspnet><p>{STORY}</p></form><form><p>Search</p></form>", STORY),
])
def test_windows_decide(body, want):
    assert html_text.main_text(f"<html><body><nav><a href=1>Home</a></nav>{body}<footer>Foot of it.</footer></body></html>") == want.strip()


def regions_by_definition(lengths, window):
    """Lines whose window of following lines, or one that they are in, has text, as maximal runs."""
    n, covered = len(lengths), set()
    for i in range(n):
        if sum(lengths[i : i + window]):
            covered |= {i}
    runs, i = [], 0
    while i < n:
        if i in covered:
            j = i
            while j in covered:
                j += 1
            stop = n if j >= n else min(n, j + window - 1)
            text = [k for k in range(i, stop) if lengths[k]]
            runs.append((text[0], text[-1] + 1, max(sum(lengths[k : k + window]) for k in range(i, j))))
            i = j
        else:
            i += 1
    return runs


def test_regions_equal_their_definition():
    rng = np.random.default_rng(3)
    for _ in range(300):
        lengths = [int(x) if x > 30 else 0 for x in rng.integers(0, 90, rng.integers(1, 25))]
        lines = [html_text.Line("x" * n + "." if n else "", n, False, ()) for n in lengths]
        runs = regions_by_definition(lengths, html_text.WINDOW)
        surged = [r for r in runs if r[2] >= html_text.SURGE] or [r for r in runs if r[2] == max(x[2] for x in runs)]
        got = html_text.regions_of(lines)
        if not runs:
            assert got == [(0, len(lines))]
            continue
        assert {r[:2] for r in surged} <= set(got) <= {r[:2] for r in runs}
        first, last = runs.index(surged[0]), runs.index(surged[-1])
        assert all(runs[k][:2] in got for k in range(max(0, first - 1), min(len(runs), last + 2)))
        assert all(runs[k][:2] not in got for k in (*range(first - 1), *range(last + 2, len(runs))))


def test_urls(spark):
    rows = [
        "https://A.Example.ORG/es/1?x#y", "http://example.org/en/12", "http://example.org/en/2", "http://x.com/fr/1", "http://com/de/", "http://xcom/de/1", "http://a.com?u=/de/", "http://a.org",
        "no scheme/de/", None, "http://one://two/de/#f", "http://b.net/p", "http://b.net/p", "",
    ]
    frame = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(rows)], "page_id long, url string, tokens string")
    none = url_filter.mine(spark.createDataFrame([], "url string, bad boolean"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(frame, none).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("example.org", "/en/2", "org/", "allow")
    assert got[3] == ("x.com", "/fr/1", "com/fr/", "allow") and got[4] == ("com", "/de/", "com/de/", "block")
    assert got[5] == ("xcom", "/de/1", None, "allow") and got[6] == ("a.com", "", None, "allow") and got[7] == ("a.org", "", None, "allow")
    assert got[8] == got[9] == got[13] == ("", "", None, "allow") and got[10] == ("one:", "//two/de/", None, "allow") and got[11] == got[12]


def test_ties_and_joined_rules(spark):
    rules = (("b.org", "/xx", "block"), ("bb.org", "/x", "allow"), ("org", "/a/b", "allow"), ("org", "/a", "block"), ("", "/", "allow"))
    rows = ["http://b.org/xx", "http://bb.org/x", "http://a.b.org/xx/1", "http://c.org/a/b", "http://c.org/a/c", "http://c.org/", "no/scheme", None, "http:///a"]
    frame = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(rows)], "page_id long, url string, rule string, __host string")
    none = url_filter.mine(spark.createDataFrame([], "url string, bad boolean"))
    one, two = ({r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(frame, none, rules=rules, inline=n).collect()} for n in (64, 0))
    assert one == two and one[2] == ("a.b.org", "/xx/1", "b.org/xx", "block") and one[3][2] == "org/a/b"
    assert url_filter.judged(frame.limit(0), none).count() == 0


def planted_urls():
    rows = [(f"http://{h}.site.net/{p}/{i}", h == "spam" and p == "win") for i in range(40) for h in ("spam", "good") for p in ("win", "news")]
    return rows + [(f"http://other.net/page/{i}?q={i % 7}", i % 6 == 0) for i in range(120)] + [(None, True), ("http://x.net/a", None)]


def test_mined_rules_equal_brute_force(spark):
    from itertools import combinations

    rules = url_filter.mine(spark.createDataFrame(planted_urls(), "url string, bad boolean"))
    got = {tuple(r.tokens): (r.n, r.n_bad) for r in rules.collect()}
    tokens = {r.url: r.t for r in spark.createDataFrame(planted_urls(), "url string, bad boolean").where("url is not null").select("url", url_filter.tokens_of(F.col("url")).alias("t")).collect()}
    rows = [(tokens[u], bad) for u, bad in planted_urls() if u is not None and bad is not None]
    base, counts = sum(b for _, b in rows) / len(rows), {}
    for t, bad in rows:
        for k in range(1, len(t) + 1):
            for c in combinations(sorted(t), k):
                n, m = counts.get(c, (0, 0))
                counts[c] = n + 1, m + bad
    want = {}
    for c, (n, m) in counts.items():
        p, z = m / n, url_filter.SURE
        low = (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
        if m >= url_filter.MIN_COUNT and p >= url_filter.MIN_CONFIDENCE and low > base:
            want[c] = n, m
    assert got == want and ("h:spam", "p:win") in got and not any("h:other" in c for c in got)
    pages = spark.createDataFrame([("http://spam.site.net/win/9",), ("http://good.site.net/win/9",), ("http://spam.site.net/win/9",), ("http://other.net/page/6?q=6",)], "url string")
    judged = url_filter.judged(pages, rules.where("confidence > 0.6")).orderBy("url").collect()
    assert [r.verdict for r in judged] == ["allow", "allow", "block", "block"] and judged[-1].mined


def test_query_of_urls_with_planted_signal(spark, tmp_path):
    """Pages name labelled documents; those of one section are bad."""
    pages = [(i, f"http://n{i % 5}.example.net/{'casino' if i % 4 == 0 else 'news'}/{i}") for i in range(400)]
    labels = [(i, int(i % 4 != 0), 0) for i in range(0, 400, 2)]
    spark.createDataFrame(pages, "page_id long, url string").withColumn("html", F.lit("")).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: r for r in op10_url_filter(spark, str(tmp_path)).collect()}
    assert len(got) == 400 and all((got[i].verdict == "block") == (i % 4 == 0) and (got[i].mined is not None) == (i % 4 == 0) for i in got)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    rows, dim = [], 64
    for i in range(300):
        rows.append((i, rng.standard_normal(dim).tolist(), int(i % 3)))
    for i in range(300, 700):  # groups of near copies, some beyond the threshold
        base = np.array(rows[i % 40][1])
        rows.append((i, (base + rng.standard_normal(dim) * rng.uniform(0.05, 0.6)).tolist(), rows[i % 40][2]))
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 0), (902, rows[0][1], 1), (903, rows[0][1], None), (904, None, 0), (905, [], 0), (906, [0.0] * dim, 0), (907, [float("nan")] * dim, 0), (908, [None] * dim, 0), (909, rows[0][1][:32], 0), (900, rows[0][1], 0), (None, rows[1][1], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(frame, part=37).collect()), key=repr)
    ok = [i for i, (_, e, y) in enumerate(rows) if e and y is not None and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in ok}
    link = {i: [] for i in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93:
                link[a].append(b)
    root = {}
    for i in range(len(rows)):
        if i not in root:
            todo, seen = [i], {i}
            while todo:
                for b in link[todo.pop()]:
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            ids = [rows[x][0] for x in seen if rows[x][0] is not None]
            root |= dict.fromkeys(seen, min(ids) if ids else None)
    want = sorted(((rows[i][0], len(link[i]), root[i], rows[i][0] == root[i]) for i in range(len(rows))), key=repr)
    total, found = sum(w[1] for w in want), sum(g[1] for g in got)
    assert len(got) == len(want) and 0.97 * total <= found <= total
    assert sum(g == w for g, w in zip(got, want)) >= 0.97 * len(want)


def test_recall_of_pairs_at_the_threshold(spark):
    rng, rows = np.random.default_rng(1), []
    for i in range(0, 2000, 2):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.931
        rows += [(i, a.tolist(), 0), (i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert got.where("n_links > 0").count() >= 0.97 * len(rows)


def test_chat_roles_and_texts_are_recovered(spark):
    messages = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    raw = chat.marked_transcripts(messages)
    held_out = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 == 0
    rows = chat.parsed(raw.withColumn("style", chat.style_of(F.col("conv_id"))), chat.train(raw.where(~held_out))).where(held_out).collect()
    texts = {}
    for m in messages.orderBy("conv_id", "turn", "role", "text").collect():
        texts.setdefault(m.conv_id, []).append((m.role, (m.text or "").strip()))
    for style, least in ((0, 0.99), (1, 0.99), (2, 0.99), (3, 0.9)):
        held = [r for r in rows if r["style"] == style]
        right = [[(t.role, t.text) for t in r.turns] == [t for t in texts[r.conv_id] if t[1]] for r in held]
        assert held and sum(right) / len(held) >= least, (style, sum(right) / len(held))
    assert all(chat.unrendered(r.chat) == [(t.role, t.text) for t in r.turns] for r in rows)


@pytest.fixture(scope="module")
def chat_model(spark):
    return chat.train(chat.marked_transcripts(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")))


def test_query_of_chats_accounts_for_every_row(spark):
    rows = op3_chat_format(spark, "/root/testdata/sf0.01").collect()
    n = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").count()
    assert sum(r.n_turns + r.n_blank for r in rows) == n
    assert all(r.chat.count("<|end|>") == r.n_recovered for r in rows)


def test_texts_stay_whole(spark, chat_model):
    text = "User: So?\nAssistant: first\n\nsecond\n\nAnswer: 42\nUser: Thanks <|end|>\nfor <|user|> and more"
    assert chat_model.turns(text) == [("user", "So?"), ("assistant", "first\n\nsecond\n\nAnswer: 42"), ("user", "Thanks <|end|>\nfor <|user|> and more")]
    for body in ("<|end|>", "<||end|>", "a <| b <|| c |>", "<|user|>\nx\n<|end|>\n", ""):
        assert chat.unrendered(chat.rendered([("user", body), ("assistant", "y")])) == [("user", body), ("assistant", "y")]


def test_viterbi_equals_brute_force(chat_model):
    from itertools import product

    text = "User: May it be?\nIt may.\n\nAnswer: no\nBot: yes"
    for starts in (True, False):
        lines = chat.lines_of(text, starts)

        def score(path):
            s = chat_model.start[path[0]] if starts else 0.0
            s += sum(chat_model.move[a, b] for a, b in zip(path, path[1:]))
            return s + sum(t[q, v] for q, line in zip(path, lines) for t, v in zip(chat_model.emit, line.features))

        best = max(score(p) for p in product(range(chat.STATES), repeat=len(lines)))
        assert abs(score(chat_model.states(lines, starts)) - best) < 1e-9


def test_marked_turns_are_parsed(spark, chat_model):
    frame = spark.createDataFrame([("User: May that be so?\nAssistant: It may.\nAnd then some more of it.\nUser: Is that all there is?", "clash"), ("", "clash"), (None, "clash"), ("Q: Which one is it?\nA: The second of them.", "clash")], "transcript string, chat string")
    got = [[(t.role, t.text) for t in r.turns] for r in chat.parsed(frame, chat_model).collect()]
    assert got == [[("user", "May that be so?"), ("assistant", "It may.\nAnd then some more of it."), ("user", "Is that all there is?")], [], [], [("user", "Which one is it?"), ("assistant", "The second of them.")]]


def test_chat_bears_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (None, 0, "user", "y"), (2, None, "robot", "z"), (2, None, "robot", "z"), (3, 200, "user", "late"), (3, 0, "user", "early"), (4, 0, "user", "w " * 50_000), (5, 0, "user", " \n ")]
    rows += [(6, 0, "user", f"same turn {i % 400}") for i in range(700)]
    raw = chat.marked_transcripts(spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string"))
    out = chat.parsed(raw, chat.train(raw)).collect()
    assert sorted({(r.conv_id or -1, r.segment) for r in out}) == [(-1, 0), (1, 0), (2, 0), (3, 0), (3, 3), (4, 0), (5, 0), (6, 0)]
    assert sum(len(r.roles) + r.n_blank for r in out) == len(rows) and sum(r.conv_id == 6 for r in out) == 3
    assert {r.conv_id: r.n_blank for r in out if r.n_blank} == {1: 1, 5: 1}
    empty = chat.marked_transcripts(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat.parsed(empty, chat.train(empty)).count() == 0


def test_operators_at_once_in_one_session(spark):
    """Scratch tables belong to a call: calls in several threads don't touch each other's."""
    from concurrent.futures import ThreadPoolExecutor

    from tempora.llm.queries import op5_mix, op7_substring_dedup, op9_embedding_dedup

    sf = "/root/testdata/sf0.001"
    alone = [sorted(map(repr, q(spark, sf).collect())) for q in (op5_mix, op7_substring_dedup, op9_embedding_dedup)]
    with ThreadPoolExecutor(3) as pool:
        runs = [pool.submit(lambda q=q: sorted(map(repr, q(spark, sf).collect()))) for q in (op5_mix, op7_substring_dedup, op9_embedding_dedup) * 2]
    assert [r.result() for r in runs] == alone * 2


def test_vectors_of_text_labels_and_none(spark):
    one, two = [float(np.sin(i)) for i in range(64)], [float(np.sin(i)) + 0.01 * (i % 3) for i in range(64)]
    rows = [(1, one, "a"), (2, two, "a"), (3, one, "b")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame).collect()} == {1: (1, 1), 2: (1, 1), 3: (0, 3)}
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_empty_pages(spark):
    assert html_text.extracted(spark.createDataFrame([], "page_id long, html string, text string")).columns == ["page_id", "html", "text"]


@pytest.mark.parametrize("body", [
    "<div class='layout menu-left'><p>{}</p></div>", "<div class='ad-free'><p>{}</p></div>", "<div id='alert-story'><p>{}</p></div>",
    "<article><div class='comments-enabled'><p>{}</p></div></article>", "<article><section class='login-guide'><p>{}</p></section></article>",
    "<div class='menu'><p>{}" + STORY * 8 + "</p></div>", "<aside><p>{}" + STORY * 4 + "</p></aside>", "<article><h1><a href=1>{}</a></h1><p>" + STORY + "</p></article>",
])
def test_marks_do_not_lose_the_story(body):
    page = f"<html><body><nav><a href=1>Home</a></nav>{body.format(STORY)}<footer>Foot of it.</footer></body></html>"
    assert html_text.main_text(page).startswith(STORY.strip())


def test_what_is_no_story_goes():
    other = "<div class='comment-list'><p>" + STORY * 20 + "</p></div><footer><p>" + STORY + "</p></footer><div class='ad box'>" + STORY + "</div>"
    assert html_text.main_text(f"<article><p>Short.</p><div class='comments'>{STORY}</div></article>{other}") == "Short."
    assert html_text.main_text(f"<div><p>{STORY}</p></div>{other}") == STORY.strip()
    assert html_text.main_text("<nav><a href=1>Home</a></nav><footer>Foot of it.</footer>") == ""
    links = "".join(f"<li><a href={i}>A related story</a></li>" for i in range(5))
    assert html_text.main_text(f"<article><p>{STORY}</p><ul>{links}</ul></article>") == STORY.strip()


@pytest.mark.parametrize("piece", ["<a ", "<a \"", "<a '>", "<div class='share'>x", "<div class='menu'>", "<aside>x", "<svg>", "<svg><p>", "<", "<!--", "<div hidden>", "</div>", "<p class=ad>x"])
def test_malformed_pages_take_linear_time(piece):
    began = time.perf_counter()
    html_text.main_text(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 6


class Plain(HTMLParser):
    """Lines of well-formed pages whose paragraphs may be left open, by a stack of elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.lines, self.now = [], [], ["", 0]

    def cut(self, blank=0):
        text = " ".join(self.now[0].split(" ")) and re.sub(r"\s+", " ", self.now[0]).strip()
        names = [n for n, _ in self.stack]
        if text and not {"head", "script", "style"} & set(names):
            kind = 2 if any(("class", "ad") in a for _, a in self.stack) else 1 if {"nav", "footer", "header", "aside"} & set(names) else 0
            self.lines.append((text, max(0, len(text) - self.now[1]), "article" in names, kind))
        elif blank and self.lines and self.lines[-1][0]:
            self.lines += [("", 0, False, 0)] * blank
        self.now = ["", 0]

    def handle_starttag(self, tag, attrs):
        if tag in ("meta", "br"):
            return self.cut() if tag == "br" else None
        if tag not in ("a", "b", "i", "script", "style"):
            self.cut()
            if tag in ("nav", "footer", "header", "aside", "article"):
                self.cut(3)
            elif attrs:
                self.cut(1)
        self.stack.append((tag, attrs))

    def handle_endtag(self, tag):
        if tag not in ("a", "b", "i", "script", "style"):
            self.cut()
        if tag in [n for n, _ in self.stack]:
            while self.stack.pop()[0] != tag:
                pass
        if tag == "article":
            self.cut(3)

    def handle_data(self, data):
        names = [n for n, _ in self.stack]
        if not {"script", "style", "title"} & set(names):
            self.now[0] += data
            self.now[1] += len(data) if "a" in names else 0


def plain_text(page):
    """The definition on pages with an article: runs of covered lines; those with lines of the article."""
    p = Plain()
    p.feed(page)
    p.cut()
    lines = p.lines
    weights = [n / 8 if kind else n * 8 if inside else n for _, n, inside, kind in lines]
    out, lost = [], 0
    for a, b, peak in regions_by_definition([math.ceil(w) for w in weights], html_text.WINDOW):
        inside = any(x[2] and not x[3] for x in lines[a:b])
        if inside:
            out += [x[0] for x in lines[a:b] if x[0] and not x[3]]
        else:
            lost += sum(1 for x in lines[a:b] if x[0] and x[3] == 1) if peak < html_text.SURGE else 0
    return " ".join(out), lost


def test_pages_equal_a_plain_version(spark):
    """On all given pages; lines of footers, which no mark takes out, go as their windows don't surge."""
    lost = 0
    for r in load(spark, "/root/testdata/sf0.01", "pages").collect():
        want, n = plain_text(r.html or "")
        assert html_text.main_text(r.html or "") == want
        lines = html_text._weighed(*html_text.lines_of(r.html or ""))
        kept = {i for a, b in html_text.regions_of(lines) for i in range(a, b)}
        lost += sum(x.kind == html_text.LESS and x.own > 0 and i not in kept for i, x in enumerate(lines))
        assert n <= lost
    assert lost >= 250


def test_extra_columns_of_vectors_change_nothing(spark):
    vectors = load(spark, "/root/testdata/sf0.001", "embeddings")
    extra = ["component_id", "n_links", "kept", "a", "b", "node", "value", "full", "filters", "root", "u", "v", "bucket"]
    own = vectors.select("*", *[F.lit("own").alias(c) for c in extra])
    one, two = (sorted(map(tuple, embedding_dedup.near_duplicates(x).select("vec_id", "n_links", "component_id", "kept").collect())) for x in (vectors, own))
    assert one == two and len(one) == vectors.count()
