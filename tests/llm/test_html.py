import math
import random
from collections import Counter

import pytest

from strata.llm import html


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


def site(spark, bodies, url="https://h.example/{}"):
    rows = [(i, url.format(i) if url else None, page(b) if b is not None else None, "x") for i, b in enumerate(bodies)]
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}


def test_declared_branches_and_markup(spark):
    body = (
        '<header>Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- note --><div class="ad">Buy</div><script>var t="</p>";</script>'
        "<article><h1>Head &amp; tail</h1><p><b>One\n  two<br><p>Three<i>four</i>&nbsp;five &lt;x&gt;<aside>side</aside><p>Six</p><form>f<input></form></article>"
        '<div id="comments"><article><p>Reader says</p></article></div><footer>&copy; h</footer>'
    )
    assert site(spark, [body])[0] == "Head & tail One two Threefour five <x> Six"


def test_site_noise_without_declared_roles(spark):
    bodies = [f'<div class="top">Same words on every page</div><div class="text"><p>Own story number {i} with words of its own</p><p>And {i * 7} more</p></div><div class="low">All rights reserved</div>' for i in range(30)]
    got = site(spark, bodies)
    assert got == {i: f"Own story number {i} with words of its own And {i * 7} more" for i in range(30)}


def frame(spark, bodies, url="https://h{}.example/{}", hosts=1):
    rows = [(i, url.format(i % hosts, i), page(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_importance_of_nodes(spark):
    bodies = [f'<div class="top">Same</div><div class="text"><p>Own {i}</p></div>' for i in range(40)]
    tree = html.site_style_tree(html.page_nodes(frame(spark, bodies))).collect()
    leaf = sorted((r for r in tree if r.words), key=lambda r: r.content)
    assert [round(r.content, 6) for r in leaf] == [1 / 40, 1.0] and all(r.pages == 40 for r in tree)
    assert leaf[0].importance < 0.2 and leaf[1].importance > 0.9


def test_tree_equals_a_plain_computation(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    bodies = []
    for i in range(60):
        lines = "".join(f"<p>{rng.choice(words)} {rng.choice(words)}. {rng.choice(words)} {i}</p>" for _ in range(rng.randint(1, 4)))
        bodies.append(f'<nav><a href="/{rng.choice(words)}">{rng.choice(words)}</a></nav><div class="t{rng.randrange(3)}"><div>{lines}</div>{rng.choice(words)}</div>')
    df = frame(spark, bodies, hosts=3)
    got = {(r.host, r.node): r for r in html.site_style_tree(html.page_nodes(df)).collect()}
    pages = [(f"h{i % 3}.example", html.parse(page(b)).nodes) for i, b in enumerate(bodies)]
    at = {}  # (host, node) -> its Node on each page
    for host, nodes in pages:
        for path, n in nodes.items():
            if path:
                at.setdefault((host, path), []).append(n)
    every = {}
    for (_, path), ns in at.items():
        every.setdefault(path, []).extend(ns)
    held = {path: Counter(c for n in ns for c in n.contents) for path, ns in every.items()}
    raw = {}
    for (host, path), ns in at.items():
        own = len(ns) / (len(ns) + html.HOST_PAGES)
        mine = Counter(c for n in ns for c in n.contents)
        raw[host, path] = (
            sum(w * mine[c] ** -own * held[path][c] ** -(1 - own) for n in ns for c, w in n.contents.items()), sum(w for n in ns for w in n.contents.values()), own,
        )
    content = {}
    for (host, path), (i, w, own) in raw.items():
        if w:
            all_i, all_w = (sum(v[k] for (_, p), v in raw.items() if p == path) for k in (0, 1))
            content[host, path] = own * i / w + (1 - own) * all_i / all_w
    composite = {}
    for (host, path), ns in at.items():
        num = den = 0.0
        for (h2, p2), c in content.items():
            chain = at[h2, p2][0].chain
            if h2 == host and path in chain:
                w = raw[h2, p2][1] * html.DECAY ** (len(chain) - 1 - chain.index(path))
                num, den = num + w * c, den + w
        if den:
            composite[host, path] = num / den
    assert set(got) == set(composite)
    for (host, path), c in composite.items():
        ns = at[host, path]
        up = ns[0].chain[-2] if len(ns[0].chain) > 1 else None
        n = len(every[path])
        lean = (n * c + html.PARENT_PAGES * composite.get((host, up), c)) / (n + html.PARENT_PAGES + html.ROLE_PAGES * ns[0].role)
        styles = Counter(tuple(x.children) for x in ns)
        h = -sum(k / len(ns) * math.log(k / len(ns)) for k in styles.values()) / math.log(len(ns)) if len(ns) > 1 else 0.0
        want = lean + (1 - lean) * (1 - html.DECAY ** len(styles)) * h
        assert got[host, path].importance == pytest.approx(want)


def test_entropy_outweighs_declared_roles(spark):
    # an aside with a text of its own on each page stays; an article that repeats on all pages goes
    bodies = [f"<article>The same words everywhere in here</article><aside><p>Story {i} of {i * i} and {i + 7}</p></aside>" for i in range(400)]
    got = {r.page_id: r.text for r in html.extract(frame(spark, bodies)).collect()}
    assert got == {i: f"Story {i} of {i * i} and {i + 7}" for i in range(400)}


def test_cut_nodes_by_join_and_by_broadcast_agree(spark, monkeypatch):
    bodies = [f'<nav><p>menu</p></nav><div class="a"><p>Own story {i}</p></div><div class="low">Rights {i % 2}</div>' for i in range(50)]
    df = frame(spark, bodies, hosts=4)
    df = df.unionAll(df.limit(3))
    want = sorted(html.extract(df).collect())
    monkeypatch.setattr(html, "MAX_BROADCAST", 0)
    assert sorted(html.extract(df).collect()) == want
    assert {r.text for r in want} == {f"Own story {i}" for i in range(50)}


def test_forms_and_reader_comments_are_never_text(spark):
    bodies = [f'<p>Text {i}</p><form>Say {i}<p>more {i * 3}</p></form><div class="comments"><p>Reader {i} says {i * 5}</p></div><button>Go {i}</button>' for i in range(20)]
    assert site(spark, bodies) == {i: f"Text {i}" for i in range(20)}


def test_a_single_page_keeps_its_text_and_odd_rows_stay(spark):
    got = site(spark, ["<p>Only page</p>", None, "", "<p>open <b>tags", "plain < text &#x41; &bogus;", "<p a='>'>q</p>"], url=None)
    assert got[1] == got[2] == ""
    assert got[3] == "open tags" and got[4] == "plain < text A &bogus;" and got[5] == "q"
    assert "Only page" in got[0]


def test_copies_of_an_article_are_kept(spark):
    body = "<nav>menu</nav><article><p>The same article on all pages</p></article>"
    assert set(site(spark, [body] * 12).values()) == {"The same article on all pages"}


@pytest.mark.parametrize("source", ["<" * 5000, "<a " * 3000, "<p " + "x='" * 3000, "<div>" * 3000 + "deep", "&amp;" * 5000, "<!--" * 2000])
def test_hostile_markup_ends(source):
    html.main_text(html.parse(source), set())


def test_hosts(spark):
    urls = ["https://User@WWW.A.org:80/x", "http://a.b?q", "nonsense", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(html.host_of(html.F.col("url")).alias("h"))
    assert [r.h for r in df.collect()] == ["www.a.org", "a.b", "", ""]


def test_empty_table(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
