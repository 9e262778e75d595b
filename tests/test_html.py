"""Links by id container and class selectors, against a tree built with the standard library's parser."""
import random
from html.parser import HTMLParser

import pytest
from corpusmill.functions.html import links_of
from corpusmill.operators import harvest as H

SELECTORS = [("div", "mw-category"), ("div", "mw-category-group")]
VOID = {"br", "img", "hr", "input"}


class Tree(HTMLParser):
    """Every link with its ancestors and its text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.links, self.first = [], [], {}

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        node = {"tag": tag, "attrs": attrs, "up": list(self.stack), "text": ""}
        self.first.setdefault(attrs.get("id"), node)
        if tag == "a" and "href" in attrs:
            self.links.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(n["tag"] == tag for n in self.stack):
            while self.stack.pop()["tag"] != tag:
                pass

    def handle_data(self, data):
        for n in self.stack:
            n["text"] += data


def brute(page, container):
    t = Tree()
    t.feed(page)
    t.close()
    box = t.first.get(container)
    if container is not None and box is None:
        return None
    out = []
    for n in t.links:
        if container is None or any(u is box for u in n["up"]):
            hits = [i for i, (tag, cls) in enumerate(SELECTORS) if any(u["tag"] == tag and cls in (u["attrs"].get("class") or "").split() for u in n["up"])]
            out.append((n["attrs"]["href"] or "", n["text"].strip(), hits))
    return out


def test_random_markup_equals_a_tree():
    rng = random.Random(8)
    bits = ["<div>", "</div>", '<div class="mw-category">', "<div class='x mw-category-group'>", "<ul>", "</ul>", "<li>", "</li>", "<p>", "</p>", "<br>", "<b>", "</b>",
            '<a href="/wiki/A">', "</a>", "<a href=/wiki/B>b</a>", "<a name=x>", "text &amp; more", " ", '<div id="mw-pages">', "<a href='/wiki/C' class=k>", "<img src=x>",
            "<!-- <a href=/no>n</a> -->", "<span/>", "<P ID='mw-pages'>", "</span>"]
    for _ in range(1500):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        for container in ("mw-pages", None):
            assert links_of(page, container, SELECTORS) == brute(page, container), page


def test_scripts_comments_and_broken_ends():
    page = ('<script>var a = "<a href=/s>s</a></div>";</script><div id=mw-pages><style>a{}</style><a href="/wiki/A&amp;B" title=">">A &lt; B</a>'
            '<a href="/wiki/open">open <b>still</div><a href="/wiki/after">after</a><!-- never closed <a href=/x>')
    assert links_of(page, "mw-pages", []) == [("/wiki/A&B", "A < B", []), ("/wiki/open", "open still", [])]
    assert links_of("", "x", []) is None and links_of(None, "x", []) is None and links_of("no <tag", None, []) == []
    assert links_of("<a href=/wiki/x>" + "<i>" * 20000 + "deep", None, []) == [("/wiki/x", "deep", [])]


@pytest.fixture
def category(spark):
    def run(pages, **how):
        df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
        rows = H.category_links(df, base_url="https://h.org", **how).orderBy("page_id", "pos").collect()
        return [(r.page_id, r.pos, r.title, r.url.removeprefix("https://h.org/wiki/")) for r in rows]

    return run


def test_selectors_in_turn_then_fallback(category):
    def link(x):
        return f'<a href="/wiki/{x}">{x}</a>'

    both = f'<div id="mw-pages"><div class="mw-category-group">{link("G")}{link("M")}</div>{link("none")}<div class="mw-category">{link("A")}{link("G")}</div></div>'
    nested = f'<div id="mw-pages"><div class="mw-category"><div class="mw-category-group">{link("N")}{link("O")}</div>{link("P")}</div></div>'
    fallback = f'<div id="mw-pages"><div class="mw-category"><a href="/wiki/Category:C">C</a><a href="/w/x">x</a><a href="/wiki/E"> </a></div>{link("F")}{link("F")}</div>{link("out")}'
    outer = f'<div class="mw-category"><div id="mw-pages">{link("Q")}</div></div>'
    got = category([both, nested, fallback, outer, link("no container"), None, ""])
    assert got == [(0, 0, "A", "A"), (0, 1, "G", "G"), (0, 2, "M", "M"), (1, 0, "N", "N"), (1, 1, "O", "O"), (1, 2, "P", "P"), (2, 0, "F", "F"), (3, 0, "Q", "Q")]


def test_cap_counts_urls_of_a_page_and_keeps_the_first(category):
    many = '<div id="mw-pages">' + "".join(f'<a href="/wiki/{i % 150}">t{i}</a>' for i in range(450)) + "</div>"
    got = category([many, many.replace("150", "x")], cap=100)
    assert [g for g in got if g[0] == 0] == [(0, i, f"t{i}", str(i)) for i in range(100)]
    assert len(category([many], cap=200)) == 150


def test_no_selectors_means_the_whole_container(category):
    page = '<ul id="list"><li><a href="/wiki/A">a</a></li></ul><a href="/wiki/B">b</a>'
    assert category([page], container="list", selectors=()) == [(0, 0, "a", "A")]
    assert category([page], container=None, selectors=()) == [(0, 0, "a", "A"), (0, 1, "b", "B")]
