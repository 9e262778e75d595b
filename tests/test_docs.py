"""HTML / JSON extraction, harvest statuses and chat replies."""
import json

from conftest import many, one
from corpusmill.functions import docs as D
from corpusmill.operators import harvest as H


def sections(*lines):
    return json.dumps({"parse": {"sections": [{"line": l, "index": i} for l, i in lines]}})


def test_pick_section(spark):
    values = [sections(("BASIC", "1"), ("C", "2"), ("C++", "3")), sections(("Clojure", "4")),
              sections(("c++", "1")), sections(("C", "T-1")), "not json"]
    assert many(spark, D.pick_section("t"), values) == ["2", "4", None, "T-1", None]
    assert many(spark, D.pick_section("t", strict=True), values) == ["2", None, None, "T-1", None]


def test_section_html_and_code_block(spark):
    j = json.dumps({"parse": {"text": {"*": "<div><pre></pre><code>a &lt; b</code></div>"}}})
    assert one(spark, D.section_html("t"), j) == "<div><pre></pre><code>a &lt; b</code></div>"
    got = many(spark, D.first_code_block("t"), [
        "<pre class='x'>int <b>x</b>;\n</pre><pre>2</pre>", "<pre></pre><code>a &lt; b</code>", "<p>none</p>"])
    assert got == ["int x;\n", "a < b", None]


def test_harvest_status(spark):
    rows = [
        (1, sections(("C", "1")), json.dumps({"parse": {"text": {"*": "<pre>main(){}</pre>"}}})),
        (2, sections(("Go", "1")), "{}"),
        (3, sections(("C", "x")), "{}"),
        (4, sections(("C", "1")), json.dumps({"parse": {"text": {"*": ""}}})),
        (5, sections(("C", "1")), json.dumps({"parse": {"text": {"*": "<p>text</p>"}}})),
    ]
    df = spark.createDataFrame(rows, "id int, sections_json string, text_json string")
    got = {r.id: r.status for r in H.harvest_status(df).collect()}
    assert got == {1: "found", 2: "no section", 3: "error", 4: "no html", 5: "no code"}


def test_extract_links(spark):
    html = ('<div id="mw-pages"><a href="/wiki/A_b">A b</a><a href="/wiki/Category:X">cat</a>'
            '<a href="/wiki/A_b">again</a><a href="/other">o</a><a href="/wiki/C%2B%2B">C++</a>'
            '<a href="/wiki/E">  </a></div><a href="/wiki/Out">out</a>')
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    links = H.link_titles(H.extract_links(df, base_url="https://h.org", container_end="</div>"))
    got = [(r.pos, r.title, r.url, r.page_title) for r in links.orderBy("pos").collect()]
    assert got == [(0, "A b", "https://h.org/wiki/A_b", "A b"), (1, "C++", "https://h.org/wiki/C%2B%2B", "C++")]
    capped = H.extract_links(spark.createDataFrame(
        [(2, '<div id="mw-pages">' + "".join(f'<a href="/wiki/p{i}">p{i}</a>' for i in range(250)) + "</div>")],
        "page_id long, html string"))
    assert capped.count() == 250  # nothing is cut unless asked for
    few = H.extract_links(spark.createDataFrame(
        [(2, '<div id="mw-pages">' + "".join(f'<a href="/wiki/p{i}">p{i}</a>' for i in range(250)) + "</div>")],
        "page_id long, html string"), cap=200)
    assert few.count() == 200


def test_replies(spark):
    good = json.dumps({"choices": [{"message": {"content": "```c\n#include <x.h>\nint main(){}\n```"}}]})
    esc = '{"choices":[{"message":{"content":"a\\nb \\"q\\" \\u003c"}}]}'
    got = many(spark, D.reply_text("t"), [good, "raw text", esc])
    assert got[1] == "raw text" and got[2] == 'a\nb "q" <'
    assert one(spark, D.reply_to_code("t"), good) == "#include <x.h>\nint main(){}\n"


def test_payload_round_trip(spark):
    p = one(spark, D.chat_payload(D.build_prompt("t", "t"), "m"), "7")
    body = json.loads(p)
    assert body["model"] == "m" and body["temperature"] == 0.2 and body["max_tokens"] == -1 and body["stream"] is False
    assert body["messages"][0]["role"] == "system"
    assert body["messages"][1]["content"].startswith("Problem 7:\n7\n\nWrite a single")


def test_links_take_their_own_attribute_in_any_quotes(spark):
    html = ("<nav><a data-href='/wiki/Wrong' href=\"/wiki/Right\">r</a> <a class=x href='/wiki/Single'>s</a> <a href=/wiki/Bare>b</a>"
            "<a title=\"href='/wiki/No'\" href=\"/wiki/Yes\">y</a><abbr href=\"/wiki/Abbr\">z</abbr></nav>")
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = [r.url for r in H.extract_links(df, container_start="<nav", container_end="</nav>").orderBy("pos").collect()]
    assert got == ["/wiki/Right", "/wiki/Single", "/wiki/Bare", "/wiki/Yes"]


def test_entities_of_all_forms(spark):
    import html

    cases = ["a&lt;b&#160;&#x3C;&#58;&nbsp;&eacute;", "&amp;lt; &amp;#58;", "&unknown; &#0; &#55296; &;", "plain", "&#128512;&copy;", "x&lt", ""]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = [r.u for r in df.select("i", D.html_unescape("t").alias("u")).orderBy("i").collect()]
    assert got == [html.unescape(c) if c not in (cases[2], cases[5]) else c for c in cases]


def test_container_ends_with_its_own_end_tag(spark):
    html = ("<div><div class=a id=\"mw-pages\"><DIV><a href='/wiki/In'>i</a></DIV><divider/><div/><a href='/wiki/Last'>l</a></div>"
            "<footer><a href='/wiki/Out'>o</a></footer></div>")
    rows = [(1, html), (2, "<p>no container</p>"), (3, "x<div id=\"mw-pages\"><a href='/wiki/Open'>n</a>"), (4, None)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    got = {}
    for r in H.extract_links(df).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append(r.url)
    assert got == {1: ["/wiki/In", "/wiki/Last"], 3: ["/wiki/Open"]}
    whole = {r.page_id: r.e for r in df.select("page_id", H.element_slice("html", 'id="mw-pages"').alias("e")).collect()}
    assert whole[1].startswith("<div class=a") and whole[1].endswith("l</a></div>") and whole[2] is None
