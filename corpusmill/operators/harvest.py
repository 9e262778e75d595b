"""Harvesting code from stored pages: link extraction with in-order
de-duplication and a per-page cap, and the per-item status pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.docs import (TEXT_SCHEMA, first_code_block, html_unescape, section_hit, section_html,
                                      section_lines, strip_tags)
from corpusmill.functions.html import page_links
from corpusmill.functions.text import let, strip_ws, url_to_title

# an attribute of its own name (no ``data-href``), quoted either way or not at all
LINK_RE = r"""(?is)<a(?:\s(?:[^>"']|"[^"]*"|'[^']*')*?)?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>(.*?)</a\s*>"""


def link_parts(html) -> Column:
    """Array of (href, inner markup) of all links in order; the page is
    scanned once, the parts are taken from each link alone."""
    h = F.col(html) if isinstance(html, str) else html

    def parts(a):
        href = F.concat(*[F.coalesce(F.regexp_extract(a, LINK_RE, g), F.lit("")) for g in (1, 2, 3)])
        return F.struct(href.alias("href"), F.regexp_extract(a, LINK_RE, 4).alias("inner"))

    return F.transform(F.regexp_extract_all(h, F.lit(LINK_RE), F.lit(0)), parts)


def container_slice(html, start: str, end: str | None) -> Column:
    """Markup from the first ``start`` marker up to the first ``end`` marker
    after it, or, when ``end`` is None, the whole element whose start tag has
    the marker (:func:`element_slice`); NULL when ``start`` is absent."""
    h = F.col(html) if isinstance(html, str) else html
    if end is None:
        return element_slice(h, start)
    pos = F.instr(h, start)
    return F.when(pos > 0, F.substring_index(F.substring(h, pos, 2147483647), end, 1))


def element_slice(html, start: str) -> Column:
    """The element whose start tag holds (or begins with) ``start``, up to its
    own end tag: start and end tags of its name are counted. Without an end
    tag it goes to the end of the text; NULL when ``start`` is absent."""
    h = F.col(html) if isinstance(html, str) else html
    at = F.instr(h, start)
    # the '<' that opens the tag in which the marker stands
    opened = at if start.startswith("<") else at - F.length(F.substring_index(F.substring(h, F.lit(1), at - 1), "<", -1)) - 1

    def cut(rest: Column) -> Column:
        name = F.regexp_extract(rest, r"^<([A-Za-z][A-Za-z0-9-]*)", 1)
        tag = F.concat(F.lit("(?is)</?"), name, F.lit(r"(?![A-Za-z0-9-])[^>]*>"))
        pieces = F.arrays_zip(F.split(rest, tag, -1).alias("gap"), F.regexp_extract_all(rest, tag, F.lit(0)).alias("tag"))

        def step(acc, x):
            pos = acc["pos"] + F.length(x["gap"]) + F.length(F.coalesce(x["tag"], F.lit("")))
            depth = acc["depth"] + F.when(x["tag"].startswith("</"), -1).when(x["tag"].endswith("/>") | x["tag"].isNull(), 0).otherwise(1)
            ends = (depth == 0) & x["tag"].startswith("</") & (acc["end"] == 0)
            return F.struct(pos.alias("pos"), depth.alias("depth"), F.when(ends, pos).otherwise(acc["end"]).alias("end"))

        zero = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("depth"), F.lit(0).alias("end"))
        end = F.aggregate(pieces, zero, step, lambda a: a["end"])
        return let(end, lambda e: F.when(e > 0, F.substring(rest, F.lit(1), e)).otherwise(rest))

    return F.when((at > 0) & (opened > 0), let(F.substring(h, opened, F.length(h)), cut))


def extract_links(pages: DataFrame, html: str = "html", key: str = "page_id",
                  container_start: str = 'id="mw-pages"', container_end: str | None = None,
                  prefix: str = "/wiki/", exclude_prefix: str | None = "/wiki/Category:",
                  base_url: Column | str = "", cap: int | None = None) -> DataFrame:
    """Links in page order -> ``(key, pos, title, url)``: href and title
    non-empty, href starting with ``prefix`` and not ``exclude_prefix``,
    first occurrence of each URL kept, with ``cap`` so many per page at most
    (after de-duplication). One shuffle, on the page key."""
    base = F.lit(base_url) if isinstance(base_url, str) else base_url
    sl = container_slice(html, container_start, container_end)
    arr = pages.select(
        F.col(key), base.alias("__base"),
        link_parts(sl).alias("__links"))
    # the _outer generator keeps Spark from inferring a size() filter that
    # would be pushed below the projection and re-run both regex scans
    links = arr.select(key, "__base", F.posexplode_outer("__links").alias("pos", "l")).where(
        F.col("l").isNotNull()).select(
        key, "pos", html_unescape(F.col("l.href")).alias("href"),
        strip_ws(html_unescape(strip_tags(F.col("l.inner")))).alias("title"), "__base")
    keep = (F.col("href") != "") & (F.col("title") != "") & F.col("href").startswith(prefix)
    if exclude_prefix:
        keep = keep & ~F.col("href").startswith(exclude_prefix)
    kept = links.where(keep).select(key, F.struct("pos").alias("at"), "title", F.concat("__base", "href").alias("url"))
    return _first_of_each(kept, key, cap)


def _first_of_each(links: DataFrame, key: str, cap: int | None) -> DataFrame:
    """``links(key, at, title, url)`` -> the first of each URL in the order of
    ``at``, numbered from 0 within the page, ``cap`` of them at most."""
    # first occurrence per URL as an aggregate on (page, url): partial
    # aggregation, and one huge page is spread over many tasks
    deduped = links.groupBy(key, "url").agg(F.min("at").alias("at"), F.min_by("title", "at").alias("title"))
    # the cap is a per-page top-k; the filtered window runs as a map-side
    # group limit, so at most `cap` rows per page and task are shuffled
    order = Window.partitionBy(key).orderBy("at")
    capped = deduped.withColumn("__n", F.row_number().over(order))
    if cap is not None:
        capped = capped.where(F.col("__n") <= cap)
    return capped.select(key, (F.col("__n") - 1).alias("pos"), "title", "url")


# The lists of a category page
CATEGORY_CONTAINER = "mw-pages"
CATEGORY_SELECTORS = (("div", "mw-category"), ("div", "mw-category-group"))


def category_links(pages: DataFrame, html: str = "html", key: str = "page_id", container: str | None = CATEGORY_CONTAINER,
                   selectors=CATEGORY_SELECTORS, prefix: str = "/wiki/", exclude_prefix: str | None = "/wiki/Category:",
                   base_url: Column | str = "", cap: int | None = None) -> DataFrame:
    """Links of the element with the id ``container`` -> ``(key, pos, title,
    url)``. Those below an element of the first selector ``(name, class)`` come
    first, then those of the second, and so on, each in page order; if a page has
    no wanted link below any of them, all links of its container count. First
    occurrence of each URL, ``cap`` per page at most. A page without the container
    has no links."""
    base = F.lit(base_url) if isinstance(base_url, str) else base_url
    found = pages.select(F.col(key), base.alias("__base"), page_links(html, container, list(selectors)).alias("__links"))

    def wanted(x: Column) -> Column:
        keep = (x["href"] != "") & (x["title"] != "") & x["href"].startswith(prefix)
        return keep & ~x["href"].startswith(exclude_prefix) if exclude_prefix else keep

    def of(links: Column, selector: int) -> Column:
        """The links below the selector (all of them for the one past the last)."""
        some = links if selector == len(selectors) else F.filter(links, lambda x: F.array_contains(x["selectors"], selector))
        return F.transform(some, lambda x: F.struct(F.lit(selector).alias("selector"), x["pos"].alias("pos"), x["title"].alias("title"), x["href"].alias("href")))

    def chosen(links: Column) -> Column:
        """Decided on the page's own array: the page is read once and nothing is joined."""
        listed = F.flatten(F.array(*[of(links, i) for i in range(len(selectors))])) if selectors else F.slice(of(links, 0), 1, 0)
        return let(listed, lambda x: F.when(F.size(x) > 0, x).otherwise(of(links, len(selectors))))

    placed = F.transform("__links", lambda x, i: F.struct(i.alias("pos"), x["href"].alias("href"), x["title"].alias("title"), x["selectors"].alias("selectors")))
    each = found.select(key, "__base", F.explode_outer(let(F.filter(placed, wanted), chosen)).alias("l")).where(F.col("l").isNotNull())
    return _first_of_each(each.select(key, F.struct("l.selector", "l.pos").alias("at"), "l.title", F.concat("__base", "l.href").alias("url")), key, cap)


def harvest_status(items: DataFrame, sections_json: str = "sections_json", text_json: str = "text_json",
                   letter: str = "c", strict: bool = False) -> DataFrame:
    """Per-item extraction with a status instead of a failure: ``error`` (the
    section list or the section is no such document, or the index is missing
    or not a number), ``no section`` (no qualifying section), ``no html``
    (empty section), ``no code`` (no code block), ``found``. Adds
    ``section_index`` and ``code``."""
    out = items.withColumn("__hit", section_hit(sections_json, letter, strict)).withColumn(
        "__listed", section_lines(sections_json).isNotNull()).withColumn("section_index", F.col("__hit.index").try_cast("int"))
    out = out.withColumn("__html", section_html(text_json)).withColumn("code", first_code_block("__html"))
    bad_body = F.col(text_json).isNotNull() & F.from_json(F.col(text_json), TEXT_SCHEMA)["parse"]["text"].isNull()
    status = (F.when(~F.col("__listed"), "error")
              .when(F.col("__hit").isNull(), "no section")
              .when(F.col("section_index").isNull() | bad_body, "error")
              .when(F.coalesce(F.col("__html"), F.lit("")) == "", "no html")
              .when(F.col("code").isNull(), "no code")
              .otherwise("found"))
    return out.withColumn("status", status).drop("__hit", "__listed", "__html")


def link_titles(links: DataFrame, url: str = "url") -> DataFrame:
    return links.withColumn("page_title", url_to_title(url))
