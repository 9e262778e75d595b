"""Registered acquisition queries: link harvest from stored pages, section
picking and code extraction, collision-safe naming, chat replies turned into
code, and the compile gate.

Stand-ins (all derived from the driver tables, so work grows with them):
``pages`` are the listing pages (links live in ``<nav>``, prefix ``/``);
a page's nav link texts play the section list of the section API and its
``<article>`` the section body; ``conversations`` user turns are the prompt
table and the following assistant turns the model replies; ``labels`` is the
compiler's verdict (``quality = 0``: failed, with the document text as the
error output).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import docs as D
from corpusmill.functions import text as T
from corpusmill.operators import harvest as H
from corpusmill.operators import names as N
from corpusmill.operators.metrics import tally
from corpusmill.operators.split import ordinal_rank
from corpusmill.plans import workflows as W
from corpusmill.sources.corpus import code_files, listing_pages, table
from corpusmill.session import fresh_folder
from corpusmill.sources.files import with_suffix

NAV_START, NAV_END = "<nav", "</nav>"
ARTICLE_START, ARTICLE_END = "<article", "</article>"
LINK_PREFIX, LINK_EXCLUDE = "/", "/Category:"
MODEL = "local-model"
# The limits of the rules that the queries show
MAX_ERROR_CHARS = 2000
NAME_CHARS = 120
MAX_SUFFIX = 999
MAX_LINKS = 200


TITLE_RE = r"^[^.\n]*"


def page_origin(url) -> F.Column:
    return F.regexp_extract(F.col(url), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)


def link_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every listing page: those of the first kind of list, then of the
    second, else all of the container; de-duplicated by URL, capped at 200 per
    page, with the title derived from the URL."""
    links = H.category_links(listing_pages(spark, sf_dir), prefix=LINK_PREFIX, exclude_prefix=LINK_EXCLUDE, base_url=page_origin("url"), cap=MAX_LINKS)
    return H.link_titles(links)


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    nav = H.container_slice("html", NAV_START, NAV_END)
    titles = F.transform(H.link_parts(nav), lambda x: T.strip_ws(D.html_unescape(D.strip_tags(x["inner"]))))
    sections = F.transform(titles, lambda t, i: F.struct(t.alias("line"), (i + 1).cast("string").alias("index")))
    article = H.container_slice("html", ARTICLE_START, ARTICLE_END)
    return pages.select(
        "page_id",
        F.to_json(F.struct(F.struct(sections.alias("sections")).alias("parse"))).alias("sections_json"),
        F.to_json(F.struct(F.struct(F.create_map(F.lit("*"), article).alias("text")).alias("parse")))
        .alias("text_json"))


def section_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: pick the C section, fetch its body, take the first code
    block; a status instead of a failure."""
    out = H.harvest_status(_sections(spark, sf_dir))
    return out.select("page_id", "section_index", "status")


def harvest_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(H.harvest_status(_sections(spark, sf_dir)), "status")


def _harvest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a section list and a section body each. The body is the
    document of the same number as the API would send it: escaped, in a
    ``<pre>`` if it was judged good, in ``<code>`` if it was not judged, as
    bare text if bad; no document, no body. The list is the page's links; a
    page without links sends no list at all, and ``C`` is listed last, without
    its index where the language is not known to the page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), "quality")
    j = pages.join(docs, pages.page_id == docs.doc_id, "left").join(labels, F.col("page_id") == F.col("l_id"), "left")
    escaped = "text"
    for ch, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&#62;"), ('"', "&#x22;")):
        escaped = F.replace(F.col(escaped) if isinstance(escaped, str) else escaped, F.lit(ch), F.lit(ent))
    body = F.when(F.col("quality") == 1, F.concat(F.lit("<p>C</p><pre class='c'>"), escaped, F.lit("</pre>"))).when(
        F.col("quality").isNull(), F.concat(F.lit("<code>"), escaped, F.lit("</code>"))).otherwise(escaped)
    titles = F.transform(H.link_parts(H.container_slice("html", NAV_START, NAV_END)), lambda x: D.strip_tags(x["inner"]))
    listed = F.transform(titles, lambda t, i: F.struct(t.alias("line"), (i + 1).cast("string").alias("index")))
    last = F.array(F.struct(F.lit("C").alias("line"), F.when(F.col("lang") != "fr", F.lit("99")).alias("index")))
    sections = F.to_json(F.struct(F.struct(F.concat(listed, last).alias("sections")).alias("parse")))
    return j.select(F.col("page_id").alias("arrival"), T.url_to_title("url").alias("title"),
                    F.when(F.size(titles) > 0, sections).otherwise("not found").alias("sections_json"),
                    F.to_json(F.struct(F.struct(F.create_map(F.lit("*"), body).alias("text")).alias("parse"))).alias("text_json"))


def code_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole harvest: section, code, name, outcome per page."""
    return W.harvest_code(_harvest_items(spark, sf_dir), max_chars=NAME_CHARS, max_suffix=MAX_SUFFIX)


def code_harvest_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(code_harvest(spark, sf_dir), "outcome")


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document harvested under its own title, its text's first line up
    to a full stop: safe names, skipped identical copies, first free suffixes."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("arrival"), F.regexp_extract("text", TITLE_RE, 0).alias("title"), F.col("text").alias("code"))
    named = N.assign_names(docs, max_chars=NAME_CHARS, max_suffix=MAX_SUFFIX, with_content=False)
    return named.select("arrival", "base", "name", "status")


def numbered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, turn, text, problem_number, reply)``: user turns as prompts, and
    the assistant turn right after each, if there is one."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    users = conv.where(F.col("role") == "user").select("conv_id", "turn", "text")
    numbered = ordinal_rank(users, ["conv_id", "turn"], "problem_number")
    replies = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return numbered.join(replies, ["conv_id", "turn"], "left")


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = numbered_prompts(spark, sf_dir)
    response = F.when(F.col("reply").isNotNull(), F.to_json(F.struct(F.array(F.struct(
        F.lit(0).alias("index"),
        F.struct(F.lit("assistant").alias("role"), F.col("reply").alias("content")).alias("message"))).alias("choices"))))
    return j.withColumn("response", response)


def reply_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt table -> numbered prompts -> replies -> code files
    ``_<n>.c``; empty generations are rejected with a status."""
    j = _replies(spark, sf_dir)
    code = D.reply_to_code("response")
    out = j.select(
        F.col("problem_number"),
        F.concat(F.lit("_"), F.col("problem_number").cast("string"), F.lit(".c")).alias("file_name"),
        D.build_prompt("problem_number", "text").alias("prompt"),
        code.alias("code"))
    status = F.when(F.col("code").isNull(), "no reply").when(F.col("code") == "", "empty").otherwise("written")
    return out.withColumn("status", status)


def chat_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies for every numbered prompt."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    users = conv.where(F.col("role") == "user").select("conv_id", "turn", "text")
    numbered = ordinal_rank(users, ["conv_id", "turn"], "problem_number")
    return numbered.select("problem_number", D.chat_payload(D.build_prompt("problem_number", "text"), MODEL)
                           .alias("payload"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(stem, returncode, stderr, asm)``: the labels as a compiler's results."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    # only the listing's existence matters: join its name, not its text
    asm = with_suffix(code_files(spark, sf_dir), ".s", value="name").withColumnRenamed("name", "asm")
    return (labels.join(docs, "doc_id", "inner")
            .select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("stem"),
                    F.when(F.col("quality") == 0, 1).otherwise(0).alias("returncode"),
                    F.when(F.col("quality") == 0, F.col("text")).otherwise(F.lit("")).alias("stderr"))
            .join(asm, "stem", "left"))


def _gated(spark: SparkSession, sf_dir: str, log_dir: str | None = None) -> DataFrame:
    return W.gate_corpus(code_files(spark, sf_dir), _results(spark, sf_dir), "corpus", MAX_ERROR_CHARS, log_dir)


def compile_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compile verdict of every source with its log line; unlabelled sources
    have no result."""
    return _gated(spark, sf_dir).select("stem", "ok", "status", "log_line")


def gate_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-5, PIP-9: the ok and failed logs as they are written, line by line."""
    root = fresh_folder(spark, "logs")
    _gated(spark, sf_dir, root)
    lines = spark.read.text(f"{root}/ok").withColumn("log", F.lit("ok")).unionByName(spark.read.text(f"{root}/failed").withColumn("log", F.lit("failed")))
    return lines.select("log", F.col("value").alias("line"))


def compile_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(_gated(spark, sf_dir), "status")
