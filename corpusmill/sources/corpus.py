"""The driver tables as a corpus of paired code files.

The driver's ``documents`` table holds prose, not code. The *code view*
below wraps every whole document text into three deterministic files per
document — a C source (``<stem>.c``), an assembly listing (``<stem>.s``) and
another decompiler's output (``<stem>.ghidra.c``) — so that every operator
runs over whole tables and whole texts. Which files exist is derived from
``labels`` (a stand-in compile / tool result), never from id arithmetic:

* ``.c``        every document;
* ``.s``        documents whose compile did not fail (``labels.quality = 0``
                marks a failure; the failed source gets no assembly);
* ``.ghidra.c`` documents the other tool was run on (those with a label row).

The same SQL expressions are used by the Spark side (``F.expr``) and the
DuckDB oracle, so both engines see byte-identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators.rows import spread

# C source: duplicated / unordered includes, a non-preferred include, a string
# literal holding '//', brace on its own line, a block comment, the whole
# document as line comments, extra blank lines at the end.
C_TEXT_SQL = (
    "concat('#include <string.h>', chr(10), '#include   <stdio.h>', chr(10), '#include <string.h>', chr(10), "
    "'#include <', lang, '.h>', chr(10), "
    "'static const char *origin = ', chr(34), source, '//', lang, chr(34), ';', chr(10), chr(10), "
    "'int f', cast(doc_id as string), '(int n)', chr(10), '{', chr(10), "
    "'  /* ', source, ' */', chr(10), "
    "'  // ', replace(text, chr(10), concat(chr(10), '  // ')), chr(10), "
    "'  return n + ', cast(n_chars as string), ';', chr(10), '}', chr(10), chr(10), chr(10), chr(10))"
)

# Assembly listing: tabs, .file/.globl/.type/.cfi noise, the whole document as
# .string lines in .rodata, an .asciz in .rodata.str1.8, a bare .data that
# sets no section, local labels, inline comments in three styles.
ASM_TEXT_SQL = (
    "concat(chr(9), '.file', chr(9), chr(34), 'doc', cast(doc_id as string), '.c', chr(34), chr(10), "
    "chr(9), '.text', chr(10), "
    "chr(9), '.section', chr(9), '.rodata', chr(10), "
    "'.LC0:', chr(10), "
    "chr(9), '.string', chr(9), chr(34), "
    "replace(text, chr(10), concat(chr(34), chr(10), chr(9), '.string', chr(9), chr(34))), chr(34), chr(10), "
    "chr(9), '.long', chr(9), cast(n_chars as string), chr(10), "
    "chr(9), '.section', chr(9), '.rodata.str1.8', chr(10), "
    "chr(9), '.string', chr(9), chr(34), lang, chr(34), chr(10), "
    "chr(9), '.data', chr(10), "
    "chr(9), '.quad', chr(9), cast(doc_id as string), chr(10), "
    "chr(9), '.text', chr(10), "
    "chr(9), '.globl', chr(9), 'f', cast(doc_id as string), chr(10), "
    "chr(9), '.type', chr(9), 'f', cast(doc_id as string), ', @function', chr(10), "
    "'f', cast(doc_id as string), ':', chr(10), "
    "'.LFB0:', chr(10), "
    "chr(9), '.cfi_startproc', chr(10), "
    "chr(9), 'addi', chr(9), 'sp,sp,-16    # frame', chr(10), "
    "chr(9), 'li', chr(9), 'a0,', cast(n_chars as string), ' ; length', chr(10), "
    "chr(9), 'mv   a1,   a0 // copy', chr(10), "
    "'.L2:', chr(10), "
    "chr(9), 'ret', chr(10), "
    "chr(9), '.size', chr(9), 'f', cast(doc_id as string), ', .-f', cast(doc_id as string), chr(10), "
    "chr(9), '.section', chr(9), '.note.GNU-stack,', chr(34), chr(34), ',@progbits', chr(10))"
)

# Another decompiler's rendering of the same function.
OTHER_TEXT_SQL = (
    "concat('undefined8 FUN_', cast(doc_id as string), '(void)', chr(10), chr(10), '{', chr(10), "
    "'  puts(', chr(34), replace(text, chr(10), ' '), chr(34), ');', chr(10), "
    "'  return ', cast(n_chars as string), ';', chr(10), '}', chr(10))"
)

# A listing page made of a stored page: its own links stand in the lists of a
# category page, in four forms by the page's language: one list; the first link
# in a list of the second kind and the others in one of the first; lists inside
# each other; no list at all. Around it stand links that do not count.
_LANG = "substr(html, instr(html, '<html lang=') + 12, 2)"
_FIRST, _LAST = "instr(html, '<nav><ul>')", "instr(html, '</ul></nav>')"
_ITEMS = f"substr(html, {_FIRST} + 9, {_LAST} - {_FIRST} - 9)"
# the last link of every list: an escape that is none, and bytes that are no UTF-8
BAD_ESCAPES = "/wiki/a%20b%ZZ%E6%97+c"
_BAD = f"'<li><a href=\"{BAD_ESCAPES}\">bad escapes</a></li>'"
_ONE = f"case when instr({_ITEMS}, '</li>') > 0 then instr({_ITEMS}, '</li>') + 4 else 0 end"
LISTING_SQL = (
    f"case when {_FIRST} > 0 and {_LAST} > {_FIRST} then concat(substr(html, 1, {_FIRST} - 1), "
    "'<div class=\"mw-category\"><p><a href=\"/outside\">outside</a></div><div id=mw-pages2><a href=/other>other</a></div>"
    "<div class=\"box\" id=''mw-pages''><!-- <a href=\"/comment\">comment</a> --><p>', "
    f"case {_LANG} when 'en' then concat('<div class=\"mw-category\"><ul>', {_ITEMS}, {_BAD}, '</ul></div><a href=\"/unlisted\">unlisted</a>') "
    f"when 'de' then concat('<div class=mw-category-group><ul>', substr({_ITEMS}, 1, {_ONE}), '</ul></div><div class=\"a mw-category b\"><ul>', "
    f"substr({_ITEMS}, {_ONE} + 1), {_BAD}, '</ul></div>') "
    f"when 'fr' then concat('<div class=\"mw-category\"><div class=\"mw-category-group\"><h3>A</h3><ul>', {_ITEMS}, {_BAD}, '</ul></div></div>') "
    f"else concat('<ul data-href=\"/data\">', {_ITEMS}, {_BAD}, '</ul>') end, "
    "'<a href=\"/Category:C\">C</a><a data-href=\"/x\">x</a><a href=\"#top\">top</a></p></div><a href=\"/after\">after</a>', "
    f"substr(html, {_LAST} + 11)) else html end"
)

STEM_SQL = "concat('doc_', cast(doc_id as string))"

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: tables of whole texts: their work is heavy for their bytes
TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, deal: bool = True) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if deal and name in TEXT_TABLES else df


def in_few_files(spark: SparkSession, sf_dir: str, name: str = "documents") -> bool:
    """Whether a table comes in fewer files than there are cores, so that its rows
    must be dealt for all of them to work. Otherwise a flow whose disk is scarce
    leaves them where they are read: what is dealt lies there too."""
    return len(table(spark, sf_dir, name, deal=False).inputFiles()) < spark.sparkContext.defaultParallelism


def code_files(spark: SparkSession, sf_dir: str, deal: bool = True) -> DataFrame:
    """``(name, path, content, kind)`` — one row per file of the code view. Without
    ``deal``, the rows stay where they are read: for flows that shuffle the texts
    before they work on them."""
    docs = table(spark, sf_dir, "documents", deal).select(*DOC_COLUMNS)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    failed = labels.where("quality = 0").select("doc_id")
    labelled = labels.select("doc_id")

    def files(df: DataFrame, suffix: str, text_sql: str) -> DataFrame:
        # ``kind`` is a literal per branch: suffix filters fold to true/false
        # on it, so Catalyst drops the branches (and their scans) a query
        # cannot use
        name = F.concat(F.expr(STEM_SQL), F.lit(suffix))
        return df.select(name.alias("name"), F.concat(F.lit("corpus/"), name).alias("path"),
                         F.expr(text_sql).alias("content"), F.lit(suffix).alias("kind"))

    return (
        files(docs, ".c", C_TEXT_SQL)
        .unionByName(files(docs.join(failed, "doc_id", "left_anti"), ".s", ASM_TEXT_SQL))
        .unionByName(files(docs.join(labelled, "doc_id", "left_semi"), ".ghidra.c", OTHER_TEXT_SQL))
    )


def code_files_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(name, content)`` of all files of the code view from one scan of the
    documents, for what looks at every kind (:func:`code_files` prunes kinds)."""
    docs = table(spark, sf_dir, "documents").select(*DOC_COLUMNS)
    verdict = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy(F.col("doc_id").alias("l_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 0), F.lit(False)).alias("failed"))
    judged = docs.join(verdict.hint("merge"), F.col("doc_id") == F.col("l_id"), "left")

    def file(suffix: str, text_sql: str, there) -> F.Column:
        return F.when(there, F.struct(F.concat(F.expr(STEM_SQL), F.lit(suffix)).alias("name"), F.expr(text_sql).alias("content")))

    every = F.array(file(".c", C_TEXT_SQL, F.lit(True)), file(".s", ASM_TEXT_SQL, ~F.coalesce("failed", F.lit(False))),
                    file(".ghidra.c", OTHER_TEXT_SQL, F.col("l_id").isNotNull()))
    return judged.select(F.explode(every).alias("f")).where(F.col("f").isNotNull()).select("f.name", "f.content")


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, url, html)``: every stored page as a category page."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.expr(LISTING_SQL).alias("html"))


def reply_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(name, path, content, kind)``, a file set for each user turn of a
    conversation, of whole turns: the turn itself (``.s``), the first reply to it
    (``.c``) and the conversation's next reply after that one (``.ghidra.c``). Every
    user turn and every first reply is a file, and no turn is set against itself."""
    turns = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    conv = Window.partitionBy("conv_id").orderBy("turn")
    ahead = conv.rowsBetween(1, Window.unboundedFollowing)
    before = conv.rowsBetween(Window.unboundedPreceding, -1)
    said = F.col("role") == "assistant"
    # decided on (conv_id, turn, role) alone: no text is sorted
    decided = turns.select("conv_id", "turn", "role").select(
        "conv_id", "turn", "role",
        F.last(F.when(~said, F.col("turn")), ignorenulls=True).over(before).alias("asked"),
        F.lag("role").over(conv).alias("previous"),
        F.first(F.when(said, F.col("turn")), ignorenulls=True).over(ahead).alias("next_reply"))
    first_reply = (F.col("role") == "assistant") & (F.col("previous") == "user")
    sets = decided.where("role = 'user'").select("conv_id", "turn", F.col("turn").alias("asked"), F.lit(".s").alias("kind")).unionByName(
        decided.where(first_reply).select("conv_id", "turn", "asked", F.lit(".c").alias("kind"))).unionByName(
        decided.where(first_reply & F.col("next_reply").isNotNull()).select("conv_id", F.col("next_reply").alias("turn"), "asked", F.lit(".ghidra.c").alias("kind")))
    name = F.concat_ws("_", F.lit("conv"), "conv_id", "asked")
    return sets.join(turns.select("conv_id", "turn", F.col("text").alias("content")), ["conv_id", "turn"]).select(
        F.concat(name, F.col("kind")).alias("name"), F.concat(F.lit("replies/"), name, F.col("kind")).alias("path"), "content", "kind")


def reply_files_sql() -> str:
    """DuckDB text of the same relation, without windows: by comparing turns."""
    turn = "select conv_id, turn, text from conversations where role = "
    reply = ("select u.conv_id, u.turn as asked, min(a.turn) as turn from (" + turn + "'user') u join (" + turn + "'assistant') a "
             "on a.conv_id = u.conv_id and a.turn > u.turn and not exists (select 1 from conversations c where c.conv_id = u.conv_id "
             "and c.role = 'user' and c.turn > u.turn and c.turn < a.turn) group by u.conv_id, u.turn")

    def part(suffix: str, found: str) -> str:
        return (f"select 'conv_' || cast(f.conv_id as varchar) || '_' || cast(f.asked as varchar) || '{suffix}' as name, c.text as content "
                f"from ({found}) f join conversations c on c.conv_id = f.conv_id and c.turn = f.turn")

    later = (f"select r.conv_id, r.asked, min(a.turn) as turn from ({reply}) r join ({turn}'assistant') a on a.conv_id = r.conv_id and a.turn > r.turn "
             "group by r.conv_id, r.asked")
    return " union all ".join([part(".s", turn.replace("turn, text", "turn as asked, turn") + "'user'"), part(".c", reply), part(".ghidra.c", later)])


def code_files_sql() -> str:
    """DuckDB/ANSI text of the same relation, for use as a CTE body."""
    cols = ", ".join(DOC_COLUMNS)

    def part(suffix: str, text_sql: str, where: str) -> str:
        return (
            f"select concat({STEM_SQL}, '{suffix}') as name, concat('corpus/', {STEM_SQL}, '{suffix}') as path, "
            f"{text_sql} as content from (select {cols} from documents) d {where}"
        )

    return " union all ".join([
        part(".c", C_TEXT_SQL, ""),
        part(".s", ASM_TEXT_SQL, "where doc_id not in (select doc_id from labels where quality = 0 and doc_id is not null)"),
        part(".ghidra.c", OTHER_TEXT_SQL, "where doc_id in (select doc_id from labels)"),
    ])
