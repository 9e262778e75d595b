"""Assembly normal form over a line table (explode + carried-forward section
window + ordered re-assembly).

This is the form to use when lines are already rows (e.g. a line-level
table). For whole files, ``functions.text.normalize_asm_expr`` computes the
same text row-locally with no shuffle and is the default in the plans; this
operator shuffles every line once (window and re-assembly share the key
partitioning).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import (BREAK_RE, _asm_line, _section_from_stripped, join_lines, let,
                                       strip_ws)


def asm_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, pos, line)`` for every line (Python line boundaries)."""
    t = F.regexp_replace(F.col(text), BREAK_RE, "\n")
    return df.select(key, F.posexplode_outer(F.split(t, "\n", -1)).alias("pos", "line")).where(
        F.col("line").isNotNull())


def section_marks(lines: DataFrame, key: str) -> DataFrame:
    """Add ``section``: the section set by the latest ``.section X`` /
    ``.text`` line at or before each line (NULL before any; a ``.section``
    with no valid name resets to NULL)."""
    st = strip_ws("line")
    is_marker = st.startswith(".section") | (st == ".text")
    mark = F.when(is_marker, F.struct(let(st, _section_from_stripped).alias("s")))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("__mark", mark).withColumn(
        "section", F.last("__mark", ignorenulls=True).over(w)["s"]).drop("__mark")


def normalize_asm(df: DataFrame, text: str = "content", key: str = "stem", keep_local_labels: bool = False,
                  out: str = "normalized") -> DataFrame:
    """``(key, out)`` for every row of ``df`` (rows with no kept line get an
    empty string)."""
    marked = section_marks(asm_lines(df, key, text), key)
    kept = marked.select(key, "pos", _asm_line(strip_ws("line"), F.col("section"), keep_local_labels).alias("ln")) \
        .where(F.col("ln").isNotNull())
    assembled = kept.groupBy(key).agg(
        strip_ws(join_lines(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ln"))), lambda s: s["ln"])))
        .alias(out))
    return df.select(key).join(assembled, key, "left").select(key, F.coalesce(F.col(out), F.lit("")).alias(out))
