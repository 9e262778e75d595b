"""Collision-safe naming of harvested files (a sequential rule re-expressed
as grouped set operations) and "skip what already exists".

Rule, per base name (``safe_filename(title)``), in arrival order:

* base not on disk: the first arrival writes it (``written``);
* otherwise an arrival whose content hash equals the **base** file's hash is
  ``skipped-same`` (suffixed copies are never compared);
* every other arrival takes the first free ``<stem>__<i><ext>``,
  ``i = 2, 3, …`` (names already on disk are not free, gaps are) —
  ``written-suffixed``; with ``max_suffix`` and none left -> ``conflict``.

Content is ``rstrip('\\n') + '\\n'`` and is hashed with sha256. Slot names that
are themselves the base name of some arrival or existing file are treated as
taken, so a title such as ``Foo__2`` never shares a file with ``Foo``'s
colliders (the sequential original would let order decide).

Scale: the slots of a base are never made. Its taken numbers and its colliders
are merged into one order in which a taken number stands behind as many colliders
as there are free numbers below it: the place in that order is the number. Per-base
values are plain aggregates (partial aggregation, so one base holding a third of
all rows costs one partial row per task). With ``max_suffix`` no base has more than
that many colliders to place (a map-side group limit) and those beyond are
conflicts. Without it, places are numbered over ranges of (base, arrival), so that
a base with very many colliders is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import safe_filename
from corpusmill.operators.split import ordinal_rank
from corpusmill.session import stored


def skip_existing(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not already produced (left anti join)."""
    return df.join(existing.select(key).dropDuplicates([key]), key, "left_anti")


def _canonical(code: str) -> F.Column:
    return F.concat(F.regexp_replace(F.col(code), r"\n+\z", ""), F.lit("\n"))


def assign_names(arrivals: DataFrame, existing: DataFrame | None = None, arrival: str = "arrival",
                 title: str = "title", code: str = "code", ext: str = ".c", max_chars: int | None = None,
                 max_suffix: int | None = None, with_content: bool = True) -> DataFrame:
    """``arrivals(arrival, title, code)`` + ``existing(name, content)`` ->
    ``(arrival, title, base, name, status[, content])``; ``name`` is NULL for
    ``skipped-same`` rows and the base name for ``conflict`` rows.

    The decision works on a narrow keyed table ``(arrival, title, base,
    hash)`` written once to the checkpoint folder (it is read by several
    branches); the canonical content is joined back only when asked for."""
    spark = arrivals.sparkSession
    if existing is None:
        existing = spark.createDataFrame([], "name string, content string")
    a = stored(arrivals.select(
        F.col(arrival).alias("arrival"), F.col(title).alias("title"),
        safe_filename(title, ext, max_chars).alias("base"),
        F.sha2(_canonical(code), 256).alias("hash")), "arrivals")
    ex = existing.select(F.col("name").alias("base"), F.sha2(F.col("content"), 256).alias("ex_hash"))

    # per base: hash of the file at the base name, and who writes it if new
    blank = {"arrival": a.schema["arrival"].dataType, "hash": "string"}
    both = a.select("base", "arrival", "hash", F.lit(None).cast("string").alias("ex_hash")).unionByName(
        ex.select("base", *[F.lit(None).cast(t).alias(c) for c, t in blank.items()], "ex_hash"))
    per_base = both.groupBy("base").agg(F.min("arrival").alias("first_arrival"), F.min_by("hash", "arrival").alias("first_hash"),
                                        F.max("ex_hash").alias("ex_hash"))
    at = a.join(per_base, "base")
    writes_base = F.col("ex_hash").isNull() & (F.col("arrival") == F.col("first_arrival"))
    same = F.col("hash") == F.coalesce("ex_hash", "first_hash")
    at = at.withColumn("decided", F.when(writes_base, "written").when(same, "skipped-same"))

    colliders = _placed(at.where(F.col("decided").isNull()).select("base", "arrival"), ["arrival"], "v", max_suffix)
    if max_suffix is not None:
        colliders = colliders.where(F.col("v") < max_suffix)  # a map-side group limit
    # numbers that are taken: free numbers below the j-th one (from 0) are i - 2 - j
    suffixed = f"^(.*)__([1-9][0-9]{{0,17}})({_re_escape(ext)})$"
    number = F.regexp_extract("slot", suffixed, 2).cast("long")
    slots = ex.select(F.col("base").alias("slot")).unionByName(a.select(F.col("base").alias("slot"))).where(F.col("slot").rlike(suffixed))
    taken = slots.select(F.regexp_replace("slot", suffixed, "$1$3").alias("base"), number.alias("i")).where("i >= 2").distinct()
    if max_suffix is not None:
        taken = taken.where(F.col("i") <= max_suffix)
    below = _placed(taken, ["i"], "j", max_suffix).select("base", (F.col("i") - 1 - F.col("j")).alias("v"), F.lit(1).alias("kind"), "i",
                                                           F.lit(None).cast(blank["arrival"]).alias("arrival"))
    merged = colliders.select("base", F.col("v").cast("long").alias("v"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("i"), "arrival").unionByName(below)
    numbered = _placed(merged, ["v", "kind", "i"], "place", max_suffix).where("kind = 0").select(
        F.col("arrival").alias("c_arrival"), (F.col("place") + 1).alias("number"))
    if max_suffix is not None:
        numbered = numbered.where(F.col("number") <= max_suffix)

    stem = F.regexp_replace(F.col("base"), F.lit(f"{_re_escape(ext)}$"), F.lit(""))
    slot = F.concat(stem, F.lit("__"), F.col("number").cast("string"), F.lit(ext))
    name = F.when(F.col("decided") == "skipped-same", None).when(F.col("number").isNotNull(), slot).otherwise(F.col("base"))
    status = F.coalesce("decided", F.when(F.col("number").isNotNull(), "written-suffixed").otherwise("conflict"))
    out = at.join(numbered, F.col("arrival") == F.col("c_arrival"), "left").select("arrival", "title", "base", name.alias("name"), status.alias("status"))
    if with_content:
        out = out.join(arrivals.select(F.col(arrival).alias("arrival"), _canonical(code).alias("content")),
                       "arrival", "inner")
    return out


def _placed(df: DataFrame, order: list[str], out: str, bound: int | None) -> DataFrame:
    """Number the rows of each base from 1 in the order given: by a window if few
    rows of a base are wanted, else over ranges of (base, order)."""
    if bound is not None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy("base").orderBy(*order)))
    ranked = ordinal_rank(df, ["base", *order], "__r")
    first = ranked.groupBy(F.col("base").alias("__b")).agg(F.min("__r").alias("__first"))
    return ranked.join(first, F.col("base") == F.col("__b")).withColumn(out, F.col("__r") - F.col("__first") + 1).drop("__r", "__b", "__first")


def _re_escape(s: str) -> str:
    return "".join("\\" + ch if ch in ".^$*+?()[]{}|\\" else ch for ch in s)
