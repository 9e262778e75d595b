"""File-shaped sources: whole text files keyed by stem, key lists, prompt
tables.

A *files* frame has ``(name, path, content)``. The stem of a file is its
name up to the **last** dot (so ``x.ghidra.c`` has stem ``x.ghidra`` when
looked up by suffix ``.c``), and the lookup helpers take the suffix
explicitly.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import decode_text, strip_ws


def load_text_files(spark: SparkSession, path: str, glob: str | None = None,
                    recursive: bool = False, hidden: bool = False) -> DataFrame:
    """Whole-file text load -> ``(name, path, content)``: bytes decoded as UTF-8
    dropping bad bytes, and universal newlines. ``glob`` is pushed to the file
    listing (``pathGlobFilter``), so unmatched files are never opened. With
    ``recursive`` there is also ``folder``, and pairs are made inside a folder
    only: equal names in two folders are two files. Spark's file listing passes
    over names that begin with ``_`` or ``.``; with ``hidden`` they are read too.

    A folder that the machines see as a local one, whether its address says so
    (``file:``) or Hadoop resolves it so (a plain path), and on other file systems a
    folder that the named-file sink has written, is listed and read in tasks of many
    files each. What is left, and patterns that only Hadoop knows, goes through
    Spark's own source, which lists in the driver and makes a task of every few files:
    the driver's memory then grows with their number."""
    address = path if hidden else _in_tasks(spark, path, glob)
    if address:
        from corpusmill.sinks.named_files import read_files

        found = read_files(spark, address, glob, recursive, hidden)
        return found.select("name", "path", decode_text("content").alias("content"), *(["folder"] if recursive else []))
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.load(path)
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    folder = [F.expr("substring(path, 1, length(path) - length(element_at(split(path, '/'), -1)) - 1)").alias("folder")] if recursive else []
    return df.select(name.alias("name"), F.col("path"), decode_text("content").alias("content"), *folder)


def _in_tasks(spark: SparkSession, path: str, glob: str | None) -> str | None:
    """The address of a folder that can be read without Hadoop, to the same files."""
    if re.search(r"[*?\[\]{}\\]", path) or re.search(r"[{}\\]|\[\^", glob or ""):
        return None
    from pyarrow.fs import FileType

    from corpusmill.sinks.named_files import STAGED, filesystem, qualified

    address = re.sub(r"^file:/+", "file:/", qualified(spark, path))
    try:
        fs, root = filesystem(address)
        # on other file systems, the tasks that wrote the folder had what it takes
        there = fs.get_file_info(root if address.startswith("file:/") else f"{root}/{STAGED}")
    except (OSError, ValueError, NotImplementedError):  # no file system that pyarrow knows
        return None
    return address if there.type == FileType.Directory else None


def stem_of(name) -> F.Column:
    """Name up to the last dot (whole name when there is none)."""
    n = F.col(name) if isinstance(name, str) else name
    ext = F.substring_index(n, ".", -1)
    return F.when(F.instr(n, ".") > 0, F.left(n, F.length(n) - F.length(ext) - 1)).otherwise(n)


def of_suffix(files: DataFrame, suffix: str) -> DataFrame:
    """Files whose name ends with ``suffix`` (all columns kept)."""
    cond = F.col("name").endswith(suffix)
    if "kind" in files.columns:
        cond = F.col("kind").endswith(suffix) & cond
    return files.where(cond)


def with_suffix(files: DataFrame, suffix: str, key: str = "stem", value: str = "content") -> DataFrame:
    """Files ending in ``suffix`` keyed by the name without it (and their folder,
    if they have one)."""
    n = F.col("name")
    cond = n.endswith(suffix)
    if "kind" in files.columns:
        # ``kind`` is the full suffix of each file; when it is a literal per
        # source branch this folds away the branches that cannot match
        cond = F.col("kind").endswith(suffix) & cond
    folder = ["folder"] if "folder" in files.columns else []
    return files.where(cond).select(
        *folder, F.expr(f"substring(name, 1, length(name) - {len(suffix)})").alias(key), F.col(value))


def primary_only(files: DataFrame, derived_suffix: str = ".ghidra.c") -> DataFrame:
    """Drop derived files (another tool's output) from a listing."""
    cond = ~F.col("name").endswith(derived_suffix)
    if "kind" in files.columns:
        cond = ~F.col("kind").endswith(derived_suffix) & cond
    return files.where(cond)


def pair_by_stem(files: DataFrame, src_suffix: str = ".s", tgt_suffix: str = ".c",
                 require_non_empty: bool = False) -> DataFrame:
    """Stems having both suffixes -> ``(stem, src, tgt)``; with a column
    ``folder``, stems of one folder -> ``(folder, stem, src, tgt)``.

    Keyed by Python's stem rule on each suffix, so ``x.ghidra.c`` pairs only
    with ``x.ghidra.s``. One shuffle of each side (an inner equi-join on stem):
    whole texts grow with the corpus, so neither side is ever broadcast on an
    estimate of its size."""
    keys = [c for c in ("folder",) if c in files.columns] + ["stem"]
    src = with_suffix(files, src_suffix, value="content").withColumnRenamed("content", "src")
    tgt = with_suffix(files, tgt_suffix, value="content").withColumnRenamed("content", "tgt")
    pairs = src.join(tgt.hint("merge"), keys, "inner").select(*keys, "src", "tgt")
    if require_non_empty and pairs.isEmpty():
        raise RuntimeError("no (src, tgt) pairs found")
    return pairs


def non_empty_pairs(pairs: DataFrame) -> DataFrame:
    """Keep pairs where both texts are non-empty (tested before any
    normalisation)."""
    return pairs.where((F.col("src") != "") & (F.col("tgt") != ""))


def read_keys(spark: SparkSession, path: str, column: str = "stem") -> DataFrame:
    """Key-list file: one key per line, trimmed, blank lines dropped."""
    df = spark.read.text(path)
    k = strip_ws("value")
    return df.select(k.alias(column)).where(F.col(column) != "")


def parse_problems(df: DataFrame, text_col: str = "value", position_col: str | None = None) -> DataFrame:
    """Prompt-table lines ``"N. statement"`` -> ``(problem_number, text)``.
    With ``position_col`` (the 1-based row position, e.g. from
    ``operators.split.ordinal_rank``) also ``number_matches``: the embedded
    number, compared as text, equals the position."""
    m = F.regexp_extract(F.col(text_col), r"^(\d+)\. ", 1)
    cols = [F.when(m != "", m.cast("int")).alias("problem_number"), F.col(text_col).alias("text")]
    if position_col is not None:
        cols.append((m == F.col(position_col).cast("string")).alias("number_matches"))
    return df.select(*cols)
