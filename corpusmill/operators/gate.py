"""Gating a corpus by an external step's result (a compiler run): path
containment, success rule, error text, survivors / rejects and log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import one_line, truncate_info


def is_safe_child(path, parent: str) -> Column:
    """Lexical, component-wise containment: ``path`` is ``parent`` or lies
    under ``parent/``."""
    p = F.col(path) if isinstance(path, str) else path
    root = parent.rstrip("/")
    return (p == F.lit(root)) | p.startswith(root + "/")


def with_suffix_path(path, new_suffix: str) -> Column:
    """Replace the last suffix of the file name (``x.c`` -> ``x.s``)."""
    p = F.col(path) if isinstance(path, str) else path
    return F.concat(F.regexp_replace(p, r"(?<=[^/])\.[^./]*\z", ""), F.lit(new_suffix))


def gate(sources: DataFrame, results: DataFrame, key: str = "stem", path: str = "path",
         parent: str | None = None, max_info: int | None = None) -> DataFrame:
    """Join sources with per-source results ``(key, returncode, stderr,
    asm)`` and decide: ``ok`` = return code 0 **and** output present;
    ``info`` = the output name on success, else the stripped error text
    (``unknown compile error`` when empty; with ``max_info``, cut at so many
    characters); ``log_line`` in the ok / failed log format. A source without
    a result stays, with ``status`` ``no result`` (others: ``compiled``,
    ``failed``). Sources outside ``parent`` are dropped."""
    src = sources
    if parent is not None:
        src = src.where(is_safe_child(path, parent))
    j = src.join(results, key, "left")
    ok = F.coalesce((F.col("returncode") == 0) & F.col("asm").isNotNull(), F.lit(False))
    name = F.element_at(F.split(F.col(path), "/"), -1)
    info = F.when(ok, F.concat(name, F.lit(" -> "), F.element_at(F.split(with_suffix_path(path, ".s"), "/"), -1))) \
        .when(F.col("returncode").isNull(), F.lit("no result")).otherwise(truncate_info("stderr", max_info))
    status = F.when(F.col("ok"), "compiled").when(F.col("returncode").isNull(), "no result").otherwise("failed")
    out = j.withColumn("ok", ok).withColumn("info", info).withColumn("status", status)
    log = F.when(F.col("ok"), F.concat(F.col(path), F.lit(" -> "), with_suffix_path(path, ".s"))) \
        .when(F.col("status") == "no result", F.concat(F.col(path), F.lit(" :: no result"))) \
        .otherwise(F.concat(F.col(path), F.lit(" (deleted) :: "), one_line("info")))
    return out.withColumn("log_line", log)


def survivors(gated: DataFrame) -> DataFrame:
    return gated.where("ok")


def rejects(gated: DataFrame) -> DataFrame:
    """Failed sources and those without a result (see ``status``)."""
    return gated.where("not ok")
