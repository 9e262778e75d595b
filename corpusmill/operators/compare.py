"""System comparison: key joins across file kinds, per-system similarity,
per-system means and candidate ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.files import with_suffix


def join_systems(files: DataFrame, keys: DataFrame | None = None, key: str = "stem",
                 **suffixes: str) -> DataFrame:
    """Inner-join one column per named suffix on the file stem, e.g.
    ``join_systems(files, truth='.c', asm='.s', other='.ghidra.c')``.
    With ``keys`` (a key list), only those keys are looked up; keys missing
    any file are silently dropped (see :func:`missing_kinds` for the report).
    """
    out = keys.select(key).dropDuplicates([key]) if keys is not None else None
    for col, suffix in suffixes.items():
        part = with_suffix(files, suffix, key=key, value="content").withColumnRenamed("content", col)
        # whole texts: no side may be broadcast on an estimate
        out = part if out is None else out.join(part.hint("merge"), key, "inner")
    return out


def missing_kinds(files: DataFrame, keys: DataFrame, key: str = "stem", **suffixes: str) -> DataFrame:
    """Report of keys lacking at least one kind: ``(key, missing array)``,
    the kinds listed in the order given."""
    out = keys.select(key).dropDuplicates([key])
    flags = []
    for col, suffix in suffixes.items():
        present = with_suffix(files, suffix, key=key, value="name") \
            .select(key).dropDuplicates([key]).withColumn(f"__has_{col}", F.lit(True))
        out = out.join(present, key, "left")
        flags.append(F.when(F.col(f"__has_{col}").isNull(), F.lit(suffix)))
    missing = F.filter(F.array(*flags), lambda x: x.isNotNull())
    return out.select(key, missing.alias("missing")).where(F.size("missing") > 0)


def system_means(scored: DataFrame, system_col: str = "system", score_col: str = "similarity",
                 digits: int | None = None) -> DataFrame:
    """Mean score and sample count per system. A system with no scored row
    has no output row (nothing to report)."""
    mean = F.avg(score_col)
    if digits is not None:
        mean = F.round(mean, digits)
    return scored.groupBy(system_col).agg(F.count(F.lit(1)).alias("n_samples"), mean.alias("mean_similarity"))


def stack_systems(df: DataFrame, key: str, score_cols: dict[str, str], system_col: str = "system",
                  score_col: str = "similarity") -> DataFrame:
    """Wide per-key scores -> long ``(key, system, score)`` rows without a
    second scan (one generator, no union)."""
    pairs = F.array(*[F.struct(F.lit(name).alias(system_col), F.col(c).cast("double").alias(score_col))
                      for name, c in score_cols.items()])
    return df.select(key, F.inline(pairs))


def rank_candidates(scored: DataFrame, key: str = "stem", candidate: str = "candidate",
                    score: str = "loss", lower_is_better: bool = True) -> DataFrame:
    """Mean score per (key, candidate) and its rank within the key."""
    agg = scored.groupBy(key, candidate).agg(F.avg(score).alias(f"mean_{score}"))
    order = F.col(f"mean_{score}").asc() if lower_is_better else F.col(f"mean_{score}").desc()
    return agg.withColumn("rank", F.rank().over(Window.partitionBy(key).orderBy(order)))
