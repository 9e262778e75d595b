"""Exact, deterministic ranking and the split / batch operators built on it.

A global ``row_number()`` with no partition pulls every row into one task.
``exact_rank`` instead orders keys by ``md5(seed:key)``, splits them into
65,536 hash buckets (first four hex digits), counts each bucket, turns the
<= 65,536 counts into running offsets (a bounded table, broadcast), and ranks
inside each bucket. Nothing runs while the DataFrame is built. The numbers equal the global window's, the work is
spread over all buckets, and the one broadcast has a proven size bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage

def order_hash(key, seed) -> F.Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def exact_rank(df: DataFrame, key: str, seed=42, rank_col: str = "rank",
               bucket_digits: int = 4, with_total: bool = False) -> DataFrame:
    """Add ``rank_col`` = 1-based position of each row in the order
    ``(md5('<seed>:' || key), key)``. Keys should be distinct (ties between
    equal keys are broken arbitrarily). ``bucket_digits`` hex digits give
    ``16**digits`` buckets; the offsets table has at most that many rows."""
    if not 1 <= bucket_digits <= 5:
        raise ValueError("bucket_digits must be in 1..5")
    h = "__h"
    b = "__b"
    # counted before any shuffle (a partial count per task and bucket); the
    # rows themselves move once, to be ranked
    keyed = df.withColumn(h, order_hash(key, seed)).withColumn(
        b, F.conv(F.substring(F.col(h), 1, bucket_digits), 16, 10).cast("int"))
    counts = keyed.groupBy(b).agg(F.count(F.lit(1)).alias("__n"))
    running = Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        b,
        F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__off"),
        F.sum("__n").over(Window.partitionBy(F.lit(1))).alias("__total"),
    )
    # offsets holds one row per non-empty bucket: at most 16**bucket_digits rows.
    ranked = keyed.join(F.broadcast(offsets), b, "inner")
    within = Window.partitionBy(b).orderBy(h, key)
    out = ranked.withColumn(rank_col, F.col("__off") + F.row_number().over(within))
    drop = [h, b, "__off"] + ([] if with_total else ["__total"])
    out = out.drop(*drop)
    if with_total:
        out = out.withColumnRenamed("__total", "n_total")
    return out


def split_cutoffs(n: F.Column, train: float, val: float):
    """``int(n * frac)`` in double arithmetic, as Python computes it."""
    n_train = F.floor(n.cast("double") * F.lit(float(train)).cast("double"))
    n_val = F.floor(n.cast("double") * F.lit(float(val)).cast("double"))
    return n_train, n_val


def split_exact(df: DataFrame, key: str = "stem", train: float = 0.8, val: float = 0.1,
                seed=42, split_col: str = "split", keep_rank: bool = False, materialize: bool = False) -> DataFrame:
    """Seeded exact-count split: the first ``int(n*train)`` keys of the
    seeded order are ``train``, the next ``int(n*val)`` are ``val``, the rest
    ``test``. Keys are de-duplicated first (map-side partial aggregation, so
    a hot key costs nothing extra). ``materialize`` writes the key set to the
    checkpoint folder, for inputs that are dear to read twice (the counts and
    the numbering each read the narrow keys)."""
    keys = df.select(key).where(F.col(key).isNotNull()).dropDuplicates([key])
    if materialize:
        keys = cut_lineage(keys)
    ranked = exact_rank(keys, key, seed, with_total=True)
    n_train, n_val = split_cutoffs(F.col("n_total"), train, val)
    r = F.col("rank")
    split = F.when(r <= n_train, "train").when(r <= n_train + n_val, "val").otherwise("test")
    start = F.when(r <= n_train, 0).when(r <= n_train + n_val, n_train).otherwise(n_train + n_val)
    out = ranked.withColumn(split_col, split).withColumn("split_rank", (r - start).cast("long"))
    cols = [key, split_col] + (["rank", "split_rank", "n_total"] if keep_rank else [])
    return out.select(*cols)


def in_stretch(key, keys: DataFrame, seed=42, key_col: str = "stem") -> F.Column:
    """Whether ``key`` lies from the first to the last of ``keys`` in the seeded
    order: two bounds, a filter that needs no join and drops none of ``keys``. A
    split of :func:`split_exact` is such a stretch, so it passes that split (and
    those between, if ``keys`` are of several) and nothing else. Reads ``keys`` once, when called."""
    first, last = keys.select(order_hash(key_col, seed).alias("h")).agg(F.min("h"), F.max("h")).first()
    return order_hash(key, seed).between(F.lit(first).cast("string"), F.lit(last).cast("string"))


def split_threshold(key, train: float = 0.8, val: float = 0.1, seed=42) -> F.Column:
    """Stateless split for unbounded input: the first 32 bits of the seeded
    md5 as a fraction in [0, 1) against the cut points. Fractions are
    approximate; membership is stable per key."""
    u = F.conv(F.substring(order_hash(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return F.when(u < float(train), "train").when(u < float(train) + float(val), "val").otherwise("test")


def assign_batches(df: DataFrame, order_col: str, size: int, group_cols=(), batch_col: str = "batch_id") -> DataFrame:
    """Fixed-size batches in order: ``floor((order - 1) / size)`` where
    ``order_col`` is a 1-based exact rank (within ``group_cols``)."""
    if size < 1:
        raise ValueError("batch size must be >= 1")
    return df.withColumn(batch_col, F.floor((F.col(order_col) - 1) / F.lit(size)).cast("long"))


def pick_one(df: DataFrame, key: str, seed=0) -> DataFrame:
    """One seeded pseudo-random row (a top-1 by hash: no full sort)."""
    return df.orderBy(order_hash(key, seed), F.col(key)).limit(1)


def ordinal_rank(df: DataFrame, order_cols: list[str], rank_col: str = "rank",
                 partitions: int | None = None) -> DataFrame:
    """1-based position in the natural order of ``order_cols`` (a total
    order), without a one-task window.

    The order columns alone are range-partitioned on the **whole** sort key (so
    one hot value of the first column is still split by the others), sorted
    within partitions and written once to the checkpoint folder; the other
    columns are joined back on them. The written
    partitions have a fixed content and order, so each row's index within
    its partition is deterministic. Per-partition counts (one row per
    partition, a bounded table) become broadcast offsets."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    wide = len(df.columns) > len(order_cols)
    keys = df.select(*order_cols)
    ordered = cut_lineage(keys.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols))
    mid = ordered.withColumn("__m", F.monotonically_increasing_id())
    part = F.shiftright(F.col("__m"), 33)
    idx = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    mid = mid.withColumn("__p", part).withColumn("__i", idx)
    counts = mid.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    running = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__p", F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__off"))
    # offsets: one row per partition
    ranked = (mid.join(F.broadcast(offsets), "__p", "inner")
              .withColumn(rank_col, F.col("__off") + F.col("__i") + 1)
              .drop("__m", "__p", "__i", "__off"))
    if not wide:
        return ranked
    named = ranked.withColumnsRenamed({c: f"__o_{c}" for c in order_cols})
    same = None
    for c in order_cols:
        eq = F.col(c).eqNullSafe(F.col(f"__o_{c}"))
        same = eq if same is None else same & eq
    return df.join(named, same, "inner").drop(*[f"__o_{c}" for c in order_cols])
