"""Optimal length buckets and token-budget batches.

Texts of a batch are padded to their bucket's length. Dynamic programming
over the global histogram of lengths chooses the bucket boundaries that
minimise the padding of all texts together. The histogram has one bin per
length below ``EXACT`` and 128 bins per doubling above, each with its count,
its sum and its largest length: at most 7,400 bins for any corpus, which is
all that the driver sees. (Boundaries are lengths that occur. The result is
the optimum over boundaries between bins, so the optimum as long as no two
lengths share a bin.)

Inside a bucket, texts are numbered in the order of a hash of their id, and
each run of ``budget // length`` texts (one at least: a text longer than the
budget is a batch of its own, never cut) is a batch. Numbering needs no global
sort: the leading digits of the hash deal each bucket to as many groups as its
rows ask for, counts per group give the offsets, and rows are numbered within
groups. So a bucket with most of the rows is no hot key.

Defined results: null and empty texts have no tokens and join the first
bucket. Null ids are numbered like others. Repeated rows get a place each.
An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import table, written

BUCKETS = 16
BUDGET = 8192
EXACT = 256
_GROUP_ROWS = 50_000


def n_tokens(text: Column) -> Column:
    """Words between ASCII blanks; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _bin(n: Column) -> Column:
    """The length itself below EXACT, above with its eight leading bits."""
    low = F.pow(F.lit(2.0), F.length(F.bin(n)) - 8)  # powers of two are exact
    return F.when(n < EXACT, n).otherwise((F.floor(n / low) * low).cast("long"))


@dataclass
class Buckets:
    length: list[int]  # largest length of each bucket, increasing
    rows: list[int]
    padding: int


def optimal(most: np.ndarray, rows: np.ndarray, total: np.ndarray, buckets: int) -> Buckets:
    """Split bins (in order; largest length, rows and tokens of each) into at
    most ``buckets`` runs such that padding is least; of equals, the split
    whose last bucket starts first."""
    n = len(most)
    count, tokens = np.r_[0, np.cumsum(rows)], np.r_[0, np.cumsum(total)]
    cost = np.r_[0, np.full(n, np.iinfo(np.int64).max // 4)]
    came: list[np.ndarray] = []
    for _ in range(min(buckets, n)):
        now, back = np.full(n + 1, np.iinfo(np.int64).max // 4), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            all_ = cost[:j] + most[j - 1] * (count[j] - count[:j]) - (tokens[j] - tokens[:j])
            back[j] = all_.argmin()
            now[j] = all_[back[j]]
        cost = now
        came.append(back)
    ends, j = [], n
    for back in reversed(came):
        ends.append(j)
        j = int(back[j])
    ends = [0, *ends[::-1]]
    return Buckets([int(most[e - 1]) for e in ends[1:]], [int(count[b] - count[a]) for a, b in zip(ends, ends[1:])], int(cost[n]) if n else 0)


def length_buckets(lengths: DataFrame, buckets: int = BUCKETS) -> Buckets:
    """``lengths`` has a long column ``n_tokens``, one row per text."""
    n = F.col("n_tokens")
    bins = lengths.groupBy(_bin(n).alias("bin")).agg(F.max(n).alias("most"), F.count(n).alias("rows"), F.sum(n).alias("total"))
    h = np.array([tuple(r) for r in bins.select("most", "rows", "total").orderBy("bin").collect()], np.int64).reshape(-1, 3)
    return optimal(h[:, 0], h[:, 1], h[:, 2], buckets)


def packed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket (from 0), bucket_tokens
    (the padded length), batch_id (from 0, in the order of buckets), slot (from
    0, within the batch)."""
    rows = written(docs.select(F.col(id_col).alias("doc_id"), n_tokens(F.col(text_col)).alias("n_tokens"),
                               F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("hash")), "lengths")
    plan = length_buckets(rows, buckets)
    if not plan.rows:
        return rows.select("doc_id", "n_tokens", *[F.lit(0).cast(t).alias(c) for c, t in (("bucket", "int"), ("bucket_tokens", "long"), ("batch_id", "long"), ("slot", "long"))])
    each = [max(1, budget // max(1, n)) for n in plan.length]
    before = np.r_[0, np.cumsum([-(-r // e) for r, e in zip(plan.rows, each)])].tolist()

    def of(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("bucket") + 1)

    bucket = F.lit(0)
    for n in plan.length[:-1]:  # as many comparisons as boundaries
        bucket = bucket + (F.col("n_tokens") > n).cast("int")
    digits = max(1, math.ceil(math.log(max(1, sum(plan.rows) / _GROUP_ROWS), 16)))
    dealt = rows.withColumn("bucket", bucket).withColumn("group", F.substring("hash", 1, digits))
    counts = dealt.groupBy("bucket", "group").agg(F.count(F.lit(1)).alias("rows"))
    offsets = counts.select(F.col("bucket").alias("b"), F.col("group").alias("g"), F.coalesce(F.sum("rows").over(
        Window.partitionBy("bucket").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("bucket", "group").orderBy("hash", "doc_id", "n_tokens")) - 1
    ranked = dealt.withColumn("within", within).join(offsets, (F.col("bucket") == F.col("b")) & (F.col("group") == F.col("g"))).withColumn(
        "rank", F.col("offset") + F.col("within"))
    return ranked.select("doc_id", "n_tokens", "bucket", of(plan.length).alias("bucket_tokens"),
                         (of(before) + F.floor(F.col("rank") / of(each))).alias("batch_id"), (F.col("rank") % of(each)).alias("slot"))


def op2_length_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def oracle(buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """The dynamic program as a recursive query, the numbering as a window."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS hash,
         CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS n
  FROM documents
),
b AS (SELECT *, CASE WHEN n < {EXACT} THEN n ELSE (n >> (length(bin(n)) - 8)) << (length(bin(n)) - 8) END AS bin FROM d),
h AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY bin) AS j, max(n) AS most, sum(count(*)) OVER (ORDER BY bin) AS c, sum(sum(n)) OVER (ORDER BY bin) AS s
  FROM b GROUP BY bin
),
dp AS (
  SELECT 1 AS k, j, CAST(most * c - s AS BIGINT) AS cost, [most] AS cuts FROM h
  UNION ALL
  SELECT k, j, min(cost) AS cost, arg_min(cuts, {{'c': cost, 'i': i}}) AS cuts FROM (
    SELECT dp.k + 1 AS k, z.j, a.j AS i, CAST(dp.cost + z.most * (z.c - a.c) - (z.s - a.s) AS BIGINT) AS cost, list_append(dp.cuts, z.most) AS cuts
    FROM dp JOIN h a ON a.j = dp.j JOIN h z ON z.j > a.j WHERE dp.k < {buckets}) GROUP BY k, j
),
best AS (SELECT cuts FROM dp WHERE j = (SELECT max(j) FROM h) AND k = (SELECT least({buckets}, count(*)) FROM h)),
p AS (SELECT doc_id, n, hash, len(list_filter(cuts, lambda x: x < n)) AS bucket, cuts FROM d, best),
r AS (
  SELECT *, cuts[bucket + 1] AS most, greatest(1, {budget} // greatest(1, cuts[bucket + 1])) AS each,
         row_number() OVER (PARTITION BY bucket ORDER BY hash, doc_id, n) - 1 AS rank
  FROM p
),
o AS (SELECT bucket AS ob, sum((count(*) + max(each) - 1) // max(each)) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r GROUP BY bucket)
SELECT doc_id, n AS n_tokens, CAST(bucket AS INTEGER) AS bucket, CAST(most AS BIGINT) AS bucket_tokens,
       CAST(coalesce(before, 0) + rank // each AS BIGINT) AS batch_id, CAST(rank % each AS BIGINT) AS slot
FROM r JOIN o ON ob = bucket
"""
