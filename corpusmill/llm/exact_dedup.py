"""Exact de-duplication in two passes over a Bloom filter, in DataFrame
operations only.

Pass 1 reads the texts once and keeps (id, digest) per row. Every digest
fills ``HASHES`` slots of one Bloom filter with saturating counters; a slot
is *shared* when two rows or more fill it. The shared slots are the filter
that pass 2 broadcasts, as bitmaps of 4 KB. Its size is bounded by
``max_filter_bits`` whatever the input, and it grows with the row count up to
that bound.

Pass 2 tests every row. A row with a slot nobody shares is the only row of
its text and passes straight through. Only the rest ("possibly repeated")
shuffle, first as partial counts per digest, then joined to the group's
decision. A false positive costs one shuffled row and nothing else, so the
result is exact for every filter size; beyond the bound more rows shuffle.

Defined results: null text counts as empty. Null ids sort last: they are kept
only if their group has no other id. Rows that agree in id and text are ties;
exactly one of them is kept. Empty tables give no rows. Columns named like an
output do no harm: decisions read the id and the text alone, and
:func:`deduplicated` returns the columns of its input unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import BLANKS, fresh, table, written

HASHES = 2
BITS_PER_ROW = 16
#: 32 MB of bitmaps at most are broadcast
MAX_FILTER_BITS = 1 << 28
_BUCKET = 32_768  # bits of one bitmap, as bitmap_construct_agg makes it


def text_digest(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the text, each run of ASCII blanks being
    one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ").cast("binary"), 256)


def _slot(digest: Column, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(i)), F.lit(bits))


def filter_bits(rows: int, most: int = MAX_FILTER_BITS) -> int:
    bits = _BUCKET
    while bits < BITS_PER_ROW * rows and bits < most:
        bits *= 2
    return bits


def repeated_slots(digests: DataFrame, bits: int) -> DataFrame:
    """Pass 1: bitmaps (bucket, bits) of the slots that two rows or more fill.
    At most ``bits / 32768`` rows of 4 KB."""
    slots = digests.select(F.explode(F.array(*[_slot(F.col("digest"), i, bits) for i in range(HASHES)])).alias("slot"))
    shared = slots.groupBy("slot").count().where("count > 1")
    return shared.groupBy(F.expr(f"slot div {_BUCKET}").alias("bucket")).agg(
        F.expr(f"bitmap_construct_agg(slot % {_BUCKET})").alias("bits"))


def _bit(bits: Column, slot: Column) -> Column:
    """Whether the slot's bit is set in its bucket's bitmap (null: no bitmap)."""
    at = F.pmod(slot, F.lit(_BUCKET))
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.floor(byte / F.pow(F.lit(2.0), at % 8)) % 2 == 1, F.lit(False))


def maybe_repeated(rows: DataFrame, filt: DataFrame, bits: int, digest: str, flag: str) -> DataFrame:
    """Pass 2: add ``flag``, false only if no other row has the digest. The
    filter is broadcast (its bound: ``MAX_FILTER_BITS / 8`` bytes)."""
    cols, out, tests = rows.columns, rows, []
    for i in range(HASHES):
        b = F.broadcast(filt.select(F.col("bucket").alias(f"{flag}_b{i}"), F.col("bits").alias(f"{flag}_m{i}")))
        slot = _slot(F.col(digest), i, bits)
        out = out.join(b, F.floor(slot / _BUCKET) == F.col(f"{flag}_b{i}"), "left")
        tests.append(_bit(F.col(f"{flag}_m{i}"), slot))
    flagged = tests[0]
    for t in tests[1:]:
        flagged = flagged & t
    return out.select(*[F.col(f"`{c}`") for c in cols], flagged.alias(flag))


def _filtered(digests: DataFrame, most: int) -> tuple[DataFrame, int]:
    bits = filter_bits(digests.count(), most)
    return written(repeated_slots(digests, bits), "bloom"), bits


def decisions(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
              max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    narrow = written(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"),
                                 F.monotonically_increasing_id().alias("row")), "digests")
    filt, bits = _filtered(narrow, max_filter_bits)
    tested = maybe_repeated(narrow, filt, bits, "digest", "maybe")
    straight = tested.where(~F.col("maybe")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    shuffled = tested.where("maybe")
    # written first: AQE splits a hot digest only if the join reads both of its
    # sides straight from a shuffle
    groups = written(shuffled.groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("first")), "groups")
    decided = shuffled.join(groups, "digest").select(
        "id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "digest")
    return straight.unionByName(decided).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def deduplicated(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                 max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """The rows that stay, with all columns of ``docs``. Rows that the filter
    knows to be single do not shuffle; of the rest, the group's smallest id is
    found on (id, digest) alone and a key of both picks the row, so a hot text
    is never one key of whole rows."""
    d, m = fresh(docs, "digest"), fresh(docs, "maybe")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    narrow = written(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest")), "digests")
    filt, bits = _filtered(narrow, max_filter_bits)
    first = maybe_repeated(narrow, filt, bits, "digest", "maybe").where("maybe").groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("last"), "id")).alias("first")).select(
        F.col("digest").alias(f"{d}_g"), F.col("first.id").alias(f"{d}_id"))
    tested = maybe_repeated(docs.withColumn(d, text_digest(F.col(text_col))), filt, bits, d, m)
    picked = tested.where(F.col(m)).join(
        first, (F.col(d) == F.col(f"{d}_g")) & F.col(id_col).eqNullSafe(F.col(f"{d}_id")), "left_semi")
    # ties (same id, same text): dropDuplicates combines on the map side
    return tested.where(~F.col(m)).select(*cols).unionByName(
        picked.dropDuplicates([d, id_col]).select(*cols))


def op9_bloom_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return decisions(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""
