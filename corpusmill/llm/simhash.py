"""SimHash near-duplicates, candidates filtered on a pigeonring.

The fingerprint is cut into ``max_bits + 1`` segments that form a ring. If two
fingerprints differ in at most ``max_bits`` bits, then by the pigeonring
principle some segment starts a chain in which the first ``l`` consecutive
segments together differ in at most ``l * max_bits / (max_bits + 1)`` bits,
for every ``l``: with four segments and three bits 0, 1, 2 and 3. So the
first segment of that chain is equal, and the second differs in one bit at
most, which leaves one of its halves equal. First segment and half are the
join key (24 of 64 bits instead of the pigeonhole's 16); pairs that meet must
pass the whole chain before the full Hamming distance is taken.

Only distinct fingerprints are joined, so copies never multiply. Keys and
checks are expressions on long integers; Python (numpy, in Arrow batches)
computes the fingerprints alone, in blocks of bounded size for texts of any
length.

Defined results: null, empty and blank texts have fingerprint zero and are
linked like any other. Rows that agree in id and text are ties with one
result. Null ids count as larger than all others: a component without any
other id has a null ``component_id``. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh, table, text_key, written
from corpusmill.llm.graph import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
_BLOCK = 65_536  # shingles whose bits are counted at once


def _bit_counts(hashes: Iterator[int], left: int) -> np.ndarray:
    counts = np.zeros(64, np.int64)
    while left:
        block = np.fromiter(hashes, np.uint64, min(left, _BLOCK))
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        left -= len(block)
    return counts


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text in UTF-8."""
    words = (text or b"").lower().split()  # both of bytes: A-Z and ASCII blanks alone
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    over = _bit_counts(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), n) * 2 > n
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(id, th, fp): fp as a signed long, th the key of the text."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["id", "th", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("th"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, th long, fp long")


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment of the ring."""
    m = max_bits + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _field(x: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << width) - 1))


def _keys(fp: Column, max_bits: int) -> Column:
    """One key for each chain start and each half of the segment after it."""
    seg, out = _segments(max_bits), []
    for i, (low, width) in enumerate(seg):
        low2, width2 = seg[(i + 1) % len(seg)]
        h = width2 // 2
        for half, (l2, w2) in enumerate(((low2, h), (low2 + h, width2 - h))):
            out.append(F.struct(F.lit(2 * i + half).alias("start"),
                                F.shiftleft(_field(fp, low, width), 32).bitwiseOR(_field(fp, l2, w2)).alias("key")))
    return F.explode(F.array(*out))


def _chain(x: Column, start: Column, max_bits: int) -> Column:
    """Whether the differing bits ``x`` stay within budget along the ring."""
    seg, per_start = _segments(max_bits), []
    m = len(seg)
    for i in range(m):
        total, ok = F.lit(0), F.lit(True)
        for step in range(m):
            total = total + F.bit_count(_field(x, *seg[(i + step) % m]))
            ok = ok & (total <= (step + 1) * max_bits // m)
        per_start.append(ok)
    return F.element_at(F.array(*per_start), (F.floor(start / 2) + 1).cast("int"))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints that differ in ``max_bits`` bits
    or fewer; ``fps`` has a distinct long column ``fp``."""
    if not 1 <= max_bits <= 15:
        raise ValueError("max_bits must be 1 to 15")
    keyed = written(fps.select("fp", _keys(F.col("fp"), max_bits).alias("k")).select("fp", "k.start", "k.key"), "keys")
    one, two = keyed.withColumnRenamed("fp", "a"), keyed.withColumnRenamed("fp", "b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    return one.join(two, ["start", "key"]).where("a < b").where(_chain(x, F.col("start"), max_bits)).where(
        F.bit_count(x) <= max_bits).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(id, th, fp, component_id) for every row."""
    rows = written(fingerprints(docs, text_col, id_col, shingle), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(fps.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    linked = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    known = written(linked.join(least, "root").select("fp", "component_id"), "components")
    return rows.join(known, "fp").select("id", "th", "fp", "component_id")


def representatives(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """The one row of each component that stays, with all its columns: the one
    with the component's id (of several, that with the smallest text key; of
    equal rows, any; null ids go unless their component has no other)."""
    d = near_duplicates(docs, text_col, id_col, shingle, max_bits)
    # without any id, the component's smallest fingerprint tells components apart
    first = d.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy(
        "component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")).agg(F.min("th").alias("th"))
    i, h, k = (fresh(docs, n) for n in ("rid", "rth", "key"))
    keep = first.select(F.col("component_id").alias(i), F.col("th").alias(h))
    keyed = docs.withColumn(k, text_key(F.col(text_col)))
    kept = keyed.join(keep, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(k) == F.col(h)), "left_semi")
    return kept.dropDuplicates([id_col, k]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    d = near_duplicates(table(spark, sf_dir, "documents"))
    return d.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
