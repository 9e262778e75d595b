"""Ranked lexical search as a dual-tree search.

An item's coordinates are ``w * repeats`` for each of its terms, a document's
``(10**9 * tf) div (1000 * tf + 12 * m)``; the score is their inner product. All
coordinates are whole and not negative, so with the maximum of each coordinate
over a node's members, the inner product of an item node's and a document node's
maxima is no less than the score of any pair below them. If it is less than the
weakest ``k``-th score of the node's items, the whole batch of pairs goes,
exactly; pairs that could tie stay.

Items are taken in blocks of bounded size, the stated query set, and each block
meets all documents:

1. One pass reads the whole texts and keeps, for each document, its number of
   terms and the block's terms in it, written to the shared folder. ``N``, ``L``
   and ``df`` are aggregates of that table.
2. Documents stay in the task that reads them, ``DOC_BLOCK`` at a time. Each
   block of documents gets its own hierarchy (median splits between two far
   documents, down to ``DOC_LEAF``), so does the block of items, and both are
   descended together, level by level. Leaf pairs that are left are scored, the
   best bounds first, which raises the ``k``-th scores the next bounds must reach.
3. A first wave of about the square root of all blocks gives every item a score
   that ``k`` documents reach; the second wave, all the others, starts from it.
   So blocks return few rows, and a window takes the ``k`` best of them.

Nothing but the items of a block, their terms and a number for each goes through
the driver.

Defined results: a null or empty text has no terms: it counts nowhere and scores
nothing. Rows are documents, so rows with equal ids are ranked side by side; a
null id comes after all others among equal scores. Items that agree in id and
text are one; items of one id and several texts are ranked apart. Very long
texts are read whole, in slices. Tables without rows, and items without a term,
give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import BLOCK, table, written

K = 20
ITEM_BLOCK = 512  # items that are searched together
ITEM_CHARS = 1 << 22  # and their characters, on average
DOC_BLOCK = 2048
DOC_TERMS = 1 << 22  # (document, term) pairs of a block of documents
ITEM_LEAF = 1
DOC_LEAF = 4
LEAVES = 32  # document leaves that are scored at once
_NO_ID = np.iinfo(np.int64).max  # stands for a null id: last among ties

#: bytes that end a term become a blank, A-Z become small; all others stay
_FOLD = bytes(x if x >= 0x80 or 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A else x + 32 if 0x41 <= x <= 0x5A else 0x20 for x in range(256))


def term_counts(text: bytes | None) -> Counter:
    """Terms of a text (UTF-8) with their numbers."""
    folded, counts, at = (text or b"").translate(_FOLD), Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + BLOCK) if at + BLOCK < len(folded) else -1
        end = len(folded) if end < 0 else end
        counts.update(folded[at:end].split())
        at = end
    return counts


class Rows:
    """Sparse rows: the coordinates of row i are ``at[i]:at[i + 1]``."""

    def __init__(self, at, cols, vals):
        self.at, self.cols, self.vals = np.asarray(at, np.int64), np.asarray(cols, np.int64), np.asarray(vals, np.float64)

    def __len__(self):
        return len(self.at) - 1

    def take(self, order: np.ndarray) -> Rows:
        sizes = np.diff(self.at)[order]
        at = np.concatenate([[0], np.cumsum(sizes)])
        src = np.repeat(self.at[order] - at[:-1], sizes) + np.arange(at[-1])
        return Rows(at, self.cols[src], self.vals[src])

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.at))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the last axis between consecutive places (empty runs: 0)."""
    total = np.concatenate([np.zeros((*values.shape[:-1], 1)), np.cumsum(values, axis=-1)], axis=-1)
    return total[..., at[1:]] - total[..., at[:-1]]


def arranged(rows: Rows, width: int, leaf: int) -> np.ndarray:
    """An order of the rows in which runs of ``leaf * 2**i`` are the nodes of a
    hierarchy: each node is split in the middle between a row of largest norm and
    the row least like it."""
    order = np.arange(len(rows))
    size = leaf
    while size < len(rows):
        size *= 2
    while size > leaf:
        now = rows.take(order)
        node, of = np.arange(len(order)) // size, now.row_of()
        norm = np.sqrt(_sums(now.vals * now.vals, now.at))

        def likeness(pick: np.ndarray) -> np.ndarray:
            """Of each row to its node's picked row."""
            pivot = np.zeros((int(node[-1]) + 1, width))
            picked = np.zeros(len(order), bool)
            picked[pick] = True
            here = picked[of]
            pivot[node[of[here]], now.cols[here]] = now.vals[here]
            return _sums(now.vals * pivot[node[of], now.cols], now.at) / np.maximum(norm, 1)

        def first(key: np.ndarray) -> np.ndarray:
            """The row of each node with the least key."""
            by = np.lexsort((key, node))
            return by[np.unique(node, return_index=True)[1]]

        one = first(-norm)
        like_one = likeness(one)
        like_two = likeness(first(like_one / np.maximum(norm[one][node], 1)))
        order = order[np.lexsort((like_two - like_one, node))]
        size //= 2
    return order


def maxima(rows: Rows, width: int, leaf: int) -> list[np.ndarray]:
    """Coordinate maxima of the nodes, from the leaves to the root."""
    n = max(1, -(-len(rows) // leaf))
    low = np.zeros((n, width))
    np.maximum.at(low.reshape(-1), rows.row_of() // leaf * width + rows.cols, rows.vals)
    levels = [low]
    while len(levels[-1]) > 1:
        x = levels[-1]
        x = np.concatenate([x, np.zeros((1, width))]) if len(x) % 2 else x
        levels.append(np.maximum(x[0::2], x[1::2]))
    return levels


class Items:
    """A block of items in the order of its hierarchy."""

    def __init__(self, ids: list, rows: Rows, width: int):
        order = arranged(rows, width, ITEM_LEAF)
        self.ids, self.rows, self.width = [ids[i] for i in order], rows.take(order), width
        self.levels = maxima(self.rows, width, ITEM_LEAF)
        dense = np.zeros((len(ids), width))
        dense[self.rows.row_of(), self.rows.cols] = self.rows.vals
        self.dense = dense
        # sums of whole numbers are exact in doubles below 2**53; a document's
        # coordinate is at most 10**6, and running sums go over all that is scored at once
        self.exact = float(dense.sum(axis=1).max(initial=0)) * 1e6 * LEAVES * DOC_LEAF < 2.0 ** 53


def search(items: Items, ids: np.ndarray, docs: Rows, k: int, reached: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], int]:
    """The ``k`` best documents of a block for each item, of those that score
    above 0 and ``reached[item]`` at least: ((item, ids, scores) and the number of
    pairs that were scored)."""
    n = len(items.ids)
    order = arranged(docs, items.width, DOC_LEAF)
    ids, docs = ids[order], docs.take(order)
    levels = maxima(docs, items.width, DOC_LEAF)
    least = np.maximum(reached, 1).astype(np.float64)  # a document must reach this
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n

    def weakest(leaf_size: int) -> np.ndarray:
        return np.minimum.reduceat(least, np.arange(0, n, leaf_size))

    # both hierarchies are descended together; the lower one waits at its root
    alive = np.ones((1, 1), bool)
    bounds = np.zeros((1, 1))
    for step in range(max(len(items.levels), len(levels)) - 1, -1, -1):
        i, d = items.levels[min(step, len(items.levels) - 1)], levels[min(step, len(levels) - 1)]
        alive = np.repeat(alive, 2, axis=0)[:len(i)] if len(alive) != len(i) else alive
        alive = np.repeat(alive, 2, axis=1)[:, :len(d)] if alive.shape[1] != len(d) else alive
        some_i, some_d = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        bounds = np.zeros(alive.shape)
        bounds[np.ix_(some_i, some_d)] = i[some_i] @ d[some_d].T
        # a bound beyond 2**53 may be rounded: leave room for that
        alive &= bounds * (1 + 1e-9) >= weakest(ITEM_LEAF << min(step, len(items.levels) - 1))[:, None]
    scored = 0
    for leaf in np.flatnonzero(alive.any(axis=1)):
        lo, hi = leaf * ITEM_LEAF, min((leaf + 1) * ITEM_LEAF, n)
        left = np.flatnonzero(alive[leaf])
        left = left[np.argsort(-bounds[leaf, left], kind="stable")]
        for at in range(0, len(left), LEAVES):
            some = left[at:at + LEAVES]
            some = some[bounds[leaf, some] * (1 + 1e-9) >= least[lo:hi].min()]
            if not len(some):
                break  # the others have no larger bounds
            rows = (some[:, None] * DOC_LEAF + np.arange(DOC_LEAF)).ravel()
            rows = rows[rows < len(ids)]
            part = docs.take(rows)
            scored += len(rows) * (hi - lo)
            weights = items.dense[lo:hi, part.cols]
            if items.exact:
                scores = _sums(weights * part.vals, part.at).astype(np.int64)
            else:
                total = np.concatenate([np.zeros((hi - lo, 1), np.int64), np.cumsum(weights.astype(np.int64) * part.vals.astype(np.int64), axis=1)], axis=1)
                scores = total[:, part.at[1:]] - total[:, part.at[:-1]]
            for i in np.flatnonzero((scores >= least[lo:hi, None]).any(axis=1)):
                hit = np.flatnonzero(scores[i] >= least[lo + i])
                who, what = np.concatenate([best[lo + i][0], ids[rows[hit]]]), np.concatenate([best[lo + i][1], scores[i][hit]])
                top = np.lexsort((who, -what))[:k]
                best[lo + i] = who[top], what[top]
                if len(top) == k:
                    least[lo + i] = max(least[lo + i], what[top[-1]])
    return [(i, *b) for i, b in enumerate(best) if len(b[0])], scored


def _vectors(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(id, n, turn, cols, tfs): the terms of ``terms`` in each document that
    has a term; ``turn`` deals the documents of a task into waves."""

    def run(batches):
        known, turn = terms.keys(), 0
        for b in batches:
            ids, ns, turns, cols, tfs = [], [], [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                counts = term_counts(text.as_py())
                if counts:
                    pairs = sorted((terms[t], counts[t]) for t in counts.keys() & known)
                    ids.append(doc_id)
                    ns.append(counts.total())
                    turns.append(turn)
                    turn += 1
                    cols.append([p[0] for p in pairs])
                    tfs.append([p[1] for p in pairs])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(turns, pa.int64()),
                                              pa.array(cols, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["id", "n", "turn", "cols", "tfs"])

    return docs.mapInArrow(run, "id long, n long, turn long, cols array<int>, tfs array<long>")


def coordinates(n: np.ndarray, at: np.ndarray, tfs: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Of documents with ``n`` terms each, in whole numbers."""
    if int(n.max(initial=0)) * 25 * docs < 1 << 63:
        m = 75 + (25 * n * docs) // total
    else:
        m = np.array([75 + 25 * int(x) * docs // total for x in n], np.int64)
    tf = tfs.astype(np.int64)
    return (10 ** 9 * tf) // (1000 * tf + 12 * np.repeat(m, np.diff(at)))


def _wave(vectors: DataFrame, items: Items, docs: int, total: int, k: int, reached: np.ndarray) -> DataFrame:
    """(item, id, score): the best of each block of documents."""

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        ids = t["id"].fill_null(_NO_ID).to_numpy()
        cols = t["cols"].combine_chunks()
        cols = cols.chunk(0) if isinstance(cols, pa.ChunkedArray) else cols
        tfs = t["tfs"].combine_chunks()
        tfs = tfs.chunk(0) if isinstance(tfs, pa.ChunkedArray) else tfs
        at = np.concatenate([[0], np.cumsum(cols.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        vals = coordinates(t["n"].to_numpy(), at, tfs.flatten().to_numpy(zero_copy_only=False), docs, total)
        found, _ = search(items, ids, Rows(at, cols.flatten().to_numpy(zero_copy_only=False), vals), k, reached)
        who = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int32)), pa.array(who, mask=who == _NO_ID),
            pa.array(np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.int64))], ["item", "id", "score"])

    def run(batches):
        held, rows, terms = [], 0, 0
        for b in batches:
            for at in range(0, b.num_rows, DOC_BLOCK):
                part = b.slice(at, DOC_BLOCK)
                held.append(part)
                rows += part.num_rows
                terms += part.nbytes // 12
                if rows >= DOC_BLOCK or terms >= DOC_TERMS:
                    yield block(held)
                    held, rows, terms = [], 0, 0
        if rows:
            yield block(held)

    return vectors.select("id", "n", "cols", "tfs").mapInArrow(run, "item int, id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(spark: SparkSession, docs: DataFrame, items: list, k: int) -> DataFrame | None:
    """The ranks of one block of items; None if no document has a term."""
    counted = [term_counts((text or "").encode()) for _, text in items]
    names = sorted(set().union(*counted)) if counted else []
    if not names:
        return None
    index = {t: i for i, t in enumerate(names)}
    vectors = written(_vectors(docs, index), "vectors")
    n_docs, total = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    df = np.zeros(len(names), np.int64)
    for r in vectors.select(F.explode("cols").alias("col")).groupBy("col").count().collect():  # a row a term of the items at most
        df[r["col"]] = r["count"]
    w = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df]
    pairs = [sorted((index[t], w[index[t]] * c) for t, c in counts.items()) for counts in counted]
    rows = Rows(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]), [c for p in pairs for c, _ in p], [x for p in pairs for _, x in p])
    block = Items([i for i, _ in items], rows, len(names))
    reached = np.zeros(len(items), np.int64)
    waves = max(2, math.isqrt(-(-n_docs // DOC_BLOCK)))
    first = written(_ranked(_wave(vectors.where(F.col("turn") % waves == 0), block, n_docs, total, k, reached), k).select("item", "id", "score"), "first")
    for r in first.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).collect():
        reached[r["item"]] = r["least"]
    found = first.unionByName(_wave(vectors.where(F.col("turn") % waves != 0), block, n_docs, total, k, reached))
    names_of = F.array(*[F.lit(i).cast("long") for i in block.ids])
    return _ranked(found, k).select(F.element_at(names_of, F.col("item") + 1).alias("item_id"), F.col("rank").cast("int").alias("rank"),
                                    F.col("id").alias("doc_id"), "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, text_col: str = "text", id_col: str = "doc_id", item_text_col: str = "text",
           item_id_col: str = "item_id") -> DataFrame:
    """(item_id, rank from 1, doc_id, score): the ``k`` documents of highest
    score above 0 for each item."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    asked = written(items.select(F.col(item_id_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).distinct(), "items")
    n, chars = asked.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    blocks = max(-(-n // ITEM_BLOCK), -(-(chars or 0) // ITEM_CHARS))
    out = None
    for b in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()
        part = _block(spark, texts, [(r["id"], r["text"]) for r in some], k)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op11_dual_tree_search(spark, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id
), s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * max(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, s GROUP BY term
), q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), r AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), s GROUP BY item_id, doc_id
), o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20
"""
