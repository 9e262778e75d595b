"""Embedding near-duplicates by collision-counting projections.

Every vector, made of length one, is projected on ``PROJECTIONS`` random lines.
Two vectors of cosine ``c`` are ``d = sqrt(2 - 2c)`` apart, and on each line their
projections differ by a normal variable of deviation ``d``, whatever the data. So
a pair at the least cosine falls into the window of ``WINDOW * d`` around either
one (a collision) with a known probability, and of all lines it collides on
``needed`` or more with probability ``RECALL``: the count a pair must reach before
its exact cosine is taken. Nearer pairs collide more often.

The sorted projections also deal the work. The first lines are cut in the middle
of their sorted sample, ``cuts`` lines to a table, which gives ``2 ** cuts`` cells
for each label. A vector lies in one cell and visits the cells that the window
around it reaches over a cut (``REACH * d`` to each side); two vectors meet if one
visits the other's cell. Two that are no farther than ``d`` apart fail at a cut
only if the cut parts them and neither is within reach, for which they must differ
by twice the reach: the number of tables is the least with which a pair at the
least cosine still meets with probability ``RECALL``. ``cuts`` follows the size of
the label, so a vector meets an ever smaller share of its label, until
``MAX_CUTS``; labels of up to 16 times ``CELL`` vectors are one cell.

Cells are worked on in blocks of bounded size on both sides, however many vectors
a cell holds. Equal vectors are one class before anything is dealt, so copies
never multiply. A block returns no pairs: for each class it gives the vectors it
is linked to, as a sum, and one edge to the smallest class that it reaches inside
the block. Components of these edges are found by alternating stars.

Defined results: vectors that are null, empty, zero or hold null or non-finite
numbers, and those without a label, are linked with nothing. Vectors of several
lengths are compared with their like. Rows are vectors: rows that agree in all are
linked as others are, and of equal ids every row is ``kept`` or none. Null ids
count as larger than all others; a component without any other id has a null
``component_id`` and is kept. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import table, written
from corpusmill.llm.graph import components

MIN_COSINE = 0.93
PROJECTIONS = 32
WINDOW = 2.0  # half a counting window, in distances at the least cosine
REACH = 1.25  # half a window at a cut
RECALL = 0.999  # of the count, and of meeting
CELL = 256  # vectors a cell holds on average, until MAX_CUTS
MAX_CUTS = 8
BLOCK_ROWS = 1024
BLOCK_VISITS = 2048
SAMPLE = 20_000  # vectors whose sorted projections give the cuts
DENSE = 16  # projections counted for all pairs of a block; the others for those that can still reach the count
SEED = 13


def _normal(z: float) -> float:
    """P(|N(0, 1)| <= z)."""
    return math.erf(z / math.sqrt(2))


def needed(projections: int, window: float = WINDOW, recall: float = RECALL) -> int:
    """Largest count that a pair at the least cosine reaches with ``recall``."""
    p, below, count = _normal(window), 0.0, 0
    while True:
        below += math.comb(projections, count) * p ** count * (1 - p) ** (projections - count)
        if below > 1 - recall or count == projections:
            return count
        count += 1


def cuts_for(n: int) -> int:
    """Fewer than five cuts, with the tables they need, save no pair."""
    return 0 if n <= 16 * CELL else min(MAX_CUTS, math.ceil(math.log2(n / CELL)))


def tables_for(cuts: int, recall: float = RECALL) -> int:
    """Tables until a pair at the least cosine meets in one with ``recall``."""
    missed = 1 - _normal(2 * REACH) ** cuts
    return 1 if missed <= 1 - recall else math.ceil(math.log(1 - recall) / math.log(missed))


@dataclass
class Lines:
    """The random lines for vectors of any length, and where they are cut."""

    distance: float
    middles: dict  # length of vectors -> middle of each line's sorted sample

    def of(self, dim: int) -> np.ndarray:
        """(dim, lines)"""
        lines = max(PROJECTIONS, MAX_CUTS * tables_for(MAX_CUTS))
        return np.random.default_rng([SEED, dim]).standard_normal((dim, lines))

    def middle(self, dim: int) -> np.ndarray:
        return self.middles.get(dim, np.zeros(self.of(1).shape[1]))

    def sides(self, p: np.ndarray, dim: int, tab: int, cuts: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector and cut of a table: its side, and whether it reaches the other."""
        off = p[:, tab * cuts:(tab + 1) * cuts] - self.middle(dim)[tab * cuts:(tab + 1) * cuts]
        return off >= 0, np.abs(off) <= REACH * self.distance


def _matrix(column) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of large numbers do not overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _deal(lines: Lines):
    """Task: (c, grp, n, vec, size) -> (grp, cuts, tab, cell, own, c, vec, size), a
    vector's own cells and those that it visits."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lengths = b.column("vec").value_lengths().to_numpy(zero_copy_only=False)
            n = b.column("n").to_numpy()
            for dim, size in sorted(set(zip(lengths.tolist(), n.tolist()))):
                rows = np.flatnonzero((lengths == dim) & (n == size))
                part, cuts = b.take(pa.array(rows)), cuts_for(size)
                p = _unit(_matrix(part.column("vec"))) @ lines.of(dim)
                for tab in range(tables_for(cuts)):
                    side, near = lines.sides(p, dim, tab, cuts)
                    bits = 1 << np.arange(cuts)
                    home = side.astype(np.int64) @ bits
                    at, cell = [np.arange(len(rows))], [home]
                    for flips in range(1, 1 << cuts):
                        own = np.flatnonzero(near[:, [k for k in range(cuts) if flips >> k & 1]].all(axis=1))
                        at.append(own)
                        cell.append(home[own] ^ flips)
                    at, cell = np.concatenate(at), np.concatenate(cell)
                    for lo in range(0, len(at), 2048):
                        i = pa.array(at[lo:lo + 2048])
                        k = len(i)
                        yield pa.RecordBatch.from_arrays([
                            part.column("grp").take(i), pa.array(np.full(k, cuts, np.int32)), pa.array(np.full(k, tab, np.int32)), pa.array(cell[lo:lo + 2048]),
                            pa.array(np.arange(lo, lo + k) < len(rows)), part.column("c").take(i), part.column("vec").take(i), part.column("size").take(i)],
                            ["grp", "cuts", "tab", "cell", "own", "c", "vec", "size"])

    return run


def colliding(p: np.ndarray, q: np.ndarray, window: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of p, row of q) that lie in each other's window on ``count``
    lines or more."""
    lines = p.shape[1]
    first = min(DENSE, lines)
    p32, q32 = p.astype(np.float32).T.copy(), q.astype(np.float32).T.copy()
    hits = np.zeros((p.shape[0], q.shape[0]), np.uint8)
    for k in range(first):
        hits += np.abs(p32[k][:, None] - q32[k][None]) <= window
    a, b = np.nonzero(hits >= count - (lines - first))  # the others cannot reach the count any more
    got = hits[a, b].astype(np.int16)
    for k in range(first, lines):
        got += np.abs(p32[k][a] - q32[k][b]) <= window
        if k % 4 == 3:
            left = got >= count - (lines - 1 - k)
            a, b, got = a[left], b[left], got[left]
    left = got >= count
    return a[left], b[left]


def reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest one that the edges lead to."""
    low = np.arange(n)
    while True:
        now = low.copy()
        np.minimum.at(now, a, low[b])
        np.minimum.at(now, b, low[a])
        now = now[now]
        if (now == low).all():
            return low
        low = now


def _meets(sides, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether i visits j's cell: at each cut on its side, or within reach of it."""
    (side_i, near_i), (side_j, _) = sides
    return ((side_i[i] == side_j[j]) | near_i[i]).all(axis=1)


def _block(lines: Lines, least: float):
    count = needed(PROJECTIONS)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """(c, links, low) of the classes that are linked within one block: left
        lie in the cell, right visit it or lie in it too."""
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            cuts, tab = key[1].as_py(), key[2].as_py()
            x, y = _matrix(left["vec"]), _matrix(right["vec"])
            dim = x.shape[1]
            p, q = _unit(x) @ lines.of(dim), _unit(y) @ lines.of(dim)
            cx, cy = left["c"].to_numpy(), right["c"].to_numpy()
            own = right["own"].to_numpy(zero_copy_only=False)
            i, j = colliding(p[:, :PROJECTIONS], q[:, :PROJECTIONS], WINDOW * lines.distance, count)
            # a pair counts once: in the first table that it meets in, and there where
            # the vector of the larger class visits the other if both visit
            here = (lines.sides(p, dim, tab, cuts), lines.sides(q, dim, tab, cuts))
            once = (cx[i] < cy[j]) | (~own[j] & ~_meets(here, i, j))
            for before in range(tab):
                s, t = lines.sides(p, dim, before, cuts), lines.sides(q, dim, before, cuts)
                once &= ~(_meets((s, t), i, j) | _meets((t, s), j, i))
            i, j = i[once], j[once]
            nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
            linked = np.zeros(len(i), bool)
            for lo in range(0, len(i), 65_536):
                a, b = i[lo:lo + 65_536], j[lo:lo + 65_536]
                with np.errstate(over="ignore", invalid="ignore"):
                    cosine = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b])
                wild = ~np.isfinite(cosine) | ~np.isfinite(nx[a] * ny[b])
                if wild.any():
                    cosine[wild] = np.einsum("ij,ij->i", _unit(x[a[wild]]), _unit(y[b[wild]]))
                linked[lo:lo + 65_536] = cosine >= least
            i, j = i[linked], j[linked]
            if len(i):
                nodes, place = np.unique(np.concatenate([cx[i], cy[j]]), return_inverse=True)
                a, b = place[:len(i)], place[len(i):]
                links = np.bincount(a, right["size"].to_numpy()[j], len(nodes)) + np.bincount(b, left["size"].to_numpy()[i], len(nodes))
                out = nodes, links.astype(np.int64), nodes[reached(a, b, len(nodes))]
        return pa.table({"c": pa.array(out[0], pa.int64()), "links": pa.array(out[1], pa.int64()), "low": pa.array(out[2], pa.int64())})

    return run


def _good(vec: Column) -> Column:
    d = vec.cast("array<double>")
    return F.coalesce(F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(d, lambda x: x != 0), F.lit(False))


def _lines(classes: DataFrame, n: int, least: float) -> Lines:
    """Cuts in the middle of each line's sorted projections of a bounded sample
    (about ``SAMPLE`` classes, twice that at most)."""
    lines = Lines(math.sqrt(max(2 - 2 * least, 0.0)), {})
    part = F.pmod(F.xxhash64("c"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))
    some = classes.where(part).select("vec").limit(2 * SAMPLE).toArrow()["vec"].combine_chunks()
    chunks = some.chunks if isinstance(some, pa.ChunkedArray) else [some]
    found: dict[int, list] = {}
    for c in chunks:
        lengths = c.value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths).tolist():
            found.setdefault(dim, []).append(_unit(_matrix(c.take(pa.array(np.flatnonzero(lengths == dim))))) @ lines.of(dim))
    for dim, p in found.items():
        lines.middles[dim] = np.median(np.concatenate(p), axis=0)
    return lines


def near_duplicates(vectors: DataFrame, min_cosine: float = MIN_COSINE, vec_col: str = "embedding", id_col: str = "vec_id",
                    label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    if not 0 < min_cosine < 1:
        raise ValueError("min_cosine must lie between 0 and 1")
    vec, label = F.col(vec_col), F.col(label_col)
    takes_part = label.isNotNull() & _good(vec)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(takes_part, label).alias("label"), F.when(takes_part, vec).alias("vec"))
    # equal vectors of a label are known by 128 bits
    h = [F.when(F.col("vec").isNotNull(), F.xxhash64(F.lit(k), "label", "vec")).alias(f"h{k}") for k in (1, 2)]
    rows = written(rows.select("id", "label", "vec", *h), "rows")
    grouped = rows.where("vec is not null").groupBy("h1", "h2").agg(
        F.first("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("size"), F.min("id").alias("least"))
    classes = written(grouped.select(F.monotonically_increasing_id().alias("c"), "h1", "h2", F.xxhash64("label", F.size("vec")).alias("grp"),
                                     "vec", "size", "least"), "classes")
    groups = classes.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    lines = _lines(classes, classes.count(), min_cosine)
    vec_type = classes.schema["vec"].dataType.simpleString()
    sized = classes.select("c", "grp", "vec", "size").join(groups, "grp").select("c", "grp", "n", "vec", "size")
    dealt = written(sized.mapInArrow(_deal(lines), f"grp long, cuts int, tab int, cell long, own boolean, c long, vec {vec_type}, size long"), "cells")
    cell = ["grp", "cuts", "tab", "cell"]
    grid = written(dealt.groupBy(*cell).agg(F.ceil(F.count_if("own") / BLOCK_ROWS).alias("row_blocks"), F.ceil(F.count(F.lit(1)) / BLOCK_VISITS).alias(
        "visit_blocks")).where("row_blocks > 0"), "grid")

    def blocks(of: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        """Each vector in one block of its own side and all of the other side."""
        # new columns each time: both sides are one table
        named = of.select(*[F.col(c).alias(c) for c in of.columns])
        return named.join(grid, cell).withColumn(own, F.pmod(F.xxhash64("c"), F.col(own_n))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_n) - 1))).select(*cell, "rb", "vb", "own", "c", "vec", "size")

    left = blocks(dealt.where("own"), "rb", "row_blocks", "vb", "visit_blocks").groupBy(*cell, "rb", "vb")
    right = blocks(dealt, "vb", "visit_blocks", "rb", "row_blocks").groupBy(*cell, "rb", "vb")
    found = written(left.cogroup(right).applyInArrow(_block(lines, min_cosine), "c long, links long, low long"), "links")
    roots = components(found.where("c <> low").select("c", "low")).withColumnRenamed("node", "c")
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    linked = classes.select("c", "h1", "h2", "size", "least").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    known = written(linked.join(least, "root").join(links, "c", "left").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id"), "known")
    alone = rows.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = rows.where("vec is not null").select("id", "h1", "h2").join(known, ["h1", "h2"]).select("id", "n_links", "component_id").unionByName(alone)
    return every.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_collision_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: every pair of a label, and components by a recursive query
ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), r AS (
  SELECT vec_id AS a, vec_id AS root FROM embeddings UNION SELECT l.a, r.root FROM r JOIN l ON l.b = r.a
), c AS (SELECT a, min(root) AS component_id FROM r GROUP BY a
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
