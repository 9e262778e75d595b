"""Nearest neighbours by inner product with multiprobe p-stable hashing.

A vector x becomes (x / s, sqrt(1 - |x / s|^2)) and a query q (q / |q|, 0). With
s = M, the largest norm, the largest inner product is the least Euclidean
distance; with s = |x| the distance is that of directions, which tells vectors
apart better where norms say little. s = M^(1 - lift) |x|^lift goes from one to
the other. The 2-stable hash functions floor((a.x + b) / w) keep near points close. A table joins ``n_hashes`` of them to a bucket. A query visits its own
bucket and, in the order of estimated success (the sum of squared distances to
the slots it would have to move to), perturbed ones, ``probes`` in each of
``n_tables`` tables.

Candidates of all tables are merged after they have been ranked by the exact
inner product of the original vectors. Rows of a bucket and the queries that
visit it meet in blocks of bounded size on both sides, their number following
the bucket's counts: a bucket with a third of all rows is many blocks. A block
keeps the ``k`` best of each query, so the merge stays small and loses nothing.

Hashes, width, lift and probes are fitted. The true neighbours, among all rows, of a
bounded sample of queries (``SAMPLE_QUERIES``) are found in one pass. Each setting of
``SETTINGS`` needs some number of probes to reach a recall of ``target`` on them;
the one is taken that costs least: the share of rows that a query then meets
(from a sample of ``SAMPLE_ROWS``) and what it takes to send a query to a bucket, in
rows met. The more rows, the nearer their neighbours and the less a probe weighs,
so the cells get finer as the table grows. If no setting reaches ``target``, the
cells are made wider until one does, at the utmost one cell, which is an exact scan.
Every row is indexed and every query searched.

Defined results: vectors that are null, empty, zero, of another length than most
or that hold a null or non-finite number take no part, nor do rows without an
id. Rows are known by their id: a query's own id is no candidate, and an id that
is there several times counts once, with its best score. Ties go to the smaller
id. Without any vectors there are no rows. Extra columns are not read.
"""

from __future__ import annotations

import itertools
import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import table, written

N_TABLES = 2
N_HASHES = 3
WIDTH = 1.5
#: (hashes, width), from coarse cells to fine ones, each tried with the lifts
SETTINGS = ((3, 1.5), (4, 1.0), (6, 1.5), (6, 1.0), (8, 1.5), (8, 1.0), (10, 1.5), (10, 1.0))
LIFTS = (0.0, 1.0)
PROBE_ROWS = 200  # sending a query to a bucket (Arrow, shuffle) counts as much as meeting so many rows
MOST_PROBES = 1024  # of a setting; one that needs more is not taken
TARGET = 0.95
SAMPLE_ROWS = 20_000
SAMPLE_QUERIES = 200
BLOCK_ROWS = 4096
BLOCK_QUERIES = 1024
SEED = 7
_LOG = logging.getLogger(__name__)


@dataclass
class Hashes:
    """Projections (tables, dimensions + 1, hashes), offsets, and the moves of a probe:
    up to two slots to each side for few hashes, else one slot in up to four hashes."""

    a: np.ndarray
    b: np.ndarray
    width: float
    scale: float  # largest norm
    lift: float = 0.0

    def __post_init__(self):
        n = self.a.shape[2]
        if n <= 4:
            moves = itertools.product(range(-2, 3), repeat=n)
        else:
            moves = (m for some in range(5) for at in itertools.combinations(range(n), some) for by in itertools.product((-1, 1), repeat=some)
                     for m in [tuple(dict(zip(at, by)).get(k, 0) for k in range(n))])
        self.moves = np.array(sorted(moves, key=lambda m: (sum(map(abs, m)), m)))

    @classmethod
    def drawn(cls, dim: int, tables: int, hashes: int, width: float, scale: float, lift: float = 0.0) -> Hashes:
        rng = np.random.default_rng(SEED)
        return cls(rng.standard_normal((tables, dim + 1, hashes)), rng.random((tables, hashes)) * width, width, scale, lift)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the coordinate that makes all norms equal."""
        x = x / (self.scale ** (1 - self.lift) * np.sqrt((x * x).sum(axis=1, keepdims=True)) ** self.lift)
        return np.c_[x, np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))]

    @staticmethod
    def queries(q: np.ndarray) -> np.ndarray:
        return np.c_[q / np.sqrt((q * q).sum(axis=1, keepdims=True)), np.zeros(len(q))]

    def slots(self, x: np.ndarray, t: int) -> np.ndarray:
        return (x @ self.a[t] + self.b[t]) / self.width

    def bucket(self, slots: np.ndarray) -> np.ndarray:
        """One long for the slots of a table: a mixed sum, so that any range
        fits. (Two buckets that share it are searched as one.)"""
        out = np.zeros(slots.shape[:-1], np.uint64)
        with np.errstate(over="ignore"):
            for k in range(slots.shape[-1]):
                out = (out ^ slots[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def probes(self, q: np.ndarray, t: int, most: int) -> np.ndarray:
        """(queries, most) buckets in the order of estimated success."""
        if len(q) > 256:  # costs of all moves are held for some queries at once
            return np.concatenate([self.probes(q[i:i + 256], t, most) for i in range(0, len(q), 256)])
        at = self.slots(q, t)
        base = np.floor(at)
        frac, cost = at - base, np.zeros((len(q), len(self.moves)))
        for k in range(at.shape[1]):
            m = self.moves[:, k][None]
            f = frac[:, [k]]
            cost += np.where(m > 0, m - f, np.where(m < 0, f - m - 1, 0)) ** 2
        order = np.argsort(cost, axis=1, kind="stable")[:, :most]
        return self.bucket(base[:, None, :] + self.moves[order])


def _good(vec: Column) -> Column:
    d = vec.cast("array<double>")
    return F.coalesce(F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(d, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(c)
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _sample(rows: DataFrame, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """About ``most`` of ``n`` rows, chosen by a hash of the row; twice that at most."""
    part = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(min(1.0, most / max(n, 1)) * (1 << 30))
    t = rows.where(part).select("id", "vec").limit(2 * most).toArrow()
    return t.column(0).to_numpy(), _matrix(t.column(1))


@dataclass
class Fit:
    hashes: Hashes
    probes: int
    recall: float  # of the sample of queries, in all rows
    share: float  # of the rows that a query meets, summed over tables


def _tried(h: Hashes, probes: int, q: np.ndarray, near: list[np.ndarray], sample: np.ndarray, target: float) -> Fit:
    """``near``: the neighbours of each query. The least number of probes, at most
    ``probes``, with that recall (with less, if they do not do)."""
    most = min(probes, len(h.moves))
    found_at = [np.full(len(v), most) for v in near]
    met = np.zeros(most)
    for t in range(len(h.a)):
        of_queries, of_rows = h.probes(h.queries(q), t, most), np.sort(h.bucket(np.floor(h.slots(h.rows(sample), t))))
        met += (np.searchsorted(of_rows, of_queries, "right") - np.searchsorted(of_rows, of_queries)).sum(axis=0)
        for i, v in enumerate(near):
            hit = of_queries[i][None] == h.bucket(np.floor(h.slots(h.rows(v), t)))[:, None]
            found_at[i] = np.minimum(found_at[i], np.where(hit.any(axis=1), hit.argmax(axis=1), most))
    found = np.sort(np.concatenate(found_at))
    need = int(found[min(int(np.ceil(target * len(found))), len(found)) - 1]) if len(found) else 0
    need = min(need, most - 1)
    return Fit(h, need + 1, float((found <= need).mean()) if len(found) else 1.0, float(met[:need + 1].sum() / max(len(q) * len(sample), 1)))


def fitted(n: int, scale: float, q: np.ndarray, near: list[np.ndarray], sample: np.ndarray, n_tables: int = N_TABLES, target: float = TARGET,
           settings=SETTINGS) -> Fit:
    """The setting of least cost for ``n`` rows that reaches ``target``."""
    dim = q.shape[1]
    tried = [_tried(Hashes.drawn(dim, n_tables, hashes, width, scale, lift), MOST_PROBES, q, near, sample, target) for hashes, width in settings for lift in LIFTS]
    good = [f for f in tried if f.recall >= target]
    width = settings[0][1]
    while not good:
        width *= 2
        last = _tried(Hashes.drawn(dim, n_tables, settings[0][0], width, scale), MOST_PROBES, q, near, sample, target)
        good = [last] if last.recall >= target else []
    return min(good, key=lambda f: f.share + PROBE_ROWS * n_tables * f.probes / max(n, 1))


def _near(rows: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int) -> list[np.ndarray]:
    """The ``k`` nearest of all rows to each of a bounded number of queries: tasks keep
    the best that they have seen."""

    def run(batches):
        best = None
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            scores = q @ x.T
            scores[q_ids[:, None] == b.column(0).to_numpy()[None]] = -np.inf
            at = np.argpartition(-scores, min(k, len(x)) - 1, axis=1)[:, :k]
            now = np.take_along_axis(scores, at, axis=1), x[at]
            if best is not None:
                scores, vecs = np.hstack([best[0], now[0]]), np.hstack([best[1], now[1]])
                at = np.argpartition(-scores, min(k, scores.shape[1]) - 1, axis=1)[:, :k]
                now = np.take_along_axis(scores, at, axis=1), np.take_along_axis(vecs, at[:, :, None], axis=1)
            best = now
        if best is not None:
            i, j = np.nonzero(best[0] > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(best[0][i, j]), pa.array(list(best[1][i, j]), pa.list_(pa.float64()))], ["q", "score", "vec"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec")
    best = rows.select("id", "vec").mapInArrow(run, "q long, score double, vec array<double>").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    t = best.select("q", "vec").toArrow()
    of, x = t.column(0).to_numpy(), _matrix(t.column(1))
    return [x[of == i].reshape(-1, q.shape[1]) for i in range(len(q))]


def _spread(h: Hashes, probes: int | None):
    """Task: (row, id, vec) -> (tab, cell, row, id, vec), rows in their own
    bucket, queries (``probes`` given) in each that they visit."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(2))
            for t in range(len(h.a)):
                cells = h.bucket(np.floor(h.slots(h.rows(x), t)))[:, None] if probes is None else h.probes(h.queries(x), t, probes)
                cells = [np.unique(c) for c in cells]  # two probes of one long are one
                at = np.repeat(np.arange(len(x)), [len(c) for c in cells])
                for k in range(0, len(at), 4096):
                    some = pa.array(at[k:k + 4096])
                    cell = np.concatenate(cells)[k:k + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), t, np.int32)), pa.array(cell), *(b.column(i).take(some) for i in range(3))],
                                                     ["tab", "cell", "row", "id", "vec"])

    return run


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _block(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The ``k`` best rows (left) of each query (right) of one block."""
        out = []
        if left.num_rows and right.num_rows:
            ids, x, q_ids, q = left["id"].to_numpy(), _matrix(left["vec"]), right["id"].to_numpy(), _matrix(right["vec"])
            scores = q @ x.T
            scores[q_ids[:, None] == ids[None]] = -np.inf
            last = -np.partition(-scores, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
            for i in range(len(q)):
                # the product of matrices may round equal vectors apart: those
                # near the k-th are all ranked by the plain sum
                near = np.flatnonzero((scores[i] >= last[i] - 1e-9 * (1 + abs(last[i]))) & (scores[i] > -np.inf)) if np.isfinite(last[i]) else np.flatnonzero(scores[i] > -np.inf)
                exact = (x[near] * q[i]).sum(axis=1)
                top = best_of(ids[near], exact, k)
                if len(top):
                    out.append((int(q_ids[i]), ids[near][top].tolist(), exact[top].tolist()))
        cols = list(zip(*out)) or [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "ids": pa.array(cols[1], pa.list_(pa.int64())), "scores": pa.array(cols[2], pa.list_(pa.float64()))})

    return run


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, vec_col: str = "embedding", id_col: str = "vec_id", n_tables: int = N_TABLES,
               n_hashes: int = N_HASHES, width: float = WIDTH, probes: int | None = None, target: float = TARGET) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the nearest found of each row for
    which ``is_query`` (over the columns of ``vectors``) holds. ``n_hashes`` and
    ``width`` hold where ``probes`` is given; else all three are fitted."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"),
                          F.monotonically_increasing_id().alias("row")).where(F.col("id").isNotNull() & _good(F.col("vec")))
    rows = written(rows, "vectors")
    norm = F.sqrt(F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    sizes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm"), F.count_if("asks").alias("q")).orderBy(
        F.desc("n"), "dim").limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], empty)
    dim, n, scale, n_q = sizes[0]
    rows = rows.where(F.size("vec") == dim)
    if probes is not None:
        h = Hashes.drawn(dim, n_tables, n_hashes, width, scale)
    elif not n_q:
        return vectors.sparkSession.createDataFrame([], empty)
    else:
        ids, q = (v[:SAMPLE_QUERIES] for v in _sample(rows.where("asks"), n_q, SAMPLE_QUERIES))
        fit = fitted(n, scale, q.reshape(-1, dim), _near(rows, ids, q, k) if len(q) else [], _sample(rows, n, SAMPLE_ROWS)[1].reshape(-1, dim), n_tables, target)
        h, probes = fit.hashes, fit.probes
        _LOG.info("%d hashes of width %s, lift %s, %d probes: recall %.3f, share of rows met %.3f", h.a.shape[2], h.width, h.lift, probes, fit.recall, fit.share)
    vec_type = rows.schema["vec"].dataType.simpleString()
    schema = f"tab int, cell long, row long, id long, vec {vec_type}"
    index = rows.select("row", "id", "vec").mapInArrow(_spread(h, None), schema)
    asks = rows.where("asks").select("row", "id", "vec").mapInArrow(_spread(h, probes), schema)

    def blocks(of: DataFrame, size: int, name: str) -> DataFrame:
        return of.groupBy("tab", "cell").agg(F.ceil(F.count(F.lit(1)) / size).alias(name))

    grid = written(blocks(index, BLOCK_ROWS, "row_blocks").join(blocks(asks, BLOCK_QUERIES, "ask_blocks"), ["tab", "cell"]), "grid")

    def dealt(of: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        """Each row in one block of its own kind and all of the other kind."""
        return of.join(grid, ["tab", "cell"]).withColumn(own, F.pmod(F.xxhash64("row"), F.col(own_n))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_n) - 1))).select("tab", "cell", "rb", "qb", "id", "vec")

    key = ["tab", "cell", "rb", "qb"]
    left = dealt(index, "rb", "row_blocks", "qb", "ask_blocks").groupBy(*key)
    right = dealt(asks, "qb", "ask_blocks", "rb", "row_blocks").groupBy(*key)
    best = left.cogroup(right).applyInArrow(_block(k), "query_id long, ids array<long>, scores array<double>")
    merged = best.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("c")).groupBy("query_id", F.col("c.ids").alias("vec_id")).agg(
        F.max("c.scores").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_multiprobe_ann(spark, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
