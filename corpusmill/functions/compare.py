"""Token-level edit distance and similarity as native column expressions.

Each distinct token of a pair is mapped to one supplementary-plane code point
(offset 65536, so no surrogates and ~1.04 M distinct tokens per pair); the
two code-point strings then go through Spark's built-in ``levenshtein``,
which counts code points. Work is O(n*m) per pair inside the JVM, with no
Python and no shuffle.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import let, tokens

CODE_POINT_OFFSET = 65536


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _encode(arr: Column, ids: Column) -> Column:
    hexes = F.transform(arr, lambda x: F.lpad(F.hex(F.element_at(ids, x) + CODE_POINT_OFFSET), 8, "0"))
    return F.decode(F.unhex(F.array_join(hexes, "")), "UTF-32")


def token_edit_distance(a_tokens, b_tokens) -> Column:
    """Unit-cost Levenshtein distance between two token arrays."""
    def dist(p):
        a, b = p["a"], p["b"]
        ids = let(F.array_distinct(F.concat(a, b)),
                  lambda v: F.map_from_arrays(v, F.sequence(F.lit(1), F.size(v))))
        return (
            F.when(F.size(a) == 0, F.size(b))
            .when(F.size(b) == 0, F.size(a))
            .otherwise(let(ids, lambda m: F.levenshtein(_encode(a, m), _encode(b, m))))
        )
    return let(F.struct(_c(a_tokens).alias("a"), _c(b_tokens).alias("b")), dist)


def similarity_from_tokens(a_tokens, b_tokens) -> Column:
    """``1 - d / max(|a|, |b|, 1)``; two empty sides -> 1.0."""
    def score(p):
        a, b = p["a"], p["b"]
        d = token_edit_distance(a, b)
        denom = F.greatest(F.size(a), F.size(b), F.lit(1))
        return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(1.0 - d / denom)
    return let(F.struct(_c(a_tokens).alias("a"), _c(b_tokens).alias("b")), score)


def similarity(a_text, b_text) -> Column:
    """Whitespace-token similarity of two texts."""
    return similarity_from_tokens(tokens(a_text), tokens(b_text))


BAND = 64  # rows to each side of the diagonal that are tried first
_EQ_BITS = 1 << 29  # bits of the places of tokens that are held at once


def _within_band(a: list, m: int, places: dict, k: int) -> int:
    """Edit distance of ``a`` and a list of ``m`` tokens that stand at ``places``
    (token -> indexes in order), over the cells at most ``k`` off the diagonal:
    never too small, and right if it is ``k`` or less. The column of
    cells is kept as bit vectors of vertical differences (Myers 1999, Hyyro 2001),
    of which only the ``2k + 1`` bits of the band are held: with each token of
    ``a`` the band moves down by one row. A cell outside counts as one more than
    its neighbour inside, which is a real way to get there.

    A token's places are made into bits for some columns at a time, so what is
    held stays bounded for texts of any length."""
    ahead = max(64, min(4096, _EQ_BITS // (2 * k + 4096)))  # columns
    base, bits_of = 1, {}
    low, last = 1, min(m, k)  # rows of the band, from 1
    full = (1 << last) - 1
    pv, mv, score = full, 0, last
    for j, tok in enumerate(a, 1):
        if j > k + 1:
            low += 1
            pv >>= 1
            mv >>= 1
        if last < m:
            last += 1
            pv |= 1 << (last - low)
            score += 1
        full = (1 << (last - low + 1)) - 1
        if j % ahead == 1:
            base, bits_of = low, {}
        bits = bits_of.get(tok)
        if bits is None:
            at = places.get(tok, ())
            top = min(m, j - j % ahead + ahead + k)  # the last row that these columns reach
            held = bytearray((top - base >> 3) + 1)  # one bit at a time of a long number would be quadratic
            for i in at[bisect_left(at, base - 1):bisect_left(at, top)]:
                held[i + 1 - base >> 3] |= 1 << (i + 1 - base & 7)
            bits = bits_of[tok] = int.from_bytes(held, "little")
        eq = bits >> (low - base) & full
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        bottom = last - low
        score += (ph >> bottom & 1) - (mh >> bottom & 1)
        ph = (ph << 1) | 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
    return score


def _edit_distance(a: list, b: list) -> int:
    """Exact unit-cost Levenshtein distance of two token lists. What both start
    and end with costs nothing and is left out; the rest is tried in a band
    around the diagonal that is doubled until the distance fits into it. So the
    work follows the distance: texts of any length that are near each other
    never cost the product of their lengths."""
    if len(a) < len(b):
        a, b = b, a
    same, most = 0, len(b)
    while same < most and a[same] == b[same]:
        same += 1
    end = 0
    while end < most - same and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[same:len(a) - end], b[same:len(b) - end]
    if not b:
        return len(a)
    places: dict = {}
    for i, tok in enumerate(b):
        places.setdefault(tok, []).append(i)
    k = max(BAND, 2 * (len(a) - len(b)))
    while True:
        k = min(k, len(a))
        d = _within_band(a, len(b), places, k)
        if d <= k or k == len(a):
            return d
        k *= 2


def _similarity_udf():
    @F.pandas_udf(T.StructType([T.StructField("distance", T.IntegerType()),
                                T.StructField("similarity", T.DoubleType())]))
    def _sim(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        dist, sims = [], []
        for x, y in zip(a, b):
            ta = x.split() if x is not None else []
            tb = y.split() if y is not None else []
            d = _edit_distance(ta, tb)
            dist.append(d)
            sims.append(1.0 if not ta and not tb else 1.0 - d / max(len(ta), len(tb), 1))
        return pd.DataFrame({"distance": dist, "similarity": sims})

    return _sim


def similarity_fast(a_text, b_text) -> Column:
    """Same value as :func:`similarity`, computed in Arrow batches with the
    bit-parallel recurrence (~word-size times fewer steps than the cell-by-
    cell JVM kernel; pays off for long texts). Returns ``struct<distance,
    similarity>``. Tokens are Python ``str.split()`` tokens.

    Pass plain columns. In Spark 4.1, a Python UDF whose inputs are all
    higher-order-function expressions (the normal forms, once Catalyst
    collapses them into the UDF's input) fails with an internal "cannot
    evaluate expression" error. Compute the normal forms in a projection
    before the call, as ``system_similarity`` does."""
    return _similarity_udf()(_c(a_text), _c(b_text))

