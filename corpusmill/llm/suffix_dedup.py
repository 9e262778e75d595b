"""Removal of repeated byte strings by prefix doubling over text positions.

A byte goes if a string of ``length`` bytes that covers it also starts
earlier (in a smaller id, or in the same document at an earlier byte).

Rounds rank strings of 32, 64 and ``length`` bytes. Within a task, the rank
of the string at each position is doubled at offsets 1, 2, 4 and so on: the
rank pair (r[p], r[p + h]) gives the rank of 2h bytes. Ranks are 64-bit
fingerprints, as only equality counts and Spark needs no dense numbers.

Every window of ``length`` bytes holds ``length - h + 1`` strings of h bytes;
the one of smallest rank (leftmost of equals) is the window's *anchor*. Equal
windows have equal anchors at equal offsets, so only anchors (in the first
round about one position in 40) leave the task, each for the run of windows
that it stands for. Spark sorts them by (rank, digest of the whole run,
document, position). All windows of a run but the first with its rank and digest are
repeats. An anchor whose rank no other run has is unique and done. What is left
(one rank, several runs: near the ends of repeats) goes to the next round with
longer strings, until the rank is that of the whole window.

Copies within a task are settled there, so an anchor rank has at most one row
per task and run: a passage in a third of all documents makes no hot key. A short
string that many documents share (a notice, a ruled line) is the anchor of as many
different runs. Such ranks are found in a bounded sample of documents; their rows
are dealt by rank and run, and known to be of several runs. The sample only decides
where rows are sorted, not what is found.
Texts without a repeated window never shuffle; a Bloom filter of bounded size
tells them (a false positive is shuffled for nothing).

Two runs count as equal if their 64-bit anchor ranks and 64-bit digests both
are.

Defined results: null counts as empty; texts shorter than ``length`` stay
whole. Null ids come before all others. Rows that agree in id and text are
one document, each getting its result; rows with one id and different texts
are documents ordered by the 64-bit hash of the text that, with the id, tells
documents apart. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import table, text_key, written
from corpusmill.llm.exact_dedup import MAX_FILTER_BITS, filter_bits, maybe_repeated, repeated_slots

LENGTH = 100
#: bytes whose ranks the rounds before the last compare
STEPS = (32, 64)
#: documents, and the most of all, in which ranks of many runs are looked for
SAMPLE_DOCS, SAMPLE_SHARE = 20_000, 1 / 16
#: a rank is dealt by its runs if it has this part of the runs of the sample's ranks of several, and so many
HOT_PART, HOT_LEAST = 1 / 4096, 8
_BLOCK = 1 << 20  # bytes ranked at once
_HELD = 1_000_000  # anchors settled within a task at once
_POS = np.uint64((1 << 24) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd: 2**64 over the golden ratio
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)
#: a place in a document: 31 bits of the position, 7 bits of windows (above them: nothing)
_AT_BITS, _RUN_BITS = 31, 7


def _id(col: Column) -> Column:
    """Null ids first."""
    return F.coalesce(col.cast("long"), F.lit(-(1 << 63)))


def _ranks(block: np.ndarray, gram: int) -> np.ndarray:
    """Rank of the ``gram`` bytes from each position on, by doubling (and a
    last, overlapping pair if ``gram`` is no power of two)."""
    with np.errstate(over="ignore"):
        r, h, step = _BYTE[block], 1, _STEP
        while 2 * h <= gram:
            r = r[:-h] * step + r[h:]
            step, h = step * step, 2 * h
        if h < gram:
            r = r[:len(r) - (gram - h)] * step + r[gram - h:]
        r ^= r >> np.uint64(29)
        r *= _STEP
        r ^= r >> np.uint64(32)
    return r


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    h = 1
    while 2 * h <= width:
        x, h = np.minimum(x[:-h], x[h:]), 2 * h
    return x if h == width else np.minimum(x[:len(x) - (width - h)], x[width - h:])


def _runs(block: bytes, starts: np.ndarray, sizes: np.ndarray, length: int, gram: int):
    """(text number, first window, windows, anchor rank, run digest) of the
    runs in texts joined to one block."""
    none = np.empty(0, np.int64)
    if len(block) < length:
        return none, none, none, none, none
    ranks = _ranks(np.frombuffer(block, np.uint8), gram)
    best = _least((ranks & ~_POS) | np.arange(len(ranks), dtype=np.uint64), length - gram + 1)
    inside = np.zeros(len(best) + 1, np.int8)
    long = sizes >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, starts[long] + sizes[long] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    if not len(window):
        return none, none, none, none, none
    anchor = (best[window] & _POS).astype(np.int64)
    cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    first, last = window[np.r_[0, cut]], window[np.r_[cut - 1, len(window) - 1]]
    view = memoryview(block)
    digest = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())), np.uint64, len(first))
    return np.searchsorted(starts, first, "right") - 1, first, last - first + 1, ranks[anchor[np.r_[0, cut]]].view(np.int64), digest.view(np.int64)


def _packed(above, at, n):
    return (above << (_AT_BITS + _RUN_BITS)) | (at << _RUN_BITS) | n


def _unpacked(p):
    return p >> (_AT_BITS + _RUN_BITS), (p >> _RUN_BITS) & ((1 << _AT_BITS) - 1), p & ((1 << _RUN_BITS) - 1)


#: the document is (id, th): th is the whole hash of its text
_ROWS = "gram long, run long, id long, place long, end long, bytes binary, th long"
_NAMES = ["gram", "run", "id", "place", "end", "bytes"]


def _batch(gram, run, ids, place, th, end=None, parts=None):
    """Rows to sort, or settled spans: these have an ``end`` (and ``place``
    with no windows) and pass the sort by."""
    cols = [pa.array(c, pa.int64()) for c in (gram, run, ids, place)]
    cols.append(pa.nulls(len(ids), pa.int64()) if end is None else pa.array(end, pa.int64()))
    cols.append(pa.nulls(len(ids), pa.binary()) if parts is None else pa.array(parts, pa.binary()))
    return pa.RecordBatch.from_arrays([*cols, pa.array(th, pa.int64())], [*_NAMES, "th"])


def _settled(ids, place, th, length):
    """Spans of repeated runs, those that touch within a document joined."""
    o = np.lexsort((place, th, ids))
    ids, th, (_, start, n) = ids[o], th[o], _unpacked(place[o])
    end = start + n + length - 1
    # within a document, runs come in order of start and of end
    at = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (th[1:] != th[:-1]) | (start[1:] > end[:-1])])
    ids, th, end, place = ids[at], th[at], end[np.r_[at[1:] - 1, len(end) - 1]], _packed(0, start[at], 0)
    with np.errstate(over="ignore"):  # any spread will do
        return _batch((ids ^ place ^ th) * _STEP.astype(np.int64), np.zeros_like(ids), ids, place, th, end)


def _repeats(gram, run, ids, place, th):
    """For rows in order of (gram, run, id, th, place): whether each starts a
    class, the row that starts its class, and whether it repeats that row at
    another place (the same place is a row that is there twice)."""
    new = np.r_[True, (gram[1:] != gram[:-1]) | (run[1:] != run[:-1])]
    first = np.maximum.accumulate(np.where(new, np.arange(len(gram)), 0))
    return new, first, ~new & ((ids != ids[first]) | (place != place[first]) | (th != th[first]))


def _anchors(length: int, gram: int, texts_of, carry: bool):
    """Task: one row per anchor rank and run, and the spans that repeats within
    the task settle. ``texts_of`` gives (id, th, start in the document, bytes)
    from batches; ``carry``: rows take the bytes of their run along."""

    def settle(held):
        gram, run, ids, place, th, parts = (np.concatenate(c) for c in zip(*held))
        o = np.lexsort((place, th, ids, run, gram))
        gram, run, ids, place, th, parts = gram[o], run[o], ids[o], place[o], th[o], parts[o] if carry else None
        new, _, rep = _repeats(gram, run, ids, place, th)
        yield _batch(gram[new], run[new], ids[new], place[new], th[new], None, parts[new] if carry else None)
        if rep.any():
            yield _settled(ids[rep], place[rep], th[rep], length)

    def rank(texts):
        sizes = np.array([len(t[3]) for t in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        block = b"".join(t[3] for t in texts)
        doc, first, n, ranks, digest = _runs(block, starts, sizes, length, gram)
        ids, th, base = (np.array([t[i] for t in texts], np.int64)[doc] for i in range(3))
        parts = np.empty(len(first) if carry else 0, object)
        if carry:
            parts[:] = [block[a:b] for a, b in zip(first.tolist(), (first + n + length - 1).tolist())]
        return ranks, digest, ids, _packed(0, first - starts[doc] + base, n), th, parts

    def run(batches):
        held, n_held, texts, size = [], 0, [], 0
        for text in texts_of(batches):
            for at in range(0, max(len(text[3]) - length + 1, 0), _BLOCK):
                part = text[3][at:at + _BLOCK + length - 1]
                if texts and size + len(part) > 2 * _BLOCK:
                    held.append(rank(texts))
                    n_held, texts, size = n_held + len(held[-1][0]), [], 0
                if n_held > _HELD:
                    yield from settle(held)
                    held, n_held = [], 0
                texts.append((text[0], text[1], text[2] + at, part))
                size += len(part)
        if texts:
            held.append(rank(texts))
        if held and sum(len(h[0]) for h in held):
            yield from settle(held)

    return run


def _whole(batches):
    """Texts of (id, th, text)."""
    for b in batches:
        for i, th, text in zip(*b.columns):
            yield i.as_py(), th.as_py(), 0, text.as_py()


def _open_runs(length: int):
    def texts(batches):
        """Texts of (id, th, text, places): the bytes of each run."""
        for b in batches:
            for i, th, text, places in zip(*b.columns):
                i, th, text = i.as_py(), th.as_py(), text.as_py()
                for at, n in zip(*(x.tolist() for x in _unpacked(np.array(places.as_py(), np.int64))[1:])):
                    yield i, th, at, text[at:at + n + length - 1]

    return texts


def _carried(batches):
    """Texts of rows that took their bytes along: (id, th, place, bytes)."""
    for b in batches:
        for i, th, place, part in zip(*b.columns):
            yield i.as_py(), th.as_py(), _unpacked(place.as_py())[1], part.as_py()


def _sorted_pass(length: int, hot: list[int] | tuple = ()):
    """Task over rows in order of (gram, run, id, th, place): spans of all rows but
    the first of their class, and the first rows of grams with several classes.
    Rows without a th are of documents that their id alone tells apart. ``hot``: grams
    of several classes, of which a task sees some."""
    hot = np.array(hot, np.int64)

    def run(batches):
        head, head_part = np.empty((5, 0), np.int64), np.empty(0, object)  # first row of the class that is open
        gram, gram_part = head, head_part  # a class's first row of the gram that is open
        given = False  # whether that row is out already
        for b in batches:
            end = b.column(4)
            if end.null_count < b.num_rows:  # settled spans pass by
                yield b.filter(end.is_valid())
                b = b.filter(end.is_null())
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in (*b.columns[:4], *b.columns[6:])]
            rows = np.hstack([head, np.stack(cols if len(cols) == 5 else [*cols, np.zeros_like(cols[0])])])
            parts = np.r_[head_part, b.column(5).to_numpy(zero_copy_only=False)]
            new, first, rep = _repeats(*rows)
            if rep.any():
                yield _settled(*rows[2:, rep], length)
            known, at = gram.shape[1], np.flatnonzero(new)[head.shape[1]:]
            starts, start_parts = np.hstack([gram, rows[:, at]]), np.r_[gram_part, parts[at]]
            same = starts[0][1:] == starts[0][:-1]
            several = np.r_[False, same] | np.r_[same, False] | np.isin(starts[0].astype(np.int64), hot)
            out = several.copy()
            out[:known] &= not given
            if out.any():
                yield _batch(*starts[:, out], None, start_parts[out])
            given = bool(several[-1]) or (given and len(several) == known)
            gram, gram_part = starts[:, -1:], start_parts[-1:]
            head, head_part = rows[:, first[-1:]], parts[first[-1:]]

    return run


def _cut(batches):
    """Task: (id, th, text, spans) -> counts and the digest of what is left."""
    for b in batches:
        out = []
        for text, spans in zip(b.column(2), b.column(3)):
            text = text.as_py()
            keep = np.ones(len(text), bool)
            for s in spans.as_py():
                keep[s["start"]:s["end"]] = False
            gone = np.flatnonzero(~keep)
            left = np.frombuffer(text, np.uint8)[keep]
            out.append((len(text), len(gone), int((np.diff(gone) > 1).sum()) + (len(gone) > 0), hashlib.sha256(left.tobytes()).hexdigest()))
        cols = [pa.array(c) for c in zip(*out)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), _id(F.col(id_col)).alias("id"), text_key(F.col(text_col)).alias("th"),
                       F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))


def _known(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` that may be among ``keys`` (both with id, th), and the others."""
    key = F.concat_ws(":", "id", "th")
    # each key twice: the filter holds the slots that are filled more than once
    twice = keys.select(F.explode(F.array(key, key)).alias("digest"))
    bits = filter_bits(keys.count(), MAX_FILTER_BITS)
    filt = written(repeated_slots(twice, bits), "bloom")
    tested = maybe_repeated(rows.withColumn("key", key), filt, bits, "key", "maybe").drop("key")
    return tested.where("maybe").drop("maybe"), tested.where("not maybe").drop("maybe")


def _hot(rows: DataFrame, docs: int, length: int, gram: int, texts_of) -> list[int]:
    """Ranks of many runs, at most ``1 / HOT_PART``, by a sample of ``docs`` documents."""
    share = min(SAMPLE_SHARE, SAMPLE_DOCS / max(docs, 1))
    some = rows.where(F.pmod(F.xxhash64("id", "th"), F.lit(1 << 30)) < int(share * (1 << 30)))
    ranked = some.mapInArrow(_anchors(length, gram, texts_of, False), _ROWS).where("end is null")
    runs = written(ranked.groupBy("gram", "run").agg(F.lit(1)).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sampled")
    total = runs.agg(F.sum("n")).first()[0] or 0
    return [r.gram for r in runs.where((F.col("n") >= HOT_LEAST) & (F.col("n") > total * HOT_PART)).select("gram").collect()]


def _dealt(ranked: DataFrame, hot: list[int]) -> DataFrame:
    """By rank, those of many runs by rank and run."""
    return ranked.repartition("gram", F.when(F.col("gram").isin(hot), F.col("run"))) if hot else ranked.repartition("gram")


def _round(rows: DataFrame, length: int, gram: int, texts_of, carry: bool, hot: list[int]) -> DataFrame:
    """Rank, sort, and tell repeats (rows with an end) from open runs."""
    ranked = rows.mapInArrow(_anchors(length, gram, texts_of, carry), _ROWS)
    in_order = _dealt(ranked, hot).sortWithinPartitions("gram", "run", "id", "th", "place")
    return written(in_order.mapInArrow(_sorted_pass(length, hot), _ROWS), f"round{gram}")


def repeated_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """(id, th, start, end): spans of bytes to remove, which may overlap."""
    steps = [g for g in STEPS if g < length]
    if not steps or length - steps[0] >= (1 << _RUN_BITS) - 1:
        raise ValueError(f"length must be {STEPS[0] + 1} to {STEPS[0] + (1 << _RUN_BITS) - 2}")
    rows = _keyed(docs, text_col, id_col).select("id", "th", "text")
    rounds = [_round(rows, length, steps[0], _whole, False, _hot(rows, rows.count(), length, steps[0], _whole))]
    open_runs = written(rounds[0].where("end is null").groupBy("id", "th").agg(F.collect_set("place").alias("places")), "open")
    maybe, _ = _known(rows, open_runs.select("id", "th"))
    texts, texts_of = maybe.join(open_runs, ["id", "th"]).select("id", "th", "text", "places"), _open_runs(length)
    for gram in [*steps[1:], length]:
        # the runs of a rank of the whole window are all one
        hot = _hot(texts, open_runs.count(), length, gram, texts_of) if texts_of is not _carried and gram < length else []
        rounds.append(_round(texts, length, gram, texts_of, gram < length, hot))
        texts, texts_of = rounds[-1].where("end is null").select("id", "th", "place", "bytes"), _carried
    spans = rounds[0]
    for r in rounds[1:]:
        spans = spans.unionByName(r)
    start = F.shiftrightunsigned("place", _RUN_BITS).bitwiseAND(F.lit((1 << _AT_BITS) - 1))
    return spans.where("end is not null").select("id", "th", start.alias("start"), "end")


def report(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = _keyed(docs, text_col, id_col)
    lists = written(repeated_spans(docs, text_col, id_col, length).groupBy("id", "th").agg(
        F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    maybe, whole = _known(rows, lists.select("id", "th"))
    joined = maybe.join(lists, ["id", "th"], "left")
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    cut = joined.select("doc", "th", "text", F.coalesce("spans", none).alias("spans")).mapInArrow(
        _cut, f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    kept = whole.select(F.col("doc").alias("id"), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
                        F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return cut.unionByName(kept).withColumnRenamed("id", "doc_id")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
