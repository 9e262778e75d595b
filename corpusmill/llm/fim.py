"""Fill-in-the-middle transformation with cuts found in a Fenwick tree.

A text is read as units, ``[A-Za-z]+|[^A-Za-z]`` from left to right, and cut
between units into prefix, middle and suffix. Its UTF-8 bytes are dealt into
blocks of ``BLOCK`` bytes. One pass counts what begins in each block, units and
code points, and a Fenwick tree keeps both counts. A cut after ``k`` units is
found by binary-lifting descent: the tree gives the block in which unit ``k``
begins, with the units and the code points before it, and only that block is
looked at again to find the byte. So a cut costs the logarithm of the blocks and
one block, whatever the length of the text, and the text itself is never made
into a list of units.

The cuts and the form follow from a hash of the id (see :func:`choice`), so a
document's output never depends on how rows are dealt to tasks. ``plain`` keeps
the text as it is. Rows are worked on one by one, in Arrow batches: no shuffle.

Defined results: a null text counts as empty, and an empty text or one that
holds a sentinel is ``plain``. A null id is hashed as the word ``null``. Repeated
rows give repeated results. Texts of any length are transformed whole; besides
the text itself, a task holds ``SLICE`` bytes of it and eight bytes for each
block. Empty tables give no rows. Columns of the input that are named like an
output are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import table

SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix, middle
KEEP_PERCENT = 90  # of the texts are transformed
SPM_PERCENT = 20  # of those have the suffix first
SEED = "1"
BLOCK = 4096
SLICE = 1 << 22  # bytes whose units are marked at once, a multiple of BLOCK

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output string"


def starts(data: np.ndarray, letter_before: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes begin a unit, and which begin a code point; ``letter_before``:
    whether the byte before them is a letter."""
    low = data | 0x20
    letter = (low >= 0x61) & (low <= 0x7A)
    point = (data & 0xC0) != 0x80
    run_on = np.empty(len(data), bool)
    run_on[:1] = letter_before
    run_on[1:] = letter[:-1]
    return np.where(letter, ~run_on, point), point


def _letter(byte: int) -> bool:
    return 0x61 <= byte | 0x20 <= 0x7A


class Cuts:
    """Fenwick tree over the blocks of one text: (units, code points)."""

    def __init__(self, data: np.ndarray, block: int = BLOCK):
        self.data, self.block = data, block
        n = -(-len(data) // block)
        tree = np.zeros((n + 1, 2), np.int64)
        step = max(block, SLICE // block * block)
        for at in range(0, len(data), step):
            marks = starts(data[at:at + step], at > 0 and _letter(int(data[at - 1])))
            edges = np.arange(0, len(marks[0]), block)
            first = at // block + 1
            for k in (0, 1):
                tree[first:first + len(edges), k] = np.add.reduceat(marks[k], edges, dtype=np.int64)
        total = tree.sum(axis=0)
        # in place: each node adds its sum to its parent's, a power of two at a time
        size = 1
        while size <= n:
            own = np.arange(size, n + 1, 2 * size)  # nodes whose lowest bit is ``size``
            up = own + size
            inside = up <= n
            np.add.at(tree, up[inside], tree[own[inside]])
            size *= 2
        self.tree, self.n = tree, n
        self.units, self.points = int(total[0]), int(total[1])

    def at(self, k: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``k`` units."""
        if k >= self.units:
            return len(self.data), self.points
        if k <= 0:
            return 0, 0
        # the last block with at most k units before it: unit k begins there, as
        # unit 0 is the first in the text
        at, units, points = 0, 0, 0
        step = 1 << self.n.bit_length()
        while step:
            if at + step <= self.n and units + int(self.tree[at + step, 0]) <= k:
                at += step
                units += int(self.tree[at, 0])
                points += int(self.tree[at, 1])
            step >>= 1
        low = at * self.block
        unit, point = starts(self.data[low:low + self.block], low > 0 and _letter(int(self.data[low - 1])))
        byte = int(np.flatnonzero(unit)[k - units])
        return low + byte, points + int(np.count_nonzero(point[:byte]))


def choice(doc_id: int | None, n: int, seed: str = SEED, keep: int = KEEP_PERCENT, spm: int = SPM_PERCENT) -> tuple[int, int, str]:
    """Units before the first and the second cut, and the form, by the first four
    32-bit numbers of sha256(``seed:doc_id``)."""
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(h[i:i + 4], "big") for i in (0, 4, 8, 12))
    one, two = h1 % (n + 1), h2 % (n + 1)
    return min(one, two), max(one, two), "plain" if h3 % 100 >= keep else "spm" if h4 % 100 < spm else "psm"


def transform(doc_id: int | None, text: bytes, block: int = BLOCK, sentinels: tuple[str, str, str] = SENTINELS, **how) -> tuple:
    """One row of ``SCHEMA`` without the id; the output in bytes."""
    cuts = Cuts(np.frombuffer(text, np.uint8), block)
    first, last, form = choice(doc_id, cuts.units, **how)
    p, s, m = (x.encode() for x in sentinels)
    if not text or form == "plain" or any(x in text for x in (p, s, m)):
        return cuts.units, "plain", None, None, None, None, text
    (a, a_points), (b, b_points) = cuts.at(first), cuts.at(last)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    out = b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))
    return cuts.units, form, a_points, b_points - a_points, a, b - a, out


def fill_in_middle(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sentinels: tuple[str, str, str] = SENTINELS,
                   seed: str = SEED, keep_percent: int = KEEP_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """A row per document: its id, units, form, the lengths of prefix and middle
    in code points and in bytes (null if plain), and the output."""
    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            rows, size = [], 0
            for i in range(b.num_rows):
                doc_id = ids[i].as_py()
                got = transform(doc_id, texts[i].as_py() or b"", sentinels=sentinels, seed=seed, keep=keep_percent, spm=spm_percent)
                rows.append((doc_id, *got))
                size += len(got[-1])
                if size >= SLICE:  # a few long texts are a batch
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    cols = list(zip(*rows)) or [()] * len(names)
    kinds = [pa.string() if n == "form" else pa.int64() for n in names[:-1]]
    arrays = [pa.array(c, k) for c, k in zip(cols, kinds)] + [pa.array(cols[-1], pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text again, from output and form alone. The text holds no sentinel, and
    none can begin inside another, so the first of each kind is the one put in."""
    p, s, m = sentinels
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)

    def parts(first: str, second: str) -> tuple[Column, Column]:
        body = F.substr(head, F.lit(len(first) + 1))
        return F.substring_index(body, second, 1), F.substring_index(body, second, -1)

    prefix, suffix = parts(p, s)
    suffix_first, prefix_last = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_last, middle, suffix_first)).otherwise(output)


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op12_fenwick_fim(spark, sf_dir: str) -> DataFrame:
    d = fill_in_middle(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _sha(F.col("output")).alias("output_sha256"),
                    _sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: cuts the text as a list of its units
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256(concat('1:', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS h FROM documents
), g AS (
  SELECT doc_id, t, u, len(u) AS n, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) % (len(u) + 1) AS k1,
         CAST(concat('0x', substr(h, 9, 8)) AS BIGINT) % (len(u) + 1) AS k2, CAST(concat('0x', substr(h, 17, 8)) AS BIGINT) % 100 AS h3,
         CAST(concat('0x', substr(h, 25, 8)) AS BIGINT) % 100 AS h4 FROM d
), c AS (
  SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
                            WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(k1, k2)], '') AS p, array_to_string(u[least(k1, k2) + 1:greatest(k1, k2)], '') AS m,
         array_to_string(u[greatest(k1, k2) + 1:], '') AS s FROM g
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE concat(p, m, s) END) AS restored_sha256
FROM c
"""
