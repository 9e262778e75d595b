"""Language identification by language-bitmask n-gram filters.

Each language has a Bloom filter of its characteristic character trigrams. The
filters are bit-sliced: one table of ``SLOTS`` slots holds, per slot, a bitmask
with one bit per language, so ``HASHES`` look-ups and an AND return all
languages whose filter contains an n-gram. A text's set bits are counted per
language; a filter that is filled to a share ``s`` says yes to a foreign
n-gram with probability ``f = s ** HASHES``, so of ``n`` n-grams and ``hits``
the corrected count is ``(hits - n * f) / (1 - f)``. The largest one decides;
its share of all (positive) counts is the score.

Learning counts the trigrams of all labelled texts that are not held out. A
trigram enters a language's filter if it makes up ``MIN_SHARE`` of that
language's trigrams or more (so a language has at most 1 / MIN_SHARE of them)
and at least ``RATIO`` of its largest share in any language. The model is
``SLOTS`` masks, a bounded size for any corpus; it alone goes through the
driver.

Letters are lower-cased; whatever is no letter becomes one blank, as are the
ends of a text, and trigrams do not reach from word to word. Texts are taken
whole, in blocks of bounded size.

Defined results: a null text, or one without a letter, is ``und`` with score 0,
as is any text if nothing was learned. Ties go to the first language in order.
Rows are predicted one by one: repeated rows and null ids get a row each (a
null id is not held out). Only the id and the text are inputs of a prediction.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import blocks, fresh, table, text_key, written

SLOTS_LOG2 = 20
HASHES = 3
MIN_SHARE = 2e-6
RATIO = 0.25
UNKNOWN = "und"
LEAST = 10  # n-grams without which no hit at all proves nothing
_MOST = 2_000_000  # distinct trigrams that a task holds before it hands them on
_ODD = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, trigram as 63 bits of code points) of all texts."""
    lowered = [f" {t.lower()} " for t in texts]
    sizes = np.array([len(t) for t in lowered], np.int64)
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    letter = _LETTER[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first blank after a letter stays
    keep[np.cumsum(sizes) - sizes] = True
    text = np.repeat(np.arange(len(texts)), sizes)[keep]
    c = np.where(letter, codes, 32)[keep].astype(np.uint64)
    same = (text[2:] == text[:-2]) & (c[1:-1] != 32)
    return text[2:][same], ((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])[same]


def slots(grams: np.ndarray, log2: int = SLOTS_LOG2) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [((g := grams * m) ^ (g >> np.uint64(31))) * _ODD[0] >> np.uint64(64 - log2) for m in _ODD[:HASHES]]


@dataclass
class Model:
    """``masks``: per 64 languages one table of slots; ``false``: each
    language's share of foreign n-grams that its filter lets pass."""

    langs: list[str]
    masks: list[np.ndarray]
    false: np.ndarray

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(trigrams, hits per language) of each text."""
        total, hits = np.zeros(len(texts)), np.zeros((len(texts), len(self.langs)))
        for block in blocks(enumerate(texts), str.isalpha):
            row = np.array([r for r, _, _ in block])
            text, grams = trigrams([t for _, t, _ in block])
            text = row[text]
            total += np.bincount(text, minlength=len(texts))
            at = slots(grams)
            for k, table_ in enumerate(self.masks):
                found = table_[at[0]]
                for s in at[1:]:
                    found = found & table_[s]
                for bit in range(min(64, len(self.langs) - 64 * k)):
                    hits[:, 64 * k + bit] += np.bincount(text[(found >> table_.dtype.type(bit)) & table_.dtype.type(1) == 1], minlength=len(texts))
        return total, hits

    def corrected(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(trigrams, hits per language without the false ones) of each text."""
        total, hits = self.hits([t or "" for t in texts])
        return total, np.maximum((hits - total[:, None] * self.false) / (1 - self.false), 0)

    def known(self, texts: list[str | None]) -> np.ndarray:
        """Whether a text may be in a learned language: it has n-grams, and some of
        them are in a filter unless they are fewer than ``LEAST`` or nothing was
        learned."""
        total, true = self.corrected(texts)
        return (total > 0) & ((true.sum(axis=1) > 0) | (total < LEAST) | (not self.langs))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        total, true = self.corrected(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best, all_ = true.argmax(axis=1), true.sum(axis=1)
        score = np.where(all_ > 0, true.max(axis=1) / np.where(all_ > 0, all_, 1), 0.0)
        some = total > 0
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best, some)], np.where(some, score, 0.0)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count(batches):
    """Task: (lang, text) -> (lang, gram, n), summed as far as one task sees."""
    sums = defaultdict(list)
    held = 0

    def merged(parts):
        grams = np.concatenate([g for g, _ in parts])
        out, at = np.unique(grams, return_inverse=True)
        return out, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

    def given():
        for lang, parts in sums.items():
            g, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
        sums.clear()

    for b in batches:
        by_lang = defaultdict(list)
        for lang, text in zip(*(c.to_pylist() for c in b.columns)):
            by_lang[lang].append(text)
        for lang, texts in by_lang.items():
            for block in blocks(enumerate(texts), str.isalpha):
                g, n = np.unique(trigrams([t for _, t, _ in block])[1], return_counts=True)
                sums[lang].append((g, n))
                held += len(g)
            if len(sums[lang]) > 16:
                before = sum(len(g) for g, _ in sums[lang])
                sums[lang] = [merged(sums[lang])]
                held -= before - len(sums[lang][0][0])
        if held > _MOST:
            yield from given()
            held = 0
    yield from given()


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          min_share: float = MIN_SHARE, ratio: float = RATIO) -> Model:
    """Learn from all rows that have a text and a language and are not held out."""
    rows = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = written(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "trigrams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return Model([], [], np.zeros(0))
    one = F.broadcast(docs.sparkSession.createDataFrame([(k, i, float(totals[k])) for i, k in enumerate(langs)], "lang string, bit int, total double"))
    shares = counts.join(one, "lang").withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= min_share)
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    chosen = shares.join(most, "gram").where(F.col("share") >= F.lit(ratio) * F.col("most")).select("gram", "bit")

    def to_slots(batches):
        for b in batches:
            at = np.concatenate(slots(b.column(0).to_numpy().view(np.uint64)))
            bit = np.tile(b.column(1).to_numpy(), HASHES)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(bit // 64), pa.array((np.uint64(1) << (bit % 64).astype(np.uint64)).view(np.int64))],
                                             ["slot", "part", "mask"])

    table_rows = chosen.mapInArrow(to_slots, "slot long, part int, mask long").groupBy("slot", "part").agg(F.bit_or("mask").alias("mask"))
    filled = table_rows.toArrow()  # at most SLOTS rows per 64 languages
    kind = next(t for t, most_ in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 1 << 62)) if len(langs) <= most_)
    masks = [np.zeros(1 << SLOTS_LOG2, kind) for _ in range((len(langs) + 63) // 64)]
    slot, part, mask = (filled.column(k).to_numpy() for k in range(3))
    for k, m in enumerate(masks):
        m[slot[part == k]] = mask[part == k].view(np.uint64).astype(kind)
    fill = np.array([np.count_nonzero(masks[i // 64] & kind(1 << (i % 64))) for i in range(len(langs))]) / (1 << SLOTS_LOG2)
    return Model(langs, masks, fill ** HASHES)


def _sent(docs: DataFrame, model: Model):
    """The model's parts as a broadcast of plain values, which a task can read
    without this package on its path."""
    return docs.sparkSession.sparkContext.broadcast((model.langs, model.masks, model.false))


def predicted(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, th, lang_pred, score) of every row."""
    shared = _sent(docs, model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = Model(*shared.value)
        for b in batches:
            langs, score = model.predict([None if t is None else t.decode("utf-8", "replace") for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(score)], ["id", "th", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("th"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, f"id {id_type}, th long, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text shows one of the learned languages, with all their
    columns unchanged: those go that have no letter, or that have ``LEAST`` n-grams
    and none of any language beyond the false positives. If nothing was learned (a corpus without
    labels), there is no language to hold a text against, and every text with a
    letter stays."""
    shared = _sent(docs, model)

    @F.pandas_udf("boolean")
    def known(texts):
        import pandas as pd

        return pd.Series(Model(*shared.value).known(texts.tolist()))

    name = fresh(docs, "known")
    return docs.withColumn(name, known(F.col(text_col))).where(F.col(name)).drop(name)


def op1_bitmask_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predicted(docs, learn(docs))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
