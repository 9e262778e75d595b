import hashlib
import os
import re

import numpy as np
import pytest
from corpusmill.llm import fim as M
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import DOCS, docs_of, duck, ordered, tables  # noqa: F401
from pyspark.sql import functions as F

NAMES = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(doc_id, text):
    """The contract, over a list of units."""
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    n = len(units)
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(t), sha(t)
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(t)
    return doc_id, n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(t)


TEXTS = [None, "", "a", "ab cd", " ", "<P>", "a<S>b", "x <M", "<", "<P", "é", "aéb", "日本 語x", "a\x00b\n\r\t c", "😀a😀", "İK ſ", "aaa" * 5000,
         "wörd " * 3000, "." * 9000, "<<>S>P>M<", "P><S M>", "naïve <s> <p>"]


def test_query_equals_units_and_sql(spark, tables, duck):
    rows = docs_of(TEXTS * 12)
    folder = tables("documents", rows, DOCS)
    got = M.op12_fenwick_fim(spark, folder).collect()
    assert ordered(got, *NAMES) == sorted((brute(r[0], r[1]) for r in rows), key=repr)
    assert ordered(got, *NAMES) == ordered(duck(folder, M.ORACLE), *NAMES)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abZ .<é日😀\n", max_size=80), st.integers(1, 7), st.integers(0, 90))
def test_every_cut_over_small_blocks(text, block, k):
    """Units that go over many blocks, blocks that begin inside a character."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    cuts = M.Cuts(np.frombuffer(text.encode(), np.uint8), block)
    assert (cuts.units, cuts.points) == (len(units), len(text))
    head = "".join(units[:k])
    assert cuts.at(k) == (len(head.encode()), len(head))


def test_a_very_long_text_and_slices(monkeypatch):
    monkeypatch.setattr(M, "SLICE", 1 << 14)
    text = ("wort é " * 40_000) + "z" * 50_000 + "日" * 20_000
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    cuts = M.Cuts(np.frombuffer(text.encode(), np.uint8))
    for k in (0, 1, 2, 77_777, len(units) - 20_001, len(units) - 20_000, len(units) - 1, len(units), len(units) + 5):
        head = "".join(units[:k])
        assert cuts.at(k) == (len(head.encode()), len(head))


def test_nulls_ties_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "ab cd ef", 1, "x"), (None, "ab cd ef", 1, "x"), (None, None, 2, None), (7, "ab cd", 3, "y")],
                               "doc_id long, text string, n int, form string")
    got = M.fill_in_middle(df).select("doc_id", "n", "form", "prefix_chars", "middle_chars", M._sha(F.col("output")).alias("output_sha256"),
                                      M._sha(M.restored(F.col("output"), F.col("form"))).alias("restored_sha256")).collect()
    assert ordered(got, *NAMES) == sorted([brute(None, "ab cd ef")] * 2 + [brute(None, None), brute(7, "ab cd")], key=repr)
    assert M.fill_in_middle(df.limit(0)).count() == 0


def test_spans_cut_the_text(spark):
    df = spark.createDataFrame(docs_of(["né ab-cd 日本 xyz"] * 40), DOCS)
    for r in M.fill_in_middle(df, keep_percent=100, spm_percent=0).collect():
        text = "né ab-cd 日本 xyz".encode()
        p, m, s = text[:r.prefix_bytes], text[r.prefix_bytes:r.prefix_bytes + r.middle_bytes], text[r.prefix_bytes + r.middle_bytes:]
        assert r.output == f"<P>{p.decode()}<S>{s.decode()}<M>{m.decode()}"
        assert (r.prefix_chars, r.middle_chars) == (len(p.decode()), len(m.decode()))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables not present")
def test_all_given_documents(spark):
    got = M.op12_fenwick_fim(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert ordered(got, *NAMES) == sorted((brute(*r) for r in docs), key=repr)
