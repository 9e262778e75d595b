import random

from corpusmill.llm import exact_dedup as X
from llm_helpers import DOCS, docs_of, duck, ordered, tables  # noqa: F401

COLS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_against_sql(spark, tables, duck):
    rnd = random.Random(1)
    texts = [" \t ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 5))) for _ in range(300)]
    texts += [None, "", " ", "x" * 200_000, "x" * 200_000] + ["hot  copy"] * 200
    folder = tables("documents", docs_of(texts), DOCS)
    got = X.op9_bloom_exact_dedup(spark, folder).collect()
    assert ordered(got, *COLS) == ordered(duck(folder, X.ORACLE), *COLS)


def test_full_filter_changes_nothing(spark, tables, duck):
    """With the smallest filter nearly every row is a false positive."""
    folder = tables("documents", docs_of([f"text {i % 20_000}" for i in range(30_000)]), DOCS)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = X.decisions(docs, max_filter_bits=32_768).collect()
    assert ordered(got, *COLS) == ordered(duck(folder, X.ORACLE), *COLS)


def test_single_rows_pass_straight_through(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(200)] + [(900, "t7")], "doc_id long, text string")
    d = df.select("doc_id", X.text_digest(df.text).alias("digest"))
    bits = X.filter_bits(201)
    tested = X.maybe_repeated(d, X.repeated_slots(d, bits), bits, "digest", "maybe")
    maybe = {r.doc_id for r in tested.where("maybe").collect()}
    assert {7, 900} <= maybe and len(maybe) < 20


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(None, None, "a"), (None, "", "b"), (3, "x y", "c"), (2, "x  y", "d"), (2, "x y", "d"), (None, "x\ty", "q"), (5, "z", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __digest string")
    got = X.deduplicated(df)
    assert got.columns == df.columns
    assert ordered(got.select("doc_id").collect(), "doc_id") == sorted([(2,), (5,), (None,)], key=repr)
    kept = X.decisions(df).where("kept").collect()
    assert ordered(kept, "doc_id", "group_size") == sorted([(2, 4), (5, 1), (None, 2)], key=repr)
    empty = df.limit(0)
    assert X.decisions(empty).count() == X.deduplicated(empty).count() == 0
