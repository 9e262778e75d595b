"""Property tests (hypothesis generates batches; one Spark job per batch)."""
import string

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import compare as C
from corpusmill.functions import text as T
from corpusmill.operators import split as S

SETTINGS = settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
code_chars = st.text(alphabet=string.ascii_letters + string.digits + " \t\n(){};#<>.\"'*/\\", max_size=80)


@SETTINGS
@given(st.lists(code_chars, min_size=1, max_size=40))
def test_comment_free_text_is_unchanged(spark, texts):
    plain = [t for t in texts if "//" not in t and "/*" not in t and "\r" not in t]
    if not plain:
        return
    df = spark.createDataFrame([(t,) for t in plain], "t string")
    assert df.where(T.remove_comments("t") != F.col("t")).count() == 0


@SETTINGS
@given(st.lists(st.tuples(st.text(alphabet="ab c\n", max_size=30), st.text(alphabet="ab c\n", max_size=30)),
                min_size=1, max_size=40))
def test_similarity_symmetric_bounded_reflexive(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select(C.similarity("a", "b").alias("ab"), C.similarity("b", "a").alias("ba"),
                     C.similarity("a", "a").alias("aa")).collect()
    for r in rows:
        assert r.ab == r.ba
        assert 0.0 <= r.ab <= 1.0
        assert r.aa == 1.0


@SETTINGS
@given(st.lists(st.lists(st.sampled_from(
    ["#include <stdio.h>", "#include <a.h>", " #include  <b.h>", "#include <math.h>", "int x;", "", "}"]),
    max_size=15), min_size=1, max_size=30))
def test_normal_form_header_is_capped_and_distinct(spark, docs):
    texts = ["\n".join(d) for d in docs]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(T.normalize_c("t").alias("n")).collect():
        head = []
        for line in r.n.split("\n"):
            if not line.startswith("#include"):
                break
            head.append(line)
        assert len(head) <= 6 and len(set(head)) == len(head)


@SETTINGS
@given(st.sets(st.text(alphabet=string.ascii_lowercase, min_size=1, max_size=6), min_size=1, max_size=300))
def test_split_exact_disjoint_and_partition_independent(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "stem string")
    a = {r.stem: r.split for r in S.split_exact(df, "stem").collect()}
    b = {r.stem: r.split for r in S.split_exact(df.repartition(7), "stem").collect()}
    assert a == b and set(a) == set(keys)
    n = len(keys)
    counts = {s: sum(1 for v in a.values() if v == s) for s in ("train", "val", "test")}
    assert counts["train"] == int(n * 0.8) and counts["val"] == int(n * 0.1)
