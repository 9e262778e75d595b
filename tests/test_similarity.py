"""Token edit distance against a brute-force dynamic programme."""
import random

import pytest

from corpusmill.functions import compare as C
from corpusmill.functions import text as T


def brute(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        d[i][0] = i
    for j in range(len(b) + 1):
        d[0][j] = j
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return d[-1][-1]


def test_edges(spark):
    df = spark.createDataFrame([("", ""), ("", "a b"), ("int main ( ) { return 0 ; }", "int foo ( void ) { return 1 ; }")],
                               "a string, b string")
    rows = df.select(C.similarity("a", "b").alias("s"),
                     C.token_edit_distance(T.tokens("a"), T.tokens("b")).alias("d")).collect()
    assert rows[0].s == 1.0 and rows[0].d == 0
    assert rows[1].s == 0.0 and rows[1].d == 2
    assert rows[2].d == 3


def test_random_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"t{i}" for i in range(40)] + ["é", "一", "{", "}", "\U0001F600"]
    pairs = []
    for _ in range(60):
        a = [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        b = [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        pairs.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [(r.a, r.b, r.d, r.s) for r in df.select(
        "a", "b", C.token_edit_distance(T.tokens("a"), T.tokens("b")).alias("d"),
        C.similarity("a", "b").alias("s")).collect()]
    for a, b, d, s in got:
        ta, tb = a.split(), b.split()
        assert d == brute(ta, tb)
        exp = 1.0 if not ta and not tb else 1.0 - brute(ta, tb) / max(len(ta), len(tb), 1)
        assert s == pytest.approx(exp)


def test_many_distinct_tokens(spark):
    a = " ".join(f"w{i}" for i in range(2501))
    b = " ".join(f"w{i}" for i in range(2501) if i not in (5, 77)) + " extra"
    df = spark.createDataFrame([(a, b)], "a string, b string")
    d = df.select(C.token_edit_distance(T.tokens("a"), T.tokens("b")).alias("d")).first().d
    assert d == 3


def test_fast_path_matches_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"t{i}" for i in range(12)] + ["é", "{"]
    pairs = []
    for _ in range(80):
        a = [rng.choice(vocab) for _ in range(rng.randint(0, 90))]
        b = [rng.choice(vocab) for _ in range(rng.randint(0, 90))]
        pairs.append((" ".join(a), "  ".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", C.similarity_fast("a", "b").alias("f"), C.similarity("a", "b").alias("s")).collect()
    for r in rows:
        ta, tb = r.a.split(), r.b.split()
        assert r.f.distance == brute(ta, tb)
        assert r.f.similarity == pytest.approx(r.s)


def test_the_band_grows_until_it_is_exact(monkeypatch):
    rng = random.Random(3)
    for band in (1, 2, 5):
        monkeypatch.setattr(C, "BAND", band)
        for _ in range(400):
            a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 16))] for _ in range(2))
            assert C._edit_distance(a, b) == brute(a, b)


def test_places_are_held_for_some_columns_at_a_time(monkeypatch):
    monkeypatch.setattr(C, "BAND", 4)
    monkeypatch.setattr(C, "_EQ_BITS", 1 << 10)
    rng = random.Random(4)
    for _ in range(15):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(150, 300))]
        b = list(a)
        for _ in range(rng.randint(0, 60)):
            b[rng.randrange(len(b))] = "x"
            if rng.random() < 0.5:
                del b[rng.randrange(len(b))]
        assert C._edit_distance(a, b) == brute(a, b)


def test_very_long_texts_that_are_near_each_other():
    """200,000 tokens: the product of the lengths is out of reach."""
    rng = random.Random(5)
    a = [str(rng.randint(0, 5000)) for _ in range(200_000)]
    b = list(a)
    for i in range(0, 200_000, 2000):
        b[i] = "changed"
    del b[1001]
    b.insert(150_000, "more")
    assert C._edit_distance(a, b) == 102
