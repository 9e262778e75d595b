"""Dictionary tokenizer: dense seeded ids, order kept, same result for the
salted, plain and broadcast joins."""
import random

from corpusmill.functions import text as T
from corpusmill.operators import tokenize as TK
from corpusmill.plans import eval_queries as EQ
from corpusmill.plans import workflows as W
from pyspark.sql import functions as F


def test_ids_in_order_for_every_join_path(spark):
    df = spark.createDataFrame([("a", ["x", "y", "x", "the"]), ("b", ["the"] * 50), ("c", [])],
                               "stem string, tokens array<string>")
    vocab = TK.build_vocab(df, "tokens", 42)
    ids = {r.token: r.id for r in vocab.collect()}
    assert sorted(ids.values()) == [1, 2, 3]
    expected = {"a": [ids["x"], ids["y"], ids["x"], ids["the"]], "b": [ids["the"]] * 50, "c": []}
    for kwargs in ({"salt_buckets": 16}, {"salt_buckets": 1}):
        got = {r.stem: r.ids for r in TK.to_ids(df, "stem", "tokens", vocab, **kwargs).collect()}
        assert got == expected, kwargs


def test_a_text_is_its_own_dictionary(spark):
    """Every distinct token once, with all its places; nulls and empty arrays have none."""
    rnd = random.Random(1)
    rows = [(i, [rnd.choice(["a", "b", "é", "", "aa", None]) for _ in range(rnd.randint(0, 40))]) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "i int, tokens array<string>")
    got = {r.i: r.g for r in df.select("i", TK.token_groups("tokens").alias("g")).collect()}
    for i, toks in rows:
        want = {}
        for at, t in enumerate(toks or []):
            if t is not None:
                want.setdefault(t, []).append(at)
        assert {g.token: g.places for g in got[i] or []} == want and len(got[i] or []) == len(want)


def test_only_distinct_tokens_of_a_text_are_joined(spark):
    """The rows that meet the vocabulary are the distinct tokens, however often they stand in a text."""
    df = spark.createDataFrame([("a", ["x"] * 5000 + ["y"]), ("b", ["x", "z"] * 700)], "stem string, tokens array<string>")
    vocab = TK.build_vocab(df, "tokens", 42)
    each = df.select(F.explode(TK.token_groups("tokens")).alias("g"))
    assert each.count() == 4
    ids = {r.token: r.id for r in vocab.collect()}
    got = {r.stem: r.ids for r in TK.to_ids(df, "stem", "tokens", vocab).collect()}
    assert got == {"a": [ids["x"]] * 5000 + [ids["y"]], "b": [ids["x"], ids["z"]] * 700}


def test_ids_after_the_cut_are_not_numbered(spark):
    """Both sides are cut to their lengths; the dictionary holds the whole texts."""
    pairs = spark.createDataFrame([("a", "train", "p q r s", "q t u"), ("b", "val", "", "p"), ("c", "test", "s", "")], "stem string, split string, src string, tgt string")
    whole = {r.stem: r for r in W.tokenized_training_set(pairs).collect()}
    cut = {r.stem: r for r in W.tokenized_training_set(pairs, max_src=2, max_tgt=1).collect()}
    assert sorted({i for r in whole.values() for i in r.input_ids + r.labels}) == [1, 2, 3, 4, 5, 6]
    for s, r in whole.items():
        assert (cut[s].input_ids, cut[s].labels, cut[s].split) == (r.input_ids[:2], r.labels[:1], r.split)
    assert whole["a"].input_ids[1] == whole["a"].labels[0] and whole["b"].input_ids == [] and whole["c"].labels == []


def test_ids_from_texts_are_those_from_tokens(spark, monkeypatch):
    """null, empty and blank texts, all whitespace, bytes that are no UTF-8, more tokens than are kept."""
    monkeypatch.setattr(TK, "KNOWN_TOKENS", 50)
    texts = [None, "", " \n\t ", "a", "int é(漢字); x\x1cy z\x85q", " ".join(f"w{i % 70}" for i in range(500)), "😀 b a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").unionByName(
        spark.sql("select 99 as i, cast(x'61FF20C3622062E6' as string) as text")).repartition(2)
    both = df.select("i", EQ.hashed_ids.of_text("text").alias("a"), EQ.hashed_ids(T.tokens("text")).alias("b")).collect()
    assert len(both) == 8 and all(r.a == r.b for r in both)
    assert {r.i: r.a and len(r.a) for r in both}[5] == 500
