"""Dictionaries of texts, made in the tasks: held against Python's split, and against the sorted groups."""
import random

from corpusmill.functions.text import PY_WHITESPACE
from corpusmill.operators import tokenize as TK
from corpusmill.plans import workflows as W
from pyspark.sql import functions as F


def test_words_codes_and_cuts(spark):
    rnd = random.Random(3)

    def text():
        return "".join(rnd.choice(["a", "b", "é", "aa", "\U0001f600", "", *PY_WHITESPACE]) for _ in range(rnd.randint(0, 60)))

    rows = [(i, text(), text()) for i in range(700)] + [(900, None, "a"), (901, "a", None), (902, "", " ")]
    df = spark.createDataFrame(rows, "i int, s string, t string")
    got = {r.i: r for r in TK.text_dictionaries(df, {"s": 5, "t": None}).collect()}
    assert len(got) == len(rows)
    for i, s, t in rows:
        r = got[i]
        if s is None or t is None:
            assert (r.words, r.codes, r.n_s, r.n_t, r.n_kept) == ([], None, None, None, None)
            continue
        kept = s.split()[:5] + t.split()
        assert [r.words[c] for c in r.codes] == kept and r.n_s == len(s.split()[:5]) and r.n_t == len(t.split())
        assert set(r.words[:r.n_kept]) == set(kept) and sorted(r.words) == sorted({*s.split(), *t.split()})


def test_ids_are_those_of_the_sorted_groups(spark):
    """the whole training set without a sorted group of places for each text."""
    rnd = random.Random(4)
    words = ["w%d" % i for i in range(300)]
    rows = [(f"s{i}", "train", " ".join(rnd.choices(words, k=rnd.randint(0, 400))), "\t".join(rnd.choices(words, k=rnd.randint(0, 90)))) for i in range(80)]
    pairs = spark.createDataFrame(rows, "stem string, split string, src string, tgt string")
    got = W.tokenized_training_set(pairs, max_src=150, max_tgt=40)
    both = pairs.select("stem", F.split(F.concat_ws(" ", "src", F.translate("tgt", "\t", " ")), " ").alias("tokens")).select(
        "stem", F.filter("tokens", lambda t: t != "").alias("tokens"))
    whole = {r.stem: r.ids for r in TK.to_ids(both, "stem", "tokens", TK.build_vocab(both, "tokens", 42)).collect()}
    found = {r.stem: r for r in got.collect()}
    assert len(found) == 80
    for stem, _, s, t in rows:
        n = len(s.split())
        assert found[stem].input_ids == whole[stem][:n][:150] and found[stem].labels == whole[stem][n:][:40]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "places" not in plan
