"""Public end-to-end flows over a directory of files."""
import os
import tempfile

from corpusmill.plans import workflows as W
from corpusmill.sources.files import load_text_files


def _corpus(spark):
    d = tempfile.mkdtemp(prefix="corpusmill-wf-")
    files = {
        "a.c": "#include <stdio.h>\nint main()\n{ return 0; } // x\n",
        "a.s": "\t.text\nmain:\n\tret\n",
        "a.ghidra.c": "int main(void) { return 0; }\n",
        "b.c": "int f() { return 1; }\n",
        "b.s": "f:\n\tli a0,1\n\tret\n",
        "b.ghidra.c": "undefined f(void) { return 1; }\n",
        "c.c": "int g;\n",
    }
    for name, text in files.items():
        with open(os.path.join(d, name), "w") as fh:
            fh.write(text)
    return load_text_files(spark, d, "*.[cs]")


def test_compare_systems_without_and_with_a_predictor(spark):
    files = _corpus(spark)
    other_only = {r.system: r for r in W.compare_systems(files).collect()}
    assert set(other_only) == {"other"} and other_only["other"].n_samples == 2
    from pyspark.sql import functions as F
    both = {r.system: r for r in W.compare_systems(files, predict=lambda asm: F.lit("int main() { return 0; }")).collect()}
    assert set(both) == {"other", "model"} and both["model"].n_samples == 2


def test_training_and_evaluation_sets_and_cleaning(spark):
    files = _corpus(spark)
    ts = {r.stem: r for r in W.build_training_set(files, 0.5, 0.5).collect()}
    assert set(ts) == {"a", "b"}
    assert ts["a"].src == "main:\nret" and ts["a"].tgt.startswith("#include <stdio.h>\n\nint main() {")
    keys = spark.createDataFrame([("b",), ("zzz",)], "stem string")
    ev = W.evaluation_set(files, keys).collect()
    assert [r.stem for r in ev] == ["b"]
    cleaned = {r.name: r.changed for r in W.clean_corpus(files).collect()}
    assert cleaned["a.c"] is True and cleaned["b.c"] is False


def test_tokenised_training_set_with_and_without_a_tokenizer(spark):
    from corpusmill.operators import plugins

    pairs = spark.createDataFrame([("a", "train", "x y x", "p q"), ("b", "test", "y z", ""), ("c", "val", "q", "x")],
                                  "stem string, split string, src string, tgt string")
    got = {r.stem: r for r in W.tokenized_training_set(pairs, max_src=2).collect()}
    ids = {t: i for r, s in ((got["a"], "p q"),) for t, i in zip(s.split(), r.labels)}
    assert len(got["a"].input_ids) == 2 and got["b"].labels == [] and got["b"].split == "test"
    # one dictionary for both sides and all splits
    assert got["c"].input_ids == [ids["q"]] and got["c"].labels == [got["a"].input_ids[0]]

    def letters(df, text, out):
        return plugins.tokenize(df, text, lambda ts: [[ord(c) for c in t] for t in ts], out)

    own = {r.stem: r for r in W.tokenized_training_set(pairs, max_src=3, max_tgt=1, tokenizer=letters).collect()}
    assert own["a"].input_ids == [120, 32, 121] and own["a"].labels == [112]


def test_budget_leaves_pairs_out_only_when_asked(spark):
    from pyspark.sql import functions as F

    files = _corpus(spark)
    all_ = W.build_training_set(files, 0.5, 0.5).count()
    kept = W.build_training_set(files, 0.5, 0.5, max_src_tokens=0)
    assert kept.count() + W.over_budget(files, 0, 0.5, 0.5).count() == all_ and W.over_budget(files, 0, 0.5, 0.5).where(F.col("n_src_tokens") == 0).count() == 0


def test_candidates_are_ranked_by_mean_loss(spark):
    src = spark.createDataFrame([("a",), ("a",), ("b",)], "stem string")
    scores = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 3.0), ("a", 1, 1.5), ("a", 2, 25.0), ("z", 0, 0.0)], "stem string, candidate int, nll double")
    got = {(r.stem, r.candidate): r for r in W.rank_candidates_by_loss(src, scores).collect()}
    assert [got["a", c]["rank"] for c in (0, 1, 2)] == [2, 1, 3] and got["a", 0].mean_loss == 2.0 and got["a", 0].n_tokens == 2
    assert got["a", 2].perplexity == float("inf") and got["b", None]["rank"] is None and len(got) == 4


def test_whole_harvest_with_every_outcome(spark):
    import json

    sec = lambda *lines: json.dumps({"parse": {"sections": [{"line": l, "index": i} for l, i in lines]}})
    body = lambda h: json.dumps({"parse": {"text": {"*": h}}})
    c = sec(("Ada", "1"), ("C", "2"))
    rows = [(1, "T", c, body("<pre>int&#32;x;</pre>")), (2, "T", c, body("<code>int x;</code>")), (3, "T", c, body("<pre>int y;</pre>")),
            (4, "U", sec(("C++", "1")), body("<pre>a</pre>")), (5, "U", c, body("")), (6, "U", c, body("text")), (7, "U", "no json", body("<pre>a</pre>")),
            (8, "U", sec(("C", None)), body("<pre>a</pre>")), (9, "U", c, "no json")]
    df = spark.createDataFrame(rows, "arrival long, title string, sections_json string, text_json string")
    got = {r.arrival: (r.name, r.status, r.outcome) for r in W.harvest_code(df).collect()}
    assert got == {1: ("T.c", "written", "saved"), 2: (None, "skipped-same", "skipped"), 3: ("T__2.c", "written-suffixed", "saved"),
                   4: (None, "no section", "skipped"), 5: (None, "no html", "skipped"), 6: (None, "no code", "skipped"),
                   7: (None, "error", "error"), 8: (None, "error", "error"), 9: (None, "error", "error")}
