"""Python plug-ins in Arrow batches."""
from corpusmill.operators import plugins as P
from corpusmill.operators.gate import gate


def test_tokenize_generate_score(spark):
    df = spark.createDataFrame([("s1", "a b c", "x y"), ("s2", "", "z")], "stem string, src string, tgt string")
    tok = P.tokenize(df, "src", lambda texts: [[len(w) for w in t.split()] for t in texts], max_length=2)
    assert {r.stem: r.input_ids for r in tok.collect()} == {"s1": [1, 1], "s2": []}
    gen = P.generate(df, "src", lambda: "M", lambda m, batch: [m + ":" + s for s in batch])
    assert {r.stem: r.prediction for r in gen.collect()}["s1"] == "M:a b c"
    sc = P.score(df, "src", "tgt", lambda: None,
                 lambda m, s, t: [(float(len(a)), len(b.split()), 0) for a, b in zip(s, t)])
    assert {r.stem: (r.nll_sum, r.n_tokens) for r in sc.collect()} == {"s1": (5.0, 2), "s2": (0.0, 1)}


def test_run_external_captures_failures(spark):
    df = spark.createDataFrame([("a", "corpus/a.c"), ("b", "corpus/b.c"), ("c", "elsewhere/c.c")], "stem string, path string")

    def compile_one(row):
        if row["stem"] == "b":
            raise RuntimeError("boom")
        return 0, "", ".text"

    results = P.run_external(df, "stem", compile_one)
    g = {r.stem: (r.ok, r.log_line) for r in gate(df, results, parent="corpus").collect()}
    assert g["a"] == (True, "corpus/a.c -> corpus/a.s")
    assert g["b"][0] is False and g["b"][1] == "corpus/b.c (deleted) :: unexpected error: boom"
    assert "c" not in g
