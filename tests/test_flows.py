"""Public flows: samples in rank order, the gate with its logs, candidates, inspection, listing, code from replies."""
from corpusmill.operators import split as S
from corpusmill.plans import workflows as W
from pyspark.sql import functions as F


def _corpus(spark, n, long=()):
    rows = []
    for i in range(n):
        body = "\tnop\n" * (4000 if i in long else 1)
        rows += [(f"f{i}.c", f"d/f{i}.c", f"int f{i}(void)\n{{ return {i}; }}\n"), (f"f{i}.s", f"d/f{i}.s", f"\t.text\nf{i}:\n{body}\tret\n")]
    return spark.createDataFrame(rows, "name string, path string, content string")


def test_first_samples_walk_on_when_the_budget_drops_some(spark):
    whole = W.build_training_set(_corpus(spark, 120)).select("stem").count()
    assert whole == 120
    rank = {r.stem: r.split_rank for r in S.split_exact(_corpus(spark, 120).where("name like '%.c'").selectExpr("replace(name, '.c', '') as stem"),
                                                        keep_rank=True).where("split = 'val'").collect()}
    order = sorted(rank, key=rank.get)
    assert [r.stem for r in W.first_samples(_corpus(spark, 120), 3).orderBy("split_rank").collect()] == order[:3]
    dropped = [int(s[1:]) for s in order[:9]]  # more than are looked at first
    got = W.first_samples(_corpus(spark, 120, long=dropped), 3, max_src_tokens=1000).orderBy("split_rank").collect()
    assert [r.stem for r in got] == order[9:12]
    every = [int(s[1:]) for s in order]
    fallback = W.first_samples(_corpus(spark, 120, long=every), 3, max_src_tokens=1000).collect()
    assert len(fallback) == 3 and not {r.stem for r in fallback} & set(order)


def test_gate_logs_candidates_inspection_and_listing(spark, tmp_path):
    files = _corpus(spark, 6).unionByName(spark.createDataFrame([("f1.ghidra.c", "d/f1.ghidra.c", "int g;\n")], "name string, path string, content string"))
    results = spark.createDataFrame([("f0", 0, "", "x"), ("f1", 1, " bad\nline ", None), ("f2", 0, "", None)], "stem string, returncode int, stderr string, asm string")
    gated = W.gate_corpus(files, results, parent="d", log_dir=str(tmp_path / "logs"))
    assert {r.stem: (r.ok, r.status) for r in gated.collect()} == {"f0": (True, "compiled"), "f1": (False, "failed"), "f2": (False, "failed"),
                                                                  **{f"f{i}": (False, "no result") for i in (3, 4, 5)}}
    assert [r.value for r in spark.read.text(str(tmp_path / "logs" / "ok")).collect()] == ["d/f0.c -> d/f0.s"]
    failed = [r.value for r in spark.read.text(str(tmp_path / "logs" / "failed")).collect()]
    assert sorted(failed) == ["d/f1.c (deleted) :: bad line", "d/f2.c (deleted) :: unknown compile error", *[f"d/f{i}.c :: no result" for i in (3, 4, 5)]]
    assert [(r.position, r.name) for r in W.sorted_listing(files).orderBy("position").collect()] == [(i + 1, f"f{i}.c") for i in range(6)]
    cands = W.candidate_texts(files, spark.createDataFrame([("f1",), ("f2",)], "stem string"), original=".c", other=".ghidra.c")
    assert sorted((r.stem, r.candidate) for r in cands.collect()) == [("f1", "original"), ("f1", "other"), ("f2", "original")]
    logits = spark.createDataFrame([("f1", [[0.0, 2.0]] * 9), ("f2", [[0.0, 2.0]] * 9)], "stem string, logits array<array<double>>")
    ids = lambda t: F.transform(t, lambda x: F.when(x == "int", 1).otherwise(0))
    ranked = {(r.stem, r.candidate): (r.n_tokens, r["rank"]) for r in W.rank_candidate_texts(cands, logits, ids).collect()}
    assert ranked == {("f1", "other"): (2, 1), ("f1", "original"): (6, 2), ("f2", "original"): (6, 1)}
    one = W.inspect_sample(files, spark.createDataFrame([("f3",)], "stem string"), lambda a: F.concat(F.lit("int main(void)\n{ /* "), a, F.lit(" */ }")))
    assert one.first().stem == "f3" and one.first().prediction.startswith("int main(void) {")


def test_generated_code_rejects_and_existing(spark):
    problems = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "problem_number int, text string")
    reply = '{"choices":[{"message":{"content":"%s"}}]}'
    replies = spark.createDataFrame([(1, reply % "```c\\n#include <x>\\n```"), (2, reply % "```\\n```"), (4, reply % "x")], "problem_number int, response string")
    got = {r.problem_number: (r.file_name, r.status, r.code) for r in W.generated_code(problems, replies, spark.createDataFrame([("_4.c",)], "name string")).collect()}
    assert got == {1: ("_1.c", "written", "#include <x>\n"), 2: ("_2.c", "empty", ""), 3: ("_3.c", "no reply", None), 4: ("_4.c", "exists", None)}
    assert W.generated_code(problems, replies).where("status = 'written'").count() == 2


def _guarded(files, keys):
    """The files, where the text of one whose stem is not among ``keys`` can't be had: an error on the first use."""
    stem = F.regexp_replace("name", r"(\.ghidra)?\.[cs]$", "")
    return files.withColumn("content", F.when(stem.isin(keys), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("moved: "), "name"))))


def test_an_evaluation_set_moves_the_texts_of_its_split_alone(spark):
    """with the seed of the split, texts of other splits are passed over where they are read."""
    files = _corpus(spark, 60)
    split = S.split_exact(files.where("name like '%.c'").selectExpr("replace(name, '.c', '') as stem"), keep_rank=True).select("stem", "split", "split_rank")
    for names in (["val", "test"], ["test"], ["val"]):
        keys = split.where(F.col("split").isin(names))
        listed = [r.stem for r in keys.collect()]
        want = sorted(W.evaluation_set(files, keys).collect())
        for require in (True, False):
            assert sorted(W.evaluation_set(_guarded(files, listed), keys, require=require, seed=42).collect()) == want
        assert len(want) == 6 * len(names)


def test_any_list_gives_the_same_set_with_a_seed(spark):
    """Lists that are no stretch of the order, with missing, repeated and null stems, of no stem at all, and of another seed."""
    files = _corpus(spark, 40)
    for listed in (["f1", "f17", "f30", "gone", None], ["f5"], ["f2", "f2"], ["gone"], []):
        keys = spark.createDataFrame([(s,) for s in listed], "stem string")
        for seed in (42, 7):
            assert sorted(W.evaluation_set(files, keys, seed=seed).collect()) == sorted(W.evaluation_set(files, keys).collect())


def test_evaluation_queries_move_no_training_text(spark, tmp_path, monkeypatch):
    """the registered queries, over files of which those of the training split can't be had."""
    from corpusmill.plans import corpus_queries as CQ
    from corpusmill.plans import eval_queries as EQ

    spark.createDataFrame([(i, [float(i * k % 7) for k in range(EQ.WIDTH)]) for i in range(70)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    files = _corpus(spark, 60)
    split = {r.stem: r.split for r in S.split_exact(files.where("name like '%.c'").selectExpr("replace(name, '.c', '') as stem"), "stem", CQ.TRAIN_FRAC, CQ.VAL_FRAC, CQ.SEED).collect()}
    for module, query, left in ((EQ, EQ.evaluation_metrics, ("val", "test")), (CQ, CQ.eval_pairs, ("test",))):
        got = []
        for some in (files, _guarded(files, [s for s, name in split.items() if name in left])):
            monkeypatch.setattr(module, "code_files", lambda *a, some=some, **k: some)
            got.append(sorted(query(spark, str(tmp_path)).collect()))
        assert got[0] and got[0] == got[1]
