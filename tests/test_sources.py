"""Whole-file loading, stems, pairing and key lists."""
import os
import tempfile

from corpusmill.sources import files as SF


def test_load_pair_and_primary(spark):
    d = tempfile.mkdtemp(prefix="corpusmill-src-")
    content = {"x.c": b"int x;\r\n", "x.s": b"\xff.text\n", "y.c": b"y", "x.ghidra.c": b"g", "z.txt": b"no"}
    for name, data in content.items():
        with open(os.path.join(d, name), "wb") as fh:
            fh.write(data)
    files = SF.load_text_files(spark, d, "*.[cs]")
    names = sorted(r.name for r in files.collect())
    assert names == ["x.c", "x.ghidra.c", "x.s", "y.c"]
    pairs = SF.pair_by_stem(files).collect()
    assert [(r.stem, r.src, r.tgt) for r in pairs] == [("x", ".text\n", "int x;\n")]
    assert sorted(r.name for r in SF.primary_only(files).collect()) == ["x.c", "x.s", "y.c"]
    stems = sorted(r.stem for r in SF.with_suffix(files, ".c").collect())
    assert stems == ["x", "x.ghidra", "y"]


def test_read_keys_and_problems(spark):
    d = tempfile.mkdtemp(prefix="corpusmill-keys-")
    p = os.path.join(d, "stems.txt")
    with open(p, "w") as fh:
        fh.write(" a \n\n b\n   \n")
    assert [r.stem for r in SF.read_keys(spark, p).collect()] == ["a", "b"]
    df = spark.createDataFrame([("1. first",), ("12. twelfth",), ("x",)], "value string")
    assert [r.problem_number for r in SF.parse_problems(df).collect()] == [1, 12, None]


def test_problem_numbers_checked_against_position(spark):
    df = spark.createDataFrame([("1. a", 1), ("3. b", 2), ("x", 3)], "value string, pos long")
    rows = SF.parse_problems(df, position_col="pos").collect()
    assert [r.number_matches for r in rows] == [True, False, False]


def test_reply_files_read_every_turn_and_pair_none_with_itself(spark, tmp_path):
    from corpusmill.sources.corpus import reply_files

    turns = [(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "assistant", "a2"), (1, 4, "user", "u2"), (1, 5, "user", "u3"),
             (1, 6, "assistant", "a3"), (2, 0, "assistant", "b0"), (2, 1, "user", "v1"), (2, 2, "assistant", "b1"), (3, 0, "user", "w")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.name, r.content) for r in reply_files(spark, str(tmp_path)).collect()}
    assert got == {("conv_1_1.s", "u1"), ("conv_1_1.c", "a1"), ("conv_1_1.ghidra.c", "a2"), ("conv_1_4.s", "u2"), ("conv_1_5.s", "u3"), ("conv_1_5.c", "a3"),
                   ("conv_2_1.s", "v1"), ("conv_2_1.c", "b1"), ("conv_3_0.s", "w")}
