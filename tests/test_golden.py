"""The data case: normalised assembly and the two similarities, on a listing,
its source and two candidates written for this test. ``CORPUSMILL_GOLDEN_DIR``
may name a folder with another such case (one ``*.s`` listing, the original
``*.c`` with the same stem and two candidates), of which 28 kept lines and the
similarities 0.238095 and 0.346154 are expected; it joins the cases if set."""
import glob
import os

import pytest
from pyspark.sql import functions as F

from conftest import GOLDEN_DIR
from corpusmill.functions import compare as C
from corpusmill.functions import text as T
from corpusmill.operators.asm import normalize_asm

LISTING = """\t.file\t"count.c"
\t.option pic
\t.text
\t.section\t.rodata
\t.align\t3
.LC0:
\t.string\t"total # %d\\n"
.LC1:
\t.string\t"done"
\t.text
\t.align\t1
\t.globl\tmain
\t.type\tmain, @function
main:
.LFB0:
\t.cfi_startproc
\taddi\tsp,sp,-16\t# frame
\tsd\tra,8(sp)
\tmv   a1,   a0 // argument
\tlla\ta0,.LC0
\tcall\tprintf@plt
0:
\tbnez\ta0,1f
1:
\tli\ta0,0 ; result
\tld\tra,8(sp)
\tret
\t.cfi_endproc
\t.size\tmain, .-main
\t.section\t.note.GNU-stack,"",@progbits
\t.string\t"GNU"
"""
KEPT = ['.string\t"total # %d\\n"', '.string\t"done"', "main:", "addi sp,sp,-16", "sd ra,8(sp)", "mv a1, a0", "lla a0,.LC0", "call printf@plt",
        "0:", "bnez a0,1f", "1:", "li a0,0", "ld ra,8(sp)", "ret"]
TRUTH = "#define LIMIT 3  \r\n\r\n\r\n\r\n#include   <stdio.h>\r\n\r\nint main(int n)\r\n{\r\n  printf(\"total # %d\\n\", n);   \r\n  return 0;\r\n}\r\n"
TRUTH_LINES = ["#include <stdio.h>", "", "#define LIMIT 3  ", "", "int main(int n) {"]
CANDIDATES = {"a": "#include <stdio.h>\nint main(int n) { printf(\"total # %d\\n\", n); return 0; }\n",
              "b": "undefined8 main(int param_1)\n\n{\n  printf(\"total # %d\\n\", param_1);\n  return 0;\n}\n"}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module", params=["own", *(["given"] if GOLDEN_DIR and os.path.isdir(GOLDEN_DIR) else [])])
def golden(spark, request):
    if request.param == "own":
        rows = [("count.s", "asm", LISTING), ("count.c", "truth", TRUTH), *((f"count-{k}.c", "candidate", t) for k, t in CANDIDATES.items())]
        rows = [(n, r, bytearray(t.encode())) for n, r, t in rows]
    else:
        asm = glob.glob(os.path.join(GOLDEN_DIR, "*.s"))[0]
        stem, rows = os.path.basename(asm)[:-2], []
        for path in [asm, *sorted(glob.glob(os.path.join(GOLDEN_DIR, "*.c")))]:
            name = os.path.basename(path)
            with open(path, "rb") as fh:
                rows.append((name, "asm" if path == asm else "truth" if name == stem + ".c" else "candidate", bytearray(fh.read())))
    df = spark.createDataFrame(rows, "name string, role string, raw binary")
    return request.param, df.select("name", "role", T.decode_text("raw").alias("content"))


def test_asm_normal_form(golden):
    case, df = golden
    lines = df.where("role = 'asm'").select(T.normalize_asm_expr("content").alias("a")).first().a.split("\n")
    if case == "own":
        assert lines == KEPT
    else:
        assert len(lines) == 28 and lines[3] == "main:" and lines[-5:] == ["0:", "1:", "2:", "3:", "4:"]
    assert lines[0].startswith(".string\t")
    assert not any(line.startswith((".LC", ".LFB")) or '"GNU"' in line for line in lines)


def test_asm_window_form_matches_expression_form(golden):
    df = golden[1].where("role = 'asm'").withColumnRenamed("name", "stem")
    w = normalize_asm(df, "content", "stem").first().normalized
    assert w == df.select(T.normalize_asm_expr("content").alias("a")).first().a


def test_c_normal_form_head(golden):
    case, df = golden
    truth = df.where("role = 'truth'")
    lines = truth.select(T.normalize_c("content").alias("c")).first().c.split("\n")
    assert lines[:2] == ["#include <stdio.h>", ""] and lines[2].endswith("  ") and lines[3] == ""
    if case == "own":
        assert lines[:5] == TRUTH_LINES
    ev = truth.select(T.normalize_for_eval("content").alias("c")).first().c
    assert ev.split("\n")[2] == lines[2].rstrip()


def test_similarities(golden):
    case, df = golden
    truth = df.where("role = 'truth'").select(T.normalize_for_eval("content").alias("t")).first().t
    cands = df.where("role = 'candidate'").select(T.normalize_for_eval("content").alias("n"))
    t = F.lit(truth)
    rows = cands.select("n", C.similarity("n", t).alias("sim"), C.token_edit_distance(T.tokens("n"), T.tokens(t)).alias("d"),
                        F.size(T.tokens("n")).alias("len")).collect()
    for r in rows:
        a, b = r.n.split(), truth.split()
        assert (r.d, r.len) == (_distance(a, b), len(a)) and r.sim == pytest.approx(1 - r.d / max(len(a), len(b)))
    if case == "given":
        assert sorted((r.d, r.len, round(r.sim, 6)) for r in rows) == [(16, 15, 0.238095), (17, 26, 0.346154)]
