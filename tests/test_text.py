"""Edge rows for the text functions, checked against plain-Python
statements of the same rules."""
import re

from pyspark.sql import functions as F

from conftest import many, one
from corpusmill.functions import text as T


def py_lines(s):
    return s.splitlines()


def test_decode_drops_bad_bytes_and_translates_newlines(spark):
    df = spark.createDataFrame([(bytearray(b"A\xffB"),), (bytearray(b"a\r\nb\rc"),)], "b binary")
    got = [r.t for r in df.select(T.decode_text("b").alias("t")).collect()]
    assert got == ["AB", "a\nb\nc"]


def test_lines_and_strip_follow_python(spark):
    values = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc", "x\x0by\x0cz\x1cw\x85v u", "  \t x 　"]
    got = many(spark, T.lines("t"), values)
    assert got == [py_lines(v) for v in values]
    got = many(spark, T.strip_ws("t"), values)
    assert got == [v.strip() for v in values]
    got = many(spark, T.tokens("t"), values)
    assert got == [v.split() for v in values]


def test_brace_and_blank_runs(spark):
    assert one(spark, T.brace_style("t"), "int f()\n  {\n}") == "int f() {\n}"
    assert one(spark, T.brace_style("t"), "if (x){ y; }") == "if (x) { y; }"


def test_include_rules(spark):
    src = "\n".join([
        "#include<a.h>", "#include <a.h>", "# include <x.h>", "#include_next <n.h>",
        "#include <math.h>", "#include   <stdio.h>", "#include <stdio.h>", "#include <b.h>",
        "#include <c.h>", "#include <d.h>", "int main(){", "}",
    ])
    whole = one(spark, T.normalize_c("t"), src)
    assert all(f"#include <{h}.h>" in whole for h in "abcd")  # no cap unless asked for
    out = one(spark, T.normalize_c("t", include_cap=6), src)
    head = out.split("\n\n")[0].split("\n")
    # preferred first (stdio, then math), then order of appearance, cap 6
    assert head == ["#include <stdio.h>", "#include <math.h>", "#include<a.h>", "#include <a.h>",
                    "#include_next <n.h>", "#include <b.h>"]
    assert "# include <x.h>" in out
    assert "int main() {" in out
    assert "#include <c.h>" not in out


def test_normalize_c_collapses_blank_runs_and_strips(spark):
    out = one(spark, T.normalize_c("t"), "\n\n int x;\n\n\n\n\nint y;  \n\n")
    assert out == "int x;\n\nint y;"


def test_tidy_and_clip(spark):
    assert one(spark, T.clip_balanced("t"), "f(){a{b}c} tail {x") == "f(){a{b}c}"
    assert one(spark, T.clip_balanced("t"), "}{") == "}{"
    assert one(spark, T.clip_balanced("t"), "no braces  ") == "no braces  "
    out = one(spark, T.tidy_c("t"), "<\nint f()\n{ return 1; } junk {")
    assert out == "int f() { return 1; }"


def test_remove_comments(spark):
    cases = {
        'a = "//x"; // c': 'a = "//x"; ',
        "c = '\"'; /* x */ d": "c = '\"';  d",
        'a = "a\\"b//c"; //z': 'a = "a\\"b//c"; ',
        "x /* multi\nline */ y": "x  y",
        "int/**/x": "intx",
        'p = "open; // tail': 'p = "open; ',
        "a\r\nb": "a\nb",
    }
    got = many(spark, T.remove_comments("t"), list(cases))
    assert got == list(cases.values())


def test_remove_comments_long_literal_does_not_overflow(spark):
    big = '"' + "x" * 2_000_000 + '" // tail'
    out = one(spark, F.length(T.remove_comments("t")), big)
    assert out == 2_000_002 + 1


def test_fences_and_model_output(spark):
    cases = [
        ("```c\nint x;\n```", "int x;\n"),
        ("prose\n```c\nint x;\n```\n", "prose\n```c\nint x;\n"),
        ("```", ""),
        ("no fence", "no fence"),
    ]
    got = many(spark, T.strip_code_fences("t"), [c for c, _ in cases])
    assert got == [e for _, e in cases]
    cases = [
        ("junk #include <a.h>\nint main", "#include <a.h>\nint main"),
        ("note: int main(void){}", "int main(void){}"),
        ("\n\t  plain", "plain"),
    ]
    got = many(spark, T.clean_model_output("t"), [c for c, _ in cases])
    assert got == [e for _, e in cases]


def test_safe_filename_and_url_title(spark):
    long = "x" * 200
    got = many(spark, T.safe_filename("t", max_chars=120), [long, "a/b:c*", "", "  two   words "])
    assert got == ["x" * 118 + ".c", "a_b_c_.c", "snippet.c", "two_words.c"]
    assert many(spark, T.safe_filename("t"), [long]) == [long + ".c"]
    got = many(spark, T.url_to_title("t"), ["https://h.org/wiki/C%2B%2B+x", "/wiki/A_B", "/wiki/%zz", "/x/y"])
    assert got == ["C+++x", "A B", "%zz", "/x/y"]


def test_content_hash_and_truncation(spark):
    import hashlib
    h = one(spark, T.content_hash("t"), "abc\n\n\n")
    assert h == hashlib.sha256(b"abc\n").hexdigest()
    got = many(spark, T.truncate_info("t", 2000), ["e" * 2000, "e" * 2001, "", "  \n"])
    assert got[0] == "e" * 2000
    assert got[1] == "e" * 2000 + " ... [truncated]"
    assert got[2] == got[3] == "unknown compile error"


def test_asm_rules(spark):
    src = "\n".join([
        "\t.section .rodata", ".LC0:", '\t.string "a # b"', "\t.data", "\t.quad 7",
        "\t.section .rodata.str1.8", '\t.string "dropped"', "\t.asciz \"z\"",
        "\t.text", "main:", ".L3:", "\tadd a0,a1 # c", "\tmv   a0,  a1 // d", "\tret ; e", "# full", "",
        "\t.section", "\t.string \"none\"",
    ])
    out = one(spark, T.normalize_asm_expr("t"), src).split("\n")
    assert out == ['.string "a # b"', ".quad 7", "main:", "add a0,a1", "mv a0, a1", "ret"]
    keep = one(spark, T.normalize_asm_expr("t", keep_local_labels=True), src).split("\n")
    assert ".L3:" in keep and ".LC0:" in keep


def test_clean_asm(spark):
    src = "\n".join([".file x", "", "  a  "] + [f"i{k}" for k in range(300)])
    assert len(one(spark, T.clean_asm("t"), src).split("\n")) == 301
    out = one(spark, T.clean_asm("t", 200), src).split("\n")
    assert len(out) == 200 and out[0] == "a" and out[-1] == "i198"


def test_collapse_blank_runs(spark):
    assert one(spark, T.collapse_blank_runs("t"), "a\n\n\n\nb\n\nc") == "a\n\nb\n\nc"


def test_percent_escapes_equal_unquote(spark):
    """Bad escapes stay, bytes that are no UTF-8 are replaced as the standard library replaces them."""
    import random
    from urllib.parse import unquote

    rng = random.Random(6)
    bits = ["%20", "%ZZ", "%", "%4", "a", "+", "%C3%A9", "%c3", "%E6%97%A5", "%E6%97", "%F0%9F%98%80", "%F0%9F", "%80", "%ff", "é", "%25", "%00", "%2", "%ED%A0%80", "%C0%AF", "%E0%80%80", "%F8%88", "_"]
    values = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 8))) for _ in range(600)] + ["a%20b%ZZ", "", "%"]
    assert many(spark, T.percent_decode("t"), values) == [unquote(v) for v in values]
    assert many(spark, T.url_to_title("t"), ["https://h.org/wiki/C%2B%2B+a%20b%ZZ_c?x=1", "/wiki/%zz"]) == ["C+++a b%ZZ c", "%zz"]


def test_comments_against_a_scanner(spark):
    """A scanner that reads character by character, over random code."""
    import random

    def scan(code):
        out, i = [], 0
        while i < len(code):
            c = code[i]
            if c in "\"'":
                j = i + 1
                while j < len(code) and code[j] != c:
                    j += 2 if code[j] == "\\" else 1
                if j < len(code):
                    out.append(code[i:j + 1])
                    i = j + 1
                    continue
            if code.startswith("//", i):
                while i < len(code) and code[i] != "\n":
                    i += 1
                continue
            if code.startswith("/*", i) and code.find("*/", i + 2) >= 0:
                i = code.find("*/", i + 2) + 2
                continue
            if c != "\r":
                out.append(c)
            i += 1
        return "".join(out)

    rng = random.Random(12)
    values = ["".join(rng.choice(["/", "*", "//", "/*", "*/", "\"", "'", "\\", "\n", "\r", "a", "é", "**/", " "]) for _ in range(rng.randint(0, 14))) for _ in range(800)]
    assert many(spark, T.remove_comments("t"), values) == [scan(v) for v in values]
    assert one(spark, T.remove_comments("t"), '"' + "x" * 2_000_000 + '" // y') == '"' + "x" * 2_000_000 + '" '
    assert one(spark, T.remove_comments("t"), "/*" + "*x" * 1_000_000 + "*/z") == "z"
