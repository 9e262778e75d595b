"""Registered queries over the code view of the driver tables.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame; nothing is
collected. Every query reads the whole ``documents`` table (plus ``labels``)
and processes whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import compare as OC
from corpusmill.operators import split as S
from corpusmill.plans import workflows as W
from corpusmill.sources.corpus import code_files, code_files_at_once, reply_files
from corpusmill.sources.files import of_suffix, pair_by_stem, primary_only, with_suffix

SEED = 42
TRAIN_FRAC = 0.8
VAL_FRAC = 0.1
MAX_SRC_TOKENS = 2048
# The limits of the rules that the queries show
INCLUDE_CAP, TIDY_INCLUDE_CAP, QUICK_ASM_LINES = 6, 8, 200


def stand_in_prediction(asm) -> F.Column:
    """A native stand-in for the generation plug-in: C rebuilt from the
    listing's first label and its string constants. Real runs plug a model in
    through ``operators.plugins.generate``."""
    a = F.col(asm) if isinstance(asm, str) else asm
    label = F.regexp_extract(a, r"(?m)^([A-Za-z_][A-Za-z0-9_]*):", 1)
    strings = F.regexp_extract_all(a, F.lit(r'(?m)^\s*\.string\s+"(.*)"\s*$'), 1)
    return F.concat(
        F.lit("int "), label, F.lit("(void)\n{\n  // "), F.array_join(strings, "\n  // "),
        F.lit("\n  return 0;\n}\n"))


def system_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean token similarity to the original C, per system (another
    decompiler, and the generation stand-in), over every primary source that
    has its assembly and the other tool's output."""
    return W.compare_systems(code_files(spark, sf_dir), predict=stand_in_prediction, include_cap=INCLUDE_CAP)


def reply_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same comparison over all stored turns: for each user turn with a reply
    and a later one, the reply is the original, the later one the other system's
    answer, and the candidate of the third system is the user turn as it is."""
    return W.compare_systems(reply_files(spark, sf_dir), predict=lambda asm: asm, include_cap=INCLUDE_CAP)


def eval_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation normal form of every C file (originals and the other
    tool's output)."""
    files = code_files(spark, sf_dir)
    return of_suffix(files, ".c").select(
        "name", T.normalize_for_eval("content", INCLUDE_CAP).alias("normalized"))


def asm_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembly normal form of every listing (row-local expression form)."""
    files = code_files(spark, sf_dir)
    return of_suffix(files, ".s").select(
        "name", T.normalize_asm_expr("content").alias("normalized"))


def comment_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment removal over every C file, with the rewrite-only-if-changed
    flag."""
    files = code_files(spark, sf_dir)
    cleaned = T.remove_comments("content")
    return of_suffix(files, ".c").select(
        "name", cleaned.alias("cleaned"), (cleaned != F.col("content")).alias("changed"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_by_stem(code_files(spark, sf_dir), ".s", ".c")


def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded exact 80/10/10 split of all paired stems."""
    return S.split_exact(pairs(spark, sf_dir).select("stem"), "stem", TRAIN_FRAC, VAL_FRAC, SEED)


def eval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation set of the test split: key list -> pair lookup (missing
    keys skipped) -> both texts non-empty -> C normal form (assembly raw)."""
    files = primary_only(code_files(spark, sf_dir, deal=False))
    keys = S.split_exact(pair_by_stem(files, ".s", ".c").select("stem"), "stem", TRAIN_FRAC, VAL_FRAC, SEED)
    return W.evaluation_set(files, keys.where("split = 'test'").select("stem"), INCLUDE_CAP, seed=SEED)


def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training set: pair -> split -> non-empty -> assembly normal form ->
    token budget (drop above 3x max, flag above max) -> C normal form."""
    return W.build_training_set(code_files(spark, sf_dir), TRAIN_FRAC, VAL_FRAC, SEED, MAX_SRC_TOKENS, INCLUDE_CAP)


def missing_kind_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary sources lacking the assembly or the other tool's output."""
    files = code_files(spark, sf_dir)
    keys = with_suffix(primary_only(files), ".c").select("stem")
    return OC.missing_kinds(files, keys, asm=".s", other=".ghidra.c")


def pending_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with no assembly yet (skip what already exists: anti join)."""
    files = code_files(spark, sf_dir)
    c = with_suffix(primary_only(files), ".c", value="name")
    s = with_suffix(files, ".s", value="name").select("stem")
    return c.join(s, "stem", "left_anti").select("stem", "name")


def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus tallies: files per kind, pairs found, usable pairs, distinct
    include lines across all C sources."""
    return W.corpus_counts(code_files_at_once(spark, sf_dir))


def tidy_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tidy every C text (lone '<' lines, braces, includes capped at 8,
    clipped at the last balanced brace)."""
    files = code_files(spark, sf_dir)
    return of_suffix(files, ".c").select("name", T.tidy_c("content", TIDY_INCLUDE_CAP).alias("tidy"))


def quick_asm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quick assembly clean-up (first 200 kept lines) of every listing."""
    files = code_files(spark, sf_dir)
    return of_suffix(files, ".s").select("name", T.clean_asm("content", QUICK_ASM_LINES).alias("cleaned"))


def sample_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One seeded test-split stem: quick asm clean-up -> generation stand-in
    -> tidy."""
    test = S.split_exact(pairs(spark, sf_dir).select("stem"), "stem", TRAIN_FRAC, VAL_FRAC, SEED).where("split = 'test'")
    return W.inspect_sample(code_files(spark, sf_dir), test, stand_in_prediction, 0, QUICK_ASM_LINES, TIDY_INCLUDE_CAP)


def sorted_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIM-1: the primary sources in the order of their names."""
    return W.sorted_listing(code_files(spark, sf_dir))


def threshold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateless (stream-safe) hash-threshold split of every paired stem."""
    return pairs(spark, sf_dir).select("stem", S.split_threshold("stem", TRAIN_FRAC, VAL_FRAC, SEED).alias("split"))


def prediction_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample report: the first five validation items of the training set
    (all five from train when validation is empty), each rendered as
    ``=== SAMPLE i ===`` + the evaluation form of its generated C."""
    from corpusmill.sinks.writers import sample_report

    first = W.first_samples(code_files(spark, sf_dir), 5, TRAIN_FRAC, VAL_FRAC, SEED, MAX_SRC_TOKENS)
    top = first.select("stem", "split_rank", T.normalize_for_eval(stand_in_prediction("src"), INCLUDE_CAP).alias("prediction"))
    return sample_report(top, "split_rank", "prediction").select("stem", F.col("value").alias("report"))


def asm_normal_form_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembly normal form through the line table: explode, carried section
    (``last(ignorenulls)`` window), ordered re-assembly. Same result as
    ``asm_normal_form``; one shuffle of all lines, keyed by file."""
    from corpusmill.operators.asm import normalize_asm

    files = of_suffix(code_files(spark, sf_dir), ".s").select("name", "content")
    return normalize_asm(files, "content", "name")
