"""End-to-end flows as public functions over any *files* frame
``(name, path, content)`` — e.g. ``sources.files.load_text_files(spark,
"hdfs:///corpus", "*.[cs]")``. The registered queries call these with the
code view of the driver tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import compare as C
from corpusmill.functions import docs as D
from corpusmill.functions import text as T
from corpusmill.functions import metrics as M
from corpusmill.operators import checks as CH
from corpusmill.operators import compare as OC
from corpusmill.operators import gate as G
from corpusmill.operators import harvest as H
from corpusmill.operators import metrics as OM
from corpusmill.operators import names as N
from corpusmill.operators import split as S
from corpusmill.operators import tokenize as TK
from corpusmill.operators.rows import select_where
from corpusmill.session import stored
from corpusmill.sinks.named_files import write_changed_files
from corpusmill.sources.files import non_empty_pairs, of_suffix, pair_by_stem, primary_only, stem_of, with_suffix


def build_training_set(files: DataFrame, train: float = 0.8, val: float = 0.1, seed=42,
                       max_src_tokens: int | None = None, include_cap: int | None = None, require: bool = False) -> DataFrame:
    """Pair ``.s``/``.c`` by stem -> seeded exact split of all pairs ->
    both texts non-empty -> assembly normal form -> token budget -> C normal
    form. With ``max_src_tokens``, pairs above three times that go (see
    :func:`over_budget`) and those above it are flagged; without, all stay.

    With ``require``, the set is written once, and no pairs at all, or no training
    or validation rows, are an error."""
    staged = _training_pairs(files, train, val, seed, include_cap)
    n = F.col("n_src_tokens")
    kept = F.lit(True) if max_src_tokens is None else n <= 3 * max_src_tokens
    if require:
        staged = CH.required(staged, "training-set", pairs=(F.count(F.lit(1)), "no (src, tgt) pairs found"),
                             train=(F.count_if(kept & (F.col("split") == "train")), "no training rows are left"),
                             val=(F.count_if(kept & (F.col("split") == "val")), "no validation rows are left"))
    if max_src_tokens is None:
        return staged.withColumn("will_truncate", F.lit(False))
    return staged.where(kept).withColumn("will_truncate", n > max_src_tokens)


def over_budget(files: DataFrame, max_src_tokens: int, train: float = 0.8, val: float = 0.1, seed=42) -> DataFrame:
    """The pairs that :func:`build_training_set` leaves out: ``(stem, split,
    n_src_tokens)``."""
    return _training_pairs(files, train, val, seed, None).where(F.col("n_src_tokens") > 3 * max_src_tokens).select(
        "stem", "split", "n_src_tokens")


def _training_pairs(files: DataFrame, train: float, val: float, seed, include_cap: int | None) -> DataFrame:
    p = pair_by_stem(files, ".s", ".c")
    split = S.split_exact(p.select("stem"), "stem", train, val, seed)
    joined = non_empty_pairs(split.hint("merge").join(p, "stem", "inner"))
    src = T.normalize_asm_expr("src")
    staged = select_where(joined, [
        F.col("stem"), F.col("split"),
        T.let(src, lambda s: F.struct(s.alias("src"), F.size(T.tokens(s)).alias("n"))).alias("a"),
        T.normalize_c("tgt", include_cap).alias("tgt"),
    ], lambda r: F.lit(True))
    return staged.select("stem", "split", F.col("a.src").alias("src"), "tgt", F.col("a.n").alias("n_src_tokens"))


def first_samples(files: DataFrame, n: int = 5, train: float = 0.8, val: float = 0.1, seed=42, max_src_tokens: int | None = None) -> DataFrame:
    """The first ``n`` validation items of the training set, in split order; if none
    is left, those of the training split: ``(stem, split_rank, src)``, the assembly
    in normal form. The order is made on the stems alone, and only the texts of the
    first few are fetched and normalised; if the token budget drops some of them,
    twice as many are looked at."""
    def stems(suffix: str, flag: str) -> DataFrame:
        return with_suffix(files, suffix).select("stem", (F.col("content") != "").alias(flag))

    both = stems(".s", "s_ok").join(stems(".c", "c_ok"), "stem")
    ranked = S.split_exact(both.select("stem"), "stem", train, val, seed, keep_rank=True).select("stem", "split", "split_rank")
    usable = stored(ranked.join(both.where("s_ok and c_ok").select("stem"), "stem"), "ranked")
    asm = with_suffix(files, ".s").withColumnRenamed("content", "src")
    found = None
    for split in ("val", "train"):
        keys, look = usable.where(F.col("split") == split), 2 * n
        total = keys.count()
        while True:
            # a stated number of narrow rows: broadcast to the listings
            some = F.broadcast(keys.orderBy("split_rank").limit(look).select("stem", "split_rank"))
            found = select_where(asm.join(some, "stem"), [F.col("stem"), F.col("split_rank"), T.normalize_asm_expr("src").alias("src")],
                                 lambda r: F.lit(True) if max_src_tokens is None else F.size(T.tokens(r["src"])) <= 3 * max_src_tokens)
            found = stored(found.orderBy("split_rank").limit(n), "samples")
            left = found.count()
            if left >= n or look >= total:
                break
            look *= 2
        if left:
            break
    return found.orderBy("split_rank").limit(n)  # a stored table has no order of its own


def evaluation_set(files: DataFrame, keys: DataFrame, include_cap: int | None = None, require: bool = False, seed=None) -> DataFrame:
    """Key list -> pair lookup (missing keys skipped) -> both texts
    non-empty -> C normal form; the assembly stays raw. Other columns of the keys
    are carried along. With ``require``, an empty list and a list without any valid
    pair are errors.

    With ``seed``, that of the split the keys come from, files outside their stretch
    of its order are passed over before any text is moved. Any list gives the same
    rows with it; one that is no part of such a split only passes over fewer files."""
    if require:
        keys = CH.required(keys, "keys", keys=(F.count(F.lit(1)), "no stems in the list"))
    elif seed is not None:
        keys = stored(keys, "keys")
    if seed is not None:
        files = files.where(S.in_stretch(stem_of("name"), keys, seed))
    p = pair_by_stem(files, ".s", ".c")
    more = [c for c in keys.columns if c != "stem"]
    ev = non_empty_pairs(keys.hint("merge").join(p, "stem", "inner"))
    out = ev.select("stem", "src", T.normalize_c("tgt", include_cap).alias("tgt"), *more)
    return CH.required(out, "evaluation-set", pairs=(F.count(F.lit(1)), "no valid pairs after filtering")) if require else out


def evaluation_batches(evaluated: DataFrame, tokenizer: Callable[[Column], Column], size: int, max_tgt: int | None = None, pad_id: int = 0,
                       group: str = "split", rank: str = "split_rank") -> DataFrame:
    """``evaluated(stem, tgt, group, rank)`` -> ``(group, stem, batch_id, labels,
    attention_mask)``: target ids by ``tokenizer`` (token array -> id array), cut to
    ``max_tgt``, in batches of ``size`` in the order of ``rank`` within each group,
    padded to the longest of the batch; labels equal to the pad id are ignored."""
    ids = tokenizer(T.tokens("tgt"))
    cut = ids if max_tgt is None else F.slice(ids, 1, max_tgt)
    rows = evaluated.select(group, "stem", rank, cut.alias("ids"))
    return OM.pad_batches(S.assign_batches(rows, rank, size), "ids", [group, "batch_id"], pad_id).select(group, "stem", "batch_id", "labels", "attention_mask")


def evaluation_metrics(batches: DataFrame, logits: DataFrame | Callable[[DataFrame], DataFrame], group: str = "split", digits: int | None = 6) -> DataFrame:
    """Teacher-forced metrics of each group: ``batches(group, stem, labels)`` with
    the ``logits(stem, logits)`` a model has stored for them (one row of logits for
    each position, ``[T, V]``), or with a function that puts ``logits`` beside the
    ``labels`` of the batches, in one row a text or in several, each of some of its
    positions (what is too large to be moved or nested whole), and, if it has them,
    ``norms``, the log-sum-exp of each row of logits. Positions are
    flattened with their labels, those ignored do not count, and a stem without
    logits counts nowhere. Adds the printable ``summary`` line."""
    flat = OM.flatten_logits(_with_logits(batches, logits), "logits", "labels", keep=(group, "stem"))
    # the line is made of the exact values, the columns are rounded
    exact = OM.split_metrics(OM.score_tokens(flat), group, digits=None)
    lines = OM.metrics_summary(exact, group).withColumnRenamed(group, "__g")
    joined = exact.join(lines, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
    numbers = [c for c, t in exact.dtypes if t == "double"]
    return joined if digits is None else joined.withColumns({c: F.when(F.isnan(c), F.col(c)).otherwise(F.round(c, digits)) for c in numbers})


def _with_logits(labelled: DataFrame, logits: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    return logits(labelled) if callable(logits) else labelled.join(logits, "stem")


def corpus_counts(files: DataFrame, primary: str = ".c", listing: str = ".s", derived: str = ".ghidra.c") -> DataFrame:
    """One row of counts over ``files(name, content)``: sources, listings and the
    other tool's files, pairs by stem and those with two non-empty texts, distinct
    include lines. The texts are read in one pass, which observes the counts of the
    files and leaves a narrow row for each."""
    name = F.col("name")
    incs = F.transform(F.filter(T.lines("content"), lambda x: T.strip_ws(x).startswith("#include")), lambda x: T.collapse_ws(T.strip_ws(x)))
    is_src, is_tgt = name.endswith(listing), name.endswith(primary)
    narrow = files.where(is_src | is_tgt).select(
        stem_of(name).alias("stem"), name.endswith(derived).alias("derived"), is_tgt.alias("is_tgt"), (F.col("content") != "").alias("ok"),
        F.when(is_tgt, F.array_distinct(incs)).alias("incs"))
    rows, seen = CH.counted(narrow, "counts", n_sources=F.count_if(F.col("is_tgt") & ~F.col("derived")), n_listings=F.count_if(~F.col("is_tgt")),
                            n_other=F.count_if("derived"))
    both = rows.groupBy("stem").agg(F.bool_or(~F.col("is_tgt")).alias("s"), F.bool_or("is_tgt").alias("t"), F.bool_and("ok").alias("ok")).where("s and t")
    n_incs = rows.select(F.explode_outer("incs").alias("inc")).where("inc is not null").agg(F.count_distinct("inc"))
    counts = both.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("ok").alias("n_usable"))
    return counts.select(*[F.lit(n).cast("long").alias(k) for k, n in seen.items()], "n_pairs", "n_usable", n_incs.scalar().alias("n_distinct_includes"))


def compare_systems(files: DataFrame, predict: Callable[[Column], Column] | None = None,
                    other_suffix: str = ".ghidra.c", keys: DataFrame | None = None,
                    include_cap: int | None = None) -> DataFrame:
    """Mean token similarity to the original, per system: the other tool's
    output (``other_suffix``) and, with ``predict`` (a column function of the
    assembly, e.g. a generation plug-in's output column), the model. Keys
    default to every primary source."""
    if keys is None:
        keys = with_suffix(primary_only(files, other_suffix), ".c").select("stem")
    joined = OC.join_systems(files, keys, truth=".c", asm=".s", other=other_suffix)
    forms = [T.normalize_for_eval("truth", include_cap).alias("truth"), T.normalize_for_eval("other", include_cap).alias("other")]
    if predict is not None:
        forms.append(T.normalize_for_eval(predict(F.col("asm")), include_cap).alias("model"))
    # one struct referenced by every similarity call (at least twice), so
    # Catalyst keeps it as a column instead of inlining the normal forms into
    # the Python UDF's inputs (which Spark 4.1 cannot evaluate)
    normalized = joined.select("stem", F.struct(*forms).alias("p"))
    scores = {"other": C.similarity_fast(F.col("p.other"), F.col("p.truth"))["similarity"]}
    if predict is not None:
        scores["model"] = C.similarity_fast(F.col("p.model"), F.col("p.truth"))["similarity"]
    scored = normalized.select("stem", *[c.alias(f"sim_{n}") for n, c in scores.items()])
    long = OC.stack_systems(scored, "stem", {n: f"sim_{n}" for n in scores})
    return OC.system_means(long, digits=9)


def clean_corpus(files: DataFrame, suffix: str = ".c") -> DataFrame:
    """Comment removal over every ``suffix`` file, with the
    rewrite-only-if-changed flag (feed ``sinks.writers.write_changed``)."""
    src = files.where(F.col("name").endswith(suffix))
    cleaned = T.remove_comments("content")
    return src.select("name", "path", "content", cleaned.alias("cleaned"),
                      (cleaned != F.col("content")).alias("changed"))


def rewrite_corpus(files: DataFrame, path: str, suffix: str = ".c") -> dict:
    """Comment removal over every ``suffix`` file; those that change are written as
    ``path/<name>``: ``rows``, ``changed``, ``files`` and ``bytes``."""
    return write_changed_files(clean_corpus(files, suffix), path, "content", "cleaned")


def gate_corpus(files: DataFrame, results: DataFrame, parent: str | None = None, max_info: int | None = None, log_dir: str | None = None,
                suffix: str = ".c", derived: str = ".ghidra.c") -> DataFrame:
    """Every primary source below ``parent`` against ``results(stem, returncode,
    stderr, asm)`` of an external step (a results table, or
    ``plugins.run_external``), as :func:`operators.gate.gate` decides. The verdicts
    are taken once and stored; with ``log_dir``, its folders ``ok`` and ``failed``
    get the log lines, in the order of the paths."""
    sources = with_suffix(primary_only(files, derived), suffix, value="path")
    gated = stored(G.gate(sources, results, "stem", "path", parent=parent, max_info=max_info).select(
        "stem", "path", "returncode", "ok", "info", "status", "log_line"), "gated")
    if log_dir is not None:
        for name, some in (("ok", G.survivors(gated)), ("failed", G.rejects(gated))):
            some.orderBy("path").select(F.col("log_line").alias("value")).write.mode("overwrite").text(f"{log_dir}/{name}")
    return gated


def inspect_sample(files: DataFrame, keys: DataFrame, predict: Callable[[Column], Column], seed=0, max_lines: int | None = None,
                   include_cap: int | None = None) -> DataFrame:
    """One seeded key of a list: its listing, cleaned quickly, goes to ``predict``
    (a column function, e.g. a generation plug-in's), whose C text is tidied:
    ``(stem, prediction)``."""
    one = S.pick_one(keys.select("stem"), "stem", seed=seed)
    asm = with_suffix(files, ".s").withColumnRenamed("content", "asm")
    # one row by construction (limit 1): broadcasting it keeps the listings
    # from being shuffled for a single lookup
    row = F.broadcast(one).join(asm, "stem", "inner")
    return row.select("stem", T.tidy_c(predict(T.clean_asm("asm", max_lines)), include_cap).alias("prediction"))


def sorted_listing(files: DataFrame, suffix: str = ".c", derived: str = ".ghidra.c") -> DataFrame:
    """The primary files in the order of their names, numbered from 1:
    ``(position, name)``. The order is made over ranges of names, not in one task."""
    names = of_suffix(primary_only(files, derived), suffix).select("name")
    return S.ordinal_rank(names, ["name"], "position").select("position", "name")


def candidate_texts(files: DataFrame, sources: DataFrame, **suffixes: str) -> DataFrame:
    """``sources(stem)`` against the texts that stand for each of them, one
    candidate per suffix (``original=".c", other=".ghidra.c"``): ``(stem, candidate,
    text)`` in C normal form. A source keeps what candidates it has."""
    every = None
    for name, suffix in suffixes.items():
        one = with_suffix(files, suffix).select("stem", F.lit(name).alias("candidate"), F.col("content").alias("text"))
        every = one if every is None else every.unionByName(one)
    return sources.select("stem").dropDuplicates(["stem"]).hint("merge").join(every, "stem").select("stem", "candidate", T.normalize_c("text").alias("text"))


def rank_candidate_texts(candidates: DataFrame, logits: DataFrame | Callable[[DataFrame], DataFrame], tokenizer: Callable[[Column], Column],
                         max_tokens: int | None = None, cap: float | None = 20.0) -> DataFrame:
    """``candidates(stem, candidate, text)`` scored by the ``logits(stem, logits)``
    that a model has stored for the source, position by position (or by a function
    that puts them beside the labels, see :func:`evaluation_metrics`): tokens, mean
    loss, perplexity (``+inf`` from ``cap`` on) and rank within the source. A
    tokenizer (token array -> id array) that has ``of_text``, the same from the text
    itself, is called by that."""
    ids = tokenizer.of_text("text") if hasattr(tokenizer, "of_text") else tokenizer(T.tokens("text"))
    labelled = candidates.select("stem", "candidate", (ids if max_tokens is None else F.slice(ids, 1, max_tokens)).alias("labels"))
    scores = _with_logits(labelled, logits)
    with_logits = scores.select("stem", "candidate", "labels", *[F.slice(c, F.lit(1), F.size("labels")).alias(c) for c in ("logits", "norms") if c in scores.columns])
    scored = OM.score_tokens(OM.flatten_logits(with_logits, "logits", "labels", keep=("stem", "candidate")))
    return rank_candidates_by_loss(candidates, scored.select("stem", "candidate", "nll"), cap)


def generated_code(problems: DataFrame, replies: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``problems(problem_number, text)`` and ``replies(problem_number, response)``
    -> ``(problem_number, file_name, prompt, code, status)``, a row a problem. A
    problem whose file is among ``existing(name)`` is not looked at again
    (``exists``); the others are ``written``, or rejected: ``empty`` (no code in the
    reply) or ``no reply``."""
    named = problems.select("problem_number", "text", F.concat(F.lit("_"), F.col("problem_number").cast("string"), F.lit(".c")).alias("file_name"))
    todo = named if existing is None else N.skip_existing(named, existing.select(F.col("name").alias("file_name")), "file_name")
    coded = todo.join(replies.select("problem_number", D.reply_to_code("response").alias("code")), "problem_number", "left")
    status = F.when(F.col("code").isNull(), "no reply").when(F.col("code") == "", "empty").otherwise("written")
    out = coded.select("problem_number", "file_name", D.build_prompt("problem_number", "text").alias("prompt"), "code", status.alias("status"))
    if existing is None:
        return out
    there = named.join(existing.select(F.col("name").alias("file_name")).distinct(), "file_name", "left_semi").select(
        "problem_number", "file_name", D.build_prompt("problem_number", "text").alias("prompt"), F.lit(None).cast("string").alias("code"), F.lit("exists").alias("status"))
    return out.unionByName(there)


def rank_candidates_by_loss(sources: DataFrame, scores: DataFrame, cap: float | None = 20.0, key: str = "stem") -> DataFrame:
    """``sources(key)`` against their N ``scores(key, candidate, nll)`` rows (one
    per token): mean loss, perplexity (``+inf`` from ``cap`` on) and rank of
    each candidate within its source. A source without any candidate keeps a
    row with nulls."""
    joined = sources.select(key).dropDuplicates([key]).join(
        scores.groupBy(key, "candidate").agg(F.count("nll").alias("n_tokens"), F.avg("nll").alias("mean_loss")), key, "left")
    order = Window.partitionBy(key).orderBy(F.col("mean_loss").asc_nulls_last(), "candidate")
    return joined.withColumn("perplexity", M.perplexity("mean_loss", cap)).withColumn(
        "rank", F.when(F.col("candidate").isNotNull(), F.row_number().over(order)))


def harvest_code(items: DataFrame, existing: DataFrame | None = None, letter: str = "c", max_chars: int | None = None,
                 max_suffix: int | None = None) -> DataFrame:
    """The whole harvest over ``items(arrival, title, sections_json,
    text_json)``: pick the section, take its first code block, name the file.
    ``(arrival, section_index, name, status, outcome)``, the outcome being
    ``saved``, ``skipped`` (nothing to take, or the same file is there) or
    ``error``; ``names.assign_names`` gives the content to write."""
    found = H.harvest_status(items, letter=letter)
    named = N.assign_names(found.where("status = 'found'").select("arrival", "title", "code"), existing, max_chars=max_chars,
                           max_suffix=max_suffix, with_content=False).select("arrival", "name", F.col("status").alias("written"))
    out = found.join(named.withColumnRenamed("arrival", "n_arrival"), F.col("arrival") == F.col("n_arrival"), "left")
    status = F.coalesce("written", "status")
    outcome = F.when(status.startswith("written"), "saved").when(status.isin("error", "conflict"), "error").otherwise("skipped")
    return out.select("arrival", "section_index", "name", status.alias("status"), outcome.alias("outcome"))


def tokenized_training_set(pairs: DataFrame, max_src: int | None = None, max_tgt: int | None = None, seed=42, first_id: int = 1,
                           tokenizer: Callable[[DataFrame, str, str], DataFrame] | None = None) -> DataFrame:
    """``pairs(stem, split, src, tgt)`` -> ``(stem, split, input_ids, labels)``.

    ``tokenizer(df, text_column, out_column)`` adds an id array (e.g.
    ``plugins.tokenize`` with a subword tokenizer). By default whitespace tokens
    get the ids of one dictionary over the whole texts of both sides and all
    splits. Ids are cut to the lengths given, after the dictionary is made."""
    if tokenizer is not None:
        def cut(col: str, most: int | None) -> Column:
            return F.col(col) if most is None else F.slice(col, 1, most)

        ids = tokenizer(tokenizer(pairs, "src", "input_ids"), "tgt", "labels")
        return ids.select("stem", "split", cut("input_ids", max_src).alias("input_ids"), cut("labels", max_tgt).alias("labels"))
    # both sides of a pair are one dictionary, written once: the vocabulary is made
    # of all its words, and only words that stay after the cut are numbered
    texts = pairs.select(F.monotonically_increasing_id().alias("row"), "stem", "split", "src", "tgt")
    rows = stored(TK.text_dictionaries(texts, {"src": max_src, "tgt": max_tgt}), "tokens")
    vocab = TK.build_vocab(rows, "words", seed, first_id)
    numbered = TK.ids_of_words(rows.select("row", F.slice("words", F.lit(1), F.col("n_kept")).alias("words")), "row", "words", vocab)
    placed = rows.select("row", "stem", "split", "codes", "n_src").join(numbered, "row", "left").select(
        "stem", "split", "n_src", F.transform("codes", lambda c: F.get("ids", c)).alias("ids"))
    return placed.select("stem", "split", F.slice("ids", F.lit(1), F.col("n_src")).alias("input_ids"),
                         F.slice("ids", F.col("n_src") + 1, F.greatest(F.size("ids") - F.col("n_src"), F.lit(0))).alias("labels"))
