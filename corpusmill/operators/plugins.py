"""Plug-in points for per-row Python: a tokenizer, a generator (model), a
scorer and an external tool. Each runs in Arrow batches inside the executors
(``mapInPandas`` / iterator pandas UDF), loads its resource once per task,
and never moves data through the driver. The core corpus work stays in
native expressions; these are the only Python steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tokenize(df: DataFrame, text: str, fn: Callable[[list[str]], list[list[int]]], out: str = "input_ids",
             max_length: int | None = None) -> DataFrame:
    """``fn`` maps a batch of texts to token id lists (e.g. a subword
    tokenizer's batch call); ids are truncated to ``max_length``."""
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def _tok(s: pd.Series) -> pd.Series:
        ids = fn([x if x is not None else "" for x in s.tolist()])
        if max_length is not None:
            ids = [list(x)[:max_length] for x in ids]
        return pd.Series([list(map(int, x)) for x in ids])

    return df.withColumn(out, _tok(F.col(text)))


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """Batched map replacing columns (``fn`` sees one Arrow batch as a
    pandas frame and returns the new columns)."""
    def run(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


def generate(df: DataFrame, src: str, load: Callable[[], object],
             predict: Callable[[object, list[str]], list[str]], out: str = "prediction") -> DataFrame:
    """Generation plug-in: ``load()`` once per task, then ``predict(model,
    batch_of_sources)`` per Arrow batch."""
    @F.pandas_udf(T.StringType())
    def _gen(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            yield pd.Series(predict(model, ["" if x is None else x for x in s.tolist()]))

    return df.withColumn(out, _gen(F.col(src)))


def score(df: DataFrame, src: str, tgt: str, load: Callable[[], object],
          score_fn: Callable[[object, list[str], list[str]], list[tuple[float, int, int]]]) -> DataFrame:
    """Scorer plug-in: per (src, tgt) row, ``score_fn`` returns
    ``(nll_sum, n_tokens, n_correct)``, which ``metrics.split_metrics``
    takes as they are; no logits per token are kept."""
    schema = T.StructType([T.StructField("nll_sum", T.DoubleType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("n_correct", T.LongType())])

    @F.pandas_udf(schema)
    def _score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = load()
        for s, t in batches:
            rows = score_fn(model, s.fillna("").tolist(), t.fillna("").tolist())
            yield pd.DataFrame(rows, columns=["nll_sum", "n_tokens", "n_correct"])

    return df.withColumn("score", _score(F.col(src), F.col(tgt))).select("*", "score.*").drop("score")


def run_external(df: DataFrame, key: str, fn: Callable[[dict], tuple[int, str, str | None]]) -> DataFrame:
    """External step per row with captured failure: ``fn(row)`` returns
    ``(returncode, stderr, output)``; an exception becomes returncode -1 and
    its message, so one bad row never fails the job."""
    in_cols = df.columns

    def run(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            codes, errs, outs = [], [], []
            for row in pdf.to_dict("records"):
                try:
                    rc, err, output = fn(row)
                    rc = int(rc)
                except Exception as exc:  # captured per row
                    rc, err, output = -1, f"unexpected error: {exc}", None
                codes.append(rc)
                errs.append(err)
                outs.append(output)
            yield pd.DataFrame({key: pdf[key], "returncode": codes, "stderr": errs, "asm": outs})

    schema = T.StructType([df.schema[key], T.StructField("returncode", T.IntegerType()),
                           T.StructField("stderr", T.StringType()), T.StructField("asm", T.StringType())])
    return df.select(*in_cols).mapInPandas(run, schema)
