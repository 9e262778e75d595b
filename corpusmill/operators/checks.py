"""Counters and fail-fast checks that ride on the pass that does the work."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation

from corpusmill.session import stored


def counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` once (see :func:`corpusmill.session.stored`) and observe the
    aggregates ``counts`` in the same pass: the stored rows and the counts."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    out = stored(df.observe(seen, *[c.alias(k) for k, c in counts.items()]), name)
    return out, seen.get


def required(df: DataFrame, name: str, **counts: tuple[Column, str]) -> DataFrame:
    """Write ``df`` once and fail with the message of the first count that is
    zero; the counts are observed in the pass that writes."""
    out, got = counted(df, name, **{k: c for k, (c, _) in counts.items()})
    for k, (_, message) in counts.items():
        if not got[k]:
            raise RuntimeError(message)
    return out
