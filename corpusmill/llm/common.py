"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import ensure_checkpoint_dir

#: ASCII white space as the contracts define it (fixed value)
BLANKS = r"[\x20\x09-\x0D]+"
#: characters of texts that are worked on at once
BLOCK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, whatever it carries."""
    taken = {c.lower() for c in df.columns}
    out = f"__{name}"
    while out.lower() in taken:
        out = f"_{out}"
    return out


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts
    the lineage, and lost executors cost no recomputation of what is above."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """Tells rows with the same id but another text apart (null = empty)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def blocks(texts: Iterable[tuple[int, str]], inside: Callable[[str], bool]) -> Iterator[list[tuple[int, str, bool]]]:
    """Lists of (row, part of its text, whether it is the first part), about
    BLOCK characters each. A long text is cut after a character that is not
    ``inside`` a word (a word longer than a block: anywhere)."""
    held: list[tuple[int, str, bool]] = []
    size = 0
    for row, t in texts:
        at = 0
        while True:
            end = min(at + BLOCK, len(t))
            most = min(end + BLOCK, len(t))
            while end < most and inside(t[end - 1]):
                end += 1
            held.append((row, t[at:end], at == 0))
            size += end - at
            if size >= BLOCK:
                yield held
                held, size = [], 0
            at = end
            if at >= len(t):
                break
    if held:
        yield held
