import os

import duckdb
import pytest


@pytest.fixture
def tables(spark, tmp_path):
    """Writes rows as a table of a fresh folder and returns the folder."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(os.path.join(tmp_path, f"{name}.parquet"))
        return str(tmp_path)

    return write


@pytest.fixture
def duck():
    """Runs SQL over the tables of a folder."""

    def run(folder, sql):
        con = duckdb.connect()
        for f in os.listdir(folder):
            if f.endswith(".parquet"):
                con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}/*.parquet'")
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        return [dict(zip(names, r)) for r in cur.fetchall()]

    return run


def ordered(rows, *names):
    """Rows (of Spark or dicts) as sorted tuples of the named columns."""
    dicts = [r if isinstance(r, dict) else r.asDict() for r in rows]
    return sorted((tuple(d[n] for n in names) for d in dicts), key=repr)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(texts, lang="en"):
    return [(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
