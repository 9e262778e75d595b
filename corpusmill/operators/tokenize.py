"""Native default tokenizer: whitespace tokens with dictionary ids.

The vocabulary is every distinct token of the input, numbered by the same
distributed exact rank as the splits (seeded md5 order), so ids are dense,
deterministic and independent of partitioning. Ids come from an equi-join on the
token (the vocabulary grows with the data and is never broadcast), but only a
text's *distinct* tokens take part: a text is first turned into its own
dictionary, each distinct token with the places where it stands, and the ids are
put back at those places after the join. Where texts are at hand, not token
arrays, :func:`text_dictionaries` makes the dictionary without a sort. Callers with a subword tokenizer use
``plugins.tokenize`` instead.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import let
from corpusmill.operators.split import exact_rank
from corpusmill.session import stored


def build_vocab(df: DataFrame, tokens_col: str, seed=42, first_id: int = 1, materialize: bool = True) -> DataFrame:
    """``(token, id)`` over every distinct token; ids start at ``first_id``
    (0 is left for padding)."""
    # explode_outer: no inferred size() filter re-running the tokenizer below
    toks = df.select(F.explode_outer(tokens_col).alias("token")).where(
        F.col("token").isNotNull()).dropDuplicates(["token"])
    if materialize:
        # written once; the rank reads it twice
        toks = stored(toks, "tokens")
    ranked = exact_rank(toks, "token", seed)
    return ranked.select("token", (F.col("rank") + (first_id - 1)).cast("int").alias("id"))


def token_groups(toks) -> Column:
    """Token array -> array of ``(token, places)``: each distinct token with its
    0-based places in order. The tokens are sorted with their places once, and
    each run of equal ones is cut out: no step looks through the whole array for
    one token, so the work is that of the sort. Null tokens have no group."""
    t = F.col(toks) if isinstance(toks, str) else toks
    placed = F.sort_array(F.filter(F.transform(t, lambda x, i: F.struct(x.alias("token"), i.alias("place"))), lambda x: x["token"].isNotNull()))

    def at(a: Column, i: Column) -> Column:
        return F.get(a, i)["token"]

    def runs(a: Column) -> Column:
        first = F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(F.filter(
            F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (at(a, i) != at(a, i - 1))))
        return let(first, lambda starts: F.transform(starts, lambda s, k: F.struct(
            at(a, s).alias("token"),
            F.transform(F.slice(a, s + 1, F.coalesce(F.get(starts, k + 1), F.size(a)) - s), lambda x: x["place"]).alias("places"))))

    return let(placed, runs)


def ids_of_groups(groups: DataFrame, key: str, groups_col: str, vocab: DataFrame, out: str = "ids") -> DataFrame:
    """``token_groups`` arrays -> id arrays in the original order, the other
    columns of ``groups`` (narrow ones) carried through. Two shuffles, both of one
    row for each distinct token of a text: by the token, where AQE splits a token
    that many texts share, and back by the text's key. Places left out of the
    groups leave no gap in the ids."""
    carry = [c for c in groups.columns if c not in (key, groups_col)]
    each = groups.select(key, *carry, F.explode_outer(groups_col).alias("__g")).select(
        key, *carry, F.col("__g.token").alias("token"), F.col("__g.places").alias("__places"))
    joined = each.join(vocab, "token", "left").select(key, *carry, "id", "__places")
    found = F.collect_list(F.when(F.col("id").isNotNull(), F.struct("id", "__places")))
    placed = F.flatten(F.transform("__f", lambda g: F.transform(g["__places"], lambda p: F.struct(p.alias("place"), g["id"].alias("id")))))
    regrouped = joined.groupBy(key).agg(*[F.first(c).alias(c) for c in carry], found.alias("__f"))
    return regrouped.select(key, *carry, F.transform(F.sort_array(placed), lambda s: s["id"]).cast("array<int>").alias(out))


#: tokens whose ids a task of :func:`text_ids` keeps at a time
KNOWN_TOKENS = 1 << 18


def text_ids(text, id_of: Callable[[bytes], int]) -> Column:
    """Text -> the ids of its whitespace tokens, ``id_of`` being a pure function of a
    token's bytes: the same as a transform of ``functions.text.tokens``, made in
    Arrow batches by Python's own ``split`` and a bounded dict of the ids at hand.
    A null text has null ids."""
    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        class Known(dict):
            def __missing__(self, token):
                found = self[token] = id_of(token.encode())
                return found

        known = Known()
        for b in batches:
            starts, out = array("i"), array("i")
            for x in b:
                data = x.as_py()
                starts.append(len(out))
                if data is not None:
                    out.extend(map(known.__getitem__, data.decode("utf-8", "replace").split()))
                if len(known) > KNOWN_TOKENS:
                    known.clear()
            starts.append(len(out))
            yield pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(out, pa.int32()), mask=b.is_null())

    return ids((F.col(text) if isinstance(text, str) else text).cast("binary"))


def text_dictionaries(df: DataFrame, sides: dict[str, int | None], part: int = 256) -> DataFrame:
    """Texts -> whitespace tokens as places in a dictionary of the row. ``sides``
    names the text columns, and how many tokens of each are kept. The other columns
    are carried along, and there are

    * ``words``: the distinct tokens of the whole texts, those that are kept first;
    * ``n_kept``: how many of them stand among the kept tokens;
    * ``codes``: for the kept tokens of all sides in turn, their place in ``words``;
    * ``n_<side>``: how many kept tokens each side has.

    A row with a null text has null codes and numbers and no words. Tokens are cut
    and told apart in the tasks, by Python's own ``split`` and a dict for each row."""
    carry = [c for c in df.columns if c not in sides]
    most = list(sides.values())
    text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*carry).schema)
    schema = f"{text}, words array<string>, n_kept int, codes array<int>, " + ", ".join(f"`n_{c}` int" for c in sides)

    def dictionary(texts):
        if None in texts:
            return [], None, None, *[None for _ in texts]
        tokens = [t.split() for t in texts]
        kept = [t[:n] for t, n in zip(tokens, most)]
        at = {}
        codes = [at.setdefault(t, len(at)) for side in kept for t in side]
        n_kept = len(at)
        for side, some in zip(tokens, kept):
            for t in side[len(some):]:
                at.setdefault(t, len(at))
        return list(at), n_kept, codes, *map(len, kept)

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, part):
                b = whole.slice(first, part)
                found = list(zip(*map(dictionary, zip(*(b.column(c).to_pylist() for c in sides)))))
                kinds = [pa.list_(pa.string()), pa.int32(), pa.list_(pa.int32()), *[pa.int32() for _ in sides]]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in carry] + [pa.array(v, k) for v, k in zip(found, kinds)],
                                                 [*carry, "words", "n_kept", "codes", *[f"n_{c}" for c in sides]])

    return df.select(*carry, *sides).mapInArrow(run, schema)


def ids_of_words(rows: DataFrame, key: str, words: str, vocab: DataFrame, out: str = "ids") -> DataFrame:
    """``(key, out)``: the ids of an array of distinct tokens, in its order. Two
    shuffles of a narrow row for each token: by the token, where AQE splits a token
    that many rows share, and back by the key with place and id in one number.
    Rows without a token have no result."""
    each = rows.select(key, F.posexplode_outer(words).alias("__at", "token")).where("token is not null")
    found = each.join(vocab, "token").select(key, F.shiftleft(F.col("__at").cast("long"), 32).bitwiseOR(F.col("id").cast("long")).alias("__n"))
    return found.groupBy(key).agg(F.sort_array(F.collect_list("__n")).alias("__ns")).select(
        key, F.transform("__ns", lambda n: n.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias(out))


def to_ids(df: DataFrame, key: str, tokens_col: str, vocab: DataFrame, out: str = "ids",
           salt_buckets: int = 1) -> DataFrame:
    """Token arrays -> id arrays in the original order; the other columns of
    ``df`` are carried through, so keep wide text columns out of ``df``. Rows with
    no token get an empty array.

    A token that many texts share is split by AQE. Where AQE is off,
    ``salt_buckets`` deals its rows by their key and repeats the vocabulary once
    per salt."""
    groups = df.withColumn(tokens_col, token_groups(tokens_col))
    if salt_buckets <= 1:
        return ids_of_groups(groups, key, tokens_col, vocab, out)

    def salted(token: Column, salt: Column) -> Column:
        return F.concat(salt.cast("string"), F.lit(":"), token)

    salt = F.pmod(F.xxhash64(F.col(key)), F.lit(salt_buckets))
    named = groups.withColumn(tokens_col, F.transform(tokens_col, lambda g: F.struct(salted(g["token"], salt).alias("token"), g["places"].alias("places"))))
    every = vocab.select(F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))).alias("__salt"), "token", "id").select(
        salted(F.col("token"), F.col("__salt")).alias("token"), "id")
    return ids_of_groups(named, key, tokens_col, every, out)
