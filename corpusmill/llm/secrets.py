"""Secret scan with multipart credential linking, in DataFrame operations only.

Candidates come in three roles: *identifiers* (``access`` key ids; weak:
``id``, a value assigned to a user or client name), *secrets* (``assign`` and
``hex``; weak: ``key``, a long token of mixed letters and digits) and
*endpoints* (weak: ``endpoint``, a URL of a service). The kinds ``assign``,
``access`` and ``hex`` are always reported. A weak candidate alone means
little and is reported only if complementary parts co-occur in its scope: a
weak identifier needs a secret, a weak secret an identifier or an endpoint, an
endpoint a secret, at most ``max_gap`` characters away in the same text. A part
must be another piece of the text: one that overlaps the candidate is none.

The join of the parts is an interval join. The starts and the ends of all
candidates of a text are ordered by their place once; the running maximum of a
role's ends so far gives the nearest part that ends before a start, the running
minimum of its starts in descending order the nearest that starts after an end.
That is linear in the candidates, where a join on ranges would emit every pair of
a long text.

Java's regular expressions give no offsets, so they are derived: a text is
split at the pattern, and a match starts after the lengths of all gaps and
matches before it.

Defined results: null text counts as empty; a text without candidates has
zero counts and empty lists. Rows are told apart by id and text; rows that
agree in both are ties and get the same result each (null ids too). Extra
columns are neither read nor returned by :func:`scan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh, table, text_key, written

MAX_GAP = 200


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_ASSIGNED = r"""["']?\x20*[:=]\x20*["']?"""
#: kind -> (pattern, group whose length counts, least length, what else a match must have);
#: the kinds stand in the order in which spans that start together are listed
PATTERNS: dict[str, tuple[str, int, int, tuple[str, ...]]] = {
    "assign": (f"(?:{_either_case('password|passwd|secret|token|api_?key')}){_ASSIGNED}([A-Za-z0-9+/_.=-]+)", 1, 6, ()),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, ()),
    "hex": (r"[0-9a-f]{24,}", 0, 24, ()),
    "id": (f"(?:{_either_case('access_?key_?id|client_?id|account_?id|user_?name|login')}){_ASSIGNED}([A-Za-z0-9._@+-]+)", 1, 3, ()),
    "key": (r"[A-Za-z0-9+/_-]{20,}", 0, 20, ("[0-9]", "[a-z]", "[A-Z]")),
    "endpoint": (f"(?:{_either_case('https?|ftps?|postgres(?:ql)?|mysql|mongodb|redis|amqp')})://[^\\x20\\x09-\\x0D\"'<>]+", 0, 0, ()),
}
BASE = ("assign", "access", "hex")
#: weak kind -> the kinds of which it needs one nearby
NEEDS = {"id": ("assign", "hex", "key"), "key": ("access", "id", "endpoint"), "endpoint": ("assign", "hex", "key")}
_CHUNK = 1024  # code points of a text that are looked through for one place


def _matches(text: Column, kind: str) -> Column:
    """Array of (gap before the match, its length, whether it counts)."""
    pattern, group, least, musts = PATTERNS[kind]
    p = F.lit(pattern)

    def one(x: Column) -> Column:
        good = F.char_length(x["value"]) >= least
        for m in musts:
            good = good & x["match"].rlike(m)
        return F.struct(F.char_length(x["gap"]).alias("gap"), F.char_length(x["match"]).alias("len"), good.alias("good"))

    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("match"),
                         F.regexp_extract_all(text, p, F.lit(group)).alias("value"))
    # the last gap has no match after it
    found = F.filter(F.transform(parts, one), lambda x: x["len"].isNotNull())
    return F.when(text.rlike(pattern), found)


def _spans(rows: DataFrame) -> DataFrame:
    """(rid, th, kind, kord, start, end) of the candidates that count."""
    kinds = F.array(*[F.struct(F.lit(i).alias("kord"), F.lit(k).alias("kind"), F.col(k).alias("found"))
                      for i, k in enumerate(PATTERNS)])
    some = rows.where(F.coalesce(*[F.col(k) for k in PATTERNS]).isNotNull()).dropDuplicates(["rid", "th"])
    each = some.select("rid", "th", F.explode(kinds).alias("k")).select(
        "rid", "th", "k.kord", "k.kind", F.posexplode("k.found").alias("i", "m"))
    upto = Window.partitionBy("rid", "th", "kord").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(upto)
    return each.select("rid", "th", "kord", "kind", end.alias("end"), "m.len", "m.good").where("good").select(
        "rid", "th", "kord", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def linked(spans: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """Base spans, and the weak ones with a complementary part within
    ``max_gap``; ``partner_gap`` is the distance to the nearest such part."""
    # a row for the start and one for the end of each span; at one place ends come
    # first, so parts that touch are apart
    places = spans.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("at_start")).withColumn(
        "place", F.when(F.col("at_start"), F.col("start")).otherwise(F.col("end")))
    one = Window.partitionBy("rid", "th")
    asc = one.orderBy("place", "at_start").rowsBetween(Window.unboundedPreceding, 0)
    desc = one.orderBy(F.desc("place"), F.desc("at_start")).rowsBetween(Window.unboundedPreceding, 0)

    def of(kinds, at_start: bool) -> Column:
        return F.when(F.col("kind").isin(*kinds) & (F.col("at_start") == at_start), F.col("place"))

    left = {f"l_{weak}": F.max(of(k, False)).over(asc) for weak, k in NEEDS.items()}
    right = {f"r_{weak}": F.min(of(k, True)).over(desc) for weak, k in NEEDS.items()}
    # the largest end of the base spans that start here or before
    upto = one.orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    base_end = F.max(F.when(F.col("kind").isin(*BASE) & F.col("at_start"), F.col("end"))).over(upto)
    near = places.withColumns(left | {"base_end": base_end}).withColumns(right)
    gap = F.lit(None).cast("long")
    for kind in NEEDS:
        side = F.when(F.col("at_start"), F.col("start") - F.col(f"l_{kind}")).otherwise(F.col(f"r_{kind}") - F.col("end"))
        gap = F.when(F.col("kind") == kind, side).otherwise(gap)
    both = near.withColumn("gap", gap).groupBy("rid", "th", "kord", "kind", "start", "end").agg(
        F.min("gap").alias("partner_gap"), F.max(F.when(F.col("at_start"), F.col("base_end"))).alias("base_end"))
    # what lies inside a base span is that span over again
    extra = (F.coalesce(F.col("base_end"), F.lit(-1)) < F.col("end")) & (F.col("partner_gap") <= max_gap)
    return both.where(F.col("kind").isin(*BASE) | extra).select("rid", "th", "kord", "kind", "start", "end", "partner_gap")


def _candidates(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """A row per document: rid, th and the matches of each kind, written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return written(docs.select(F.col(id_col).alias("rid"), text_key(F.col(text_col)).alias("th"),
                               *[_matches(text, k).alias(k) for k in PATTERNS]), "candidates")


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_gap: int = MAX_GAP) -> DataFrame:
    """One row per document: rid (its id), th (key of its text) and ``spans``, an array
    of (start, kord, end, kind) in order; null without any."""
    found = _candidates(docs, text_col, id_col)
    lists = linked(_spans(found), max_gap).groupBy("rid", "th").agg(
        F.sort_array(F.collect_list(F.struct("start", "kord", "end", "kind"))).alias("spans"))
    rows, lists = found.select("rid", "th"), lists.withColumnsRenamed({"rid": "s_id", "th": "s_th"})
    return rows.join(lists, F.col("rid").eqNullSafe(F.col("s_id")) & (F.col("th") == F.col("s_th")), "left").select("rid", "th", "spans")


def redacted(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", mark: str = "[SECRET]",
             max_gap: int = MAX_GAP) -> DataFrame:
    """``docs`` with every reported span replaced by ``mark`` (spans that
    overlap become one). Rows without spans, null texts included, stay as
    they are; the columns stay the same.

    Linear in the text and its spans: what stays between spans is taken from
    chunks of the text, so a place is never searched from the text's beginning."""
    k, i, h, g, e = (fresh(docs, n) for n in ("key", "sid", "sth", "gaps", "end"))
    spans = linked(_spans(_candidates(docs, text_col, id_col)), max_gap)
    before = Window.partitionBy("rid", "th").orderBy("start", "kord").rowsBetween(Window.unboundedPreceding, -1)
    gaps = spans.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0).cast("long"))).groupBy("rid", "th").agg(
        # a span that begins inside the ones before it has no gap of its own
        F.sort_array(F.collect_list(F.when(F.col("start") >= F.col("from"), F.struct("from", "start")))).alias(g), F.max("end").alias(e))
    lists = gaps.withColumnsRenamed({"rid": i, "th": h})
    text = F.col(text_col)
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))

    def kept(parts: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / _CHUNK).cast("int")
        some = F.array_join(F.slice(parts, first + 1, F.floor(end / _CHUNK).cast("int") - first + 1), "")
        return some.substr((start - first * _CHUNK + 1).cast("int"), (end - start).cast("int"))

    def done(parts: Column) -> Column:
        heads = F.transform(F.col(g), lambda x: F.concat(kept(parts, x["from"], x["start"]), F.lit(mark)))
        return F.concat(F.array_join(heads, ""), kept(parts, F.col(e), F.char_length(text).cast("long")))

    joined = docs.withColumn(k, text_key(text)).join(lists, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(k) == F.col(h)), "left")
    new = F.element_at(F.transform(F.array(chunks), done), 1)  # the chunks are made once
    return joined.select(*[F.when(F.col(g).isNull(), text).otherwise(new).alias(c) if c == text_col else F.col(f"`{c}`")
                           for c in docs.columns])


def op5_linked_secrets(spark, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"))
    spans = F.coalesce(F.col("spans"), F.expr("cast(array() as array<struct<start:bigint,kord:int,end:bigint,kind:string>>)"))

    def listed(a: Column) -> Column:
        return F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda x: x["kord"] < len(BASE))
    return rows.select(F.col("rid").alias("doc_id"), *[count(k) for k in BASE],
                       F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(spans).alias("spans"))


#: the oracle's own tables: patterns as the contract has them, and the pairs of
#: complementary kinds one by one
_SQL_KINDS = [
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, "length(v) >= 6"),
    ("access", r"AKIA[A-Z0-9]+", 0, "length(v) >= 20"),
    ("hex", r"[0-9a-f]+", 0, "length(v) >= 24"),
    ("id", r"""(?i:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]+)""", 1, "length(v) >= 3"),
    ("key", r"[A-Za-z0-9+/_-]{20,}", 0, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')"),
    ("endpoint", r"""(?i:https?|ftps?|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+""", 0, "true"),
]
_SQL_NEEDS = "('id','assign'), ('id','hex'), ('id','key'), ('key','access'), ('key','id'), ('key','endpoint'), ('endpoint','assign'), ('endpoint','hex'), ('endpoint','key')"


def oracle() -> str:
    """The same in SQL, its linking by a plain join on ranges."""
    parts = []
    for i, (kind, pattern, group, good) in enumerate(_SQL_KINDS):
        p = pattern.replace("'", "''")
        parts.append(f"""SELECT r, {i} AS kord, '{kind}' AS kind, e - length(m) AS s, e FROM (
            SELECT r, m, v, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e FROM (
              SELECT r, unnest(string_split_regex(t, '{p}')) AS g, unnest(regexp_extract_all(t, '{p}', 0)) AS m,
                     unnest(regexp_extract_all(t, '{p}', {group})) AS v, generate_subscripts(string_split_regex(t, '{p}'), 1) AS i
              FROM d WHERE regexp_matches(t, '{p}'))
            WHERE m IS NOT NULL) WHERE {good}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
c AS MATERIALIZED ({' UNION ALL '.join(parts)}),
k AS (
  SELECT * FROM c a WHERE kord < 3 OR (
    NOT EXISTS (SELECT 1 FROM c b WHERE b.r = a.r AND b.kord < 3 AND b.s <= a.s AND b.e >= a.e)
    AND EXISTS (SELECT 1 FROM c b WHERE b.r = a.r AND (a.kind, b.kind) IN ({_SQL_NEEDS})
                AND ((b.s >= a.e AND b.s - a.e <= 200) OR (a.s >= b.e AND a.s - b.e <= 200))))
),
l AS (
  SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kord) AS spans,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kord) FILTER (WHERE kord < 3) AS base,
         count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex
  FROM k GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN l USING (r)
"""
