"""Independent DuckDB formulations of the registered queries (the
correctness oracle). They are written against the driver's pre-registered
views and share only the code-view input expressions with the Spark side.

Oracle caveats: RE2 has no possessive quantifiers or look-behind, and its
``\\s`` is ASCII; the driver tables contain no non-ASCII whitespace, so the
ASCII sets below agree with the Python/Unicode sets the Spark side uses.
"""

from __future__ import annotations

from corpusmill.functions.docs import PROMPT_SUFFIX, SYSTEM_PROMPT
from corpusmill.functions.text import PREFERRED_HEADERS
from corpusmill.sources.corpus import ASM_TEXT_SQL, BAD_ESCAPES, C_TEXT_SQL, code_files_sql, reply_files_sql

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# the fixed values are the library's own
PREFER = PREFERRED_HEADERS


def _sql_text(s: str) -> str:
    """A text as an SQL expression, its line breaks as chr(10)."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in s.split("\n"))


def files_cte() -> str:
    return f"files as ({code_files_sql()})"


def lines_expr(t: str) -> str:
    l0 = f"string_split({t}, chr(10))"
    return f"(case when {l0}[-1] = '' then list_slice({l0}, 1, len({l0}) - 1) else {l0} end)"


def normalize_c_ctes(src: str, key: str, text: str, out: str, cap: int = 6, prefix: str = "nc") -> str:
    """CTEs turning ``src(key, text)`` into ``{prefix}7(key, out)``."""
    prefer = ", ".join(f"list_filter(incs, lambda x: contains(x, '{p}'))" for p in PREFER)
    return f""",
{prefix}1 as (select {key}, regexp_replace({text}, '\\)\\s*\\{{', ') {{', 'g') as t from {src}),
{prefix}2 as (select {key}, {lines_expr('t')} as l from {prefix}1),
{prefix}3 as (select {key},
   list_transform(list_filter(l, lambda x: starts_with(trim(x, {WS}), '#include')),
                  lambda x: regexp_replace(trim(x, {WS}), '\\s+', ' ', 'g')) as inc_all,
   list_filter(l, lambda x: not starts_with(trim(x, {WS}), '#include')) as body from {prefix}2),
{prefix}4 as (select {key}, body, list_filter(inc_all, lambda x, i: list_position(inc_all, x) = i) as incs from {prefix}3),
{prefix}5 as (select {key}, body, list_concat(flatten([{prefer}]), incs) as pref from {prefix}4),
{prefix}6 as (select {key}, body, list_slice(list_filter(pref, lambda x, i: list_position(pref, x) = i), 1, {cap}) as ordered from {prefix}5),
{prefix}7 as (select {key}, trim(regexp_replace(
   (case when len(ordered) > 0 then array_to_string(ordered, chr(10)) || chr(10) || chr(10) else '' end)
   || array_to_string(body, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), {WS}) as {out} from {prefix}6)"""


def eval_form_expr(t: str) -> str:
    return f"array_to_string(list_transform({lines_expr(t)}, lambda x: rtrim(x, {WS})), chr(10))"


def asm_ctes(src: str, key: str, text: str, out: str, prefix: str = "na") -> str:
    """CTEs turning ``src(key, text)`` into ``{prefix}4(key, out)`` with a
    line table, a carried-forward section (window) and an ordered string_agg."""
    st = f"trim(raw, {WS})"
    return f""",
{prefix}0 as (select {key}, string_split({text}, chr(10)) as lns from {src}),
{prefix}1 as (select {key}, unnest(lns) as raw, generate_subscripts(lns, 1) as pos from {prefix}0),
{prefix}2 as (select {key}, pos, {st} as st,
   case when starts_with({st}, '.section')
          then coalesce(nullif(regexp_extract({st}, '^\\.section\\s+([.A-Za-z0-9_]+)', 1), ''), '<none>')
        when {st} = '.text' then '.text' end as mark from {prefix}1),
{prefix}3 as (select {key}, pos, st,
   last_value(mark ignore nulls) over (partition by {key} order by pos rows between unbounded preceding and current row) as sec,
   rtrim(regexp_replace(st, '(//|#|;).*$', ''), {WS}) as cut from {prefix}2),
{prefix}4k as (select {key}, pos,
   case when st = '' or starts_with(st, '#') or starts_with(st, '//') or starts_with(st, ';') then null
        when starts_with(st, '.section') or st = '.text' then null
        when starts_with(st, '.') then
          case when sec in ('.rodata', '.data')
                and regexp_extract(st, '^\\S+', 0) in ('.string', '.byte', '.word', '.short', '.long', '.quad')
               then st end
        when cut = '' then null
        when ends_with(cut, ':') then cut
        else regexp_replace(cut, '\\s+', ' ', 'g') end as keep from {prefix}3),
{prefix}4 as (select {key}, trim(coalesce(string_agg(keep, chr(10) order by pos), ''), {WS}) as {out}
   from {prefix}4k group by {key})"""


def suffix_key(name: str, suffix: str) -> str:
    return f"substr({name}, 1, length({name}) - {len(suffix)})"


PAIRS_CTE = (
    "pairs as (select " + suffix_key("c.name", ".c") + " as stem, s.content as src, c.content as tgt "
    "from files c join files s on " + suffix_key("c.name", ".c") + " = " + suffix_key("s.name", ".s") +
    " where c.name like '%.c' and s.name like '%.s')"
)


def split_cte(src: str = "pairs", key: str = "stem", seed: int = 42, train: float = 0.8, val: float = 0.1,
              name: str = "splits") -> str:
    return f"""{name}_r as (select {key}, row_number() over (order by md5('{seed}:' || cast({key} as varchar)), {key}) as rk,
   count(*) over () as n from (select distinct {key} from {src} where {key} is not null)),
{name} as (select {key}, case when rk <= floor(n * cast({train} as double)) then 'train'
   when rk <= floor(n * cast({train} as double)) + floor(n * cast({val} as double)) then 'val' else 'test' end as split,
   rk, rk - case when rk <= floor(n * cast({train} as double)) then 0
                 when rk <= floor(n * cast({train} as double)) + floor(n * cast({val} as double)) then floor(n * cast({train} as double))
                 else floor(n * cast({train} as double)) + floor(n * cast({val} as double)) end as split_rank
   from {name}_r)"""


# the same tokens for RE2, which has neither possessive repetition nor look-ahead
_LITERALS = "|".join(f"{q}(?:[^{q}\\\\]|\\\\.)*{q}" for q in ('"', "''"))
COMMENT_RE_RE2 = f"({_LITERALS})|//[^\\n]*|/\\*(?:[^*]|\\*+[^*/])*\\*+/|\\r"


def q_eval_normal_form() -> str:
    return f"""with {files_cte()}, src as (select name, content from files where name like '%.c')
{normalize_c_ctes('src', 'name', 'content', 'norm')}
select name, {eval_form_expr('norm')} as normalized from nc7"""


def q_asm_normal_form() -> str:
    return f"""with {files_cte()}, src as (select name, content from files where name like '%.s')
{asm_ctes('src', 'name', 'content', 'normalized')}
select name, normalized from na4"""


def q_comment_free() -> str:
    return f"""with {files_cte()}
select name, regexp_replace(content, '{COMMENT_RE_RE2}', '\\1', 'gs') as cleaned,
  regexp_replace(content, '{COMMENT_RE_RE2}', '\\1', 'gs') <> content as changed
from files where name like '%.c'"""


def q_split_assignment() -> str:
    return f"""with {files_cte()}, {PAIRS_CTE}, {split_cte()}
select stem, split from splits"""


def q_eval_pairs() -> str:
    return f"""with {files_cte()}, {PAIRS_CTE}, {split_cte()},
ev as (select p.stem, p.src, p.tgt from splits s join pairs p on s.stem = p.stem
       where s.split = 'test' and p.src <> '' and p.tgt <> '')
{normalize_c_ctes('ev', 'stem', 'tgt', 'tgt_n')}
select ev.stem, ev.src, nc7.tgt_n as tgt from ev join nc7 on ev.stem = nc7.stem"""


def q_training_set() -> str:
    return f"""with {files_cte()}, {PAIRS_CTE},
{split_cte('pairs')},
usable as (select * from pairs where src <> '' and tgt <> '')
{asm_ctes('usable', 'stem', 'src', 'src_n')}
{normalize_c_ctes('usable', 'stem', 'tgt', 'tgt_n')},
staged as (select s.stem, s.split, na4.src_n as src, nc7.tgt_n as tgt,
   len(list_filter(regexp_split_to_array(na4.src_n, '\\s+'), lambda x: x <> '')) as n_src_tokens
   from splits s join na4 on s.stem = na4.stem join nc7 on s.stem = nc7.stem)
select stem, split, src, tgt, n_src_tokens, n_src_tokens > 2048 as will_truncate
from staged where n_src_tokens <= 3 * 2048"""


def q_training_tokens() -> str:
    return f"""with ts as ({q_training_set()}),
w as (select stem, split, list_filter(regexp_split_to_array(src, '\\s+'), lambda x: x <> '') as a,
   list_filter(regexp_split_to_array(tgt, '\\s+'), lambda x: x <> '') as b from ts),
vocab as (select token, row_number() over (order by md5('42:' || token), token) as id
   from (select distinct unnest(list_concat(a, b)) as token from w)),
u as (select stem, 'a' as side, unnest(a) as token, generate_subscripts(a, 1) as pos from w
   union all select stem, 'b', unnest(b), generate_subscripts(b, 1) from w),
ids as (select stem, side, list(v.id order by u.pos) as ids from u join vocab v on u.token = v.token group by 1, 2)
select w.stem, w.split, list_slice(coalesce(x.ids, []), 1, 2048) as input_ids, list_slice(coalesce(y.ids, []), 1, 256) as labels
from w left join ids x on x.stem = w.stem and x.side = 'a' left join ids y on y.stem = w.stem and y.side = 'b'"""


def q_missing_kind_report() -> str:
    return f"""with {files_cte()},
keys as (select distinct {suffix_key('name', '.c')} as stem from files where name like '%.c' and name not like '%.ghidra.c'),
s as (select distinct {suffix_key('name', '.s')} as stem from files where name like '%.s'),
g as (select distinct {suffix_key('name', '.ghidra.c')} as stem from files where name like '%.ghidra.c')
select k.stem, list_filter(['.s', '.ghidra.c'], lambda x: (x = '.s' and s.stem is null) or (x = '.ghidra.c' and g.stem is null)) as missing
from keys k left join s on k.stem = s.stem left join g on k.stem = g.stem
where s.stem is null or g.stem is null"""


def q_pending_compile() -> str:
    return f"""with {files_cte()}
select {suffix_key('name', '.c')} as stem, name from files c
where name like '%.c' and name not like '%.ghidra.c'
  and not exists (select 1 from files s where s.name like '%.s' and {suffix_key('s.name', '.s')} = {suffix_key('c.name', '.c')})"""


def q_corpus_counts() -> str:
    return f"""with {files_cte()}, {PAIRS_CTE},
incs as (select distinct regexp_replace(trim(x, {WS}), '\\s+', ' ', 'g') as inc
   from (select unnest({lines_expr('content')}) as x from files where name like '%.c')
   where starts_with(trim(x, {WS}), '#include'))
select (select count(*) from files where name like '%.c' and name not like '%.ghidra.c') as n_sources,
       (select count(*) from files where name like '%.s') as n_listings,
       (select count(*) from files where name like '%.ghidra.c') as n_other,
       (select count(*) from pairs) as n_pairs,
       (select count(*) from pairs where src <> '' and tgt <> '') as n_usable,
       (select count(*) from incs) as n_distinct_includes"""


def q_quick_asm() -> str:
    return f"""with {files_cte()}
select name, array_to_string(list_slice(list_filter(list_transform({lines_expr('content')}, lambda x: trim(x, {WS})),
   lambda x: x <> '' and not starts_with(x, '.')), 1, 200), chr(10)) as cleaned
from files where name like '%.s'"""


def q_threshold_split() -> str:
    u = "cast(cast(('0x' || substr(md5('42:' || stem), 1, 8)) as bigint) as double) / 4294967296.0"
    return f"""with {files_cte()}, {PAIRS_CTE}
select stem, case when {u} < 0.8 then 'train' when {u} < 0.8 + 0.1 then 'val' else 'test' end as split from pairs"""


def tidy_ctes(src: str, key: str, text: str, out: str, cap: int = 8) -> str:
    """Tidy: lone '<' lines dropped, braces, includes (cap 8) + trimmed body,
    blank runs collapsed, then clipped at the last '}' where depth is 0."""
    prefer = ", ".join(f"list_filter(incs, lambda x: contains(x, '{p}'))" for p in PREFER)
    return f""",
td0 as (select {key}, regexp_replace({text}, '(?m)^<\\s*$', '', 'g') as t0 from {src}),
td1 as (select {key}, {lines_expr("regexp_replace(t0, '\\)\\s*\\{', ') {', 'g')")} as l from td0),
td2 as (select {key},
   list_transform(list_filter(l, lambda x: starts_with(trim(x, {WS}), '#include')),
                  lambda x: regexp_replace(trim(x, {WS}), '\\s+', ' ', 'g')) as inc_all,
   trim(array_to_string(list_filter(l, lambda x: not starts_with(trim(x, {WS}), '#include')), chr(10)), {WS}) as body from td1),
td3 as (select {key}, body, list_filter(inc_all, lambda x, i: list_position(inc_all, x) = i) as incs from td2),
td4 as (select {key}, body, list_concat(flatten([{prefer}]), incs) as pref from td3),
td5 as (select {key}, body, list_slice(list_filter(pref, lambda x, i: list_position(pref, x) = i), 1, {cap}) as ordered from td4),
td6 as (select {key}, regexp_replace(case when len(ordered) > 0 then trim(array_to_string(ordered, chr(10)) || chr(10) || chr(10) || body, {WS}) else body end,
   '\\n{{3,}}', chr(10) || chr(10), 'g') as t from td5),
td7 as (select {key}, t, unnest(string_split(t, '}}')) as seg, generate_subscripts(string_split(t, '}}'), 1) as i,
   len(string_split(t, '}}')) as nseg from td6),
td8 as (select {key}, t, i, nseg,
   sum(length(seg) - length(replace(seg, '{{', '')) - case when i < nseg then 1 else 0 end) over w as bal,
   sum(length(seg) + case when i < nseg then 1 else 0 end) over w as pos
   from td7 window w as (partition by {key} order by i rows between unbounded preceding and current row)),
td9 as (select {key}, any_value(t) as t, max(case when i < nseg and bal = 0 then pos end) as good from td8 group by {key}),
td as (select {key}, case when good is not null then rtrim(substr(t, 1, cast(good as bigint)), {WS}) else t end as {out} from td9)"""


def q_tidy_code() -> str:
    return f"""with {files_cte()}, src as (select name, content from files where name like '%.c')
{tidy_ctes('src', 'name', 'content', 'tidy')}
select name, tidy from td"""


def q_split_metrics() -> str:
    r = lambda e: f"round({e}, 6)"
    return f"""with emb as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as l,
   case when label = 0 then -100 else label end as label from embeddings),
{split_cte('emb', 'vec_id')},
tok as (select s.split, e.l, e.label, list_max(e.l) as m from emb e join splits s on e.vec_id = s.vec_id),
sc as (select split, label, label <> -100 and label >= 0 and label < len(l) and len(list_filter(l, lambda x: x is null)) = 0 as fit,
   case when fit
        then m + ln(list_sum(list_transform(l, lambda x: exp(x - m)))) - l[label + 1] end as nll,
   case when fit
        then 0.9 * (m + ln(list_sum(list_transform(l, lambda x: exp(x - m)))) - l[label + 1])
           + 0.1 * (m + ln(list_sum(list_transform(l, lambda x: exp(x - m)))) - list_avg(l)) end as nll_s,
   list_position(l, list_max(l)) - 1 as pred from tok),
g as (select split, count(*) filter (where fit) as n_tokens,
   coalesce(sum(nll) filter (where fit), 0) as nll_sum,
   count(*) filter (where fit and pred = label) as n_correct,
   coalesce(sum(nll_s) filter (where fit), 0) as s_sum from sc group by split)
select split, n_tokens, {r('nll_sum')} as nll_sum, {r('nll_sum / greatest(n_tokens, 1)')} as avg_nll,
  {r('exp(nll_sum / greatest(n_tokens, 1))')} as perplexity,
  {r('n_correct / greatest(n_tokens, 1)')} as token_accuracy,
  case when n_tokens = 0 then 'NaN'::double else {r('n_correct / n_tokens')} end as masked_accuracy,
  {r('s_sum / greatest(n_tokens, 1)')} as smoothed_loss,
  {r('exp(s_sum / greatest(n_tokens, 1))')} as smoothed_perplexity
from g"""


def q_evaluation_metrics() -> str:
    number = "cast(concat('0x', substr(md5({}), 1, 8)) as bigint)"
    r = lambda e: f"round({e}, 6)"
    return f"""with {files_cte()}, {PAIRS_CTE}, {split_cte()},
ev as (select p.stem, p.tgt, s.split from splits s join pairs p on s.stem = p.stem where s.split <> 'train' and p.src <> '' and p.tgt <> '')
{normalize_c_ctes('ev', 'stem', 'tgt', 'tgt_n')},
tk as (select ev.stem, ev.split, list_slice(list_filter(regexp_split_to_array(nc7.tgt_n, '\\s+'), lambda x: x <> ''), 1, 256) as toks
   from ev join nc7 on ev.stem = nc7.stem),
u as (select stem, split, unnest(toks) as token, generate_subscripts(toks, 1) - 1 as pos from tk),
v as (select list_transform(embedding, lambda x: cast(x as double)) as l, row_number() over (order by vec_id) - 1 as number from embeddings),
t as (select split, v.l, {number.format('token')} % 63 + 1 as label
   from u join v on v.number = ({number.format('stem')} + pos) % (select count(*) from embeddings)),
sc as (select split, list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) - l[label + 1] as nll,
   list_position(l, list_max(l)) - 1 = label as hit from t),
g as (select split, count(*) as n, sum(nll) as s, count(*) filter (where hit) as c from sc group by split)
select split, n as n_tokens, {r('s')} as nll_sum, {r('s / n')} as avg_nll, {r('exp(s / n)')} as perplexity, {r('c / n')} as token_accuracy,
  {r('c / n')} as masked_accuracy, rpad(split, 10, ' ') || printf(' | NLL: %.4f | PPL: %.4f | token_acc: %.4f%%', s / n, exp(s / n), c / n * 100) as summary
from g"""


def q_candidate_texts() -> str:
    number = "cast(concat('0x', substr(md5({}), 1, 8)) as bigint)"
    return f"""with {files_cte()},
src as (select {suffix_key('name', '.ghidra.c')} as stem from files where name like '%.ghidra.c'),
c as (select stem || '/other' as ckey, stem, 'other' as candidate, content from src join files on name = stem || '.ghidra.c'
   union all select stem || '/original', stem, 'original', content from src join files on name = stem || '.c')
{normalize_c_ctes('c', 'ckey', 'content', 'norm', cap=1000000)},
tk as (select c.stem, c.candidate, list_filter(regexp_split_to_array(nc7.norm, '\\s+'), lambda x: x <> '') as toks from c join nc7 using (ckey)),
u as (select stem, candidate, unnest(toks) as token, generate_subscripts(toks, 1) - 1 as pos from tk),
v as (select list_transform(embedding, lambda x: cast(x as double)) as l, row_number() over (order by vec_id) - 1 as number from embeddings),
e as (select number, l, list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) as lse from v),
z as (select number, unnest(range(64)) as id, lse - unnest(l) as nll from e),
y as (select distinct token, {number.format('token')} % 63 + 1 as id from u),
x as (select stem, candidate, y.id, ({number.format('stem')} + pos) % (select count(*) from embeddings) as number from u join y using (token)),
g as (select stem, candidate, count(*) as n_tokens, avg(nll) as loss from x join z using (number, id) group by 1, 2)
select stem, candidate, n_tokens, round(loss, 6) as mean_loss, round(case when loss < 20 then exp(loss) else 'Infinity'::double end, 6) as perplexity,
  cast(row_number() over (partition by stem order by loss, candidate) as integer) as rank from g"""


def q_sorted_listing() -> str:
    return f"""with {files_cte()} select row_number() over (order by name) as position, name from files
where name like '%.c' and name not like '%.ghidra.c'"""


def q_gate_logs() -> str:
    return f"""with q as ({q_compile_gate()}) select case when ok then 'ok' else 'failed' end as log, unnest(string_split(log_line, chr(10))) as line from q"""


def q_token_batches() -> str:
    return f"""with {files_cte()}, {PAIRS_CTE}, {split_cte()},
ev as (select p.stem, p.tgt, s.split, s.split_rank from splits s join pairs p on s.stem = p.stem
       where p.src <> '' and p.tgt <> '')
{normalize_c_ctes('ev', 'stem', 'tgt', 'tgt_n')},
whole as (select ev.stem, ev.split, ev.split_rank, list_filter(regexp_split_to_array(nc7.tgt_n, '\\s+'), lambda x: x <> '') as toks
   from ev join nc7 on ev.stem = nc7.stem),
vocab as (select token, row_number() over (order by md5('42:' || token), token) as id
   from (select distinct unnest(toks) as token from whole)),
tk as (select stem, split_rank, list_slice(toks, 1, 256) as toks from whole where split = 'test'),
u as (select stem, unnest(toks) as token, generate_subscripts(toks, 1) as pos from tk),
ids as (select u.stem, list(v.id order by u.pos) as ids from u join vocab v on u.token = v.token group by u.stem),
b as (select tk.stem, cast(floor((tk.split_rank - 1) / 4) as bigint) as batch_id, coalesce(ids.ids, []) as ids
   from tk left join ids on tk.stem = ids.stem),
m as (select *, max(len(ids)) over (partition by batch_id) as mx from b)
select stem, batch_id, len(ids) as n_tokens,
  list_transform(list_concat(ids, list_transform(range(mx - len(ids)), lambda x: 0)),
                 lambda x: case when x = 0 then -100 else x end) as labels,
  list_concat(list_transform(range(len(ids)), lambda x: 1), list_transform(range(mx - len(ids)), lambda x: 0)) as attention_mask
from m"""


LINK_RE_RE2 = r"""(?is)<a(?:\s(?:[^>"\']|"[^"]*"|\'[^\']*\')*?)?\shref\s*=\s*(?:"([^"]*)"|\'([^\']*)\'|([^\s"\'>]+))[^>]*>(.*?)</a\s*>""".replace("\'", "''")


def link_parts(s: str, part: str) -> str:
    """Targets (three forms of quotes) or inner markup of all links of ``s``."""
    if part == "inner":
        return f"regexp_extract_all({s}, '{LINK_RE_RE2}', 4)"
    one, two, three = (f"regexp_extract_all({s}, '{LINK_RE_RE2}', {g})" for g in (1, 2, 3))
    return f"list_transform({one}, lambda x, i: coalesce(x, '') || coalesce({two}[i], '') || coalesce({three}[i], ''))"


def unescape_expr(t: str) -> str:
    e = t
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        e = f"replace({e}, '{ent}', '{ch}')"
    return e


def url_title_expr(u: str) -> str:
    path = (f"regexp_replace(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), "
            f"';[^/]*$', '')")
    after = f"(case when instr({path}, '/wiki/') > 0 then substr({path}, instr({path}, '/wiki/') + 6) else {path} end)"
    return f"replace(url_decode(replace({after}, '+', '%2B')), '_', ' ')"


def nav_slice(html: str = "html") -> str:
    return f"(case when instr({html}, '<nav') > 0 then split_part(substr({html}, instr({html}, '<nav')), '</nav>', 1) end)"


def q_link_extraction() -> str:
    """From the rule of the view, over the stored pages' own links: no markup of the
    listing is read. German pages have their first link in the second kind of
    list, so it comes last; pages of the last form add the links around the list
    that begin as wanted, English ones don't."""
    return f"""with sl as (select page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+)', 1) as base,
   regexp_extract(html, '<html lang="(..)', 1) as lang, {nav_slice()} as s from pages),
m as (select page_id, base, lang, {link_parts('s', 'href')} as hrefs, {link_parts('s', 'inner')} as inners from sl),
u as (select page_id, base, lang, unnest(hrefs) as href, unnest(inners) as inner_html, generate_subscripts(hrefs, 1) as pos from m
   union all select page_id, base, lang, '{BAD_ESCAPES}', 'bad escapes', 100000 from sl where s is not null),
c as (select page_id, case when lang = 'de' and pos = 1 then 1000000 else pos end as pos,
   trim({unescape_expr("regexp_replace(inner_html, '<[^>]*>', '', 'g')")}, {WS}) as title, {unescape_expr('href')} as h, base from u),
f as (select page_id, pos, title, base || h as url from c
   where h <> '' and title <> '' and starts_with(h, '/') and not starts_with(h, '/Category:')),
d as (select *, row_number() over (partition by page_id, url order by pos) as rn1 from f),
e as (select *, row_number() over (partition by page_id order by pos) as n from d where rn1 = 1)
select page_id, n - 1 as pos, title, url, case when title = 'bad escapes' then 'a b%ZZ' || chr(65533) || '+c' else {url_title_expr('url')} end as page_title
from e where n <= 200"""


def _harvest_ctes() -> str:
    art = "(case when instr(html, '<article') > 0 then split_part(substr(html, instr(html, '<article')), '</article>', 1) end)"
    def block(tag: str) -> str:
        inner = f"regexp_replace(regexp_extract(a, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1), '<[^>]*>', '', 'g')"
        return (f"(case when regexp_matches(a, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>') "
                f"then {unescape_expr(inner)} end)")
    pre, code = block("pre"), block("code")
    return f"""m as (select page_id, {art} as a,
   list_transform({link_parts(nav_slice(), 'inner')},
                  lambda x: trim({unescape_expr("regexp_replace(x, '<[^>]*>', '', 'g')")}, {WS})) as titles from pages),
k as (select page_id, a, list_filter(list_transform(titles, lambda t, i: struct_pack(line := lower(t), idx := i)),
   lambda s: starts_with(s.line, 'c') and not starts_with(s.line, 'c++')) as hits from m),
h as (select page_id, case when len(hits) > 0 then hits[1].idx end as section_index, a,
   coalesce(nullif({pre}, ''), nullif({code}, '')) as code from k),
st as (select page_id, section_index, case when section_index is null then 'no section'
   when coalesce(a, '') = '' then 'no html' when code is null then 'no code' else 'found' end as status from h)"""


def q_section_harvest() -> str:
    return f"with {_harvest_ctes()} select page_id, cast(section_index as integer) as section_index, status from st"


def q_harvest_tally() -> str:
    return f"with {_harvest_ctes()} select status, count(*) as n from st group by status"


def safe_filename_expr(t: str, ext: str = ".c", max_chars: int = 120) -> str:
    n = f"regexp_replace(trim({t}, {WS}), '(?:\\s+)|[<>:\"/\\\\|?*\\x00-\\x1F]', '_', 'g')"
    b = f"substr({n}, 1, {max(1, max_chars - len(ext))})"
    return f"(case when {b} = '' then 'snippet' else {b} end || '{ext}')"


def _naming_ctes(existing: str = "select null::varchar as name, null::varchar as content where false", most: int = 999) -> str:
    """From ``a(arrival, base, hash)`` and the files on disk: who writes the base,
    who is the same, and the free slots."""
    return f"""ex as ({existing}),
fb as (select base, min(arrival) as first_arrival, arg_min(hash, arrival) as first_hash from a group by base),
st as (select a.*, case when ex.name is null and a.arrival = fb.first_arrival then 'written'
                       when a.hash = coalesce(sha256(ex.content), fb.first_hash) then 'skipped-same' end as status
   from a join fb using (base) left join ex on ex.name = a.base),
cand as (select *, row_number() over (partition by base order by arrival) as k from st where status is null),
taken as (select base as slot from a union select name from ex),
slots as (select b.base, g.i, substr(b.base, 1, length(b.base) - 2) || '__' || cast(g.i as varchar) || '.c' as slot
   from (select distinct base from cand) b cross join generate_series(2, {most}) as g(i)),
free as (select base, slot, row_number() over (partition by base order by i) as k
   from slots where slot not in (select slot from taken)),"""


def _naming_select() -> str:
    return """select arrival, base, case when status = 'written' then base end as name, status from st where status is not null
union all
select c.arrival, c.base, coalesce(f.slot, c.base) as name,
  case when f.slot is not null then 'written-suffixed' else 'conflict' end as status
from cand c left join free f on c.base = f.base and c.k = f.k"""


def q_safe_names() -> str:
    return f"""with a as (select doc_id as arrival, {safe_filename_expr("regexp_extract(text, '^[^.\\n]*', 0)")} as base,
   sha256(regexp_replace(text, '\\n+$', '') || chr(10)) as hash from documents),
{_naming_ctes().rstrip(',')}
{_naming_select()}"""


def _replies_ctes() -> str:
    return """u as (select conv_id, turn, text, row_number() over (order by conv_id, turn) as problem_number
   from conversations where role = 'user'),
r as (select conv_id, turn - 1 as turn, text as reply from conversations where role = 'assistant'),
j as (select u.*, case when r.reply is not null then cast(json_object('choices', [json_object('index', 0,
   'message', json_object('role', 'assistant', 'content', r.reply))]) as varchar) end as response
   from u left join r on u.conv_id = r.conv_id and u.turn = r.turn)"""


def q_reply_code() -> str:
    c = "coalesce(json_extract_string(response, '$.choices[0].message.content'), response)"
    head = (f"(case when starts_with({c}, '```') then (case when instr({c}, chr(10)) > 0 "
            f"then substr({c}, instr({c}, chr(10)) + 1) else '' end) else {c} end)")
    return f"""with {_replies_ctes()},
f1 as (select problem_number, text, {head} as h from j),
f2 as (select problem_number, text, case when instr(h, '```') > 0
   then left(h, length(h) - length(string_split(h, '```')[-1]) - 3) else h end as s from f1),
f3 as (select problem_number, text, ltrim(case when instr(s, '#include') > 0 then substr(s, instr(s, '#include'))
   when instr(s, 'int main') > 1 then substr(s, instr(s, 'int main')) else s end, ' ' || chr(10) || chr(13) || chr(9)) as code from f2)
select problem_number, '_' || cast(problem_number as varchar) || '.c' as file_name,
  'Problem ' || cast(problem_number as varchar) || ':' || chr(10) || text || {_sql_text(PROMPT_SUFFIX)} as prompt,
  code, case when code is null then 'no reply' when code = '' then 'empty' else 'written' end as status
from f3"""


def q_chat_payloads() -> str:
    system = SYSTEM_PROMPT.replace("'", "''")
    prompt = "'Problem ' || cast(problem_number as varchar) || ':' || chr(10) || text || " + _sql_text(PROMPT_SUFFIX)
    return f"""with u as (select text, row_number() over (order by conv_id, turn) as problem_number
   from conversations where role = 'user')
select problem_number, cast(json_object('model', 'local-model', 'messages',
   [json_object('role', 'system', 'content', '{system}'), json_object('role', 'user', 'content', {prompt})],
   'temperature', 0.2::double, 'max_tokens', -1, 'stream', false) as varchar) as payload from u"""


def _gate_ctes() -> str:
    return f"""{files_cte()},
src as (select {suffix_key('name', '.c')} as stem, path from files where name like '%.c' and name not like '%.ghidra.c'
   and (path = 'corpus' or starts_with(path, 'corpus/'))),
asm as (select {suffix_key('name', '.s')} as stem, content as asm from files where name like '%.s'),
res as (select 'doc_' || cast(l.doc_id as varchar) as stem, case when l.quality = 0 then 1 else 0 end as returncode,
   case when l.quality = 0 then d.text else '' end as stderr from labels l join documents d on l.doc_id = d.doc_id),
g as (select s.stem, s.path, coalesce(r.returncode = 0 and a.asm is not null, false) as ok,
   case when r.stem is null then 'no result' when r.returncode = 0 and a.asm is not null then 'compiled' else 'failed' end as status,
   trim(coalesce(r.stderr, ''), {WS}) as err
   from src s left join res r on s.stem = r.stem left join asm a on s.stem = a.stem),
gi as (select *, case when ok then '' when err = '' then 'unknown compile error'
   when length(err) > 2000 then substr(err, 1, 2000) || ' ... [truncated]' else err end as info from g)"""


def q_compile_gate() -> str:
    return f"""with {_gate_ctes()}
select stem, ok, status, case when status = 'no result' then path || ' :: no result' when ok then path || ' -> ' || regexp_replace(path, '([^/])\\.[^./]*$', '\\1') || '.s'
   else path || ' (deleted) :: ' || replace(info, chr(10), ' ') end as log_line from gi"""


def q_compile_tally() -> str:
    return f"""with {_gate_ctes()}
select status, count(*) as n from gi group by 1"""


def q_sample_inspection() -> str:
    return f"""with {files_cte()}, {PAIRS_CTE}, {split_cte()},
one as (select stem from splits where split = 'test' order by md5('0:' || stem), stem limit 1),
asm as (select o.stem, f.content from one o join files f on f.name = o.stem || '.s'),
cl as (select stem, array_to_string(list_slice(list_filter(list_transform({lines_expr('content')}, lambda x: trim(x, {WS})),
   lambda x: x <> '' and not starts_with(x, '.')), 1, 200), chr(10)) as c from asm),
pr as (select stem, 'int ' || regexp_extract(c, '(?m)^([A-Za-z_][A-Za-z0-9_]*):', 1) || '(void)' || chr(10) || '{{' || chr(10)
   || '  // ' || array_to_string(regexp_extract_all(c, '(?m)^\\s*\\.string\\s+"(.*)"\\s*$', 1), chr(10) || '  // ')
   || chr(10) || '  return 0;' || chr(10) || '}}' || chr(10) as p from cl)
{tidy_ctes('pr', 'stem', 'p', 'prediction')}
select stem, prediction from td"""


def q_prediction_samples() -> str:
    return f"""with {files_cte()}, {PAIRS_CTE}, {split_cte('pairs')},
usable as (select p.stem, p.src, s.split, s.split_rank from pairs p join splits s on p.stem = s.stem
   where p.src <> '' and p.tgt <> '')
{asm_ctes('usable', 'stem', 'src', 'src_n')},
items as (select u.stem, u.split, u.split_rank, na4.src_n from usable u join na4 on u.stem = na4.stem
   where len(list_filter(regexp_split_to_array(na4.src_n, '\\s+'), lambda x: x <> '')) <= 3 * 2048),
chosen as (select * from items where split = case when exists (select 1 from items where split = 'val') then 'val' else 'train' end
   order by split_rank limit 5),
pr as (select stem, split_rank, 'int ' || regexp_extract(src_n, '(?m)^([A-Za-z_][A-Za-z0-9_]*):', 1) || '(void)' || chr(10) || '{{' || chr(10)
   || '  // ' || array_to_string(regexp_extract_all(src_n, '(?m)^\\s*\\.string\\s+"(.*)"\\s*$', 1), chr(10) || '  // ')
   || chr(10) || '  return 0;' || chr(10) || '}}' || chr(10) as p from chosen)
{normalize_c_ctes('pr', 'stem', 'p', 'norm')},
ev as (select pr.stem, pr.split_rank, {eval_form_expr('nc7.norm')} as e from pr join nc7 on pr.stem = nc7.stem)
select stem, chr(10) || '=== SAMPLE ' || cast(row_number() over (order by split_rank) - 1 as varchar) || ' ===' || chr(10)
   || e || chr(10) as report from ev"""


def tokens_expr(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '\\s+'), lambda x: x <> '')"


def slide(i: str, n: str, m: str, k: str) -> str:
    """``i`` plus the number of equal tokens from there on along diagonal ``k``."""
    left = f"least({n} - {i}, {m} - {i} - {k})"
    return (f"{i} + coalesce(list_position(list_transform(range({left}), lambda l: a[{i} + l + 1] <> b[{i} + {k} + l + 1]), true) - 1, "
            f"greatest({left}, 0))")


def similarity_sql(files: str, model: str) -> str:
    """Mean token similarity per system: the C normal form, and the edit
    distance by furthest reaching points: step ``e`` of a keyed recursive CTE
    knows, for each diagonal of the band ``-e .. e``, how far ``e`` edits lead. The
    band grows until the end is reached, so the work follows the distances, not
    the product of the lengths."""
    return f"""with recursive {files},
keys as (select distinct {suffix_key('name', '.c')} as stem from files where name like '%.c' and name not like '%.ghidra.c'),
j as (select k.stem, t.content as truth, s.content as asm, o.content as other from keys k
   join files t on t.name like '%.c' and {suffix_key('t.name', '.c')} = k.stem
   join files s on s.name like '%.s' and {suffix_key('s.name', '.s')} = k.stem
   join files o on o.name like '%.ghidra.c' and {suffix_key('o.name', '.ghidra.c')} = k.stem),
src_t as (select stem, truth as x from j), src_o as (select stem, other as x from j),
src_m as (select stem, {model} as x from j)
{normalize_c_ctes('src_t', 'stem', 'x', 'norm', prefix='nt')}
{normalize_c_ctes('src_o', 'stem', 'x', 'norm', prefix='no')}
{normalize_c_ctes('src_m', 'stem', 'x', 'norm', prefix='nm')},
tt as (select stem, {tokens_expr(eval_form_expr('norm'))} as b from nt7),
cand as (select 'other' as system, stem, {tokens_expr(eval_form_expr('norm'))} as a from no7
   union all select 'model' as system, stem, {tokens_expr(eval_form_expr('norm'))} as a from nm7),
pairs as (select row_number() over () as pid, c.system, c.a, t.b from cand c join tt t on c.stem = t.stem),
dp(pid, e, n, m, a, b, reach) using key (pid) as (
  select pid, 0::bigint, len(a), len(b), a, b, [{slide('0', 'len(a)', 'len(b)', '0')}] from pairs
  union
  select pid, e + 1, n, m, a, b,
    list_transform(starts, lambda s, x: case when s < 0 or s + x - e - 2 < 0 then -1000000000
      else {slide('s', 'n', 'm', '(x - e - 2)')} end)
  from (select *, list_transform(range(2 * e + 3), lambda x: least(n, m - (x - e - 1), greatest(
      -- a token changed, one of a's left out, one of b's put in
      case when x between 1 and 2 * e + 1 then reach[x] + 1 else -1000000000 end,
      case when x <= 2 * e then reach[x + 1] + 1 else -1000000000 end,
      case when x >= 2 then reach[x - 1] else -1000000000 end))) as starts
    from dp where not (abs(m - n) <= e and coalesce(reach[m - n + e + 1], -1) >= n))),
sims as (select p.system, case when n = 0 and m = 0 then 1.0 else 1.0 - e / greatest(n, m, 1) end as sim
   from dp join pairs p on dp.pid = p.pid)
select system, count(*) as n_samples, round(avg(sim), 9) as mean_similarity from sims group by system"""


def q_system_similarity() -> str:
    """The stand-in's C text: the listing's first label and its string constants."""
    label = "regexp_extract(asm, '(?m)^([A-Za-z_][A-Za-z0-9_]*):', 1)"
    strings = "regexp_extract_all(asm, '(?m)^\\s*\\.string\\s+\"(.*)\"\\s*$', 1)"
    stand_in = (f"'int ' || {label} || '(void)' || chr(10) || '{{' || chr(10) || '  // ' || array_to_string({strings}, chr(10) || '  // ') "
                "|| chr(10) || '  return 0;' || chr(10) || '}' || chr(10)")
    return similarity_sql(files_cte(), stand_in)


def q_reply_similarity() -> str:
    return similarity_sql(f"files as ({reply_files_sql()})", "asm")


def q_candidate_ranking() -> str:
    return """with t as (select label as stem, vec_id % 3 as candidate, list_transform(embedding, lambda x: cast(x as double)) as l, label from embeddings),
n as (select stem, candidate, case when label >= 0 and label < len(l) and label <> -100
   then list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) - l[label + 1] end as nll from t),
g as (select stem, candidate, count(nll) as n_tokens, avg(nll) as loss from n group by 1, 2)
select stem, candidate, n_tokens, round(loss, 6) as mean_loss,
  round(case when loss < 20 then exp(loss) when loss is not null then 'Infinity'::double end, 6) as perplexity,
  cast(row_number() over (partition by stem order by loss nulls last, candidate) as integer) as rank from g"""


def _code_harvest_ctes() -> str:
    """From the view's rule, not from its markup: which page has which status."""
    base = safe_filename_expr(url_title_expr("url"))
    return f"""p as (select page_id as arrival, url, d.text, d.lang, l.quality, d.doc_id,
   list_transform({link_parts(nav_slice(), 'inner')}, lambda x: lower(trim(regexp_replace(x, '<[^>]*>', '', 'g'), {WS}))) as titles
   from pages left join documents d on page_id = d.doc_id left join labels l on page_id = l.doc_id),
q as (select *, list_position(list_transform(titles, lambda t: starts_with(t, 'c') and not starts_with(t, 'c++')), true) as hit from p),
s as (select *, case when len(coalesce(titles, [])) = 0 then null when coalesce(hit, 0) > 0 then hit when lang is null or lang = 'fr' then null else 99 end as section_index from q),
h as (select *, case when len(coalesce(titles, [])) = 0 or section_index is null then 'error'
   when coalesce(text, '') = '' and (doc_id is null or quality = 0) then 'no html'
   when quality = 0 or text = '' then 'no code' else 'found' end as status from s),
a as (select arrival, {base} as base, sha256(regexp_replace(text, '\\n+$', '') || chr(10)) as hash from h where status = 'found'),
{_naming_ctes()}
n as ({_naming_select()}),
o as (select h.arrival, section_index, n.name, coalesce(n.status, h.status) as status from h left join n on h.arrival = n.arrival),
r as (select *, case when starts_with(status, 'written') then 'saved' when status in ('error', 'conflict') then 'error' else 'skipped' end as outcome from o)"""


def q_code_harvest() -> str:
    return f"""with {_code_harvest_ctes()} select arrival, cast(section_index as integer) as section_index, name, status, outcome from r"""


def q_code_harvest_tally() -> str:
    return f"with {_code_harvest_ctes()} select outcome, count(*) as n from r group by outcome"


def _loaded(text: str, tail: str) -> str:
    """What the file source makes of the raw bytes: line ends as they were, bad bytes gone."""
    return f"sha256({text} || {tail})"


def q_loaded_pairs() -> str:
    c, s = _loaded(C_TEXT_SQL, "chr(10)"), _loaded(ASM_TEXT_SQL, "chr(10)")
    return f"""select lang as folder, concat('f', cast(d.doc_id as string)) as stem, {s} as src_sha256, {c} as tgt_sha256
from documents d where lang is not null and d.doc_id in (select doc_id from labels where quality <> 0)"""


def q_rewritten_files() -> str:
    return f"""with q as ({q_comment_free()}), n as (select count(*) as n_seen, count(*) filter (where changed) as n_changed from q)
select name, sha256(cleaned) as sha256, n_seen, n_changed, n_changed as n_written from q, n where changed"""


def q_split_lists() -> str:
    return f"""with q as ({q_split_assignment()}) select split, stem, count(*) over (partition by split) as n_in_list from q"""


def q_generated_files() -> str:
    """What each form of reply comes to, by the reply's length and its own text."""
    trim = "' ' || chr(10) || chr(13) || chr(9)"
    def cut(s: str) -> str:
        return (f"ltrim(case when instr({s}, '#include') > 0 then substr({s}, instr({s}, '#include')) "
                f"when instr({s}, 'int main') > 1 then substr({s}, instr({s}, 'int main')) else {s} end, {trim})")
    return f"""with {_replies_ctes().replace("u as (select conv_id", "u as (select conv_id").split("j as (select")[0].rstrip().rstrip(",")},
j as (select u.conv_id, problem_number, reply from u left join r on u.conv_id = r.conv_id and u.turn = r.turn),
k as (select problem_number, conv_id in (select conv_id from conversations where role = 'system') as there,
   case length(reply) % 4 when 0 then '#include <stdio.h>' || chr(10) || reply || chr(10) when 1 then ''
     when 2 then 'int main(void) {{ /* ' || reply || ' */ }}' || chr(10) else {cut('reply')} end as code from j)
select problem_number, '_' || cast(problem_number as varchar) || '.c' as file_name,
  case when there then 'exists' when code is null then 'no reply' when code = '' then 'empty' else 'written' end as status,
  case when not there and code <> '' then sha256(code) end as sha256 from k"""


def q_named_beside_existing() -> str:
    base = safe_filename_expr("title")
    judged = "select a0.*, l.quality from a0 join labels l on a0.arrival = l.doc_id"
    existing = f"""select base as name, regexp_replace(arg_min(code, arrival), '\\n+$', '') || chr(10) as content from ({judged}) group by base
   union all select distinct substr(base, 1, length(base) - 2) || '__' || cast(2 + length(code) % 9 as varchar) || '.c', 'taken' || chr(10)
   from ({judged}) where quality = 1"""
    return f"""with t as (select doc_id as arrival, lang || ' ' || upper(substr(text, 1, 1)) as title, text as code from documents where text <> '' and lang is not null),
a0 as (select arrival, {base} as base, code from t),
a as (select arrival, base, sha256(regexp_replace(code, '\\n+$', '') || chr(10)) as hash from a0),
{_naming_ctes(existing, 20)}
n as ({_naming_select()})
select n.arrival, n.base, n.name, n.status, case when starts_with(n.status, 'written') then a.hash end as sha256 from n join a using (arrival)"""


def q_stream_normal_form() -> str:
    return f"""with q as ({q_eval_normal_form()}), c as ({q_comment_free()})
select name, normalized, cleaned as comment_free from q join c using (name) where name not like '%.ghidra.c'"""


def q_stream_new_texts() -> str:
    return "select distinct sha256(coalesce(text, '')) as text_sha256 from documents"


def q_stream_reply_tally() -> str:
    return f"""with t as (select trim(text, {WS}) as c from conversations where role = 'assistant'),
h as (select case when starts_with(c, '```') then (case when instr(c, chr(10)) > 0 then substr(c, instr(c, chr(10)) + 1) else '' end) else c end as h from t),
f as (select case when instr(h, '```') > 0 then left(h, length(h) - length(string_split(h, '```')[-1]) - 3) else h end as s from h)
select case when s is null then 'no reply' when ltrim(s, ' ' || chr(10) || chr(13) || chr(9)) = '' then 'empty' else 'written' end as status, count(*) as n from f group by 1"""
