"""Text column functions (``Column -> Column``).

Every function here is a composition of built-in Spark expressions, so it
runs in the JVM (higher-order functions are interpreted there, not compiled),
works on batch and streaming frames alike, and never shuffles. No function
cuts anything unless the caller asks for it. Python text semantics (``str.strip``,
``str.split``, ``str.splitlines``) are reproduced with explicit character
sets, because Java's ``\\s`` is ASCII-only by default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Java regex fragments for the sets above (explicit classes: the (?U) flag
# makes every match several times slower).
WS_CLASS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a"
            r"\u2028\u2029\u202f\u205f\u3000]")
WS = WS_CLASS
WS_RUN = WS_CLASS + "+"
# The line boundaries str.splitlines() breaks on (besides \n),
# with \r\n counting once.
BREAK_RE = r"\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
LINE_SPLIT_RE = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# whitespace that is not a line break (for per-line matching after the
# breaks have been normalised to \n)
HWS = r"[\t\x1f \xa0\u1680\u2000-\u200a\u202f\u205f\u3000]"

# Headers the C normaliser lifts first, in this order.
PREFERRED_HEADERS = ["<stdio.h>", "<stdlib.h>", "<string.h>", "<ctype.h>", "<math.h>"]

# Data directives kept verbatim inside .rodata / .data.
ASM_DATA_DIRECTIVES = [".string", ".byte", ".word", ".short", ".long", ".quad"]
ASM_DATA_SECTIONS = [".rodata", ".data"]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Column helpers that use an input several times would otherwise copy the
    input's whole expression tree into each use, and every copy is evaluated
    separately (sub-expression elimination does not reach into lambdas)."""
    return F.element_at(F.transform(F.array(_c(value)), lambda v: body(v)), 1)


# ---------------------------------------------------------------------------
# Contract helpers (decoding, whitespace, lines)
# ---------------------------------------------------------------------------

def decode_text(binary) -> Column:
    """Bytes -> text the way ``read_text(encoding='utf-8', errors='ignore')``
    does it: invalid bytes are dropped (a genuine U+FFFD is dropped too) and
    universal newlines turn ``\\r\\n`` / ``\\r`` into ``\\n``."""
    s = F.make_valid_utf8(_c(binary).cast("string"))
    s = F.regexp_replace(s, "\uFFFD", "")
    return F.regexp_replace(s, r"\r\n?", "\n")


def strip_ws(text) -> Column:
    """Python ``str.strip()``."""
    return F.btrim(_c(text), F.lit(PY_WHITESPACE))


def rstrip_ws(text) -> Column:
    """Python ``str.rstrip()``."""
    return F.rtrim(_c(text), F.lit(PY_WHITESPACE))


def lstrip_ws(text) -> Column:
    return F.ltrim(_c(text), F.lit(PY_WHITESPACE))


def collapse_ws(text) -> Column:
    """``' '.join(s.split())`` for an already stripped string."""
    return F.regexp_replace(_c(text), WS_RUN, " ")


def unify_breaks(text) -> Column:
    """Every line boundary ``str.splitlines()`` knows -> ``\n`` (``\r\n``
    counts once), in one regex pass."""
    return F.regexp_replace(_c(text), BREAK_RE, "\n")


def split_nl(text) -> Column:
    """Lines of a text whose only break is ``\n`` (literal split, no
    regex), without the trailing empty line."""
    return let(F.split(_c(text), "\n", -1),
               lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1))
               .otherwise(parts))


def lines(text) -> Column:
    """Python ``str.splitlines()``: array of lines, no trailing empty line."""
    return split_nl(unify_breaks(text))


def join_lines(arr) -> Column:
    return F.array_join(arr, "\n")


def tokens(text) -> Column:
    """Python ``str.split()``: whitespace tokens, no empty strings (every
    whitespace character becomes a space, then a literal split)."""
    # translate + literal split measured faster than any regex split here
    spaced = F.translate(_c(text), PY_WHITESPACE, " " * len(PY_WHITESPACE))
    return F.filter(F.split(spaced, " ", -1), lambda x: x != "")


# ---------------------------------------------------------------------------
# C normal form
# ---------------------------------------------------------------------------

def brace_style(text) -> Column:
    """``)`` + any whitespace + ``{`` -> ``) {`` (also across newlines)."""
    return F.regexp_replace(_c(text), r"\)" + WS_CLASS + r"*\{", ") {")


def _is_include(line: Column) -> Column:
    # cheap literal test first; ``strip().startswith`` needs only the left trim
    return (F.instr(line, "#include") > 0) & lstrip_ws(line).startswith("#include")


def _contains(needle: str):
    # a one-argument lambda: PySpark reads a two-argument one as (x, index)
    return lambda x: F.instr(x, needle) > 0


def ordered_includes(lns: Column, cap: int | None, prefer=PREFERRED_HEADERS) -> Column:
    """Distinct include keys (whitespace collapsed), preferred headers first
    (substring test, in preference order), the rest in order of appearance;
    with ``cap``, the first ones alone (the others leave the text)."""
    incs = F.array_distinct(F.transform(F.filter(lns, _is_include), lambda x: collapse_ws(strip_ws(x))))
    ordered = let(incs, lambda i: F.array_distinct(
        F.concat(F.flatten(F.array(*[F.filter(i, _contains(p)) for p in prefer])), i)))
    return ordered if cap is None else F.slice(ordered, 1, cap)


def collapse_blank_runs(text) -> Column:
    return F.regexp_replace(_c(text), r"\n{3,}", "\n\n")


def drop_repeated_blank_lines(lns) -> Column:
    """Line-array form of ``re.sub(r'\n{3,}', '\n\n', text)`` for texts that
    are stripped afterwards: an empty line right after an empty line goes."""
    return F.filter(lns, lambda x, i: ~((x == "") & (i > 0) & (F.element_at(lns, i) == "")))


def _normal_c_lines(text, include_cap: int | None, prefer) -> Column:
    """Lines of the C normal form before the final join + strip: includes
    first (then one empty line), body, repeated empty lines dropped."""
    def assemble(lns):
        body = F.filter(lns, lambda x: ~_is_include(x))
        return let(ordered_includes(lns, include_cap, prefer), lambda ordered: F.when(
            F.size(ordered) > 0, F.concat(ordered, F.array(F.lit("")), body)).otherwise(body))

    return let(let(lines(brace_style(text)), assemble), drop_repeated_blank_lines)


def normalize_c(text, include_cap: int | None = None, prefer=PREFERRED_HEADERS) -> Column:
    """C normal form: brace placement, includes lifted/deduped (capped, if asked for), at most
    one blank line in a row, stripped. Two regex passes per text (braces,
    line breaks); the rest works on the line array."""
    return strip_ws(join_lines(_normal_c_lines(text, include_cap, prefer)))


def normalize_for_eval(text, include_cap: int | None = None, prefer=PREFERRED_HEADERS) -> Column:
    """Evaluation form: C normal form with every line right-trimmed
    (right-trimming every line, then stripping the text, is the same as
    stripping first and right-trimming the lines after)."""
    return strip_ws(join_lines(F.transform(_normal_c_lines(text, include_cap, prefer), rstrip_ws)))


def clip_balanced(text) -> Column:
    """Cut after the last ``}`` that brings the brace depth back to exactly 0
    (depth may go negative; only ``}`` is tested), then right-trim. No such
    point -> unchanged.

    One step per ``}``-terminated segment, not per character."""
    return let(text, _clip)


def _clip(t: Column) -> Column:
    # split on the literal '}' (no regex); every piece but the last was
    # followed by one
    acc0 = F.struct(F.lit(0).alias("bal"), F.lit(0).alias("pos"), F.lit(-1).alias("good"), F.lit(1).alias("i"))

    def scan(segs):
        n = F.size(segs)

        def step(acc, seg):
            closes = acc["i"] < n
            opened = F.length(seg) - F.length(F.replace(seg, F.lit("{"), F.lit("")))
            bal = acc["bal"] + opened - F.when(closes, 1).otherwise(0)
            pos = acc["pos"] + F.length(seg) + F.when(closes, 1).otherwise(0)
            good = F.when(closes & (bal == 0), pos).otherwise(acc["good"])
            return F.struct(bal.alias("bal"), pos.alias("pos"), good.alias("good"), (acc["i"] + 1).alias("i"))

        return F.aggregate(segs, acc0, step, lambda a: a["good"])

    good = let(F.split(t, "}", -1), scan)
    return let(good, lambda g: F.when(g >= 0, rstrip_ws(F.substring(t, F.lit(1), g))).otherwise(t))


def tidy_c(text, include_cap: int | None = None, prefer=PREFERRED_HEADERS) -> Column:
    """Tidy generated C: drop lone ``<`` lines, brace style, includes lifted
    (``include_cap`` of them, if given), body trimmed, blank runs collapsed, clipped at the last balanced
    ``}``."""
    # the lone-'<' rule only matters when some line starts with '<'
    t = let(text, lambda src: F.when(
        src.startswith("<") | (F.instr(src, "\n<") > 0),
        F.regexp_replace(src, r"(?md)^<" + WS_CLASS + r"*$", "")).otherwise(src))

    def assemble(lns):
        body = strip_ws(join_lines(F.filter(lns, lambda x: ~_is_include(x))))
        return let(F.struct(ordered_includes(lns, include_cap, prefer).alias("o"), body.alias("b")), lambda r: F.when(
            F.size(r["o"]) > 0, strip_ws(F.concat(join_lines(r["o"]), F.lit("\n\n"), r["b"]))).otherwise(r["b"]))

    # the assembled text is stripped and has only \n breaks, so collapsing
    # blank runs can work on its lines
    collapsed = join_lines(let(split_nl(let(lines(brace_style(t)), assemble)), drop_repeated_blank_lines))
    return let(collapsed, clip_balanced)


# ---------------------------------------------------------------------------
# Assembly
# ---------------------------------------------------------------------------

def _first_token_in(st: Column, words) -> Column:
    """``st.split()[0] in words`` for a stripped line, without a regex: the
    line is a word, or starts with it followed by a whitespace character."""
    conds = []
    for w in words:
        nxt = F.substring(st, len(w) + 1, 1)
        conds.append(st.startswith(w) & ((F.length(st) == len(w)) | (F.instr(F.lit(PY_WHITESPACE), nxt) > 0)))
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def _asm_line(st: Column, section: Column, keep_local_labels: bool) -> Column:
    """One stripped line -> kept text or NULL, given the active section."""
    data_keep = section.isin(*ASM_DATA_SECTIONS) & _first_token_in(st, ASM_DATA_DIRECTIVES)
    code = let(rstrip_ws(F.regexp_replace(st, r"(?s)(?://|#|;).*", "")), lambda cut: F.when(
        cut == "", F.lit(None)).when(cut.endswith(":"), cut).otherwise(collapse_ws(cut)))
    directive = F.when(data_keep, st)
    if keep_local_labels:
        directive = directive.when(st.endswith(":") & ~st.contains(" "), st)
    return (
        F.when((st == "") | st.startswith("#") | st.startswith("//") | st.startswith(";"), F.lit(None))
        .when(st.startswith(".section") | (st == ".text"), F.lit(None))
        .when(st.startswith("."), directive)
        .otherwise(code)
    )


def _section_of(first_line: Column) -> Column:
    return let(strip_ws(first_line), _section_from_stripped)


def _section_from_stripped(st: Column) -> Column:
    name = F.regexp_extract(st, r"^\.section" + WS_CLASS + r"+([.A-Za-z0-9_]+)", 1)
    return (
        F.when(st.startswith(".section"), F.when(name != "", name))
        .when(st == ".text", F.lit(".text"))
    )


def normalize_asm_expr(text, keep_local_labels: bool = False) -> Column:
    """Assembly normal form as a single row-local expression (no shuffle,
    stream-safe).

    The text is cut into chunks at every section-setting line (``.section X``
    or a bare ``.text``); every line of a chunk shares the section its first
    line sets, so the carry-forward needs no window and no quadratic state.
    Rules: blanks and full-line comments dropped; ``.string/.byte/.word/
    .short/.long/.quad`` kept verbatim in ``.rodata``/``.data`` only; every
    other directive dropped (local labels too, unless ``keep_local_labels``);
    code cut at the first ``//``, ``#`` or ``;``; labels kept, instructions
    whitespace-collapsed.
    """
    t = unify_breaks(text)
    marker = rf"\n(?={HWS}*\.section|{HWS}*\.text{HWS}*(?:\n|\z))"
    chunks = F.split(t, marker, -1)

    def per_chunk(chunk):
        def with_lines(lns):
            return let(_section_of(F.element_at(lns, 1)), lambda sec: F.filter(
                F.transform(lns, lambda ln: let(strip_ws(ln), lambda st: _asm_line(st, sec, keep_local_labels))),
                lambda x: x.isNotNull()))
        return let(F.split(chunk, "\n", -1), with_lines)

    return strip_ws(join_lines(F.flatten(F.transform(chunks, per_chunk))))


def clean_asm(text, max_lines: int | None = None) -> Column:
    """Quick clean-up: stripped lines, blanks and every ``.``-line dropped;
    with ``max_lines``, the first kept lines alone."""
    kept = F.filter(F.transform(lines(text), strip_ws), lambda x: (x != "") & ~x.startswith("."))
    return join_lines(kept if max_lines is None else F.slice(kept, 1, max_lines))


# ---------------------------------------------------------------------------
# Comments, fences, model output
# ---------------------------------------------------------------------------

def _quoted(mark: str) -> str:
    """A literal between two marks: plain characters and escapes. Possessive, as
    Java would recurse once per character on a long literal."""
    return rf"{mark}(?:[^{mark}\\]++|\\.)*+{mark}"


# what a C scanner meets outside of code: literals, which stay, and what goes
LITERAL = "|".join(map(_quoted, ('"', "'")))
LINE_COMMENT, BLOCK_COMMENT = r"//[^\n]*", r"/\*(?:[^*]++|\*(?!/))*+\*/"
NOT_CODE = rf"(?s)(?<literal>{LITERAL})|{LINE_COMMENT}|{BLOCK_COMMENT}|\r"


def remove_comments(text) -> Column:
    """Strip ``//`` and ``/* */`` comments and carriage returns, leaving
    string and character literals alone."""
    return F.regexp_replace(_c(text), NOT_CODE, "${literal}")


def strip_code_fences(text) -> Column:
    """Drop an opening fence line (only at position 0) and cut at the last
    remaining fence."""
    def opened(s: Column) -> Column:
        nl = F.instr(s, "\n")
        return F.when(s.startswith("```"), F.when(nl > 0, F.substring(s, nl + 1, 2147483647)).otherwise(F.lit(""))).otherwise(s)

    def closed(head: Column) -> Column:
        tail_len = F.length(F.substring_index(head, "```", -1))
        return F.when(F.instr(head, "```") > 0, F.substring(head, 1, F.length(head) - tail_len - 3)).otherwise(head)

    return let(let(text, opened), closed)


def clean_model_output(text) -> Column:
    """Jump to the first ``#include``; else to the first ``int main``; then
    drop leading spaces, newlines, carriage returns and tabs."""
    def cut(s: Column) -> Column:
        inc, mn = F.instr(s, "#include"), F.instr(s, "int main")
        return F.when(inc > 0, F.substring(s, inc, 2147483647)).when(mn > 1, F.substring(s, mn, 2147483647)).otherwise(s)

    return F.ltrim(let(text, cut), F.lit(" \n\r\t"))


# ---------------------------------------------------------------------------
# Names, URLs, hashes, logs
# ---------------------------------------------------------------------------

# Fixed value: characters that may not stand in a file name (inside of a class)
UNSAFE_IN_NAMES = r'<>:"/\\|?*\x00-\x1F'


def safe_filename(title, ext: str = ".c", max_chars: int | None = None) -> Column:
    """Title -> file name, in one pass over the stripped title: a run of
    whitespace and each character that file systems refuse become ``_``. With
    ``max_chars``, cut to ``max_chars - len(ext)``; empty -> ``snippet``."""
    base = F.regexp_replace(strip_ws(title), f"(?:{WS_RUN})|[{UNSAFE_IN_NAMES}]", "_")
    if max_chars is not None:
        base = F.substring(base, 1, max(1, max_chars - len(ext)))
    return F.concat(F.when(base == "", F.lit("snippet")).otherwise(base), F.lit(ext))


# one escape or a run of them; what is no escape stays between the runs
ESCAPES_RE = r"(?:%[0-9A-Fa-f]{2})+"


def percent_decode(text) -> Column:
    """Percent escapes decoded as a browser or ``unquote`` does it: each run of
    escapes becomes bytes, and the bytes text, in which a byte sequence that is no
    UTF-8 is replaced by U+FFFD. ``%`` without two hexadecimal digits stays, and so
    does ``+``."""
    def decoded(t: Column) -> Column:
        runs = F.regexp_extract_all(t, F.lit(ESCAPES_RE), F.lit(0))
        chars = F.transform(runs, lambda r: _utf8(F.unhex(F.replace(r, F.lit("%"), F.lit("")))))
        return F.array_join(F.zip_with(F.split(t, ESCAPES_RE, -1), chars, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")

    return let(_c(text), lambda t: F.when(F.instr(t, "%") > 0, decoded(t)).otherwise(t))


def _utf8(data: Column) -> Column:
    """Bytes as text, each maximal part of a sequence that is no UTF-8 being one U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def url_to_title(url) -> Column:
    """URL -> page title: path after ``/wiki/`` (whole path when absent),
    percent-decoded (``+`` stays ``+``), ``_`` -> space."""
    def title(path: Column) -> Column:
        after = F.when(F.instr(path, "/wiki/") > 0, F.substring(path, F.instr(path, "/wiki/") + 6, 2147483647)).otherwise(path)
        return F.replace(percent_decode(after), F.lit("_"), F.lit(" "))

    path = F.regexp_extract(_c(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return let(F.regexp_replace(path, r";[^/]*\z", ""), title)


def content_hash(text) -> Column:
    """sha256 of the canonical file content ``rstrip('\\n') + '\\n'``."""
    return F.sha2(F.concat(F.regexp_replace(_c(text), r"\n+\z", ""), F.lit("\n")), 256)


def truncate_info(text, n: int | None = None, empty: str = "unknown compile error") -> Column:
    """Stripped error text, with ``n`` cut at so many characters with a marker;
    empty -> a fixed message."""
    t = strip_ws(F.coalesce(_c(text), F.lit("")))
    cut = t if n is None else F.when(
        F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(" ... [truncated]"))).otherwise(t)
    return F.when(t == "", F.lit(empty)).otherwise(cut)


def one_line(text) -> Column:
    return F.replace(_c(text), F.lit("\n"), F.lit(" "))
