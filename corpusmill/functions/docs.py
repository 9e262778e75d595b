"""HTML and JSON column functions: code blocks, section lists, chat payloads
and replies. Native expressions only; nested markup that regular
expressions cannot follow is documented per function."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import clean_model_output, let, strip_code_fences, strip_ws

# The prompt wording and the system instruction of the
# generation step.
PROMPT_SUFFIX = "\n\nWrite a single self-contained C program that solves this. Output ONLY C code."
SYSTEM_PROMPT = (
    "You are an expert C programmer. "
    "You receive algorithmic problem statements. "
    "You MUST respond with ONLY valid C source code for a single .c file. "
    "No markdown fences, your output must compile as is. "
    "Include a main() function that demonstrates or solves the problem."
)
TEMPERATURE = 0.2
MAX_TOKENS = -1

SECTIONS_SCHEMA = "struct<parse:struct<sections:array<struct<line:string,index:string>>>>"
TEXT_SCHEMA = "struct<parse:struct<text:map<string,string>>>"


ENTITY_RE = r"&(?:#[0-9]{1,10}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]*);"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def html_unescape(text) -> Column:
    """Character references, decoded once: numeric ones (decimal and
    hexadecimal) and the named ones of HTML 4 (the standard library's table).
    Unknown names and numbers that are no character stay as they are."""
    names = F.create_map(*[F.lit(x) for n, c in sorted(name2codepoint.items()) for x in (n, chr(c))])

    def decoded(ref: Column) -> Column:
        name = F.substring(ref, 2, F.length(ref) - 2)
        number = F.when(F.lower(name).startswith("#x"), F.conv(F.substring(name, 3, 12), 16, 10)).when(
            name.startswith("#"), F.substring(name, 2, 12)).try_cast("long")
        good = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.coalesce(F.when(good, char), F.try_element_at(names, name), ref)

    def all_of(t: Column) -> Column:
        parts, refs = F.split(t, ENTITY_RE, -1), F.regexp_extract_all(t, F.lit(ENTITY_RE), F.lit(0))
        return F.array_join(F.zip_with(parts, refs, lambda p, r: F.concat(p, F.coalesce(decoded(r), F.lit("")))), "")

    return let(_c(text), lambda t: F.when(F.instr(t, "&") > 0, all_of(t)).otherwise(t))


def strip_tags(html) -> Column:
    return F.regexp_replace(_c(html), r"<[^>]*>", "")


def element_text(html, tag: str) -> Column:
    """Text of the first ``<tag …>…</tag>`` (tags inside removed, entities
    decoded); NULL when there is none."""
    inner = F.regexp_extract(_c(html), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    found = F.regexp_like(_c(html), F.lit(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>"))
    return F.when(found, html_unescape(strip_tags(inner)))


def first_code_block(html) -> Column:
    """First ``<pre>`` text if non-empty, else first ``<code>`` text if
    non-empty, else NULL."""
    return let(_c(html), lambda h: F.coalesce(F.nullif(element_text(h, "pre"), F.lit("")),
                                             F.nullif(element_text(h, "code"), F.lit(""))))


def section_lines(json) -> Column:
    return F.from_json(_c(json), SECTIONS_SCHEMA)["parse"]["sections"]


def pick_section(json, letter: str = "c", strict: bool = False) -> Column:
    """See :func:`section_hit`; its ``index`` alone."""
    return section_hit(json, letter, strict)["index"]


def section_hit(json, letter: str = "c", strict: bool = False) -> Column:
    """The section ``(line, index)``: raw index of the first section whose stripped, lower-cased line starts
    with ``letter`` but not ``letter++``. ``strict=True`` also requires the
    letter to stand alone (end, whitespace or a dash after it). Returns the
    index as text (NULL when no line qualifies); cast it with ``try_cast``."""
    def ok(s):
        line = F.lower(strip_ws(F.coalesce(s["line"], F.lit(""))))
        cond = line.startswith(letter) & ~line.startswith(letter + "++")
        if strict:
            cond = cond & F.regexp_like(line, F.lit(rf"^{letter}(\s|$|[–-])"))
        return cond
    return F.try_element_at(F.filter(section_lines(json), ok), F.lit(1))


def section_html(json) -> Column:
    """``parse.text['*']`` of a section response."""
    return F.from_json(_c(json), TEXT_SCHEMA)["parse"]["text"]["*"]


def build_prompt(number, statement) -> Column:
    return F.concat(F.lit("Problem "), _c(number).cast("string"), F.lit(":\n"), _c(statement), F.lit(PROMPT_SUFFIX))


def chat_payload(prompt, model: str, system: str = SYSTEM_PROMPT, temperature: float = TEMPERATURE,
                 max_tokens: int = MAX_TOKENS) -> Column:
    """Chat-completion request body as JSON text."""
    msg = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    body = F.struct(
        F.lit(model).alias("model"),
        F.array(msg("system", F.lit(system)), msg("user", _c(prompt))).alias("messages"),
        F.lit(float(temperature)).alias("temperature"),
        F.lit(int(max_tokens)).alias("max_tokens"),
        F.lit(False).alias("stream"),
    )
    return F.to_json(body)


def reply_text(response) -> Column:
    """``choices[0].message.content`` of a chat response, falling back to the
    raw text when it is not such a JSON document."""
    return let(_c(response), lambda r: F.coalesce(F.get_json_object(r, "$.choices[0].message.content"), r))


def reply_to_code(response) -> Column:
    """Reply -> code: content, fences stripped, cut to the first include /
    ``int main``, leading whitespace dropped."""
    return clean_model_output(strip_code_fences(reply_text(response)))
