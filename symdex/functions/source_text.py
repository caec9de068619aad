"""Column helpers for reading source text without a parser.

*Folding*: string literals and comments are kept in place, but every
character inside them that matters to structure (newline, brackets, quotes,
``#``, ``@`` ...) is mapped to a private-use character with ``translate``.  A
multi-line docstring or JSDoc block therefore becomes part of one physical
line, and no regex over the folded text can be fooled by code-like text in a
string.  ``unfold`` maps the characters back, so the original literal is
recovered exactly.  Folding is one ``split`` plus one ``regexp_extract_all``
over the file row: linear, in place, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from symdex.functions.columns import js_trim, let

# Characters hidden inside literals and comments, and their stand-ins
# (private-use code points U+E000..).  Both strings have the same length.
FOLD_FROM = "\n\r()[]{}#:@,;='\"`/*\\<>"
FOLD_TO = "".join(chr(0xE000 + i) for i in range(len(FOLD_FROM)))

NAME = r"[\p{L}_$][\p{L}\p{N}_$]*"
PY_NAME = r"[\p{L}_][\p{L}\p{N}_]*"

# Python tokens: prefixed string literals (triple first) and comments.
# The first look-ahead only rules out, at one glance, places where no token can start.
PY_TOKEN = (
    r"(?=[rRbBuUfF\"'#])(?:"
    r"(?<![\p{L}\p{N}_])[rRbBuUfF]{0,2}(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''"
    r"|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+')|#[^\n]*+)"
)
# TS/JS tokens.  A comment that starts its line takes the whitespace after it
# along (folded), so a JSDoc block lands on the line of the declaration below
# it; a comment after code keeps its newline.  Then string/template literals,
# and regex literals: a slash where an expression starts, that is after an
# operator, an opening bracket, an arrow or one of a few keywords (after a name,
# a number or a closing bracket it divides; after < or > it may close a tag).
# A token starts at a quote or at white space before a slash; looking for these
# first spares all other places the look-behind.
_BEFORE_REGEX = (
    r"(?<=[(,=:\[!&|?{;+*%~^-]|=>|(?<![\p{L}\p{N}_$.])(?:return|typeof|case|in|of|delete|void|throw|instanceof|yield|await|do|else))"
)
TS_TOKEN = (
    r"(?m)(?=[\"'`]|[ \t\r\n]*+/)(?:^[ \t]*+/\*[\s\S]*?\*/[ \t\r\n]*|^[ \t]*+//[^\n]*+[ \t\r\n]*"
    r"|/\*[\s\S]*?\*/|//[^\n]*+"
    r"|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
    r"|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
    r"|" + _BEFORE_REGEX + r"[ \t\r\n]*+/(?![*/])(?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*+\])++/[\p{L}\p{N}_$]*+)"
)
_PREFIX = r"^([ \t]*(?:/\*\*?|//)|[rRbBuUfF]{0,2}(?:\"\"\"|'''|\"|')|`|#|[ \t\r\n]*/)"


def _fold_token(m: Column) -> Column:
    """Fold one token: keep its delimiters, hide the inside (and a comment's trailing whitespace)."""
    prefix = F.regexp_extract(m, _PREFIX, 1)
    is_block = m.rlike(r"^[ \t]*/\*")
    is_line = m.rlike(r"^[ \t]*//")
    is_hash = m.startswith("#")
    ws = F.regexp_extract(m, r"([ \t\r\n]*)$", 1)
    closing = F.regexp_extract(m, r"(\"\"\"|'''|\"|'|`|/[\p{L}\p{N}_$]*)$", 1)
    raw_tail = (F.when(is_block, F.concat(F.lit("*/"), ws)).when(is_line, ws)
                .when(is_hash, F.lit("")).otherwise(closing))
    inner = F.substring(m, F.length(prefix) + 1, F.length(m) - F.length(prefix) - F.length(raw_tail))
    tail = (F.when(is_block, F.concat(F.lit("*/"), F.translate(ws, FOLD_FROM, FOLD_TO)))
            .when(is_line, F.translate(ws, FOLD_FROM, FOLD_TO))
            .when(is_hash, F.lit("")).otherwise(closing))
    return F.concat(prefix, F.translate(inner, FOLD_FROM, FOLD_TO), tail)


def fold(content: Column, token_re: str) -> Column:
    """Content with every literal / comment folded (same length, same order)."""
    return _tokens_replaced(content, token_re, _fold_token)


def unfold(text: Column) -> Column:
    return F.translate(text, FOLD_TO, FOLD_FROM)


def clean_docstring(text: Column) -> Column:
    """Strip the quote run, dedent lines 2.. by their minimum indent, trim."""
    def with_text(s2):
        def with_lines(lines):
            rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
            indents = F.transform(F.filter(rest, lambda l: js_trim(l) != ""),
                                  lambda l: F.length(F.regexp_extract(l, r"^[\s\u00A0\uFEFF]*", 0)))
            return let(F.array_min(indents), lambda m: F.when(F.size(lines) <= 1, js_trim(s2)).otherwise(js_trim(
                F.array_join(F.transform(lines, lambda l, i: F.when(
                    (i > 0) & m.isNotNull() & (F.length(l) >= m), F.substring(l, m + 1, 1 << 30)).otherwise(l)), "\n"))))
        return let(F.split(s2, "\n", -1), with_lines)
    stripped = F.regexp_replace(F.regexp_replace(text, r"^['\"]['\"]['\"]|['\"]['\"]['\"]$", ""), r"^['\"]|['\"]$", "")
    return F.when(text.isNotNull(), let(stripped, with_text))


def jsdoc_description(block: Column) -> Column:
    """Text of a ``/** ... */`` block before its first tag, margin stripped, trimmed."""
    body = F.regexp_replace(F.regexp_replace(block, r"^/\*\*", ""), r"\*/[\s]*$", "")

    def with_lines(lines):
        first_tag = F.array_position(F.transform(lines, lambda l: l.rlike(r"^\s*@")), True)
        kept = F.when(first_tag > 0, F.slice(lines, 1, first_tag - 1)).otherwise(lines)
        return js_trim(F.array_join(kept, "\n"))
    return let(F.transform(F.split(body, "\n", -1), lambda l: F.regexp_replace(l, r"^[ \t]*\*? ?", "")), with_lines)


def jsdoc_return_type(block: Column) -> Column:
    """The ``{type}`` of an ``@returns`` / ``@return`` tag, null when absent."""
    t = F.regexp_extract(block, r"@returns?\s*\{([^}]*)\}", 1)
    return F.when(t != "", t)


#: Arrows are no brackets; every other token is a bracket, a comma or a run of anything else.
_LIST_TOKEN = r"=>|->|[\[\](){}<>,]|[^\[\](){}<>,=\-]+|[=\-]"


def split_top_level(text: Column) -> Column:
    """Split at the commas outside all brackets: the depth is counted over the tokens, however deep they nest."""
    state = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("parts"))

    def step(s, t):
        cut = (t == ",") & (s["depth"] == 0)
        opens, closes = t.isin("(", "[", "{", "<"), t.isin(")", "]", "}", ">")
        depth = F.when(opens, s["depth"] + 1).when(closes, F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        return F.struct(
            depth.alias("depth"),
            F.when(cut, F.lit("")).otherwise(F.concat(s["part"], t)).alias("part"),
            F.when(cut, F.concat(s["parts"], F.array(s["part"]))).otherwise(s["parts"]).alias("parts"),
        )

    tokens = F.regexp_extract_all(text, F.lit(_LIST_TOKEN), 0)
    return F.aggregate(tokens, state, step, lambda s: F.concat(s["parts"], F.array(s["part"])))


#: Levels that the patterns match by themselves; ``shallow`` brings any text down to them.
LEVELS = 8


def nested(opening: str, closing: str, atom: str) -> str:
    """Regex of text whose brackets balance, for texts of ``LEVELS`` levels at most (see :func:`shallow`)."""
    inner = f"(?:{atom})*+"
    for _ in range(LEVELS):
        inner = f"(?:(?:{atom})++|{opening}{inner}{closing})*+"
    return inner


#: Brackets of a text are counted in runs of so many, so that no intermediate string grows with the text.
_RUN = 256
ROUND, CURLY, ANGLE = ("(", ")", r"(?=[()])"), ("{", "}", r"(?=[{}])"), ("<", ">", r"(?=<|(?<!=)>)")


def _shallow_kind(text: Column, opening: str, closing: str, cut: str) -> Column:
    """Brackets of one kind below ``LEVELS // 2`` levels as their folded stand-ins: a running depth over the bracket tokens."""
    hidden = {c: FOLD_TO[FOLD_FROM.index(c)] for c in (opening, closing)}

    def change(token: Column) -> Column:
        return F.when(token.startswith(opening), F.lit(1)).when(token.startswith(closing), F.lit(-1)).otherwise(F.lit(0))

    def run(tokens: Column, depth: Column) -> Column:
        def step(s, t):
            d = change(t)
            # an opening bracket stands at the depth it leads to, a closing one at the depth it leaves
            own = s["depth"] + F.greatest(d, F.lit(0))
            bracket = F.when((d != 0) & (own > LEVELS // 2), F.translate(F.substring(t, 1, 1), opening + closing, hidden[opening] + hidden[closing])).otherwise(F.substring(t, 1, 1))
            return F.struct((s["depth"] + d).alias("depth"), F.concat(s["out"], bracket, F.substring(t, 2, 1 << 30)).alias("out"))
        return F.aggregate(tokens, F.struct(depth.alias("depth"), F.lit("").alias("out")), step, lambda s: s["out"])

    def with_runs(runs):
        nets = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, t: a + change(t)))
        # the depth each run starts at
        starts = F.aggregate(nets, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.try_element_at(a, F.lit(-1)) + n)))
        return F.array_join(F.zip_with(runs, F.slice(starts, 1, F.size(runs)), run), "")

    tokens = F.split(text, cut, -1)
    return let(tokens, lambda ts: let(F.transform(F.sequence(F.lit(0), F.ceil(F.size(ts) / _RUN).cast("int") - 1), lambda i: F.slice(ts, i * _RUN + 1, _RUN)), with_runs))


def shallow(text: Column, *kinds) -> Column:
    """Folded text with at most ``LEVELS`` levels of brackets: those further in become stand-ins, which ``unfold`` maps back.

    Brackets are matched by depth over the token stream, however deep they nest; what lies inside hidden
    ones still lies inside the ones that stay, so lists split and headers end at the same places.
    """
    for opening, closing, cut in kinds or (ROUND, CURLY, ANGLE):
        text = _shallow_once(text, opening, closing, cut)
    return text


def _shallow_once(text: Column, opening: str, closing: str, cut: str) -> Column:
    # as many levels need as many brackets
    def body(t):
        return F.when(F.length(t) - F.length(F.replace(t, F.lit(opening), F.lit(""))) > LEVELS, _shallow_kind(t, opening, closing, cut)).otherwise(t)
    return let(text, body)


def matching(text: Column, fits, *kinds) -> Column:
    """``text`` where the pattern test ``fits`` holds for it as it is, else its :func:`shallow` form."""
    return let(text, lambda t: F.when(fits(t), t).otherwise(shallow(t, *kinds)))


BLANK = ""


def mask(content: Column, token_re: str) -> Column:
    """Content with the inside of every literal / comment blanked (whitespace kept).

    Same length and same line breaks as the input, so line and column
    positions carry over; no identifier can be found inside a string or a
    comment of the masked text.  The code of a template's ``${...}`` stays,
    its own literals blanked (not where it holds braces in braces or a template).
    """
    def blank(t):
        return F.regexp_replace(t, r"\S", BLANK)

    def blank_template(t):
        text, code = F.split(t, _TEMPLATE_CODE, -1), F.regexp_extract_all(t, F.lit(_TEMPLATE_CODE), 0)
        return _rejoined(F.transform(text, blank), F.transform(code, lambda c: _tokens_replaced(c, _QUOTED, blank)))

    return _tokens_replaced(content, token_re, lambda t: F.when(t.startswith("`") & t.contains("${"), blank_template(t)).otherwise(blank(t)))


_QUOTED = r"\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_TEMPLATE_CODE = r"(?<!\\)\$\{[^{}`]*+(?:\{[^{}`]*+\}[^{}`]*+)*+\}"


def _rejoined(gaps: Column, tokens: Column) -> Column:
    """The gaps around some tokens and these, in turn."""
    return let(F.struct(gaps.alias("gaps"), tokens.alias("tokens")), lambda v: _joined(v["gaps"], v["tokens"]))


def _joined(gaps: Column, tokens: Column) -> Column:
    return F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(tokens)), tokens, lambda a, b: F.concat(a, b)), ""),
                    F.try_element_at(gaps, F.lit(-1)))


def _tokens_replaced(content: Column, token_re: str, replace: Callable[[Column], Column]) -> Column:
    """Every token of the content replaced: it is searched once for the tokens and once for the gaps."""
    def body(c):
        found = F.struct(F.split(c, token_re, -1).alias("gaps"), F.regexp_extract_all(c, F.lit(token_re), 0).alias("tokens"))
        return let(found, lambda v: _joined(v["gaps"], F.transform(v["tokens"], replace)))
    return let(content, body)
