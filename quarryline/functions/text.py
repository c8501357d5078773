"""Texts, code tokens and extents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The lexical classes of C++ as one pattern, in order of precedence.
CODE_TOKEN = (
    r'(?s)<(?:VAR|LIT)_\d+>|(?:u8|u|U|L)?R"[^\s(]{0,16}\(.*?\)[^\s"]{0,16}"'
    r'|(?:u8|u|U|L)?"[^"\\]*(?:\\.[^"\\]*)*"' r"|(?:u8|u|U|L)?'[^'\\]*(?:\\.[^'\\]*)*'"
    r"|//[^\n]*|/\*.*?\*/|[A-Za-z_$][A-Za-z0-9_$]*|0[xX][0-9A-Fa-f']+|0[bB][01']+|\d[\d']*(?:\.\d[\d']*)?(?:[eEpP][+-]?\d[\d']*)?[uUlLfFzZ]*"
    r"|<=>|>>=|<<=|->\*|\.\*|::|->|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|##|\.\.\.|[^\s]"
)
#: A string or character literal, which is kept, or a comment.
COMMENT = r"""(?s)((?:R"[^\s(]{0,16}\(.*?\)[^\s"]{0,16}"|"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'))|/\*.*?\*/|//[^\n]*"""
#: Names that a parenthesis follows without a call.
NO_CALLS = "if for while switch catch return sizeof alignof decltype static_cast dynamic_cast const_cast reinterpret_cast noexcept static_assert alignas defined".split()
CJK = "[一-鿿]"


def fold(text: Column) -> Column:
    """White space folded to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def without_comments(code: Column) -> Column:
    """Code without comments and without runs of blank lines."""
    return F.regexp_replace(stripped(code), r"\n\s*\n+", "\n")


def stripped(code: Column) -> Column:
    """Code without comments; what looks like one inside a literal stays."""
    return F.regexp_replace(code, COMMENT, "$1")


def code_tokens(code: Column) -> Column:
    """Tokens of a C++ text in order, comments dropped; null for null."""
    found = F.regexp_extract_all(code, F.lit(CODE_TOKEN), 0)
    return F.filter(found, lambda t: ~(t.startswith("//") | t.startswith("/*")))


def is_literal(token: Column) -> Column:
    """Numbers, strings and characters with any prefix, and literal blanks."""
    return token.rlike(r"""^(?:<LIT_|\d|(?:u8|u|U|L)?R?"|(?:u8|u|U|L)?')""")


def declared_calls(code: Column) -> Column:
    """Names that a parenthesis follows, as often as they occur."""
    return F.regexp_extract_all(code, F.lit(r"\b([A-Za-z_][A-Za-z0-9_:]*)\s*\("), 1)


def call_targets(code: Column) -> Column:
    """Distinct names that a call or definition parenthesis follows, in order of appearance."""
    return F.array_except(declared_calls(code), F.array(*map(F.lit, NO_CALLS)))


def approximate_tokens(text: Column) -> Column:
    """Tokens a text may take: CJK characters over 1.5 plus the others over 4, rounded down; 0 for null."""
    cjk = F.length(text) - F.length(F.regexp_replace(text, CJK, ""))
    return F.coalesce(F.floor(cjk / F.lit(1.5) + (F.length(text) - cjk) / F.lit(4.0)).cast("int"), F.lit(0))


def sanitised_template(code: Column) -> Column:
    """A template that a parser can read: variables become names, literals zero."""
    return F.regexp_replace(F.regexp_replace(code, r"<VAR_(\d+)>", "var_$1"), r"<LIT_\d+>", "0")


def extent(text: Column) -> Column:
    """``sl-sc-el-ec`` as a struct of four ints; null where the text has another form."""
    parts = F.split(text, "-")
    fields = [F.get(parts, F.lit(i)).cast("int").alias(n) for i, n in enumerate(("sl", "sc", "el", "ec"))]
    return F.when(text.rlike(r"^\d+-\d+-\d+-\d+$"), F.struct(*fields))


def within(inner: Column, outer: Column) -> Column:
    """Whether one parsed extent lies inside another; null if either is null."""
    start = F.struct(outer["sl"], outer["sc"]) <= F.struct(inner["sl"], inner["sc"])
    return F.when(inner.isNotNull() & outer.isNotNull(), start & (F.struct(inner["el"], inner["ec"]) <= F.struct(outer["el"], outer["ec"])))


def source_lines(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last`` of a text, counted from one."""
    return F.array_join(F.slice(F.split(text, "\n"), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def without_directives(code: Column) -> Column:
    """Code whose preprocessor lines, continued ones too, are blanks of the same length."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(False).alias("open"))

    def step(state: Column, line: Column) -> Column:
        masked = state["open"] | line.rlike(r"^\s*#")
        shown = F.when(masked, F.regexp_replace(line, r"[^\r]", " ")).otherwise(line)
        return F.struct(F.concat(state["done"], F.array(shown)).alias("done"), (masked & line.rlike(r"\\\r?$")).alias("open"))

    return F.aggregate(F.split(code, "\n"), start, step, lambda state: F.array_join(state["done"], "\n"))


def decoded(data: Column) -> Column:
    """Text of raw bytes: UTF-16 where a byte order mark says so, else UTF-8, else Latin-1; null for null."""
    mark = F.hex(F.substring(data, 1, 2))
    utf8 = data.cast("string")
    return (
        F.when(mark == "FFFE", F.decode(F.substring(data, 3, 1 << 30), "UTF-16LE"))
        .when(mark == "FEFF", F.decode(F.substring(data, 3, 1 << 30), "UTF-16BE"))
        .when(F.is_valid_utf8(utf8), utf8)
        .otherwise(F.decode(data, "ISO-8859-1"))
    )


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The part of a text between two places counted in UTF-8 bytes; null if either is null."""
    return F.substring(F.encode(text, "UTF-8"), start.cast("int") + 1, F.greatest(end - start, F.lit(0)).cast("int")).cast("string")


def replaced(text: Column, ranges: Column) -> Column:
    """A text with byte ranges replaced: ``ranges`` are structs with ``start``, ``end`` and ``new``, and don't overlap.

    They are taken from the right, so that earlier places stay what they are.
    """
    whole = F.encode(text, "UTF-8")
    right = F.reverse(F.array_sort(F.transform(ranges, lambda r: F.struct(r["start"].cast("int").alias("s"), r["end"].cast("int").alias("e"), r["new"].alias("new")))))
    step = lambda b, r: F.concat(F.substring(b, F.lit(1), r["s"]), F.encode(r["new"], "UTF-8"), F.substring(b, r["e"] + 1, F.lit(1 << 30)))
    return F.aggregate(right, whole, step).cast("string")


def json_safe(values: Column) -> Column:
    """Numbers of an array that JSON can hold; the others become null."""
    return F.transform(values, lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x))
