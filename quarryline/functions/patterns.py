"""Code as templates: local names and literals become numbered blanks.  All in JVM expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quarryline.functions.text import code_tokens, is_literal

#: Keywords of C++, words that declare the name after them, control words and operators with meaning.
KEYWORDS = (
    "alignas alignof and and_eq asm auto bitand bitor bool break case catch char char8_t char16_t char32_t class compl concept const consteval constexpr constinit const_cast continue "
    "co_await co_return co_yield decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace new "
    "noexcept not not_eq nullptr operator or or_eq private protected public register reinterpret_cast requires return short signed sizeof static static_assert static_cast struct switch "
    "template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while xor xor_eq"
).split()
DECLARING = "class struct enum union namespace typename using typedef new delete sizeof alignof decltype".split()
CONTROL = "break case catch continue co_await co_return delete do else for goto if new return switch throw try while".split()
OPERATORS = "= += -= *= /= %= &= |= ^= <<= >>= == != < > <= >= && || ! + - * / % ++ -- << >> & | ^".split()


def _is_name(token: Column) -> Column:
    return token.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$") & ~token.isin(KEYWORDS)


def _kept(tokens: Column, token: Column, i: Column) -> Column:
    """Whether a name says what the code does: an API, a member, a type, a macro or something declared."""
    at = lambda k: F.coalesce(F.get(tokens, i + k), F.lit(""))
    before, after = at(-1), at(1)
    shape = token.rlike("^[A-Z]") | token.endswith("_") | token.startswith("m_")
    place = before.isin(".", "->", "::", *DECLARING) | after.isin("(", "::") | _is_name(after)
    pointer = after.isin("*", "&", "&&") & (_is_name(at(2)) | _is_name(at(3)) | _is_name(at(4)))
    return shape | place | pointer


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _templated(code: Column) -> Column:
    kind = lambda tokens: lambda t, i: F.when(is_literal(t), "l").when(_is_name(t), F.when(_kept(tokens, t, i), "k").otherwise("v")).otherwise("o")
    number = lambda name, values, t: F.concat(F.lit(f"<{name}_"), F.array_position(values, t).cast("string"), F.lit(">"))

    def fill(tokens: Column, kinds: Column) -> Column:
        pick = lambda k: F.array_distinct(F.filter(tokens, lambda t, i: F.get(kinds, i) == k))
        names = lambda found, literals: lambda t, i: F.when(F.get(kinds, i) == "v", number("VAR", found, t)).when(F.get(kinds, i) == "l", number("LIT", literals, t)).otherwise(t)
        template = _let(pick("v"), lambda found: _let(pick("l"), lambda literals: F.transform(tokens, names(found, literals))))
        return F.struct(tokens.alias("tokens"), template.alias("template"), pick("k").alias("anchors"))

    return _let(code_tokens(code), lambda tokens: _let(F.transform(tokens, kind(tokens)), lambda kinds: fill(tokens, kinds)))


def with_template(df: DataFrame, code: str) -> DataFrame:
    """Add ``tokens``, ``template`` (tokens with ``<VAR_n>`` and ``<LIT_n>``, numbered by first use) and ``anchors``.

    Anchors are the distinct names kept.  A null code gives null for all three.
    Columns of these names are replaced.  The generator keeps the optimizer from
    copying the expression into whatever reads its result.
    """
    return df.drop("tokens", "template", "anchors").select("*", F.inline(F.array(_templated(F.col(code)))))
