"""A C++ grammar over token classes, parsed bracket by bracket from the inside out.

The lexer turns a text into a string with one character a token: names, macro-like
names, built-in types, keywords by their place in the syntax, literals, operators by
the operands they take.  Each innermost bracket is then parsed and becomes a single
character for what it can be: an empty or filled parenthesis, the header of a loop,
an index, an attribute, and for braces any of statements, declarations and values.
So every rule sees one level of nesting at a time, as a short string, and equal
strings are parsed once.  Unknown macros may stand where a specifier, a statement or
a declaration may.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Words of the language by their place in the syntax.
_WORDS = {
    "t": "int char bool void float double auto unsigned signed long short wchar_t char8_t char16_t char32_t __int64 __int128",
    "s": "const static inline virtual constexpr consteval constinit extern mutable volatile friend explicit register thread_local typedef typename noexcept restrict __restrict __inline __forceinline export",
    "q": "override final",
    "c": "class struct union enum",
    "u": "new delete sizeof co_await co_yield throw alignof typeid not compl",
    "o": "and or xor bitand bitor and_eq or_eq xor_eq not_eq",
    "R": "return co_return",
    "K": "break continue",
    "I": "if", "L": "else", "F": "for", "W": "while", "D": "do", "S": "switch", "C": "case", "d": "default", "G": "goto",
    "Y": "try", "H": "catch", "A": "public private protected", "n": "namespace", "T": "template", "U": "using", "O": "operator", "Q": "requires",
    "v": "this true false nullptr",
}
#: Operators by the operands they take.  A single > may close a template list, so >> is two tokens.
_OPERATORS = {
    "o": "/ % | ^ || == != <= >= += -= *= /= %= &= |= ^= <=> .* ->* << <<= >>=",
    "r": "* & &&",
    "a": "+ -",
    "g": "! ~",
    "m": "++ --",
    "w": ". ->",
    "z": "::",
    "E": "...",
}

_TOKEN = re.compile(
    r"[A-Za-z_]\w*|\.?\d(?:[eEpP][+-]|[\w.])*|\.\.\.|<=>|<<=|>>=|->\*|::|->|\+\+|--|&&|\|\||[-+*/%&|^!=<>]=|<<|\.\*|[^\s\w]"
)
_MACRO = re.compile(r"_*[A-Z][A-Z0-9_]+[a-z]?\d*\Z")


class _Classes(dict):
    """The class of each token met."""

    def __missing__(self, token: str) -> str:
        first = token[0]
        if first.isalpha() or first == "_":
            kind = "M" if _MACRO.match(token) else "i"
        elif first.isdigit() or first == "." and len(token) > 1:
            kind = '"' if token.startswith("0s") else "0"
        else:
            kind = token
        if len(self) < 500_000:
            self[token] = kind
        return kind


_CLASS = _Classes({word: kind for table in (_WORDS, _OPERATORS) for kind, words in table.items() for word in words.split()})
_DIGRAPHS = {"<%": "{", "%>": "}", "<:": "[", ":>": "]"}
_DIGRAPH = re.compile(r"<%|%>|<:(?!:[^:>])|:>")


def token_classes(code: str) -> str:
    """The classes of the tokens of a text without comments, directives and literals."""
    if "<:" in code or "<%" in code:
        code = _DIGRAPH.sub(lambda m: _DIGRAPHS[m.group()], code)
    return "".join(map(_CLASS.__getitem__, _TOKEN.findall(code)))


# --- characters for parsed brackets ---
EMPTY, FILLED, HEADER, COLON = "e", "p", "f", "j"  # (), (..), (..;..;..) or (x : y), other colons
INDEX, ATTRIBUTE = "b", "@"
#: Braces by what they can be: 1 statements, 2 declarations, 4 values.
BRACES = "①②③④⑤⑥⑦"
_B = "[" + BRACES + "]"
_STATEMENTS = "[" + "".join(b for i, b in enumerate(BRACES, 1) if i & 1) + "]"
_VALUES = frozenset(b for i, b in enumerate(BRACES, 1) if i & 4)

_INNERMOST = re.compile(r"\(([^(){}\[\]]*)\)|\[([^(){}\[\]]*)\]|\{([^(){}\[\]]*)\}")
#: Names of operator functions, defaulted and deleted functions, qualified names, and lists of template arguments.
_OPERATOR_NAME = re.compile(r"O(?:e(?=[pe])|b|[uU]b?|[org=<>agmw,]{1,3}(?=[pe<])|\"i?)")
_DEFAULTED = re.compile(r"=[du](?=[;,}]|\Z)")
_QUALIFIED = re.compile(r"(?:(?<![iM>])z)?(?:i(?:<[^<>;]*>)?z[gs]?)+(?=[iMO])|(?<![iM>])z(?=i)")
_ANGLES = re.compile(r"(?<=[TiMszgO])<((?:[^<>;?]|<(?:[^<>;?]|<(?:[^<>;?]|<[^<>;?]*>)*>)*>)*)>(?![0v\"])")
#: Two classes that never stand side by side within one level.
_CLASH = re.compile(
    r"[oa?](?:[o=?>:,;]|\Z)|=(?:[o=?>:,;]|\Z)|[wz](?:[o=?:,;<>apev0\"]|\Z)|g(?:[o=?>:,;]|\Z)|,[,:o=?]|0[i0tvuMcs\"]|v[iM0tv\"]|\"(?:[0tvc]|i(?!\"))|(?<![u@])b[i0v\"](?!\"|w)|m[iM]?m(?![iM])|[:?]\?"
    r"|i(?:0|v|u(?!b))|(?<![:,s])A|q[i0](?![pe;=]|" + _B + r")|^[o=?,w:]|t[0v\"]"
)
#: What goes on after a brace only where a class stands before it.
_BAD_AFTER_BRACE = re.compile(_B + r"[its0vMu\"]")
_CONTROL = re.compile(r"[IFLWSDCYHK]")
_LINKAGE = re.compile(r"\As\"")
_RUN = re.compile(r"[itMsqc]{3,}")


def _long_run(run: str, after: str) -> bool:
    """Whether a run of names is none that a declaration could begin with."""
    plain = "".join(c for c in run if c in "it")
    called = after in ("p", "e")
    last = plain.rfind("t")
    tail = len(plain) - last - 1
    if last < 0:
        return tail > (3 if called else 2)
    return tail > (2 if called else 1) or plain[:last].count("i") > 1


@lru_cache(1 << 18)
def simple(text: str, declared: bool = False) -> bool:
    """Whether one level of tokens up to a semicolon is an expression or a declaration without a body."""
    if not text:
        return True
    if text == "K" or text in ("R", "u", "Gi", "GM"):
        return True
    text = text.replace(ATTRIBUTE, "")
    text = _DEFAULTED.sub("=0", _OPERATOR_NAME.sub("i", text))
    if text[:1] == "R":
        text = text[1:]
    if "R" in text:
        return False
    text = _LINKAGE.sub("s", text)
    if text[:1] == "U":
        return _CONTROL.search(text) is None
    for _ in range(3):
        shorter = _ANGLES.sub("", text)
        if shorter == text:
            break
        text = shorter
    text = _QUALIFIED.sub("", text)
    if _CONTROL.search(text) or "n" in text and not text.startswith("n") or HEADER in text or "d" in text:
        return False
    if COLON in text and not text.startswith(("i", "s")):
        return False
    if _CLASH.search(text):
        return False
    if ":" in text and not ("?" in text and text.count(":") <= text.count("?")) and "c" not in text and not declared and not re.search(r":[0iMz]", text):
        return False
    if "c" not in text and _BAD_AFTER_BRACE.search(text) or not declared and not _braces_fit(text):
        return False
    for run in _RUN.finditer(text):
        if _long_run(run.group(), text[run.end() : run.end() + 1]):
            return False
    return True


def _braces_fit(text: str) -> bool:
    for i, token in enumerate(text):
        if token in BRACES and token not in _VALUES:
            before = text[:i]
            # bodies within an expression: lambdas, local classes, requirements and macros with a block
            if not ("b" in before or "c" in before or "Q" in before or before[-1:] in ("p", "e", "Q", "q", "s") or before == "v"):
                return False
    return True


#: What comes before a plain statement: conditions, loops, labels, blocks, handlers and macros with a block.
_PREFIX = re.compile(
    rf"(?:@|I[sMgi]*p|L|FM?[fj]|Wp|[iM]f|Sp|D|Y(?={_B})|H[pe](?={_B})|[iM]@?:(?!:)|C[^:;]+:|d:|A[iM]?:|(?:[iM]z)*[iM][pe]?{_STATEMENTS}(?![,.)])|{_STATEMENTS}(?!w))*"
)


@lru_cache(1 << 18)
def statement(piece: str, last: bool) -> bool:
    """Whether the tokens between two semicolons are whole statements and, unless ``last``, one more up to the semicolon."""
    piece = piece.replace(ATTRIBUTE, "")
    at = _PREFIX.match(piece).end()
    rest = piece[at:]
    if last:
        # what follows the last semicolon ends in a block, or is a macro alone
        return (not at or piece[at - 1] in BRACES or piece[at - 1] == ":") if not rest else re.fullmatch(r"(?:M[pe]?|i[pe])+", rest) is not None or _declaration_end(rest)
    return simple(rest) or simple(rest, True) and rest[:1] in "csTnUM"


def _declaration_end(rest: str) -> bool:
    return bool(re.fullmatch(rf"[^;=]*c[^;=]*{_B}", rest)) and simple(rest)


@lru_cache(1 << 17)
def statements(text: str) -> bool:
    pieces = text.split(";")
    # every loop that tests at its end has its test
    return text.count("D") <= text.count("W") and all(statement(p, False) for p in pieces[:-1]) and statement(pieces[-1], True)


_ACCESS = re.compile(r"(?:(?:M[pe]?)*A[iM]?|[iM]):(?!:)")
#: The end of a function's head: its parameters, qualifiers, a trailing type.
_FUNCTION = re.compile(r"[pe][sqzrMiwj<>E,t@bpeQo0v]*\Z")
_TEMPLATE = re.compile(r"T(?:<((?:[^<>]|<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>)*)>)?")
#: A class whose semicolon is missing before the next declaration.
_MISSING_END = re.compile(rf"c[^=]*{_B}[itsMcT]")
_LOOSE = re.compile(r"(?:M[pe]?|i[pe])+")


@lru_cache(1 << 17)
def _ends(head: str, brace: str) -> bool | None:
    """Whether a declaration with this head ends with the brace; None if no head takes such a brace."""
    kind = BRACES.index(brace) + 1
    head = _TEMPLATE.sub("", _OPERATOR_NAME.sub("i", head.replace(ATTRIBUTE, "")))
    if re.fullmatch(r"s*n(?:s?iz?)*M*|s*\"|s*n?M*", head):
        return True if kind & 2 else None
    if re.fullmatch("H[pe]", head):
        return True if kind & 1 else None
    if "=" in head or head[-1:] in (",", ":"):
        return False
    colon = re.search(r"(?<=[pesqM])Y?:", head)
    if colon and "c" not in head[: colon.start()]:
        # members to initialise go on; the body follows a closed initialiser
        ended = head[-1] in "peYE" or head[-1] in BRACES
        return (True if kind & 1 else None) if ended else False
    if head.endswith("Y"):
        return True if kind & 1 else None
    if head.endswith(tuple(BRACES)):
        return None
    body = _FUNCTION.search(head)
    if "c" in head:
        tail = head.rsplit("c", 1)[1]
        if not (body and re.search(r"[pe][sq]*\Z", head) and not re.fullmatch(r"(?:[iM]p)?", tail)):
            return False if kind & 6 else None
    if _MISSING_END.search(head):
        return None
    if body:
        return (True if kind & 1 else None) if _sound_head(head) else None
    return False if kind & 4 else None


@lru_cache(1 << 17)
def _sound_head(head: str) -> bool:
    return simple(head, True)


@lru_cache(1 << 17)
def declaration(piece: str, last: bool) -> bool:
    """Whether the tokens between two semicolons are whole declarations and, unless ``last``, one more up to the semicolon."""
    piece = piece.replace(ATTRIBUTE, "")
    start = 0
    for at, token in enumerate(piece):
        if token in BRACES:
            while found := _ACCESS.match(piece, start):
                start = found.end()
            ended = _ends(piece[start:at], token)
            if ended is None:
                return False
            if ended:
                start = at + 1
    rest = piece[start:]
    while found := _ACCESS.match(rest):
        rest = rest[found.end() :]
    if last:
        return not rest or _LOOSE.fullmatch(rest) is not None
    rest = _TEMPLATE.sub("", rest)
    return simple(rest, True)


@lru_cache(1 << 16)
def declarations(text: str) -> bool:
    pieces = text.split(";")
    return all(declaration(p, False) for p in pieces[:-1]) and declaration(pieces[-1], True)


@lru_cache(1 << 18)
def values(text: str) -> bool:
    """A list of values or enumerators, the last comma allowed."""
    if ";" in text:
        return False
    text = text.removesuffix(",")
    # designators, and macros that stand for several rows
    text = re.sub(r"(?:^|(?<=,))(?:wi|b)(?==)", "i", text)
    text = re.sub(rf"(?:^|(?<=,))wi(?={_B})", "", text)
    text = re.sub(r"(?:^|(?<=,))((?:Mp?)+)(?=[M\"0i" + BRACES + r"])", "", text)
    return simple(text)


@lru_cache(1 << 18)
def parenthesis(text: str) -> str | None:
    """What a parenthesis with this content is; None if it is nothing."""
    if not text:
        return EMPTY
    text = text.replace(ATTRIBUTE, "")
    parts = text.split(";")
    if len(parts) == 3:
        return HEADER if all(map(simple, parts)) else None
    if len(parts) == 2:
        if ":" in parts[1] and "?" not in parts[1]:
            return HEADER if simple(parts[0]) and _each(parts[1]) else None
        return FILLED if simple(parts[0]) and parts[1] and simple(parts[1]) else None
    if len(parts) > 3:
        return None
    if ":" in text and text.count(":") > text.count("?"):
        return HEADER if _each(text) else COLON if '"' in text or ":" in (text[0], text[-1]) else None
    if text in ("E", "tE", ",E") or re.fullmatch(r"[oa=<>rgm,s]|R?[uIFWSRTc]", text):
        return FILLED
    # a type alone, operators as arguments of a macro, and a fold
    text = re.sub(r"(?:^|(?<=,))[o<>=a](?=,|\Z)", "i", text)
    text = re.sub(r"\A(?:E[oar,])|[oar,]E\Z", "", re.sub(r"E[oar,=<>](?=[iMp0])|(?<=[iMpb])[oar]E", "", text))
    if text.endswith(","):
        return None
    return FILLED if simple(text, True) or _generic(text) else None


def _generic(text: str) -> bool:
    """Arguments that are blocks, returns or classes: macros take any of them."""
    parts = text.split(",")
    return all(p and (p in BRACES or p in "Rdqsnc" or p[0] in "Rcu" and simple(p[1:], True) or simple(p, True)) for p in parts)


@lru_cache(1 << 16)
def _each(text: str) -> bool:
    item, _, source = text.partition(":")
    return bool(item and source) and simple(item) and simple(source)


#: Captures of a lambda.
_CAPTURES = re.compile(r"(?:(?:[=r]|r?v|r?(?:iE?|Ei)(?:=[^,]+)?|i?=.+|[iM][pe]?E?)(?:,(?!\Z)|\Z))*")


@lru_cache(1 << 16)
def index(text: str) -> str | None:
    """A subscript, the bounds of an array, captures, or the inside of an attribute."""
    if not text or text == INDEX:
        return ATTRIBUTE if text else INDEX
    if ";" in text:
        return None
    if _CAPTURES.fullmatch(text) or simple(text, True) or text.startswith(("U", "i", "M", "@")) and not _CONTROL.search(text):
        return INDEX
    return None


@lru_cache(1 << 18)
def brace(text: str) -> str | None:
    if not text:
        return BRACES[6]
    kind = (1 if statements(text) else 0) | (2 if declarations(text) else 0) | (4 if values(text) else 0)
    return BRACES[kind - 1] if kind else None


def _reduce(match: re.Match) -> str:
    which = match.lastindex
    # a mark that no rule takes stands for a bracket that is nothing
    return (parenthesis, index, brace)[which - 1](match.group(which)) or "!"


def syntax_problem(code: str) -> str | None:
    """What is wrong with a C++ text without comments, directives and literals; None if it parses."""
    text = token_classes(code)
    while True:
        reduced, n = _INNERMOST.subn(_reduce, text)
        if not n:
            break
        text = reduced
        if "!" in text:
            return "expression"
    if any(c in text for c in "(){}[]"):
        return "bracket"
    return None if declarations(text) else "declaration"
