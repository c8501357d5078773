"""Small grammars that tell whether a source text parses, and as which language.

Each grammar is a lexer of one regular expression and a few structural rules.  The
C++ grammar accepts unknown macros, either branch of a conditional, and recent
syntax; it rejects what no compiler could read: open literals, comments and
brackets, foreign characters, merge residue, and declarations that break off.
"""

from __future__ import annotations

import re
from collections.abc import Set

from quarryline.llm.cpp import syntax_problem

# every alternative begins with a fixed character, which keeps the scan fast
_MASKED = re.compile(
    r"""/(?:/(?:\\\n|[^\n])*|\*.*?\*/)|R"(?P<raw>[^()\\\s]{0,16})\(.*?\)(?P=raw)"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])+'""", re.S
)
_SEPARATED = re.compile(r"\b[0-9][0-9a-fA-FxXbB.]*(?:'[0-9a-fA-F]+)+")
_MERGE = re.compile(r"^(?:<{7}(?:[ :].*)?|>{7}(?: .*)?|\|{7}(?: .*)?|={7})[ \t\r]*$", re.M)
_STRAY = re.compile(r"[^\w\s!-~]|[@`$]|\\(?![ \t\r]*\n)")
_DIRECTIVE = re.compile(r"^[ \t]*#(?:\\\r?\n|[^\n])*", re.M)
_DIRECTIVE_WORD = re.compile(r"\s*#\s*(\w*)")
_DISABLED = re.compile(r"^[ \t]*#[ \t]*if[ \t]+(?:0|false)[ \t\r]*$", re.M)
_EDGE = re.compile(r"[(){}\[\]]")
_CLOSES = {"(": ")", "[": "]", "{": "}"}
#: Heads at the left margin that only other languages have.
_FOREIGN = re.compile(
    r"^(?:(?:export\s+)?(?:async\s+)?(?:def|function|fn|func|let|var)\s+\w+\s*[(=:]|(?:package|import)\s+[\w.]+\s*[^\w.;\s]|(?:package|import)\s+[\w.]+\s+[A-Za-z_]|(?:public|private|protected)\s+(?:class|static|final|void|int)\b|from\s+\w+\s+import\b|class\s+\w+\s*\(|class\s+\w+\s+extends\b)", re.M
)


def _mask(match: re.Match) -> str:
    token = match.group()
    if token[0] == "/":
        return " " + "\n" * token.count("\n")
    return "0" if token[-1] != '"' else '0' + "\n" * token.count("\n")


def masked(text: str) -> str:
    """A C++ text with comments as blanks and literals as zeros; lines stay."""
    return _MASKED.sub(_mask, _digits_joined(text))


def _string_mask(match: re.Match) -> str:
    token = match.group()
    return "0s" if token[0] not in "/'" else _mask(match)


def _digits_joined(text: str) -> str:
    return _SEPARATED.sub(lambda m: m.group().replace("'", ""), text) if "'" in text else text


def without_disabled(code: str) -> str:
    """The text without what ``#if 0`` switches off; its directives stay."""
    if not _DISABLED.search(code):
        return code
    kept, at, depth = [], 0, 0
    for match in _DIRECTIVE.finditer(code):
        word = _DIRECTIVE_WORD.match(match.group()).group(1)
        if depth:
            if word in ("if", "ifdef", "ifndef"):
                depth += 1
            elif word == "endif" or depth == 1 and word.startswith("el"):
                depth -= 1
                if not depth:
                    at = match.start()
        elif _DISABLED.match(match.group()):
            kept.append(code[at : match.end()])
            depth, at = 1, len(code)
    return "".join(kept) + "\n" + code[at:]


def branches(text: str, number: int) -> tuple[str, int] | None:
    """The text without directives and with one branch of each conditional, and the most branches after a first one.

    The branch is the one of this number, or the last where there are fewer; None if the directives don't pair.
    """
    kept: list[tuple[str, tuple]] = []
    stack: list[list[int]] = []
    final: dict[int, int] = {}
    serial = 0
    at = 0
    for match in _DIRECTIVE.finditer(text):
        kept.append((text[at : match.start()], tuple(map(tuple, stack))))
        at = match.end()
        word = _DIRECTIVE_WORD.match(match.group()).group(1)
        if word in ("if", "ifdef", "ifndef"):
            serial += 1
            stack.append([serial, 0])
            final[serial] = 0
        elif word.startswith("el"):
            if not stack:
                return None
            stack[-1][1] += 1
            final[stack[-1][0]] = stack[-1][1]
        elif word == "endif":
            if not stack:
                return None
            stack.pop()
    kept.append((text[at:], ()))
    if stack:
        return None
    return "".join(piece for piece, where in kept if all(branch == min(number, final[s]) for s, branch in where)), max(final.values(), default=0)


def cpp_problem(text: str) -> str | None:
    """Why a text isn't C++ that can be parsed; None if it can.

    Each branch of a conditional is parsed with the text around it, all first
    branches together, then all second ones, and so on; what ``#if 0`` switches off isn't read.
    """
    code = without_disabled(_MASKED.sub(_string_mask, _digits_joined(text)))
    if "/*" in code or "*/" in code:
        return "comment"
    if _MERGE.search(code):
        return "merge"
    if "%:" in code:
        code = re.sub(r"^[ \t]*%:", "#", code, flags=re.M)
    plain = _DIRECTIVE.sub("", code) if "#" in code else code
    if '"' in plain or "'" in plain:
        return "literal"
    if "#" in plain or _STRAY.search(plain):
        return "character"
    if _FOREIGN.search(plain):
        return "declaration"
    if "#" not in code:
        return syntax_problem(code)
    number = most = 0
    while number <= most:
        chosen = branches(code, number)
        if chosen is None:
            return "conditional"
        most = chosen[1]
        problem = syntax_problem(chosen[0])
        if problem:
            return problem
        number += 1
    return None


def balanced(code: str) -> bool:
    """Whether the brackets of a masked text pair."""
    stack: list[str] = []
    for token in _EDGE.findall(code):
        if token in _CLOSES:
            stack.append(_CLOSES[token])
        elif not stack or stack.pop() != token:
            return False
    return not stack


# --- other languages: a ranking by telling tokens, then a grammar for each ---

_PYTHON_LINE = re.compile(r"\s*(?:(?:def|class|if|elif|for|while|with|try|except|else|finally)\b.*:|(?:import|from|return|pass|raise|yield|break|continue)\b.*|@\w[\w.]*.*|#.*|\"\"\".*|[\w.\[\], ()'\"]+\s*[-+*/|&]?=\s*.+|[\w.]+\(.*\)|[\])}].*)\s*")
_SHELL_LINE = re.compile(r"\s*(?:#.*|set\s.*|export\s.*|(?:if|elif|for|while|until)\b.*(?:then|do)?(?:;.*)?|then|else|fi|do|done|esac|case\s.*|\w+=\S*|[\w./-]+(?:\s.*)?)\s*")
_MARKUP = re.compile(r"<(!DOCTYPE|/?[a-zA-Z][\w-]*)(?:\s[^<>]*)?/?>")
_SCRIPT = re.compile(r"\b(?:function|const|let|var|=>|require|export|typeof|===)")
_JAVA = re.compile(r"\b(?:package|import|public|private|extends|implements|final)\b")


def language_scores(text: str) -> dict[str, float]:
    """Telling tokens of each language per line."""
    lines = [line for line in text.splitlines() if line.strip()]
    n = max(1, len(lines))
    count = lambda pattern: sum(bool(re.match(pattern, line)) for line in lines) / n
    printable = sum(c.isprintable() or c.isspace() for c in text) / max(1, len(text))
    return {
        "binary": 2.0 if printable < 0.9 else 0.0,
        "python": count(r"\s*(?:def|class)\s+\w+.*:\s*$|\s*(?:import|from)\s+\w[\w. ]*$|\s*self\.|\s*\w[\w., ]* = .*[^;{]$"),
        "shell": count(r"#!.*sh|\s*(?:export|set|fi|done|then)\b|\s*if \[") + 0.5 * count(r".*\$[{(\w]"),
        "markup": count(r"\s*<(?:!DOCTYPE|/?[a-zA-Z][\w-]*)[ >]"),
        "diff": count(r"(?:---|\+\+\+) \S|@@ ") * 2 + 0.5 * count(r"[-+]"),
        "markdown": count(r"#{1,6} |\s*[-*] |```|.*`[^`]+`.*"),
        "json": 1.5 if text.lstrip()[:1] in ("{", "[") and '"' in text and ";" not in text else 0.0,
        "script": len(_SCRIPT.findall(text)) / n,
        "java": 0.7 * len(_JAVA.findall(text)) / n,
    }


def _python(text: str) -> bool:
    """Python's own grammar, and line by line what only older versions read."""
    import ast
    import warnings

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        lines = [line for line in text.splitlines() if line.strip()]
        return all(map(_PYTHON_LINE.fullmatch, lines)) and not any(line.rstrip().endswith((";", "{")) for line in lines)


def _parses(language: str, text: str) -> bool:
    lines = [line for line in text.splitlines() if line.strip()]
    if language == "binary":
        return True
    if language == "python":
        return _python(text)
    if language == "shell":
        return text.lstrip().startswith("#!") or (text.count("then") == sum(line.split("#")[0].split()[-1:] == ["fi"] or "; fi" in line for line in lines) and all(_SHELL_LINE.fullmatch(x) for x in lines))
    if language == "markup":
        return sum(bool(_MARKUP.search(line)) for line in lines) >= 0.8 * len(lines)
    if language == "diff":
        return any(line.startswith("@@ ") for line in lines)
    if language == "markdown":
        return not any(line.rstrip().endswith((";", "{", "}")) for line in lines)
    if language == "json":
        import json

        try:
            json.loads(text)
        except ValueError:
            return False
        return True
    return balanced(masked(text))


# Languages with the brackets of C++, which its structural grammar alone would let pass.
# Each pattern matches a line that C++ wouldn't hold, in a text whose literals are masked.
_TELLING = {
    "script": r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b\s*\*?\s*\w*\s*\(|(?:export\s+)?(?:const|let|var)\s+(?:\w+|\{[\w\s,:]*\}|\[[\w\s,]*\])\s*(?::\s*[\w<>\[\]]+\s*)?=[^=]|.*(?:[!=]==|\)\s*=>|\b\w+\s*=>\s*[{\w(]|\brequire\s*\(\s*0|\bmodule\.exports\b|\btypeof\s+\w|\bconsole\.\w+\()|import\b.*\bfrom\s+0|export\s+(?:default|class|interface|type)\b",
    "rust": r"(?:pub(?:\(\w+\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+\w+\s*[<(]|let\s+(?:mut\s+)?\w+\s*[:=]|let\s+\(|impl\b[^;=(]*\{|(?:pub\s+)?use\s+\w+(?:::|;)|pub\s+(?:struct|enum|mod|trait|type|use)\b|(?:if|while)\s+let\b|match\s+[\w.&()]+\s*\{|.*(?:&mut\s|\b(?:println|vec|format|panic|assert_eq|assert)!\s*[(\[]|\)\s*->\s*(?:[&\w]|\())",
    "csharp": r"using\s+System\b|using\s+[A-Z]\w*(?:\.\w+)*\s*;|namespace\s+\w+(?:\.\w+)+|(?:public|private|protected|internal)\s+(?!slots\b|signals\b)\w+[^:]|foreach\s*\(\s*(?:var|\w+)\s+\w+\s+in\b|.*\{\s*(?:get|set)\s*;|var\s+\w+\s*=[^=]",
    "java": r"import\s+(?:static\s+)?(?:javax?|org|com|net|android)\.[\w.*]+\s*;|package\s+[\w.]+\s*;|(?:public|private|protected)\s+(?!slots\b|signals\b)\w+[^:]|(?:abstract\s+|final\s+)?(?:class|interface)\s+\w+[\w<>, ]*\s(?:extends|implements)\s|.*\)\s*throws\s+\w+|.*\bSystem\.out\.",
    "go": r"package\s+\w+\s*$|func\s*(?:\(\s*\w+\s+\*?\w+\s*\)\s*)?\w+\s*\(|import\s*\($|type\s+\w+\s+(?:struct|interface)\b|.*\w\s*:=\s*|defer\s+\w|go\s+func\b|(?:if|for)\s+[^(;]*\{$",
    "kotlin": r"(?:(?:private|public|internal|override|suspend|inline|open)\s+)*fun\s+(?:<\w+>\s*)?[\w.]+\s*\(|(?:(?:private|override|lateinit|const)\s+)*va[lr]\s+\w+\s*(?::|=|by\b)|(?:data|sealed|open)\s+class\b|when\s*\(?.*\{$",
    "swift": r"(?:(?:private|public|static|override|mutating)\s+)*func\s+\w+\s*[<(]|(?:let|var)\s+\w+\s*[:=]|guard\s+.*\belse\b|if\s+let\b|(?:extension|protocol)\s+\w+",
    "css": r"(?:color|background|margin|padding|border|font|display|position|width|height|max-width|min-width|max-height|min-height|top|left|right|bottom|overflow|opacity|float|cursor|z-index|line-height|text-\w+|flex|align-\w+|justify-\w+|transition|transform|content|box-\w+|(?:background|margin|padding|border|font|flex|grid|list)-[\w-]+)\s*:\s*[^:;{}()]*[^:;{}]*;?\s*\}?$|[\w.#*-][^;{}()=]*\{\s*[a-z-]+\s*:[^:].*\}$|[.#][a-zA-Z][\w-]*[^;{}()=]*\{$",
    "sql": r"(?i:select\s+(?:distinct\s+)?[\w.*(\",\s)]+(?:\bfrom\b|,|$)|insert\s+into\s|update\s+\w+\s+set\b|create\s+(?:or\s+replace\s+|temp\w*\s+|unique\s+)*(?:table|view|index|schema|database)\s|delete\s+from\s|alter\s+table\s|drop\s+(?:table|view|index)\s|from\s+\w+|where\s+\w+|(?:group|order)\s+by\s|(?:left|right|inner|outer|cross)?\s*join\s+\w+|\w+\s+(?:integer|bigint|varchar|text|timestamp)\b(?!\s*[;(=&*]\s*[^\d\s]).*,?$)",
    "proto": r"syntax\s*=\s*0;|message\s+\w+\s*\{|service\s+\w+\s*\{|rpc\s+\w+\s*\(|(?:repeated|optional|required)\s+[\w.]+\s+\w+\s*=\s*\d+|(?:string|bytes|u?int(?:32|64)|bool|double|float)\s+\w+\s*=\s*\d+\s*;|package\s+[\w.]+\s*;",
}
_TELLING = {language: re.compile(r"[ \t]*(?:" + pattern + ")") for language, pattern in _TELLING.items()}
#: Signs and words one of which every text of these languages holds; few C++ texts do.
_HINT_SIGNS = ("=>", ":=", "===", "!==", "println!", "vec!")
_HINT_WORDS = frozenset("function let var val require typeof fn impl pub foreach package export extends implements throws func fun guard syntax message rpc".split())
class _Statements:
    """Beginnings of statements in letters of any case, each looked for by its first word."""

    def __init__(self, beginnings: dict[str, str]):
        self.any_case = re.compile(r"\b(?:" + "|".join(word + rest for word, rest in beginnings.items()) + ")", re.I)
        # a pattern that begins with a fixed word is found fast
        self.lower = {word: re.compile(rf"{word}(?<!\w{word}){rest}") for word, rest in beginnings.items()}

    def search(self, code: str) -> bool | None:
        if code.isascii():
            low = code.lower()
            found = any(word in low and pattern.search(low) for word, pattern in self.lower.items())
        else:
            found = self.any_case.search(code)
        return True if found else None


_SQL = _Statements({"select": r"\s+[\w*]", "insert": r"\s+into", "update": r"\s+\w+\s+set", "create": r"\s+\w+\s+\w", "delete": r"\s+from", "alter": r"\s+table", "drop": r"\s+\w"})
#: Words that tell of another language only in such a place.
_HINT_PLACES = {
    "import": r"\bimport\s+\w",
    "using": r"\busing\s+[A-Z]\w*(?:\.\w+)*\s*;",
    "const": r"^[ \t]*const\s+\w+\s*=",
    **dict.fromkeys(("public", "private", "protected", "internal"), r"^[ \t]*(?:public|private|protected|internal)\s+\w"),
}
_HINT_PLACES = {word: re.compile(pattern, re.M) for word, pattern in _HINT_PLACES.items()} | dict.fromkeys(_SQL.lower, _SQL)
_HINT_PLACES |= {cased: pattern for word, pattern in _HINT_PLACES.items() for cased in (word.upper(), word.capitalize())}
_HINT_PROPERTY = re.compile(r"\{\s*[a-z-]+\s*:(?!:)")
_HINT_RULE = re.compile(r"^[ \t]*[\w.#*-][^;{}()=\n]*\{\s*[a-z-]+\s*:(?!:)", re.M)
_IDENTIFIER = re.compile(r"[A-Za-z_]\w*")
#: Lines that only C++ and C hold, and declarations by a built-in type, which some of the others share.
_CPP_LINE = re.compile(r"[ \t]*(?:#|template\s*<|namespace\s+\w*\s*\{|(?:public|private|protected)\s*:|.*(?:\bstd::|\w->\w|\bnullptr\b|\boperator\b|\w::~?\w+\s*\([^!]*\)\s*(?:const\s*)?\{|\bconst\s+[\w:<>]+\s*[&*]|\w[*&]\s+\w+\s*[,)=;]|\w\s+[*&]\w+\s*[,)=;]))")
_BUILT_IN = re.compile(r"[ \t]*(?:.*[(,;]\s*)?(?:static\s+|inline\s+|const\s+|unsigned\s+|long\s+|constexpr\s+)*(?:int|void|bool|char|double|float|auto|size_t|unsigned|long)\b[\s*&]*\w+\s*[(,)=;\[{:]")
_SHARE_BUILT_IN = ("java", "csharp", "proto")
#: Share of telling lines, and how often the lines that tell of C++, from which a foreign grammar overrules a structural pass.
TELLING_SHARE = 0.15
TELLING_RATIO = 2.0


def hinted(code: str, words: Set[str] | None = None) -> bool:
    """Whether a masked text holds what tells of another bracketed language; ``words`` are its identifiers, if known."""
    if any(sign in code for sign in _HINT_SIGNS):
        return True
    words = set(_IDENTIFIER.findall(code)) if words is None else words
    if not _HINT_WORDS.isdisjoint(words):
        return True
    patterns = {_HINT_PLACES[w] for w in _HINT_PLACES.keys() & words}
    return any(p.search(code) for p in patterns) or _HINT_PROPERTY.search(code) is not None and _HINT_RULE.search(code) is not None


def telling_share(lines: list[str], pattern: re.Pattern) -> float:
    return sum(pattern.match(line) is not None for line in lines) / max(1, len(lines))


def overruling(text: str) -> str | None:
    """The language whose grammar overrules a bare structural pass as C++, by clearly more telling lines; None if none does."""
    if text.lstrip().startswith("#!"):
        return "shell"
    code = masked(text)
    # the bracketed languages parse wherever the structure does; the others have grammars of their own
    parsed = [language for language in ("python", "shell", "markup", "diff", "markdown", "json") if _parses(language, text)]
    if not parsed and not hinted(code):
        return None
    lines = [line for line in code.split("\n") if any(c.isalnum() for c in line)]
    found = [(share, language) for language, pattern in _TELLING.items() if (share := telling_share(lines, pattern)) >= TELLING_SHARE]
    if parsed:
        scores = language_scores(code)
        found += [(scores[language], language) for language in parsed if scores[language] >= 0.4]
    if not found:
        return None
    cpp, built_in = telling_share(lines, _CPP_LINE), telling_share(lines, _BUILT_IN)
    found = [(-share, language) for share, language in found if share > TELLING_RATIO * (cpp + (0 if language in _SHARE_BUILT_IN else built_in))]
    return min(found)[1] if found else None


def ranking(text: str, code: str | None = None) -> list[tuple[float, str]]:
    """All languages by their telling tokens a line, the likeliest first; ties in the order of names.  ``code`` is the masked text, if known."""
    code = masked(text) if code is None else code
    lines = [line for line in code.split("\n") if any(c.isalnum() for c in line)]
    scores = language_scores(text)
    for language, pattern in _TELLING.items():
        scores[language] = max(scores.get(language, 0.0), telling_share(lines, pattern))
    scores["c++"] = telling_share(lines, _CPP_LINE) + telling_share(lines, _BUILT_IN)
    return sorted(((score, language) for language, score in scores.items()), key=lambda x: (-x[0], x[1]))


def classify(text: str) -> tuple[str, str]:
    """Verdict and detail of a text: ``("valid", "c++")``, ``("foreign", language)`` or ``("corrupt", reason)``.

    Every grammar is tried on every text.  A text that C++ accepts is foreign where
    another grammar accepts it too and clearly more of its lines tell of that
    language.  A text that C++ rejects is foreign where a grammar of a language that
    ranks before C++ accepts it, the likeliest language first; else it is corrupt.
    """
    problem = cpp_problem(text)
    if problem is None:
        language = overruling(text)
        return ("foreign", language) if language else ("valid", "c++")
    for score, language in ranking(text):
        if language == "c++" or not score:
            break
        if _parses(language, text):
            return "foreign", language
    return "corrupt", problem
