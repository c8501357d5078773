"""Generated, minified, vendored and data files among hand-written sources.

A character trigram model of identifiers is trained on the whole corpus, one per
language.  A file is described by the cross-entropy of its identifiers under that
model (mangled names), by the diversity of its names and line shapes (templates),
by the share of literals and white space, and by its naming style against that of
its repository; paths and head comments complete the evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Set
from functools import lru_cache
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarryline.llm.grammars import classify, hinted, masked, ranking
from quarryline.llm.splits import clean_path, entity
from quarryline.plans.lineage import cut

#: Folders and file names that tell of copied or produced files.
VENDORED_PATH = re.compile(
    r"(?:^|/)(?:third[_-]?party|3rd[_-]?party|vendor(?:ed)?|extern(?:als?)?|deps|dependencies|submodules|pods|node_modules|bower_components|subprojects|contrib/bundled|bundled)/", re.I
)
GENERATED_PATH = re.compile(
    r"(?:^|/)(?:build/gen|gen|generated|autogen|auto_generated|generated[_-]files|cmake-build-[\w-]+|single_include|bazel-(?:bin|out|genfiles)|dist)/"
    r"|(?:^|/)(?:moc|ui|qrc)_[^/]*$|\.(?:pb|grpc\.pb|generated|gen|g|min|tab|yy)\.\w+$|[_-](?:generated|autogen|amalgamated|amalgamation)\.\w+$|(?:^|/)lex\.yy\.\w+$",
    re.I,
)
GENERATED_COMMENT = re.compile(
    r"@generated\b|\bdo not (?:edit|modify|change)\b|\bauto(?:matically|matic|mated)?[- ]?generated\b|\bautogen(?:erated)?:"
    r"|\bchanges? (?:\w+ ){0,3}(?:will|would) be (?:lost|overwritten|discarded)|\bregenerate\b.{0,20}\binstead\b|\bmachine[- ](?:made|generated)\b"
    r"|\b(?:written|produced|emitted|created) by (?:the )?[\w.-]+ (?:compiler|generator|tool|v?\d[\d.]*)|\boutput of [\w.-]+\s*(?:$|\*/)"
    r"|^(?:[^\S\n]|[/*#-])*(?:(?:this|the) (?:file|code|source|unit) (?:is|was|has been) |code |file )?generated (?:by|from|with|using) "
    r"|自动生成|自動生成|请勿(?:手工|手动)?(?:修改|编辑)|automatisch (?:erzeugt|generiert|erstellt)|nicht (?:\w+ ){0,2}bearbeiten",
    re.I | re.M,
)
VENDORED_COMMENT = re.compile(
    r"\bvendored (?:snapshot|copy|from|version|release)\b|\bimported from (?:the )?upstream|^(?:[^\S\n]|[/*#-])*upstream:|\(?unmodified copy\b|\bbundled (?:copy|version) of\b"
    r"|\bthird[- ]party (?:code|copy|library|source)\b|\bdistributed under its own licen[cs]e\b|\bkeep in sync with upstream\b",
    re.I | re.M,
)
_LICENCE = re.compile(r"copyright|licen[cs]e|upstream|\bv?\d+\.\d+", re.I)
_HEAD = re.compile(r"\A(?:\s*(?://[^\n]*|/\*.*?(?:\*/|\Z)|#[^\n]*))*", re.S)
_IDENTIFIER = re.compile(r"[A-Za-z_]\w*")
_LITERAL = re.compile(r'"(?:\\.|[^"\\\n])*"')
_NUMBER = re.compile(r"(?<![\w.])\.?\d[\w.]*")
_NUMBERED = re.compile(r"_\d+$")
#: Words of the language, which say nothing of names.
KEYWORDS = frozenset(
    "alignas alignof asm auto bool break case catch char class co_await co_return co_yield concept const constexpr continue decltype default delete do double else enum explicit export "
    "extern false final float for friend goto if import inline int long module mutable namespace new noexcept nullptr operator override private protected public register requires return "
    "short signed sizeof static static_cast struct switch template this throw true try typedef typename union unsigned using virtual void volatile while std size_t int64_t int32_t uint8_t uint32_t uint64_t".split()
)
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789_"
_FOLD = {c: c for c in LETTERS} | {c.upper(): c for c in LETTERS}


def _folded(name: str) -> str:
    return "^^" + (name.lower() if name.isascii() else "".join(_FOLD.get(c, "?") for c in name)) + "$"


def trigrams(names: Counter) -> Counter:
    """Character trigrams of counted names; the alphabet bounds their number to about 40 cubed."""
    found: Counter = Counter()
    items = list(names.items())
    for at in range(0, len(items), 1 << 16):
        folded = [_folded(name) for name, _ in items[at : at + (1 << 16)]]
        sizes = np.array([len(f) for f in folded])
        owner = np.repeat(np.arange(len(folded)), sizes)
        # a trigram begins anywhere but at the last two characters of a name
        starts = np.flatnonzero(np.cumsum(sizes)[owner] - np.arange(len(owner)) > 2)
        signs = np.frombuffer("".join(folded).encode("ascii"), dtype="uint8").astype("int64")
        codes = (signs[starts] << 14) + (signs[starts + 1] << 7) + signs[starts + 2]
        counts = np.array([n for _, n in items[at : at + (1 << 16)]], dtype="int64")
        totals = np.bincount(codes, weights=counts[owner[starts]])
        for code in np.flatnonzero(totals).tolist():
            found[chr(code >> 14) + chr(code >> 7 & 127) + chr(code & 127)] += int(totals[code])
    return found


class NameModel:
    """Add-half smoothed trigram model: bits per character of a name."""

    def __init__(self, counts: dict[str, int]):
        contexts: Counter = Counter()
        for gram, n in counts.items():
            contexts[gram[:2]] += n
        self.cost = {gram: -math.log2((n + 0.5) / (contexts[gram[:2]] + 20)) for gram, n in counts.items()}
        self.unseen = {context: -math.log2(0.5 / (n + 20)) for context, n in contexts.items()}
        self.known: dict[str, float] = {}

    def bits(self, name: str) -> float:
        found = self.known.get(name)
        if found is None:
            folded, cost = _folded(name), self.cost
            total, n = 0.0, len(folded) - 2
            for i in range(n):
                bits = cost.get(folded[i : i + 3])
                total += self.unseen.get(folded[i : i + 2], _NEVER) if bits is None else bits
            found = total / n
            if len(self.known) < 200_000:
                self.known[name] = found
        return found


#: Bits of a letter after two that no name has in this order.
_NEVER = -math.log2(0.5 / 20)


def words_of(code: str) -> Counter:
    """Identifiers and keywords of a masked text and how often each occurs."""
    return Counter(_IDENTIFIER.findall(code))


def names_of(words: Counter) -> Counter:
    """Without the keywords."""
    names = words.copy()
    for word in KEYWORDS & words.keys():
        del names[word]
    return names


@lru_cache(1 << 17)
def name_traits(name: str) -> tuple[bool, bool, bool, bool]:
    """Numbered, single letter, snake case, camel case."""
    snake = "_" in name.strip("_") and name.islower()
    camel = name[:1].islower() and not snake and any(c.isupper() for c in name[1:])
    return bool(_NUMBERED.search(name)), len(name) == 1, snake, camel


class _Styles(dict):
    """Of each name 1 for snake case, _CAMEL for camel case and 0 for none."""

    def __missing__(self, name: str) -> int:
        _, _, snake, camel = name_traits.__wrapped__(name)
        if len(self) >= 300_000:
            self.clear()
        found = self[name] = _CAMEL if camel else int(snake)
        return found


_CAMEL = 1 << 32
_STYLES = _Styles()


def styled(names: Counter) -> tuple[int, int]:
    """How often counted names are in snake case, and how often in camel case."""
    camel, snake = divmod(sum(map(mul, map(_STYLES.__getitem__, names), names.values())), _CAMEL)
    return snake, camel


def detected(text: str, code: str, words: Set[str]) -> str:
    """The language a text's tokens tell of; ``code`` is the text with literals masked, ``words`` its identifiers."""
    # without a word of another language, and with statements, nothing else ranks first
    if not hinted(code, words) and 8 * code.count(";") > code.count("\n"):
        return "c++"
    return ranking(text, code)[0][1]


def describe(path: str, text: str, models: dict[str, NameModel]) -> dict:
    """Evidence on one file; the cross-entropy is that of the model of its language, if there is one."""
    path = path.replace("\\", "/")
    head = _HEAD.match(text).group()
    code = masked(text)
    dense = max(1, len("".join(text.split())))
    words = words_of(code)
    names = names_of(words)
    model = models.get(detected(text, code, words.keys())) if models else None
    n = max(1, names.total())
    numbered = short = snake = camel = 0
    for name, count in names.items():
        a, b, c, d = name_traits(name)
        numbered, short, snake, camel = numbered + count * a, short + count * b, snake + count * c, camel + count * d
    literals = sum(map(len, _LITERAL.findall(text))) + sum(map(len, _NUMBER.findall(code)))
    shapes = Counter(s for s in map(str.strip, _NUMBER.sub("9", _IDENTIFIER.sub("w", code)).split("\n")) if len(s) > 4)
    lines = shapes.total()
    return {
        "path_vendored": bool(VENDORED_PATH.search(path)),
        "path_generated": bool(GENERATED_PATH.search(path)),
        "comment_generated": bool(GENERATED_COMMENT.search(head)),
        "comment_vendored": bool(VENDORED_COMMENT.search(head)),
        "comment_licence": bool(_LICENCE.search(head)),
        "names": names.total(),
        "bits": sum(map(model.bits, names)) / max(1, len(names)) if model else 0.0,
        "numbered": numbered / n,
        "short": short / n,
        "literals": min(1.0, literals / dense),
        "literal_size": literals,
        "blank": 1 - dense / max(1, len(text)),
        "lines": lines,
        "uniform": sum(c for _, c in shapes.most_common(3)) / max(1, lines),
        "snake": snake,
        "camel": camel,
        "foreign": classify(text)[0] == "foreign" if lines and (literals > 0.3 * dense or lines < 20 or sum(c for _, c in shapes.most_common(3)) > 0.4 * lines) else False,
    }


#: Thresholds of the content evidence.
MANGLED_BITS = 3.0
MANGLED_NAMES = 20
NUMBERED_NAMES = 0.04
UNIFORM_LINES = 0.7
LITERAL_SHARE = 0.4
LITERAL_CHARACTERS = 150
DENSE_TEXT = 0.05

_SCHEMA = (
    "file_id long, repository string, path_vendored boolean, path_generated boolean, comment_generated boolean, comment_vendored boolean, comment_licence boolean, names long, "
    "bits double, numbered double, short double, literals double, literal_size long, blank double, lines long, uniform double, snake long, camel long, foreign boolean"
)


def source_texts(files: DataFrame) -> DataFrame:
    """``file_id, path, repository, text`` of the files that have an id and a text that isn't blank."""
    name = F.regexp_extract(entity(F.col("corpus"), F.col("project"), F.col("cppFile")), r"^((?:library|project):[^:]+)", 1)
    text = F.array_join("func_src", "\n\n")
    columns = files.where("file_id is not null and func_src is not null").select("file_id", F.coalesce(clean_path(F.col("cppFile")), F.lit("")).alias("path"), name.alias("repository"), text.alias("text"))
    return columns.where("text rlike '\\\\S'")


def corpus_names(texts: DataFrame) -> tuple[dict[str, dict[str, int]], DataFrame]:
    """From one pass over all texts: trigram counts of each language, and the naming style of each repository.

    The alphabet bounds the trigrams, so they may go to the driver.  The styles stay
    a table, ``repository, all_snake, all_camel``; each delivery of a file adds to them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        styles: dict[str | None, list[int]] = {}
        for batch in batches:
            for repository, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                code = masked(text)
                words = words_of(code)
                names = names_of(words)
                # a name counts once a file, so that no file outweighs the others
                found.setdefault(detected(text, code, words.keys()), Counter()).update(names.keys())
                style, (snake, camel) = styles.setdefault(repository, [0, 0]), styled(names)
                style[0] += snake
                style[1] += camel
            if sum(map(len, found.values())) + len(styles) > 300_000:
                yield from give(found, styles)
                found, styles = {}, {}
        yield from give(found, styles)

    def give(found: dict[str, Counter], styles: dict[str | None, list[int]]) -> Iterator[pa.RecordBatch]:
        names = ["language", "repository", "gram", "n", "snake", "camel"]
        long, string = pa.int64(), pa.string()
        for language, own in found.items():
            grams = trigrams(own)
            empty = pa.nulls(len(grams))
            columns = [pa.array([language] * len(grams), string), empty.cast(string), pa.array(list(grams), string), pa.array(list(grams.values()), long), empty.cast(long), empty.cast(long)]
            yield pa.RecordBatch.from_arrays(columns, names)
        empty = pa.nulls(len(styles))
        columns = [empty.cast(string), pa.array(list(styles), string), empty.cast(string), empty.cast(long), pa.array([s for s, _ in styles.values()], long), pa.array([c for _, c in styles.values()], long)]
        yield pa.RecordBatch.from_arrays(columns, names)

    # small rows, written once: both the model and the styles are read from them
    rows = cut(texts.select("repository", "text").mapInArrow(count, "language string, repository string, gram string, n long, snake long, camel long"))
    model: dict[str, dict[str, int]] = {}
    for row in rows.where("gram is not null").groupBy("language", "gram").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        model.setdefault(row["language"], {})[row["gram"]] = row["n"]
    return model, rows.where("gram is null").groupBy("repository").agg(F.sum("snake").alias("all_snake"), F.sum("camel").alias("all_camel"))


def evidence_of(texts: DataFrame, counts: dict[str, dict[str, int]], styles: DataFrame) -> DataFrame:
    """Evidence on each of some texts, given the names of the whole corpus."""
    names = [f.split()[0] for f in _SCHEMA.split(", ")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = {language: NameModel(grams) for language, grams in counts.items()}
        for batch in batches:
            ids, paths, repositories, bodies = (batch.column(i).to_pylist() for i in range(4))
            rows = [describe(p, t, models) for p, t in zip(paths, bodies)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(repositories, pa.string()), *(pa.array([r[n] for r in rows]) for n in names[2:])], names)

    found = texts.select("file_id", "path", "repository", "text").mapInArrow(measure, _SCHEMA)
    found = found.groupBy("file_id").agg(*[F.max(n).alias(n) for n in names[1:]])
    own, all_ = F.col("snake") / (F.col("snake") + F.col("camel")), F.col("all_snake") / (F.col("all_snake") + F.col("all_camel"))
    styled = (F.col("snake") + F.col("camel") >= 10) & (F.col("all_snake") + F.col("all_camel") >= 200)
    joined = found.join(styles, "repository", "left")
    foreign_style = F.coalesce(F.when(styled, F.abs(own - all_) > 0.8), F.lit(False))
    content = ~F.col("foreign")
    return joined.select(
        *found.columns,
        foreign_style.alias("foreign_style"),
        (F.col("path_vendored") | F.col("comment_vendored") | foreign_style & F.col("comment_licence")).alias("vendored"),
        (F.col("path_generated") | F.col("comment_generated")).alias("declared"),
        # the cross-entropy decides alone, but on few names only beside uniform lines or many literals
        (content & (F.col("bits") >= MANGLED_BITS) & ((F.col("names") >= MANGLED_NAMES) | ((F.col("uniform") >= 0.45) | (F.col("literals") >= 0.25)) & (F.col("lines") >= 3))).alias("mangled"),
        (content & ((F.col("numbered") > NUMBERED_NAMES) | (F.col("uniform") >= UNIFORM_LINES)) & (F.col("lines") >= 10)).alias("templated"),
        (content & (F.col("literals") >= LITERAL_SHARE) & (F.col("literal_size") >= LITERAL_CHARACTERS)).alias("data"),
        (content & ((F.col("blank") < DENSE_TEXT) | (F.col("blank") < 0.08) & (F.col("short") > 0.2))).alias("minified"),
    )


def file_evidence(files: DataFrame) -> DataFrame:
    """Evidence on every file, and what it amounts to.

    Null and blank texts and null ids give no row; a null path gives no path
    evidence.  Deliveries of one file give one row.  Extra columns are ignored.
    """
    texts = source_texts(files)
    return evidence_of(texts, *corpus_names(texts))


def flagged(evidence: DataFrame) -> DataFrame:
    """``file_id`` of the files whose evidence says that no one wrote them by hand."""
    return evidence.where("vendored or declared or mangled or templated or data or minified").select("file_id")


def not_hand_written(files: DataFrame) -> DataFrame:
    """``file_id`` of the files that are generated, minified, vendored or data."""
    return flagged(file_evidence(files))


def provenance_report(files: DataFrame) -> DataFrame:
    """For every repository the number of files, and how many are vendored, generated, data, minified or hand-written."""
    evidence = file_evidence(files)
    n = lambda condition, name: F.count_if(F.expr(condition)).alias(name)
    return evidence.groupBy("repository").agg(
        F.count(F.lit(1)).alias("files"),
        n("vendored", "vendored"),
        n("declared or mangled or templated", "generated"),
        n("data", "data"),
        n("minified", "minified"),
        n("not (vendored or declared or mangled or templated or data or minified)", "hand_written"),
    )
