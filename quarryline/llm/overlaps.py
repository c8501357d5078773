"""Functions of evaluation files that the training files repeat, exactly or almost.

A function becomes a string over statements: comments, layout and its own name are
gone, parameters and locals are blanks.  Strings are joined under an edit distance
of a fifth of their length: an evaluation string is cut into one more segment than
it may have edits, so one segment stands unchanged in any match, near its place.
Candidates are verified by dynamic programming in a band; a consistent renaming of
the blanks is part of the verification.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator, Set
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarryline.llm.provenance import KEYWORDS, corpus_names, evidence_of, flagged, source_texts
from quarryline.llm.splits import entity
from quarryline.llm.syntax import verdicts_of
from quarryline.plans.lineage import cut

#: Functions and texts with fewer characters other than white space don't count.
LEAST_CHARACTERS = 200
#: One statement in so many may differ.
ONE_IN = 5

# every alternative begins with a fixed character, which keeps the scan fast
_COMMENT = re.compile(r'//(?:\\\n|[^\n])*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'', re.S)
#: Strings, members, names with what qualifies them and the parenthesis of a call, numbers, and single signs.
_PIECE = re.compile(r'"(?:\\.|[^"\\\n])*"|(?:->|::|\.)\s*[A-Za-z_~]\w*|[A-Za-z_]\w*(?:::[~\w]+)*(?:\s*\()?|\.?\d[\w.]*|[^\s\w]')
#: The same without the single signs, to split an ASCII text by: signs and white space lie between.
_WORD = re.compile(
    r'([A-Za-z_]\w*(?:(?:::[~\w]+)+|)(?:\(|\s+\(|)|\d[\w.]*|\.(?:\d[\w.]*|\s*[A-Za-z_~]\w*)|->\s*[A-Za-z_~]\w*|::\s*[A-Za-z_~]\w*|"[^"\\\n]*(?:\\.[^"\\\n]*)*")', re.A
)
#: A name that a declarator, a list or a statement goes on from, after a blank or a reference sign.
_DECLARATOR = re.compile(r"[\s*&](?=[A-Za-z_])(?<=[\w>*&][\s*&]|\s[*&])([A-Za-z_]\w*)\s?(?=[=;,)({:\[])(?!::)")
_TYPE_WORD = re.compile(r"\w*\Z")
_WORD_SIGNS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"
#: Names bound together, and captures that begin with a value of their own.
_BOUND = re.compile(r"auto(?<!\wauto)\s*&*\s*\[([\w\s,]+)\]")
_CAPTURED = re.compile(r"\[([^\[\]=]*\w\s*=[^\[\]]*)\]\s*[({]")
#: Words before a name that declare nothing.
_NO_TYPE = frozenset("return throw new delete else case goto co_return co_yield co_await sizeof typename using namespace operator and or not public private protected if while switch do class struct enum union".split())
#: A name that reads as a local where nothing else declares it: no member, constant or type, by its spelling.
_LOCAL = re.compile(r"(?!(?:m|g|s)_|k[A-Z0-9]|\w*_t\Z)[a-z]\w*(?<!_)\Z")
_HEADER_NAME = re.compile(r"(?:[\w~]+::)*~?\w+\s*(?=\()")
_BLANK = "\x01"


def split_class(split: Column) -> Column:
    """``train``, ``validation`` or ``test`` for any spelling of a split; null for others."""
    name = F.lower(F.trim(split))
    return F.when(name.isin("train", "training"), "train").when(name.isin("val", "valid", "validation", "dev"), "validation").when(name == "test", "test")


class _Words(dict):
    """What ``of`` says of a word, kept for the words met."""

    def __init__(self, of: Callable[[str], str | None]):
        self.of = of

    def __missing__(self, word: str) -> str | None:
        found = self.of(word)
        # literals hardly come back; the words that do are soon known again
        if word[0] != '"':
            if len(self) >= 300_000:
                self.clear()
            self[word] = found
        return found


def _name(word: str) -> str | None:
    """The name in a word that may be a blank."""
    name = word[:-1].rstrip() if word[-1] == "(" else word
    return None if not (name[:1].isalpha() or name[:1] == "_") or ":" in name or name in KEYWORDS else name


def _bare(word: str) -> str:
    return _BLANK if word[-1] != "(" and _name(word) and _LOCAL.match(word) else word


#: What reads as a local is a blank unless it is called; any other name must be declared.
_BARE = _Words(_bare)
_ASKED = _Words(lambda word: None if _bare(word) == _BLANK else _name(word))


def declared(code: str, asked: Set[str] | None = None) -> Set[str]:
    """The names, or which of some names, a function declares as parameters or locals, in any spelling."""
    found: set[str] = set()
    for match in _DECLARATOR.finditer(code):
        name, at = match.group(1), match.start()
        if name in found or asked is not None and name not in asked:
            continue
        before = code[max(0, at - 60) : at + 1]
        kind = before.rstrip(" \n\t*&")
        signs = before[len(kind) :]
        # a sign between blanks is an operator, and so is an angle after a blank
        if signs[:1].isspace() and signs[-1:].isspace() and signs.strip() or kind[-1:] == ">" and (kind[-2:-1].isspace() or kind[-2:] == "->"):
            continue
        word = kind[len(kind.rstrip(_WORD_SIGNS)) :] if kind.isascii() else _TYPE_WORD.search(kind).group()
        if (word or kind[-1:] == ">") and word not in _NO_TYPE and not word[:1].isdigit():
            found.add(name)
    if "auto" in code:
        found.update(n.strip() for names in _BOUND.findall(code) for n in names.split(",") if n.strip())
    if "](" in code or "] {" in code or "]{" in code:
        found.update(name for inner in _CAPTURED.findall(code) for name in re.findall(r"(?:\A|,)\s*&?(\w+)\s*=", inner))
    return found if asked is None else found & asked


def statements(text: str) -> tuple[list[str], list[list[str]]]:
    """The statements of a function with blanks for its own names, and these names by statement."""
    code = _COMMENT.sub(_uncommented, text)
    brace = code.find("{")
    head = code[:brace] if brace >= 0 else code
    code = _HEADER_NAME.sub(" ", head, count=1) + (code[brace:] if brace >= 0 else "")
    parts = _WORD.split(code) if code.isascii() else None
    words = parts[1::2] if parts else _PIECE.findall(code)
    distinct = set(words)
    bare = list(map(_BARE.__getitem__, words))
    found = declared(code)
    own = {word: word for word in found & distinct if _ASKED[word]}
    own |= {word: name for word in distinct if word[-1] == "(" and (name := word[:-1].rstrip()) in found and _ASKED[word]}
    if own:
        blanks = {word: _BLANK + "(" if word[-1] == "(" else _BLANK for word in own}
        bare = list(map(blanks.get, words, bare))
        names = [own.get(w, w) for w, b in zip(words, bare) if b[0] == _BLANK != w]
    else:
        names = [w for w, b in zip(words, bare) if b == _BLANK != w]
    if parts:
        parts[1::2] = bare
    code = dense("".join(parts or bare))
    # a piece ends at a brace or semicolon outside parentheses
    pieces, depth, start, end = [], 0, 0, 0
    for part in code.replace("{", ";").replace("}", ";").split(";"):
        end += len(part)
        if "(" in part or ")" in part:
            depth += part.count("(") - part.count(")")
        if depth <= 0:
            depth = 0
            if end > start:
                pieces.append(code[start:end])
            start = end + 1
        end += 1
    if len(code) > start:
        pieces.append(code[start:])
    owned, at = [], 0
    for piece in pieces:
        n = piece.count(_BLANK)
        owned.append(names[at : at + n])
        at += n
    return pieces, owned


_SPACE = bytes(b for b in range(128) if chr(b).isspace())


def dense(text: str) -> str:
    """The text without white space."""
    return text.encode("ascii").translate(None, _SPACE).decode("ascii") if text.isascii() else "".join(text.split())


def _uncommented(match: re.Match) -> str:
    token = match.group()
    return " " if token[0] == "/" else token


def _hash64(text: str) -> int:
    import xxhash

    n = xxhash.xxh3_64_intdigest(text)
    return n - (1 << 64) if n >> 63 else n


def canonical(pieces: list[str], owned: list[list[str]]) -> int:
    """Equal for functions that differ by nothing but a renaming."""
    names = list(chain.from_iterable(owned))
    order = {name: i for i, name in enumerate(dict.fromkeys(names))}
    numbers = list(map(order.__getitem__, names))
    return _hash64("\n".join(pieces) + repr(numbers))


def edits_within(a: list[int], b: list[int], most: int) -> list[tuple[int, int]] | None:
    """Matched positions of a best alignment with at most ``most`` edits, by dynamic programming in a band; else None."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    far = most + 1
    rows = [[j if j <= most else far for j in range(m + 1)]]
    for i in range(1, n + 1):
        row, above = [far] * (m + 1), rows[-1]
        low, high = max(0, i - most), min(m, i + most)
        if low == 0:
            row[0] = i
        for j in range(max(1, low), high + 1):
            best = above[j - 1] + (a[i - 1] != b[j - 1])
            if above[j] + 1 < best:
                best = above[j] + 1
            if row[j - 1] + 1 < best:
                best = row[j - 1] + 1
            row[j] = best if best < far else far
        if min(row[low : high + 1]) > most:
            return None
        rows.append(row)
    if rows[n][m] > most:
        return None
    pairs, i, j = [], n, m
    while i and j:
        if a[i - 1] == b[j - 1] and rows[i][j] == rows[i - 1][j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif rows[i][j] == rows[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
        elif rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def same_function(a: list[int], names_a: list[list[str]], b: list[int], names_b: list[list[str]]) -> bool:
    """At most one in ONE_IN statements differs, with one renaming for all others."""
    longest = max(len(a), len(b))
    most = longest // ONE_IN
    shared = Counter(a) & Counter(b)
    if shared.total() < longest - most:
        return False
    pairs = edits_within(a, b, most)
    if pairs is None:
        return False
    edits = longest - len(pairs)
    votes = Counter((x, y) for i, j in pairs for x, y in zip(names_a[i], names_b[j]))
    forth: dict[str, str] = {}
    back: dict[str, str] = {}
    for (x, y), _ in sorted(votes.items(), key=lambda v: (-v[1], v[0])):
        if x not in forth and y not in back:
            forth[x], back[y] = y, x
    broken = sum(any(forth.get(x) != y for x, y in zip(names_a[i], names_b[j])) for i, j in pairs)
    return edits + broken <= most


#: A statement in more functions than this is hot, and segments keep clear of it where they can.
HOT = 500


def cuts(n: int, hot: set[int] | None = None) -> list[tuple[int, int]]:
    """Segments of an evaluation string of n statements: one more than any match of it may have edits.

    Any disjoint substrings will do, as an edit spoils one of them at most.  So
    they are laid between the hot positions if there is room for pieces of two
    statements or more; else they divide the whole string.
    """
    parts = n // (ONE_IN - 1) + 1
    if hot:
        free, start = [], 0
        for at in [*sorted(hot), n]:
            free.append((start, at))
            start = at + 1
        for length in (4, 3, 2):
            found = [(s, s + length) for a, b in free for s in range(a, b - length + 1, length)]
            if len(found) >= parts:
                return found[:parts]
    edges = [i * n // parts for i in range(parts + 1)]
    return [(s, e) for s, e in zip(edges, edges[1:]) if e > s]


#: Lengths that segments can have; training strings give their substrings of these lengths.
_LENGTHS = (1, 2, 3, 4)


_SCANNED = "file_id long, side string, key long, string array<long>, names string, text_key string"


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each function that counts, and one with the digest of the text, white space aside, for each file whose text counts."""
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        ids, sides, keys, names, texts = [], [], [], [], []
        # the hashes of all statements of the batch, and where each row's begin
        hashes, starts = [], [0]
        for file_id, side, functions in zip(*(batch.column(i).to_pylist() for i in range(3))):
            solid = []
            for text in functions or ():
                if not text:
                    continue
                solid.append(dense(text))
                if len(solid[-1]) < LEAST_CHARACTERS:
                    continue
                pieces, owned = statements(text)
                ids.append(file_id)
                sides.append(side)
                keys.append(canonical(pieces, owned))
                hashes.extend(map(xxh3_64_intdigest, pieces))
                starts.append(len(hashes))
                names.append("|".join(map(" ".join, owned)))
                texts.append(None)
            if sum(map(len, solid)) >= LEAST_CHARACTERS:
                ids.append(file_id)
                sides.append(side)
                keys.append(None)
                starts.append(len(hashes))
                names.append(None)
                texts.append(hashlib.sha256("".join(solid).encode("utf-8", "surrogatepass")).hexdigest())
        strings = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.array(hashes, dtype="uint64").view("int64")), mask=pa.array([k is None for k in keys], pa.bool_()))
        arrays = [pa.array(ids, pa.int64()), pa.array(sides, pa.string()), pa.array(keys, pa.int64()), strings, pa.array(names, pa.string()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["file_id", "side", "key", "string", "names", "text_key"])


def scanned(files: DataFrame) -> DataFrame:
    """All functions and texts in one pass over the files, written once."""
    return cut(_sided(files).select("file_id", "side", "func_src").mapInArrow(_functions, _SCANNED))


def _mix(values: np.ndarray) -> np.ndarray:
    """One hash of the rows of a matrix of statement hashes."""
    out = np.full(len(values), values.shape[1], dtype="uint64")
    for column in values.T:
        out = (out ^ column.view("uint64")) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view("int64")


_SEGMENTS = pa.schema([("segment", pa.int64()), ("key", pa.int64()), ("pos", pa.int32()), ("n", pa.int32())])


def _pieces(evaluation: bool):
    """Rows ``segment, key, pos, n`` for the segments of evaluation strings, or for the substrings of training strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = batch.column(1)
            keys, sizes = batch.column(0).to_numpy(zero_copy_only=False), strings.value_lengths().to_numpy(zero_copy_only=False)
            # all strings of the batch, one after another
            flat, begins = strings.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
            if evaluation:
                spans = [(row, s, e - s) for row, (n, hot) in enumerate(zip(sizes.tolist(), batch.column(2).to_pylist())) for s, e in cuts(n, set(hot or ()))]
                rows, starts, lengths = np.array(spans, dtype="int64").reshape(-1, 3).T
                places = [(length, rows[lengths == length], starts[lengths == length]) for length in _LENGTHS]
            else:
                owner = np.repeat(np.arange(len(sizes)), sizes)
                at = np.arange(len(flat)) - begins[owner]
                left = sizes[owner] - at
                # short strings allow no edit and are segments as a whole
                fits = [(length, (left >= length) & ((length > 1) | (sizes[owner] == 1))) for length in _LENGTHS]
                places = [(length, owner[here], at[here]) for length, here in fits]
            for length, rows, starts in places:
                if len(rows):
                    hashes = _mix(flat[(begins[rows] + starts)[:, None] + np.arange(length)[None]])
                    columns = hashes, keys[rows], starts.astype("int32"), sizes[rows].astype("int32")
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_SEGMENTS)

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(6))))
        split = lambda names: [part.split() for part in names.split("|")]
        kept = [(e, t) for e, t, se, ne, st, nt in rows if same_function(se, split(ne), st, split(nt))]
        yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in kept], pa.int64()), pa.array([t for _, t in kept], pa.int64())], ["e", "t"])


def _sided(files: DataFrame) -> DataFrame:
    side = split_class(F.col("split"))
    return files.where(side.isNotNull() & F.col("file_id").isNotNull() & F.col("func_src").isNotNull()).withColumn("side", F.when(side == "train", "t").otherwise("e"))


def _matches(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The owners of each function as ``key, side, file_id``, and the matched functions as ``e, t``."""
    functions = rows.where("key is not null")
    # copies of one function become one row, before any function meets another
    distinct = cut(functions.groupBy("key").agg(F.first("string").alias("string"), F.first("names").alias("names"), F.bool_or(F.col("side") == "e").alias("e"), F.bool_or(F.col("side") == "t").alias("t")))
    schema = "segment long, key long, pos int, n int"
    common = distinct.select(F.explode(F.array_distinct("string")).alias("statement")).groupBy("statement").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("statement")
    placed = distinct.where("e").select("key", F.posexplode("string").alias("at", "statement")).join(common, "statement").groupBy("key").agg(F.collect_set("at").alias("hot"))
    segments = distinct.where("e").join(placed, "key", "left").select("key", "string", "hot").mapInArrow(_pieces(True), schema).toDF("segment", "e", "e_pos", "e_n")
    substrings = distinct.where("t").select("key", "string").mapInArrow(_pieces(False), schema).toDF("segment", "t", "t_pos", "t_n")
    most = F.floor(F.greatest("e_n", "t_n") / ONE_IN)
    near = (F.abs(F.col("e_pos") - F.col("t_pos")) <= most) & (F.abs(F.col("e_n") - F.col("t_n")) <= most) & (F.col("e") != F.col("t"))
    candidates = segments.join(substrings, "segment").where(near).select("e", "t").distinct()
    sources = distinct.select("key", "string", "names")
    paired = candidates.join(sources.toDF("e", "e_string", "e_names"), "e").join(sources.toDF("t", "t_string", "t_names"), "t")
    verified = paired.select("e", "t", "e_string", "e_names", "t_string", "t_names").mapInArrow(_verify, "e long, t long")
    equal = distinct.where("e and t").select(F.col("key").alias("e"), F.col("key").alias("t"))
    owners = functions.select("key", "side", "file_id").distinct()
    return owners, verified.union(equal)


def shared_functions(rows: DataFrame) -> DataFrame:
    """``e_file, t_file``: evaluation and training files that share a function, each pair once, from ``scanned`` files."""
    owners, matched = _matches(rows)
    e_owners = owners.where("side = 'e'").select(F.col("key").alias("e"), F.col("file_id").alias("e_file"))
    t_owners = owners.where("side = 't'").select(F.col("key").alias("t"), F.col("file_id").alias("t_file"))
    return matched.join(e_owners, "e").join(t_owners, "t").select("e_file", "t_file").distinct()


def _equal_texts(files: DataFrame, rows: DataFrame) -> DataFrame:
    """``file_id, side, text_key`` of the files of problems 3 and 5 whose text, white space aside, both sides hold.

    Which files are such is told as ``not_hand_written`` and ``unparsable_files``
    tell it, with the models of all texts, but asked only of files that have an
    equal on the other side.  A pair counts if both of its files are such.
    """
    keyed = rows.where("text_key is not null").select("file_id", "side", "text_key")
    both = keyed.groupBy("text_key").agg(F.bool_or(F.col("side") == "e").alias("e"), F.bool_or(F.col("side") == "t").alias("t")).where("e and t").select("text_key")
    equal = cut(keyed.join(both, "text_key").distinct())
    if equal.isEmpty():
        return equal
    texts = source_texts(files)
    asked = cut(texts.join(equal.select("file_id").distinct(), "file_id", "left_semi"))
    produced = flagged(evidence_of(asked, *corpus_names(texts)))
    broken = verdicts_of(asked).where("verdict != 'valid'").select("file_id")
    return equal.join(produced.union(broken).distinct(), "file_id", "left_semi")


def overlapping_files(files: DataFrame) -> DataFrame:
    """Pairs of a train file and an evaluation file that overlap, as ``file_id_a, file_id_b``, the smaller id first.

    Null ids, null splits and null or empty functions take no part.  A file
    delivered under splits of both sides takes part on both, but never with
    itself.  Extra columns are ignored.
    """
    rows = scanned(files)
    texts = _equal_texts(files, rows)
    e = texts.where("side = 'e'").select("text_key", F.col("file_id").alias("e_file"))
    t = texts.where("side = 't'").select("text_key", F.col("file_id").alias("t_file"))
    pairs = shared_functions(rows).union(e.join(t, "text_key").select("e_file", "t_file")).where("e_file != t_file")
    return pairs.select(F.least("e_file", "t_file").alias("file_id_a"), F.greatest("e_file", "t_file").alias("file_id_b")).distinct()


def repeated_files(files: DataFrame) -> DataFrame:
    """``file_id`` of the evaluation files that overlap with a train file, found without listing the pairs.

    Of the files on the train side of a function or text the smallest and the
    largest id are kept: an evaluation file overlaps unless both are its own.
    """
    rows = scanned(files)
    owners, matched = _matches(rows)
    ends = lambda side, key: side.groupBy(key).agg(F.min("file_id").alias("low"), F.max("file_id").alias("high"))
    train = ends(owners.where("side = 't'").withColumnRenamed("key", "t"), "t")
    partners = matched.join(train, "t").groupBy("e").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    found = owners.where("side = 'e'").join(partners, F.col("key") == F.col("e")).select("file_id", "low", "high")
    texts = _equal_texts(files, rows)
    equal = texts.where("side = 'e'").join(ends(texts.where("side = 't'"), "text_key"), "text_key").select("file_id", "low", "high")
    return found.union(equal).where("low != file_id or high != file_id").select("file_id").distinct()


def overlap_report(files: DataFrame) -> DataFrame:
    """For every evaluation split and repository: ``split, repository, files, repeated``, the files and how many a train file repeats.

    A file delivered under several splits or repositories counts in each.
    """
    hits = repeated_files(files).withColumn("hit", F.lit(1))
    name = F.regexp_extract(entity(F.col("corpus"), F.col("project"), F.col("cppFile")), r"^((?:library|project):[^:]+)", 1)
    side = split_class(F.col("split"))
    own = files.where(side.isin("validation", "test")).where("file_id is not null").select("file_id", side.alias("split"), name.alias("repository")).distinct()
    return own.join(hits, "file_id", "left").groupBy("split", "repository").agg(F.count(F.lit(1)).alias("files"), F.count("hit").alias("repeated"))
