"""Per-document text statistics, and prose told from lists, tables and junk.

Huge texts are cut into chunks of ``CHUNK`` characters.  A chunk gives partial
counts and the state at its two edges: the piece of a word that a cut may have
divided and the open line.  Partial counts are added up by Spark; the edge states
of a document are joined in order, which corrects words and lines that were cut.
Prose is judged on parts of whole lines with the lines around them; each part gives
the sentences it counts, and Spark keeps each sentence of a document once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

CHUNK = 1 << 16
#: Longest piece of a divided word that is kept as text; a longer word is no common word.
PIECE = 40
#: Prose of a cut text is judged in parts of so many lines, each with this many lines around it.
PART_LINES = 1024
AROUND = 12
#: A sentence of so many characters counts once in a text.
REPEATED = 12
#: Where ``str.splitlines`` ends a line, as a Java pattern.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

#: Frequent English and German words by their role in a clause.
DETERMINERS = "the a an our every my your their his her der die das den dem des ein eine einen einem einer".split()
LINKS = (
    "of in on at by for with from to into over under behind next after before than then and or about like without through between against "
    "this that these those one all any some each no both again still not "
    "von vom zu zum zur in im mit auf für aus an bei nach vor über unter durch und oder auch noch nur hier nicht zuerst fall fällen"
).split()
MODIFIERS = "same other such more most only also just next last".split()
CLAUSES = (
    "is are was were be been being am has have had do does did can could should would will may might must isn't don't doesn't didn't wasn't it's "
    "i we you he she it they we'd they'd i'd who which what when whenever where while because if but so as how why yet though although unless until there let please "
    "ist sind war hat haben wird werden muss man kann soll wir ich sie er es wenn weil ob dass aber wie wo was sich bitte habe"
).split()
#: Frequent words of further languages, with d for determiners, l for links, c for what makes clauses and m for modifiers.
FURTHER = {
    "french": {
        "d": "le la les un une des du ce cette ces mon ma mes son sa ses notre nos votre vos leur leurs",
        "l": "de à au aux en dans par pour avec sans sur sous entre vers chez et ou mais donc car comme",
        "c": "je tu il elle nous vous ils elles on que qui quoi dont où quand si est sont était étaient sera ont avait avaient être peut doit ne pas se",
        "m": "plus très aussi même tout tous toute bien encore",
    },
    "spanish": {
        "d": "el la los las un una unos unas este esta estos estas su sus mi mis nuestro nuestra",
        "l": "de del a al en por para con sin sobre entre hacia desde hasta y e o u",
        "c": "que se no es son era eran fue fueron ha han había hay está están ser estar yo él ella ellos nosotros lo le les me te nos cuando si como pero porque donde quien puede debe",
        "m": "más muy también todo todos ya aún",
    },
    "italian": {
        "d": "il lo la i gli le un uno una questo questa questi suo sua",
        "l": "di del della dei delle a al alla in nel nella da dal dalla con su sul sulla per tra fra e ed o",
        "c": "che non è sono era erano ha hanno aveva si ci lui lei noi voi loro io se quando come ma perché dove chi può deve essere stato",
        "m": "più molto anche tutto tutti già ancora",
    },
    "portuguese": {
        "d": "o a os as um uma este esta seu sua",
        "l": "de do da dos das em no na nos nas por para com sem sobre entre e ou ao à",
        "c": "que se não é são era foi foram tem têm havia há está estão ele ela eles nós eu quando como mas porque onde pode deve ser",
        "m": "mais muito também todo todos já ainda",
    },
    "dutch": {
        "d": "de het een deze dit die haar onze",
        "l": "van in op aan met voor door over onder bij uit naar en of om tot te",
        "c": "is zijn was waren heeft hebben had wordt worden kan moet zal ik je hij zij we wij ze er dat als wie wat maar want omdat niet",
        "m": "ook nog meer zeer al",
    },
    "polish": {
        "l": "w we i z ze na do o po za od przez dla oraz a u przy",
        "c": "nie się jest są był była było to że jak ale który która które czy gdy może tym być już go jej ich",
        "m": "tylko także bardzo też",
    },
}
#: Share of a further language's words that are frequent ones; languages that inflect have fewer.
FURTHER_SHARE = 0.2
PUNCTUATION = ".!?:;,\"')]}。！？；：，”』」…"

_ROLE = {w: "d" for w in DETERMINERS} | {w: "l" for w in LINKS} | {w: "c" for w in CLAUSES} | {w: "m" for w in MODIFIERS}
_FURTHER = [{w: role for role, words in roles.items() for w in words.split()} for roles in FURTHER.values()]
_FURTHER_ALONE = frozenset(w for roles in _FURTHER for w in roles) - _ROLE.keys()
_QUOTES = "«»„“”¿¡"
_STRIP = ".,;:!?\"'()[]{}*_>…"
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_CJK_STOP = re.compile(r"[。！？，；]")
#: Letters of alphabets that are neither Latin nor CJK, and the stops they use.
_SCRIPT = re.compile(r"[\u0370-\u1cff\uac00-\ud7a3]")
_STOP = re.compile(r"[.!?;,:…؟،؛।۔]")
_SENTENCE = re.compile(r"[^.!?。！？\n]+")
_BAD = re.compile(r"d(?=[dlc])")
_STAMP = re.compile(r"[\[(]?\d{1,4}[-:/.]\d{2}[-:/.]\d{2}")
_ITEM = re.compile(r"(?:[-*+•]|\d+[.)]) ")


def line_roles(line: str) -> tuple[str, int]:
    """Role of each word of a line (d, l, c, m, x for other words, o for other tokens) and its CJK characters."""
    return "".join(map(token_role, line.split())), 0 if line.isascii() else len(_CJK.findall(line))


@lru_cache(1 << 17)
def token_role(token: str) -> str:
    word = token.strip(_STRIP).lower().replace("’", "'")
    return _ROLE.get(word) or ("x" if word.replace("-", "").replace("'", "").isalpha() else "o" if word else "")


@lru_cache(1 << 17)
def further_roles(token: str) -> str:
    """The role of a token in each further language, - where it is none of its frequent words; empty if it is none of any."""
    word = token.strip(_STRIP + _QUOTES).lower().replace("’", "'")
    found = "".join(roles.get(word, "-") for roles in _FURTHER)
    return found if found.strip("-") else ""


@lru_cache(1 << 17)
def _word(token: str) -> str:
    """The word of a token; empty if it is none."""
    word = token.strip(_STRIP + _QUOTES)
    return word if word.replace("-", "").replace("'", "").replace("’", "").isalpha() else ""


def _accented(word: str) -> bool:
    return not word.isascii() and any("\x7f" < c < "\u0250" for c in word)


def further_prose(lines: list[str]) -> bool:
    """Whether neighbouring lines read as sentences of a language other than English, German, Chinese or Japanese.

    The languages with lists are told by the roles of words, as English is.  Another
    alphabet, or accents on many words, together with stops between words of a usual
    length, tell of the others.
    """
    tokens = [t for line in lines for t in line.split()]
    words = list(filter(None, map(_word, tokens)))
    if len(words) < 6 or len(words) < 0.6 * len(tokens):
        return False
    roles = list(map(further_roles, tokens))
    if sum(map(bool, roles)) >= FURTHER_SHARE * len(words):
        # the language with the most frequent words decides, so that none covers for the order of another
        owns = ["".join(r[language] if r else "-" for r in roles) for language in range(len(_FURTHER))]
        most = min(own.count("-") for own in owns)
        for own in (own for own in owns if own.count("-") == most):
            determiners, bad = own.count("d"), len(_BAD.findall(own))
            frequent = {t for t, r in zip(tokens, own) if r != "-"}
            if len(own) - most >= FURTHER_SHARE * len(words) and own.count("c") >= 0.03 * len(words) and bad <= max(1, 0.1 * determiners) and len(frequent) >= 4:
                return True
    if sum(_SCRIPT.match(w) is not None for w in words) < 0.6 * len(words) and sum(map(_accented, words)) < 0.15 * len(words):
        return False
    stops = sum(len(_STOP.findall(line)) for line in lines)
    length = sum(map(len, words)) / len(words)
    # sentences have stops, but not after each word, and go on in small letters where an alphabet has them
    large = sum(w[0].isupper() and w[1:].islower() for w in words)
    return len(words) / 25 <= stops <= len(words) / 2.5 and 2 <= length <= 12 and large <= 0.4 * len(words)


def _further(lines: list[str], i: int, roles: str, cjk: int, places: list[int]) -> bool:
    """Whether a line is prose of a further language, as part of the lines around it."""
    if cjk or roles.count("o") > 0.35 * len(roles):
        return False
    # a line of ASCII without a frequent word of these languages alone is of none
    if lines[i].isascii() and _FURTHER_ALONE.isdisjoint(lines[i].lower().split()):
        return False
    return further_prose([lines[j] for j in sorted(places)])


def prose_lines(lines: list[str], first: int = 0, last: int | None = None) -> Iterator[tuple[int, int, list[tuple[str, int]]]]:
    """The lines in running sentences among ``lines[first:last]``: number, characters, and each sentence's key and characters.

    A line counts as prose by the words of the lines around it: mostly plain words,
    enough function words, words that make clauses, and determiners that stand
    before content words.
    """
    lines = [line.strip() for line in lines]
    stats = []
    for line in lines:
        roles, cjk = line_roles(line)
        stats.append((roles, cjk, _size(line), len(_CJK_STOP.findall(line)) if cjk else 0, line[-1:] in (".", "!", "?"), line[:1].islower()))
    for i in range(first, len(stats) if last is None else min(last, len(stats))):
        roles, cjk, size = stats[i][:3]
        if not size:
            continue
        near, words, places = [stats[i]], len(roles), [i]
        for step in (-1, 1):
            # two lines each way, more of them where lines are short
            j, taken = i + step, 0
            while 0 <= j < len(stats) and stats[j][2] and (taken < 2 or taken < AROUND and words < 24):
                near.append(stats[j])
                places.append(j)
                words += len(stats[j][0])
                j, taken = j + step, taken + 1
        item = len(roles) <= 9 and _ITEM.match(lines[i]) and lines[i][-1] not in ".!?…:" or _STAMP.match(lines[i])
        if not item and (_is_prose(roles, cjk, size, near) or _further(lines, i, roles, cjk, places)):
            yield i, size, [(s.strip().lower(), len(s) - s.count(" ")) for s in _SENTENCE.findall(lines[i])]


def _size(line: str) -> int:
    return len(line) - line.count(" ") - line.count("\t")


def prose_characters(text: str) -> tuple[int, int]:
    """Characters other than white space of a text, and those of them in running sentences.

    A sentence met before in the text doesn't count again.
    """
    lines = text.splitlines()
    seen: set[str] = set()
    prose = 0
    for _, size, sentences in prose_lines(lines):
        prose += size
        for key, length in sentences:
            if not key or len(key) >= REPEATED and key in seen:
                prose -= length
            seen.add(key)
    return sum(_size(line.strip()) for line in lines), prose


def part_prose(lines: list[str], first: int, last: int) -> tuple[int, dict[int, tuple[int, int]]]:
    """Prose of ``lines[first:last]`` aside from sentences that may be met again, and of these, by hash, the place and characters of the first."""
    import xxhash

    prose = 0
    found: dict[int, tuple[int, int]] = {}
    for i, size, sentences in prose_lines(lines, first, last):
        prose += size
        for place, (key, length) in enumerate(sentences):
            if not key or len(key) >= REPEATED:
                prose -= length
            if len(key) >= REPEATED:
                hashed = xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"))
                found.setdefault(hashed - (1 << 63), (((i - first) << 32) + place, length))
    return prose, found


def _is_prose(roles: str, cjk: int, size: int, near: list[tuple[str, int, int, int, bool, bool]]) -> bool:
    if cjk > 0.4 * size:
        chars = sum(n[1] for n in near)
        return sum(n[3] for n in near) >= chars / 60
    joined = "".join(n[0] for n in near)
    # short lines that each begin anew and end without a stop: menus and the like
    if len(near) > 3 and len(joined) <= 5 * len(near) and not any(n[4] for n in near) and sum(n[5] for n in near) < 0.5 * len(near):
        return False
    words = len(joined) - joined.count("o")
    if not words or roles.count("o") > 0.35 * len(roles) or words < 0.6 * len(joined):
        return False
    determiners, clauses = joined.count("d"), joined.count("c")
    helpers = determiners + clauses + joined.count("l") + joined.count("m")
    bad = sum(len(_BAD.findall(n[0])) for n in near)
    return helpers >= 0.25 * words and clauses >= 0.03 * words and bad <= max(1, 0.1 * determiners) and bad <= 0.3 * determiners


def chunk_counts(text: str, whole: bool = True) -> dict:
    """Partial counts of one chunk, and what a neighbour needs to correct them.

    The words at the two edges stay uncounted and are handed on as ``head`` and
    ``tail`` (length and, if short, text); a chunk without white space is one piece.
    Lines: those that end inside the chunk are counted, but for the first, whose
    beginning may lie in an earlier chunk.
    """
    words = text.split()
    starts, ends = text[:1].isspace(), text[-1:].isspace()
    solid = bool(text) and len(words) == 1 and not starts and not ends
    head = "" if starts or not words else words[0]
    tail = "" if ends or not words or solid else words[-1]
    inner = words[1 if head else 0 : len(words) - (1 if tail else 0)]
    lines = text.split("\n")
    marks = [line.rstrip()[-1:] for line in lines]
    spaces = sum(map(str.isspace, text))
    total = len(text) - spaces
    # the prose of a cut text is judged in parts of whole lines
    prose = min(total, prose_characters(text)[1]) if whole else 0
    return {
        "words": len(inner),
        "letters": sum(map(len, inner)),
        "common": sum(token_role(w) in _COMMON for w in inner),
        "symbols": len(text) - sum(map(str.isalnum, text)) - spaces,
        "characters": total,
        "prose": prose,
        "solid": solid,
        "head_length": len(head),
        "head": head if len(head) <= PIECE else None,
        "tail_length": len(tail),
        "tail": tail if len(tail) <= PIECE else None,
        "lines": sum(m != "" for m in marks[1:-1]),
        "ended": sum(m != "" and m in PUNCTUATION for m in marks[1:-1]),
        "breaks": len(lines) - 1,
        "first_mark": marks[0],
        "last_mark": marks[-1] if len(lines) > 1 else marks[0],
    }


_COMMON = frozenset("dlcm")
_SUMS = ("words", "letters", "common", "symbols", "characters", "prose", "lines", "ended")
_FIELDS = (
    "words long, letters long, common long, symbols long, characters long, prose long, solid boolean, head_length long, head string, "
    "tail_length long, tail string, lines long, ended long, breaks long, first_mark string, last_mark string"
)


def join_edges(states: list[dict]) -> dict:
    """Words and lines that the cuts between ordered chunks divide: what to add to the sums."""
    extra = dict.fromkeys(("words", "letters", "common", "lines", "ended"), 0)
    length, word = 0, ""
    mark = ""

    def close_word() -> None:
        nonlocal length, word
        if length:
            extra["words"] += 1
            extra["letters"] += length
            extra["common"] += word is not None and token_role(word) in _COMMON
        length, word = 0, ""

    def close_line() -> None:
        nonlocal mark
        extra["lines"] += mark != ""
        extra["ended"] += mark != "" and mark in PUNCTUATION
        mark = ""

    for s in states:
        length += s["head_length"]
        word = word + s["head"] if word is not None and s["head"] is not None and len(word) <= PIECE else None
        if not s["solid"]:
            close_word()
            length, word = s["tail_length"], s["tail"]
        mark = s["first_mark"] or mark
        if s["breaks"]:
            close_line()
            mark = s["last_mark"]
    close_word()
    close_line()
    return extra


def _columns(states: list[dict | None]) -> list[pa.Array]:
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    return [pa.array([s and s[n] for s in states], pa.string() if n in ("head", "tail", "first_mark", "last_mark") else pa.bool_() if n == "solid" else pa.int64()) for n in names]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    for batch in batches:
        states = [chunk_counts(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_columns(states)], ["key", "part", *names])


def _count_parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Counts of the chunks of cut texts; prose of their parts of lines, and a row for each sentence that may be met again."""
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    for batch in batches:
        rows, parts, hashes, places, states = [], [], [], [], []
        for row, (lined, part, text) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))):
            found = [(part, 0, 0, chunk_counts(text, whole=False))]
            if lined:
                first = min(part * size, AROUND)
                prose, sentences = part_prose(text.split("\n"), first, first + size)
                found = [(part, 0, 0, _EMPTY | {"prose": prose})]
                found += [(-1, h, ((part * size) << 32) + place, _EMPTY | {"prose": length}) for h, (place, length) in sentences.items()]
            for a, h, place, state in found:
                rows.append(row), parts.append(a), hashes.append(h), places.append(place), states.append(state)
        keys, lined = batch.column(0).take(pa.array(rows, pa.int64())), batch.column(1).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([keys, lined, pa.array(parts, pa.int32()), pa.array(hashes, pa.int64()), pa.array(places, pa.int64()), *_columns(states)], ["key", "lined", "part", "sentence", "place", *names])


_EMPTY = {f.split()[0]: 0 if f.split()[1] == "long" else None for f in _FIELDS.split(", ")}


def text_statistics(df: DataFrame, ids: str = "doc_id", texts: str = "text", chunk: int = CHUNK, part_lines: int = PART_LINES) -> DataFrame:
    """Statistics of every row's text.

    Gives the id as ``doc_id``, and ``words`` (runs without white space),
    ``mean_word_length``, ``symbol_ratio`` (characters neither letter, digit nor
    white space, over those not white space), ``ended_lines`` (share of lines with
    text that end in punctuation), ``common_words`` (share of frequent English and
    German words), ``prose_share`` (share of characters in running sentences) and
    ``kind``: ``empty``, ``prose``, or ``other`` where less than half is prose.
    Null, empty and blank texts have no words, null ratios and kind ``empty``.
    A repeated id gives a row for each of its rows.  Other columns are ignored.
    """
    rows = df.select(F.col(ids).alias("doc_id"), F.coalesce(F.col(texts).cast("string"), F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk).select(F.struct("doc_id", F.lit(None).cast("string").alias("row")).alias("key"), F.lit(0).alias("part"), "text")
    # only texts that are cut need a key for their row
    long = rows.where(F.length("text") > chunk).select(F.struct("doc_id", F.uuid().alias("row")).alias("key"), "text")
    parts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int"))
    chunks = F.transform(parts, lambda i: F.struct(F.lit(False).alias("lined"), i.alias("part"), F.substring(F.col("text"), i * chunk + 1, F.lit(chunk)).alias("text")))
    groups = F.sequence(F.lit(0), F.floor((F.size("split") - 1) / part_lines).cast("int"))
    start = lambda i: F.greatest(F.lit(0), i * part_lines - AROUND)
    around = lambda i: F.array_join(F.slice(F.col("split"), start(i) + 1, (i + 1) * part_lines + AROUND - start(i)), "\n")
    lines = F.transform(groups, lambda i: F.struct(F.lit(True).alias("lined"), i.alias("part"), around(i).alias("text")))
    # chunks and parts come from one pass, as the key of a row is made anew in each
    cut_up = long.withColumn("split", F.split("text", LINE_END, -1)).select("key", F.inline(F.concat(chunks, lines)))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"key struct<doc_id:{kind},row:string>, part int, {_FIELDS}"
    whole = _ratios(_edges(short.mapInArrow(_count, schema).select(F.col("key.doc_id"), *_SUMS, F.array(F.struct("part", *_EDGE)).alias("edges"))))
    fields = [f.split()[0] for f in _FIELDS.split(", ")]
    schema = f"key struct<doc_id:{kind},row:string>, lined boolean, part int, sentence long, place long, {_FIELDS}"
    counted = cut_up.mapInArrow(lambda batches: _count_parts(batches, part_lines), schema)
    # of the rows of one sentence the first is kept; all others are alone
    counted = counted.groupBy("key", "lined", "part", "sentence").agg(F.min_by(F.struct(*fields), "place").alias("counts")).select("key", "lined", "part", "counts.*")
    edges = F.array_sort(F.collect_list(F.when(~F.col("lined"), F.struct("part", *_EDGE)))).alias("edges")
    counted = counted.groupBy("key").agg(*[F.sum(c).alias(c) for c in _SUMS], edges).withColumn("prose", F.least("prose", "characters"))
    return whole.unionByName(_ratios(_edges(counted.select("key.doc_id", *_SUMS, "edges"))))


_EDGE = ("solid", "head_length", "head", "tail_length", "tail", "breaks", "first_mark", "last_mark")


def _edges(df: DataFrame) -> DataFrame:
    """Add what the edge states of each document amount to."""
    names = ("words", "letters", "common", "lines", "ended")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = {n: batch.column(n) for n in batch.schema.names}
            extra = [join_edges(e) for e in table["edges"].to_pylist()]
            for n in names:
                table[n] = pa.array([a + e[n] for a, e in zip(table[n].to_pylist(), extra)], pa.int64())
            yield pa.RecordBatch.from_arrays([table[n] for n in ("doc_id", *_SUMS)], ["doc_id", *_SUMS])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in _SUMS))


def _ratios(df: DataFrame) -> DataFrame:
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    prose: Column = share("prose", "characters")
    kind = F.when(F.col("characters") == 0, "empty").when(prose >= 0.5, "prose").otherwise("other")
    return df.select(
        "doc_id",
        "words",
        share("letters", "words").alias("mean_word_length"),
        share("symbols", "characters").alias("symbol_ratio"),
        share("ended", "lines").alias("ended_lines"),
        share("common", "words").alias("common_words"),
        prose.alias("prose_share"),
        kind.alias("kind"),
    )


def other_than_prose(df: DataFrame, ids: str = "doc_id", texts: str = "text") -> DataFrame:
    """Ids of the texts of which more than half isn't running text, each once."""
    return text_statistics(df, ids, texts).where("kind = 'other' and doc_id is not null").select("doc_id").distinct()
