"""Passages of held-out texts inside a corpus, found with suffix arrays of the corpus.

Each task builds the suffix arrays of its shards of the corpus, a shard being about
``SHARD_WORDS`` words.  Suffixes are sorted by prefix doubling, together with those of
the held-out texts so that both have ranks in one order; stretches of the corpus
between words foreign to every held-out text that are too short to match stay out.
Every suffix of the held-out texts is looked up in each array by binary search, and
every place found is extended to the longest verbatim match with its item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarryline.plans.lineage import cut

LEAST_WORDS = 15
SHARD_WORDS = 1_000_000
#: Held-out words that one pass over the corpus carries; more of them take more passes.
PASS_WORDS = 2_000_000

_WORD = re.compile(r"\w+")
_COLUMNS = ["doc_id", "item_id", "windows", "longest", "doc_at", "item_at"]


def words_of(text: str) -> list[str]:
    """Maximal runs of letters, digits and underscores, case folded."""
    found = _WORD.findall(text)
    return " ".join(found).casefold().split(" ") if found else []


def doubled_ranks(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4.. words, up to ``longest`` or more; a last entry stands for the end."""
    ranks = [np.r_[words.astype("int64"), -1]]
    size, n = 1, len(words)
    while size < longest:
        last = ranks[-1]
        after = last[np.minimum(np.arange(n) + size, n)]
        _, rank = np.unique((last[:-1] << 32) | (after + 1), return_inverse=True)
        ranks.append(np.r_[rank, -1])
        size *= 2
    return ranks


def common_length(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``a`` and ``b`` share, at least as far as the ranks reach."""
    shared, n = np.zeros(len(a), "int64"), len(ranks[0]) - 1
    for level in range(len(ranks) - 1, -1, -1):
        rank = ranks[level]
        shared += (rank[np.minimum(a + shared, n)] == rank[np.minimum(b + shared, n)]) * (1 << level)
    return shared


class _Shards:
    """The held-out texts of one pass, and the search for them in shards of the corpus."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least, self.vocabulary = least, {}
        # 0 ends a text; the texts of a repeated id are one item
        texts: dict[int, list[int]] = {}
        for item, text in items:
            texts.setdefault(item, []).extend([*(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)), 0])
        self.ids, self.texts = list(texts), [np.array(t, dtype=">u4") for t in texts.values()]
        self.words = np.concatenate(self.texts).astype("int64") if texts else np.zeros(0, "int64")
        self.owner = np.repeat(np.arange(len(texts)), [len(t) for t in self.texts])
        stops = np.flatnonzero(self.words == 0)
        self.left = stops[np.searchsorted(stops, np.arange(len(self.words)))] - np.arange(len(self.words))
        self.longest = int(self.left.max(initial=0))

    def matches(self, docs: list[int], texts: list[list[str]]) -> tuple[list, ...]:
        """doc, item, matched windows, longest match and where it begins in both, of one shard."""
        nothing = ([],) * 6
        get, least = self.vocabulary.get, self.least
        lengths = np.array([len(t) for t in texts])
        words = np.fromiter((get(w, 0) for t in texts for w in [*t, ""]), dtype="int64", count=int(lengths.sum()) + len(texts))
        # 0 stands for unknown words and ends; only longer stretches between them can match
        stops = np.flatnonzero(words == 0)
        left = stops[np.searchsorted(stops, np.arange(len(words)))] - np.arange(len(words))
        run_start = np.r_[0, stops[:-1] + 1]
        long = np.repeat(stops - run_start >= least, stops - run_start + 1)
        place = np.flatnonzero(long)
        if not len(place) or self.longest < least:
            return nothing
        n = len(place)
        ranks = doubled_ranks(np.r_[words[place], self.words], self.longest)
        final, left = ranks[-1], left[place]
        # the suffix array of the shard, and the order of first words that its order refines
        array = np.flatnonzero(left >= least)
        array = array[np.argsort(final[array], kind="stable")]
        level = (least - 1).bit_length() - 1 if least > 1 else 0
        end = len(final) - 1
        opening = lambda at: ranks[level][at] << 32 | ranks[level][np.minimum(at + least - (1 << level), end)]
        held = np.flatnonzero(self.left >= least)
        openings, wanted = opening(array), opening(held + n)
        first, last = np.searchsorted(openings, wanted, "left"), np.searchsorted(openings, wanted, "right")
        hit = np.flatnonzero(last > first)
        if not len(hit):
            return nothing
        # one entry per distinct passage of an item, so that repeated passages don't multiply
        spans = np.unique(np.stack([self.owner[held[hit]], first[hit], last[hit]], axis=1), axis=0)
        sizes = spans[:, 2] - spans[:, 1]
        item = np.repeat(spans[:, 0], sizes)
        offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = array[np.repeat(spans[:, 1], sizes) + offset]
        # the longest match at a place is with one of the item's two suffixes next to it in the order
        keys = self.owner[held] * (end + 1) + final[held + n]
        order = np.argsort(keys, kind="stable")
        keys, held = keys[order], held[order]
        near = np.searchsorted(keys, item * (end + 1) + final[at])
        length = np.zeros(len(at), "int64")
        for side in (near - 1, near):
            other = held[np.clip(side, 0, len(held) - 1)]
            shared = np.minimum(np.minimum(common_length(ranks, at, other + n), left[at]), self.left[other])
            length = np.maximum(length, np.where(self.owner[other] == item, shared, 0))
        doc = np.searchsorted(np.cumsum(lengths + 1), place[at], "right")
        by = np.lexsort((place[at], -length, item, doc))
        doc, item, at, length = doc[by], item[by], at[by], length[by]
        pair = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
        windows = np.diff(np.r_[pair, len(at)])
        ends = np.cumsum(lengths + 1)
        doc_at = place[at[pair]] - (ends - lengths - 1)[doc[pair]]
        item_at = [self._place(i, words[p : p + m]) for i, p, m in zip(item[pair], place[at[pair]], length[pair])]
        return [docs[i] for i in doc[pair]], [self.ids[i] for i in item[pair]], windows.tolist(), length[pair].tolist(), doc_at.tolist(), item_at

    def _place(self, item: int, passage: np.ndarray) -> int:
        """The first word of an item at which a passage of it begins."""
        text, wanted = self.texts[item].tobytes(), passage.astype(">u4").tobytes()
        at = text.find(wanted)
        while at % 4:
            at = text.find(wanted, at + 1)
        return at // 4


def leaked_passages(corpus: DataFrame, items: DataFrame, least: int = LEAST_WORDS, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """Documents that hold at least ``least`` consecutive words of an item.

    Gives ``doc_id, item_id, windows, longest, doc_at, item_at``: the positions in the
    document at which such a passage begins, the words of the longest verbatim match,
    and the words before it in the document and in the item (the first such place).
    Null ids and null, empty or short texts match nothing.  A repeated document
    id gives the sums over its rows.  Extra columns are ignored.  The items are
    the held-out side; they are carried in passes of a bounded number of words,
    one pass at a time, so that no more of them are ever in the driver.
    """
    held = items.select(F.col(item).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where("item_id is not null and text is not null")
    size = held.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    passes = 1 + size // PASS_WORDS
    docs = corpus.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    parts = []
    for number in range(passes):
        chosen = held.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number) if passes > 1 else held
        rows = [(r["item_id"], r["text"]) for r in chosen.toLocalIterator()]

        def find(batches: Iterator[pa.RecordBatch], rows: list = rows) -> Iterator[pa.RecordBatch]:
            held_out = _Shards(rows, least)
            ids: list[int] = []
            texts: list[list[str]] = []
            held_words = 0

            def shard() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held_out.matches(ids, texts)], _COLUMNS)

            for batch in batches:
                for one, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    words = words_of(body)
                    if len(words) < least:
                        continue
                    ids.append(one)
                    texts.append(words)
                    held_words += len(words)
                    if held_words >= SHARD_WORDS:
                        yield shard()
                        ids, texts, held_words = [], [], 0
            if ids:
                yield shard()

        part = docs.mapInArrow(find, ", ".join(f"{c} long" for c in _COLUMNS))
        parts.append(cut(part) if passes > 1 else part)
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    first = F.min(F.struct(-F.col("longest"), "doc_at", "item_at")).alias("first")
    found = found.groupBy("doc_id", "item_id").agg(F.sum("windows").alias("windows"), F.max("longest").alias("longest"), first)
    return found.select("doc_id", "item_id", "windows", "longest", "first.doc_at", "first.item_at")


def clean_corpus(corpus: DataFrame, items: DataFrame, least: int = LEAST_WORDS, doc: str = "doc_id") -> DataFrame:
    """The corpus without the documents that hold a passage; rows with a null id stay."""
    leaked = leaked_passages(corpus, items, least, doc).select(F.col("doc_id").alias("_leaked")).distinct()
    return corpus.join(leaked, corpus[doc] == leaked["_leaked"], "left_anti")


def leak_report(corpus: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """For every item with a leak: ``item_id, docs, windows, longest``."""
    found = leaked_passages(corpus, items, least)
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"), F.sum("windows").alias("windows"), F.max("longest").alias("longest"))
