"""Encoding of a corpus with a public tokenizer through a table of distinct words.

Texts are split into words inside Spark tasks.  Each distinct word of the corpus
is encoded once.  Documents fall into hash blocks; a block gets the ids of its own
distinct words only, and the ids of a document are joined by the position of its
words.  So the words of the corpus are shuffled once per block, not once per use.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarryline.plans.lineage import cut, width

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pattern of the byte-level vocabulary, and its form for ASCII texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Characters of a block on average; its texts and distinct words fit in memory with ease.
BLOCK_CHARACTERS = 6_000_000


@lru_cache
def _splitters():
    import regex

    return re.compile(ASCII_PATTERN, re.ASCII).findall, regex.compile(PATTERN, regex.V1).findall


@lru_cache
def _ranks(path: str) -> dict[bytes, int]:
    """Pieces and ids of a rank file: a piece in base 64 and its id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(number) for piece, number in map(bytes.split, lines)}


@lru_cache
def _tokenizer(path: str):
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


def split_words(text: str) -> list[str]:
    """The words of a text, which joined give the text again."""
    plain, full = _splitters()
    return plain(text) if text.isascii() else full(text)


def _blocks(df: DataFrame, ids: str, texts: str) -> tuple[DataFrame, int]:
    docs = df.select(F.col(ids).alias("doc_id"), F.col(texts).cast("string").alias("text"))
    characters = docs.agg(F.sum(F.length("text") + 200).alias("n")).first()["n"] or 0
    blocks = 1 + characters // BLOCK_CHARACTERS
    # the text is part of the key, so that rows with one id or none still spread
    return docs.withColumn("block", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(blocks)).cast("int")), blocks


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each block among the rows of a task so far, given out when there are many."""
    words: dict[int, set[str]] = {}

    def flush() -> pa.RecordBatch:
        sizes = [len(v) for v in words.values()]
        blocks = np.repeat(np.array(list(words), "int32"), sizes)
        return pa.RecordBatch.from_arrays([pa.array(blocks), pa.array([w for v in words.values() for w in v], pa.string())], ["block", "word"])

    held = 0
    for batch in batches:
        for block, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                own = words.setdefault(block, set())
                before = len(own)
                own.update(split_words(text))
                held += len(own) - before
                if held > 500_000:
                    yield flush()
                    words, held = {}, 0
    if held:
        yield flush()


def encode_corpus(df: DataFrame, ids: str = "doc_id", texts: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Ids of every row's text under the rank file ``vocabulary``, as ``doc_id, ids``.

    No special tokens are added, and their strings in a text are ordinary text.  A
    null text and an empty text both give an empty list.  Every row gives a row,
    also one with a null or repeated id.  Other columns are ignored.
    """
    docs, blocks = _blocks(df, ids, texts)
    # as blocks are dealt by hash, twice as many partitions keep them apart
    parts = max(width(df.sparkSession), 2 * blocks)
    # written once: both the encoding and the join read it
    by_block = cut(docs.select("block", "text").mapInArrow(_words, "block int, word string").distinct())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_word = _tokenizer(vocabulary).encode_ordinary
        for batch in batches:
            codes = [array("i", encode_word(w)).tobytes() for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], ["word", "code"])

    encoded = by_block.select("word").distinct().mapInArrow(encode, "word string, code binary")

    def place(texts_: pa.Table, words: pa.Table) -> pa.Table:
        code = dict(zip(words.column("word").to_pylist(), words.column("code").to_pylist())).__getitem__
        flat, ends = bytearray(), array("i", [0])
        for text in texts_.column("text").to_pylist():
            if text:
                flat += b"".join(map(code, split_words(text)))
            ends.append(len(flat) // 4)
        lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, "int32")), pa.Array.from_buffers(pa.int32(), len(flat) // 4, [None, pa.py_buffer(flat)]))
        return pa.table({"doc_id": texts_.column("doc_id"), "ids": lists})

    kind = docs.schema["doc_id"].dataType.simpleString()
    dictionary = by_block.join(encoded, "word").repartition(parts, "block")
    return docs.repartition(parts, "block").groupBy("block").cogroup(dictionary.groupBy("block")).applyInArrow(place, f"doc_id {kind}, ids array<int>")


@lru_cache
def _pieces(path: str) -> pa.BinaryArray:
    """The pieces of a rank file at the places of their ids; ids without one and the last place hold nothing."""
    ranks = _ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 2)
    for piece, number in ranks.items():
        table[number] = piece
    return pa.array(table, pa.binary())


#: Ids that are joined with their pieces at once.
DECODED_IDS = 4_000_000


def decode_corpus(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Texts of ``doc_id, ids``, as ``doc_id, text``: each id is joined with its piece where it stands, so nothing is shuffled.

    An empty list gives an empty text; a null list gives null; nulls and ids
    outside the vocabulary give nothing.  Bytes that are no UTF-8 become U+FFFD.
    The vocabulary's table is of fixed size; a task reads it once.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(vocabulary)
        for batch in batches:
            ends = np.r_[0, np.cumsum(np.asarray(batch.column(1).value_lengths().fill_null(0)))]
            start = 0
            while start < batch.num_rows:
                # as many rows as stay within the bound, and one at least
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + DECODED_IDS, "right")) - 1)
                part = batch.slice(start, stop - start)
                ids = np.asarray(part.column(1).flatten().fill_null(-1))
                ids = np.where((ids >= 0) & (ids < len(pieces)), ids, len(pieces) - 1)
                joined = pieces.take(pa.array(ids))
                places = np.frombuffer(joined.buffers()[1], "int32")[: len(ids) + 1] if len(ids) else np.zeros(1, "int32")
                offsets = np.ascontiguousarray(places[ends[start : stop + 1] - ends[start]])
                data = joined.buffers()[2] if len(ids) else pa.py_buffer(b"")
                missing = np.asarray(part.column(1).is_null())
                texts = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(offsets), data])
                yield pa.RecordBatch.from_arrays([part.column(0), texts, pa.array(missing)], ["doc_id", "data", "missing"])
                start = stop

    kind = encoded.schema["doc_id"].dataType.simpleString()
    decoded = encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(decode, f"doc_id {kind}, data binary, missing boolean")
    return decoded.select("doc_id", F.when(~F.col("missing"), F.decode("data", "UTF-8")).alias("text"))


def vocabulary_use(df: DataFrame, ids: str = "doc_id", texts: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """How often each id occurs in the corpus, and in how many documents: ``id, uses, docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a batch gives one row an id, so the vocabulary bounds what is shuffled
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten().to_numpy().astype("int64")
            rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            uses, docs = np.bincount(flat), np.bincount(np.unique(rows << 32 | flat) & 0xFFFFFFFF)
            found = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype("int32")), pa.array(uses[found]), pa.array(docs[found])], ["id", "uses", "docs"])

    encoded = encode_corpus(df, ids, texts, vocabulary).select("ids")
    return encoded.mapInArrow(count, "id int, uses long, docs long").groupBy("id").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"))
