import os

import pytest

from quarryline.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary files here")

TEXTS = [
    "", None, "   ", "a", "it's <|endoftext|> we'll\n\n\tgo  on", "x" * 5000, "不同的函数，100 次。", "naïve café — ½ ² 　end  \r\n", "🙂🙂 emoji‍", "\x00\x1c\x1f\x85 odd", "don't 'S don'ts 12a3 __x__", "a\n \n b   \n", "The the THE " * 50,
]


def test_ids_equal_the_whole_encoding_and_decode_back(spark):
    rows = [(i, t, "en", 1, "w") for i, t in enumerate(TEXTS)] + [(None, "null id", "en", 1, "w"), (3, "repeated id", "en", 1, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, word int, ids string")
    encoded = tokens.encode_corpus(df)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in encoded.collect())
    from tokenizers import Tokenizer

    # the same vocabulary in another library, over whole texts
    whole = Tokenizer.from_file(tokens.VOCABULARY.removesuffix("tiktoken") + "json")
    whole.encode_special_tokens = True
    want = sorted((i if i is not None else -1, whole.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows)
    assert got == want
    unique = encoded.where("doc_id is not null and doc_id != 3")
    assert {r.doc_id: r.text for r in tokens.decode_corpus(unique).collect()} == {i: t or "" for i, t in enumerate(TEXTS) if i != 3}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.encode_corpus(df).count() == 0 and tokens.vocabulary_use(df).count() == 0


def test_use_counts(spark):
    df = spark.createDataFrame([(1, "a a a"), (2, "a")], "doc_id long, text string")
    ids = tokens._tokenizer(tokens.VOCABULARY).encode_ordinary("a")
    found = {r.id: (r.uses, r.docs) for r in tokens.vocabulary_use(df).collect()}
    assert found[ids[0]] == (2, 2)


def test_decoding_of_odd_lists(spark, monkeypatch):
    monkeypatch.setattr(tokens, "DECODED_IDS", 3)
    a = tokens._tokenizer(tokens.VOCABULARY).encode_ordinary("añ")
    rows = [(1, a), (2, []), (3, None), (4, [None, *a, 10**8, -5]), (5, a[-1:]), (None, a * 9), (6, a), (7, [])]
    got = {r.doc_id: r.text for r in tokens.decode_corpus(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()}
    assert {i: got[i] for i in (1, 2, 3, 4, 6, 7)} == {1: "añ", 2: "", 3: None, 4: "añ", 6: "añ", 7: ""} and got[None] == "añ" * 9
    assert tokens.decode_corpus(spark.createDataFrame([], "doc_id long, ids array<int>")).count() == 0
