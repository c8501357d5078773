import random

from quarryline.llm import leaks

CORPUS = "doc_id long, text string, item_id int, windows string"
ITEMS = "item_id long, task string, text string, doc_id string"


def places(docs, items, least):
    """doc, item: windows, longest verbatim match, and its first place in both."""
    found = {}
    for item, text in items:
        held = leaks.words_of(text or "")
        for doc, body in docs:
            words = leaks.words_of(body or "")
            if item is None or doc is None:
                continue
            matches = {}
            for p in range(len(words)):
                for q in range(len(held)):
                    n = 0
                    while p + n < len(words) and q + n < len(held) and words[p + n] == held[q + n]:
                        n += 1
                    if n >= least:
                        matches.setdefault(p, []).append((-n, p, q))
            if matches:
                best = min(m for all_ in matches.values() for m in all_)
                found[doc, item] = (len(matches), -best[0], best[1], best[2])
    return found


def brute(docs, items, least):
    found = set()
    for item, text in items:
        words = leaks.words_of(text or "")
        grams = {tuple(words[i : i + least]) for i in range(len(words) - least + 1)}
        for doc, body in docs:
            w = leaks.words_of(body or "")
            if item is not None and doc is not None and any(tuple(w[i : i + least]) in grams for i in range(len(w) - least + 1)):
                found.add((doc, item))
    return found


def run(spark, docs, items, least=5):
    corpus = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], CORPUS)
    held = spark.createDataFrame([(i, "t", t, "y") for i, t in items], ITEMS)
    return leaks.leaked_passages(corpus, held, least), corpus, held


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leaks, "SHARD_WORDS", 300)
    pick = random.Random(2)
    word = lambda: pick.choice("alpha beta gamma delta eps zeta Straße _x 12".split())
    items = [(i, " ".join(word() for _ in range(pick.randrange(3, 40)))) for i in range(12)] + [(50, None), (51, ""), (None, "alpha beta gamma delta eps"), (52, "a a a a a a a a a a")]
    docs = []
    for i in range(60):
        body = [word() for _ in range(pick.randrange(0, 60))]
        if i % 3 == 0:
            w = leaks.words_of(items[i % 12][1])
            body[3:3] = w[: pick.randrange(2, 9)]
        docs.append((i, ",\n ".join(body).upper()))
    docs += [(100, None), (101, ""), (None, docs[0][1]), (102, "a " * 5000), (103, docs[3][1]), (103, docs[3][1])]
    got = run(spark, docs, items)[0].collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items, 5) and len(got) == len({(r.doc_id, r.item_id) for r in got})
    # a document longer than the item repeats it, but no match is longer than the item
    assert next((r.windows, r.longest) for r in got if r.doc_id == 102) == (4996, 10)
    alone = [(d, t) for d, t in docs if d not in (102, 103)]
    assert {(r.doc_id, r.item_id): (r.windows, r.longest, r.doc_at, r.item_at) for r in got if r.doc_id not in (102, 103)} == places(alone, items, 5)


def test_passages_side_by_side_are_no_longer_match(spark):
    a, b = ([f"{x}{i}" for i in range(15)] for x in "ab")
    items = [(1, " ".join([*a, "between", *b])), (1, "another text of this id"), (2, " ".join(a + b))]
    found = run(spark, [(5, " ".join(["z", *a, *b])), (6, " ".join(a))], items, 15)[0].collect()
    assert {tuple(r) for r in found} == {(5, 1, 2, 15, 1, 0), (5, 2, 16, 30, 1, 0), (6, 1, 1, 15, 0, 0), (6, 2, 1, 15, 0, 0)}


def test_many_passes_and_clean(spark, monkeypatch):
    monkeypatch.setattr(leaks, "PASS_WORDS", 3)
    docs, items = [(1, "one two three four five six"), (2, "nothing here at all, really"), (None, "x")], [(7, "ONE-two three; four five"), (8, "six five four three two one")]
    found, corpus, held = run(spark, docs, items)
    assert {tuple(r) for r in found.collect()} == {(1, 7, 1, 5, 0, 0)}
    assert {r.doc_id for r in leaks.clean_corpus(corpus, held, 5).collect()} == {2, None}
    assert [tuple(r) for r in leaks.leak_report(corpus, held, 5).collect()] == [(7, 1, 1, 5)]


def test_empty(spark):
    assert run(spark, [], [(1, "a b c d e")])[0].count() == 0
    assert run(spark, [(1, "a b c d e")], [])[0].count() == 0
