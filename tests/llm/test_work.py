"""The string stages of the overlaps and the name models: whole batches at once, with the results of plain loops."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from quarryline.llm import grammars, overlaps, provenance


def strings(pick, rows):
    return [[pick.randrange(-9, 9) for _ in range(pick.choice((0, 1, 1, 2, 3, 4, 5, 17, 40)))] for _ in range(rows)]


def test_segments_of_a_batch_at_once(monkeypatch):
    pick = random.Random(6)
    own = strings(pick, 200)
    hot = [sorted(pick.sample(range(len(s)), len(s) // 3)) or None for s in own]
    mixed, mix = [], overlaps._mix
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(own)), pa.int64()), pa.array(own, pa.list_(pa.int64())), pa.array(hot, pa.list_(pa.int32()))], ["key", "string", "hot"])
    # a slice, whose arrays don't begin at their buffers' start
    own, hot, batch = own[7:], hot[7:], batch.slice(7)
    monkeypatch.setattr(overlaps, "_mix", lambda values: mixed.append(len(values)) or mix(values))
    for evaluation in (False, True):
        mixed.clear()
        out = list(overlaps._pieces(evaluation)(iter([batch, batch.slice(0, 0)])))
        found = Counter(zip(*(sum((b.column(i).to_pylist() for b in out), []) for i in range(4))))
        assert len(mixed) <= len(overlaps._LENGTHS), "hashes are mixed once for each length, however many strings a batch holds"
        wanted: Counter = Counter()
        for key, (string, marks) in enumerate(zip(own, hot), 7):
            n = len(string)
            spans = overlaps.cuts(n, set(marks or ())) if evaluation else [(s, s + k) for k in (1, 2, 3, 4) for s in range(n - k + 1) if k > 1 or n == 1]
            wanted.update((mix(np.array([string[s:e]])).tolist()[0], key, s, n) for s, e in spans)
        assert found == wanted and sum(found.values()) == sum(mixed)


def plain_statements(text):
    """Statements and names by one token after another."""
    code = re.sub(r'//(?:\\\n|[^\n])*|/\*.*?\*/|("(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\')', lambda m: m.group(1) or " ", text, flags=re.S)
    brace = code.find("{")
    code = overlaps._HEADER_NAME.sub(" ", code[:brace] if brace >= 0 else code, count=1) + (code[brace:] if brace >= 0 else "")
    words = overlaps._PIECE.findall(code)
    named = [w[:-1].rstrip() if w[-1] == "(" else w for w in words]
    named = [n if (n[:1].isalpha() or n[:1] == "_") and ":" not in n and n not in overlaps.KEYWORDS else None for n in named]
    local = [bool(n and w == n and overlaps._LOCAL.match(n)) for w, n in zip(words, named)]
    declared = overlaps.declared(code, {n for n, own in zip(named, local) if n and not own})
    pieces, owned, piece, names, depth = [], [], "", [], 0
    for word, name, own in zip(words, named, local):
        if own or name in declared:
            names.append(name)
            word = "\x01(" if word[-1] == "(" else "\x01"
        for sign in "".join(word.split()):
            depth += (sign == "(") - (sign == ")")
            if sign in "{};" and depth <= 0:
                depth = 0
                if piece:
                    pieces.append(piece)
                    owned.append(names)
                piece, names = "", []
            else:
                piece += sign
    return (pieces + [piece], owned + [names]) if piece else (pieces, owned)


BODY = """int Owner::run(int count, const Row &Limit, const std::vector<Row>& rows) {
  // a comment; with { signs
  auto Copy = m_Table [count + .5f]; "text; // no { comment"; char c = 'x';
  for (int I = 0; I < Limit.size (); ++I) { m_sum->add(rows[I] , 1.5e3); ::free  (count); a::b::c(count); }
  auto Visit = [Kept = count](Row* Each) { return Each -> next(Kept); };
  if (Visit (rows)) return Visit\n(rows) + TOTAL; }
  ) ; Left(count;
"""


def test_statements_as_token_by_token():
    for text in (BODY, BODY.replace("Copy", "Copié").replace("text", "é ü"), "", "{}", "int f(", BODY.replace("\n", "\x1f\n\v"), 'x("a\\"b;c");' * 3, "a.b . c->d ::e::~f 1.e+5 0x1p3 .5.x"):
        assert overlaps.statements(text) == plain_statements(text)


def test_dense():
    for text in ("", " a\tb\x0b\x0c\r\n\x1c\x1d\x1e\x1fc ", "a\u00a0b\u3000c\x85d e"):
        assert overlaps.dense(text) == "".join(text.split())


def test_words_are_still_kept_when_full():
    words = overlaps._Words(lambda word: word)
    words.update(dict.fromkeys(map(str, range(300_000))))
    assert words["fresh"] == "fresh" and "fresh" in words


def test_trigrams_and_styles_as_by_loops():
    names = Counter({"a": 3, "_": 1, "camelCase": 4, "snake_case": 2, "Übergröße": 5, "aaaa": 7, "A_B": 1, "x1": 2} | {f"name_{i}": i + 1 for i in range(70_000)})
    wanted: Counter = Counter()
    for name, n in names.items():
        folded = provenance._folded(name)
        for i in range(len(folded) - 2):
            wanted[folded[i : i + 3]] += n
    assert provenance.trigrams(names) == wanted and provenance.trigrams(Counter()) == Counter()
    traits = [(provenance.name_traits(name), n) for name, n in names.items()]
    assert provenance.styled(names) == (sum(n for t, n in traits if t[2]), sum(n for t, n in traits if t[3]))


def test_statement_hints_in_any_case():
    texts = ["select a", "x.select (a)", "Insert  INTO t", "preselect a", "update t\nset x", "update(t); set", "DROP x", "dropx", "delete from", "delete p;", "é alter table", "create or Replace", "_drop a"]
    plain = re.compile(r"(?i:\b(?:select\s+[\w*]|insert\s+into|update\s+\w+\s+set|create\s+\w+\s+\w|delete\s+from|alter\s+table|drop\s+\w))")
    assert [bool(grammars._SQL.search(t)) for t in texts] == [plain.search(t) is not None for t in texts]
