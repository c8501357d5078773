"""Syntax, provenance and overlaps of source files."""

import random

import pytest

from quarryline.llm import overlaps, provenance, syntax
from quarryline.llm.grammars import classify

FILES = "file_id long, project string, corpus string, cppFile string, func_src array<string>, split string, text string, repository int, verdict string"

VALID = [
    "int f(int a) { return a; }",
    'const char* s = "<<<<<<< x ======= }}";\n/* >>>>>>> { */\n// =======\n',
    "void g() {\n#ifdef A\n  if (x()) {\n#else\n  if (y) {\n#endif\n  h();\n  }\n}",
    "auto v = []<typename T>(T&& v) requires requires { v.f(); } { return v.f(); };",
    'static const char* p = R"py(def f(x): return {x: [)py";',
    "FOO_DECLARE(a, b)\nint x = 1'000'000;",
    "Foo& operator=(const Foo&) = default; auto l = [=] { return a + 1.; };",
    "char c = '{'; int d = '\\'';",
    "template <class... A> void f(A&&... a) { g(a...); }",
    "#define X(a) \\\n  (a)\nint y;",
    "import foo.bar;\nint z;",
]
CORRUPT = ["int f() {\n  g(", "int f() { g(a; }", "int f() {}}", "int f() {\n<<<<<<< HEAD\n  a();\n=======\n  b();\n>>>>>>> x\n}", 'int f() { s = "open\n; }', "int f() { /* open }", "int f() { } */", "#ifdef A\nint f() { }", "int f() { a = ; }", "static v", "int f() { return @; }"]
FOREIGN = {
    "python": "import os\n\ndef f(a, limit=None):\n    x = a[:3]\n    return x\n",
    "shell": '#!/bin/sh\nset -e\nexport A=${B:-c}\nif [ -z "$x" ]; then y --z; fi\n',
    "markup": "<!DOCTYPE html>\n<html><body>\n<li>a</li>\n</body></html>\n",
    "diff": "--- a/x.cc\n+++ b/x.cc\n@@ -1,2 +1,2 @@\n-  a(b);\n+  c(d);\n",
    "json": '{\n  "a": null,\n  "b": [1, 2]\n}\n',
    "markdown": "# Title\n\nRun `x` if you want; it's safe, but don't.\n",
}


@pytest.mark.parametrize("text", VALID)
def test_valid(text):
    assert classify(text) == ("valid", "c++")


@pytest.mark.parametrize("text", CORRUPT)
def test_corrupt(text):
    assert classify(text)[0] == "corrupt"


@pytest.mark.parametrize("language", FOREIGN)
def test_foreign(language):
    assert classify(FOREIGN[language]) == ("foreign", language)


#: Texts whose brackets balance, so that the structure alone would pass as C++.
BALANCED = {
    "script": "const fs = require('fs');\n\nfunction load(path, done) {\n  let text = fs.read(path);\n  if (text === null) {\n    return done();\n  }\n  return text.map((x) => x.trim());\n}\n",
    "rust": "use crate::table;\n\npub fn total(rows: &[i64], least: i64) -> i64 {\n    let mut sum = 0;\n    for row in rows {\n        if *row > least {\n            sum += row;\n        }\n    }\n    sum\n}\n",
    "csharp": "using System;\nusing System.Linq;\n\nnamespace Shop.Core {\n  public class Cart {\n    public int Count { get; set; }\n    private void Clear() {\n      Count = 0;\n    }\n  }\n}\n",
    "java": "package shop.core;\n\nimport java.util.List;\n\npublic final class Cart {\n  private int count;\n  public void clear() {\n    count = 0;\n  }\n}\n",
    "go": "package main\n\nfunc total(rows []int, least int) int {\n\tsum := 0\n\tfor _, r := range rows {\n\t\tsum += r\n\t}\n\treturn sum\n}\n",
    "css": ".menu a {\n  color: red;\n  margin: 0 auto;\n}\nbody {\n  font-size: 12px;\n}\n",
    "sql": "CREATE TABLE orders (id INTEGER, name VARCHAR(20));\nINSERT INTO orders VALUES (1, 'a');\nSELECT id, name\nFROM orders\nWHERE id > 3;\n",
    "proto": 'syntax = "proto3";\n\nmessage Row {\n  string name = 1;\n  repeated int64 sizes = 2;\n}\n',
}


@pytest.mark.parametrize("language", BALANCED)
def test_balanced_foreign(language):
    assert classify(BALANCED[language])[0] == "foreign"


@pytest.mark.parametrize("text", ["function f(a, b) { return a; }", "fn main() { run(); }", "def f(a) { b(); }", "#!/bin/sh\nrun() {\n  make all;\n}\n"])
def test_foreign_heads(text):
    assert classify(text)[0] != "valid"


@pytest.mark.parametrize(
    "text",
    [
        "class A : public B {\npublic slots:\n  void f();\nprivate:\n  int a;\n};",
        "using A = int;\nusing std::swap;\nusing namespace x::y;\nvoid f(var v) { let(v); v.select(a, from); }",
        "// function f(a) { let x = 1; }\n/* SELECT a FROM b */\nint f() { return g([](int x) -> int { return x; }); }",
        "struct Css { int width : 3; int color : 2; };\nint f(int k) { switch (k) { default: return 0; } }",
        'const char* q() {\n  return R"(SELECT a\nFROM b\nWHERE c = 1)";\n}',
    ],
)
def test_valid_with_foreign_words(text):
    assert classify(text) == ("valid", "c++")


def row(i, functions, path="src/a.cc", split="train", project="p"):
    return (i, project, "project", path, functions, split, "x", 1, "y")


def test_syntax_operator(spark):
    rows = [row(1, [VALID[0]]), row(2, [CORRUPT[0], None]), row(2, [CORRUPT[0], None]), row(3, None), row(4, []), row(5, [None, " "]), row(6, [FOREIGN["json"]], None), row(None, [CORRUPT[0]]), row(7, ["int a;" * 20000])]
    df = spark.createDataFrame(rows, FILES)
    assert sorted(r.file_id for r in syntax.unparsable_files(df).collect()) == [2, 6]
    evidence = spark.createDataFrame([(2, "failed", [(1, 2)], 0, None)], "file_id long, status string, error_ranges array<struct<start_byte long, end_byte long>>, macro_related_error_count int, scanned_at timestamp")
    lexical = spark.createDataFrame([(2, False), (1, True), (None, None)], "file_id long, parse_valid boolean")
    report = {(r.repository, r.language): (r.files, r.invalid) for r in syntax.syntax_report(df, evidence, lexical).collect()}
    assert report[("project:p", "c++")] == (3, 1)
    assert syntax.unparsable_files(spark.createDataFrame([], FILES)).count() == 0


def function(pick, name, n=14):
    words = "alpha beta gamma delta omega sigma kappa theta".split()
    shapes = ["m_{a}Value.{b}Thing(count, {n}, limit);", "auto {a}Copy = m_{b}Table[count + {n}];", "if (count > {n}) return {a}Other(limit);", "++m_{a}Total; {b}Queue.push(limit, count);", "while (m_{a}Next(count) && {n} < limit.size()) m_{b}Step();", "m_{a}Flags |= {b}Mask & ~count; log(\"{a} {b}\", {n});", "delete m_{a}Old; m_{b}Old = nullptr;", "for (int i = {n}; i < limit; ++i) m_{a}Sum += {b}Part(i);"]
    lines = ["  " + pick.choice(shapes).format(a=pick.choice(words), b=pick.choice(words), n=pick.randrange(10**6)) for _ in range(n)]
    return f"int Owner::{name}(int count, const Row& limit) {{\n" + "\n".join(lines) + "\n  return count;\n}", lines


def test_provenance_operator(spark):
    pick = random.Random(4)
    plain = [row(i, [function(pick, f"runThing{i}")[0], function(pick, f"stopThing{i}")[0]], f"src/file{i}.cc") for i in range(40)]
    code = [function(pick, "anyThing")[0]]
    cases = [
        row(101, code, "third_party/zlib/a.cc"),
        row(102, ["// Generated by tool from a.idl. Do not edit by hand.\n" + code[0]]),
        row(103, ["const unsigned char* d() {\n static const unsigned char d[] = {\n" + "  0x2f,0x83,0x3f,0x30,0xd6,0xee,0x1f,0x57,\n" * 12 + " };\n return d;\n}"]),
        row(104, ["".join(f"int a{i}(int a){{b(a);c=a<3?d:e(a);if(c>a)return f(a);}}" for i in range(30))]),
        row(105, ["int lex(C* c) {\n" + "\n".join(f"  yy_state_{i}: if (yych == {i * 3}) goto yy_state_{i * 7}; yy_f({i});" for i in range(30)) + "\n}"]),
        row(106, ["/* zed is distributed under its own licence; vendored snapshot 2022-04 */\n" + code[0]]),
        row(107, code, "src/ui_panel.h"),
    ]
    decoys = [
        row(201, ['// Emits generated code for the caller, never edit the order of passes.\n' + code[0]], "src/generator/a.cc"),
        row(202, ["// Vendors may override this hook; see the vendor table.\n" + code[0]], "src/vendor_id/b.cc"),
        row(203, ['int f() {\n  out << "// DO NOT EDIT, generated file";\n  return 0;\n}'], "core/build_info/c.cc"),
        row(204, [code[0]], "src/external_sort/d.cc"),
        row(205, [FOREIGN["markup"]]),
        row(206, None),
        row(None, code, "vendor/x.cc"),
    ]
    df = spark.createDataFrame(plain + cases + cases[:2] + decoys, FILES)
    assert sorted(r.file_id for r in provenance.not_hand_written(df).collect()) == [101, 102, 103, 104, 105, 106, 107]
    report = provenance.provenance_report(df).collect()
    assert sum(r.files for r in report) == 52 and sum(r.hand_written for r in report) == 45
    assert provenance.not_hand_written(spark.createDataFrame([], FILES)).count() == 0


def test_notice_after_a_long_licence():
    licence = "/*\n" + " * Permission is granted to anyone to use this software for any purpose.\n" * 120 + " */\n"
    body = "int f(int a) {\n  return a;\n}\n"
    assert len(licence) > 4000
    for notice, key in (("// Code generated by tool. DO NOT EDIT.\n", "comment_generated"), ("// vendored copy of zed\n", "comment_vendored")):
        assert provenance.describe("src/a.cc", licence + notice + body, {})[key]
        assert not provenance.describe("src/a.cc", licence + body + notice, {})[key]


def brute(rows):
    """All pairs of functions, with the verification alone."""
    sides = [(i, overlaps_side, f) for i, _, _, _, fs, split, *_ in rows if i is not None and (overlaps_side := side(split)) for f in fs or () if f and len("".join(f.split())) >= 200]
    prepared = [(i, s, *overlaps.statements(f)) for i, s, f in sides]
    pairs = set()
    for i, s, p, o in prepared:
        for j, t, q, r in prepared:
            if s == "e" and t == "t" and i != j and overlaps.same_function([overlaps._hash64(x) for x in p], o, [overlaps._hash64(x) for x in q], r):
                pairs.add((min(i, j), max(i, j)))
    return pairs


def side(split):
    name = (split or "").strip().lower()
    return "t" if name in ("train", "training") else "e" if name in ("val", "valid", "dev", "validation", "test") else None


def test_overlaps_match_brute_force(spark):
    pick = random.Random(8)
    rows = []
    for i in range(30):
        text, lines = function(pick, f"doThing{i}", n=pick.randrange(4, 26))
        rows.append(row(i * 10, [text], f"src/a{i}.cc", pick.choice([" Train", "training"])))
        changed = list(lines)
        for _ in range(pick.randrange(0, 8)):
            at = pick.randrange(len(changed))
            kind = pick.randrange(3)
            if kind == 0:
                changed[at] = "  other(limit, 1);"
            elif kind == 1 and len(changed) > 2:
                del changed[at]
            else:
                changed.insert(at, "  m_added.push(count);")
        body = "\n\n".join(changed).replace("count", "n").replace("limit", "bound")
        rows.append(row(i * 10 + 1, ["// note\nint Owner::renamed(int n, const Row& bound) {" + body + "\n  return n; }"], f"src/b{i}.cc", pick.choice(["TEST", "val ", "dev", None])))
    rows += [rows[0], row(1000, None), row(1001, [None, ""], split="test"), row(None, rows[0][4], split="test"), row(1002, rows[0][4], split="test"), row(1003, rows[0][4], split="test")]
    df = spark.createDataFrame(rows, FILES)
    got = [tuple(r) for r in overlaps.overlapping_files(df).collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got)) and len(got) > 8


def test_hot_statements_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "HOT", 2)
    pick = random.Random(12)
    opening = ["  checkAll(1);", "  lockAll(2);", "  traceAll(3);", "  openAll(4);"]
    rows = []
    for i in range(12):
        _, lines = function(pick, f"x{i}", n=pick.randrange(8, 20))
        changed = list(lines)
        for _ in range(pick.randrange(0, 5)):
            changed[pick.randrange(len(changed))] = f"  replaced({pick.randrange(99)});"
        for k, (body, split) in enumerate(((lines, "train"), (changed, "test"))):
            rows.append(row(i * 2 + k, [f"int f{i}{k}(int count, const Row& limit) {{\n" + "\n".join(opening + body) + "\n  return count;\n}"], split=split))
    got = {tuple(r) for r in overlaps.overlapping_files(spark.createDataFrame(rows, FILES)).collect()}
    assert got == brute(rows) and len(got) >= 5


def test_cuts_are_disjoint_and_clear_of_hot_positions():
    pick = random.Random(3)
    for n in range(1, 60):
        for hot in (set(), {0, 1}, set(range(4)), {pick.randrange(n) for _ in range(n // 3)}, set(range(n))):
            spans = overlaps.cuts(n, {h for h in hot if h < n})
            assert len(spans) == n // 4 + 1 or n < 4
            assert all(s < e <= n and e - s <= 4 for s, e in spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_inconsistent_renaming_counts():
    a = "int f(int x, int y) {" + "".join(f" g{i}(x, y);" for i in range(10)) + " }"
    b = "int f(int x, int y) {" + "".join(f" g{i}({'y, x' if i % 2 else 'x, y'});" for i in range(10)) + " }"
    prepared = [([overlaps._hash64(p) for p in s], o) for s, o in map(overlaps.statements, (a, b))]
    assert overlaps.same_function(*prepared[0], *prepared[0]) and not overlaps.same_function(*prepared[0], *prepared[1])


def test_equal_texts_of_data_files(spark):
    data = "static const int t[] = {\n" + "  17, 23, 42, 99, 1024, 77,\n" * 12 + "};"
    rows = [row(1, [data], "a.cc", "train"), row(2, [data.replace("  ", "\t")], "b.cc", "test"), row(3, [data + " "], "c.cc", None)]
    assert {tuple(r) for r in overlaps.overlapping_files(spark.createDataFrame(rows, FILES)).collect()} == {(1, 2)}
    report = {(r.split, r.repository): (r.files, r.repeated) for r in overlaps.overlap_report(spark.createDataFrame(rows, FILES)).collect()}
    assert report == {("test", "project:p"): (1, 1)}
    assert overlaps.overlapping_files(spark.createDataFrame([], FILES)).count() == 0


def test_edit_distance_band():
    pick = random.Random(1)
    for _ in range(300):
        a, b = ([pick.randrange(4) for _ in range(pick.randrange(0, 9))] for _ in range(2))
        table = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        for most in range(6):
            found = overlaps.edits_within(a, b, most)
            assert (found is not None) == (table[-1][-1] <= most)
            if found is not None:
                assert all(a[i] == b[j] for i, j in found)


@pytest.mark.parametrize("names", ["in_a tmp_b row_count", "inA tmpB rowCount", "a b n", "value_ total_ rest_", "m_first m_second m_third"])
def test_renamed_locals_in_any_spelling(spark, names):
    def text(a, b, n, name):
        lines = [f"  {b} += table_{i}.find({a} * {i}) + {n};" for i in range(12)]
        return f"int Owner::{name}(const Row& {a}, int *{n}) {{\n  auto {b} = start({a});\n" + "\n".join(lines) + f"\n  return {b};\n}}"

    rows = [row(1, [text("x", "y", "z", "f")], split="train"), row(2, [text(*names.split(), "g")], split="test")]
    assert {tuple(r) for r in overlaps.overlapping_files(spark.createDataFrame(rows, FILES)).collect()} == {(1, 2)}


def test_declared_names():
    code = "int f(const Foo& in_a, std::vector<int> tmpB, char *p) { for (auto [k, v] : m) x = a * kB; if (a > b) return zed; Foo obj(3); auto l = [n = 3](int w) { return n == c; }; else run(x); }"
    asked = set("in_a tmpB p k v m x a kB b zed obj l n w c run".split())
    assert overlaps.declared(code, asked) == set("in_a tmpB p k v obj l n w".split())


def test_report_counts_what_the_pairs_hold(spark):
    pick = random.Random(21)
    body = [function(pick, f"same{i}")[0] for i in range(4)]
    rows = [row(i, [body[i % 4]], split=s, project=f"p{i % 3}") for i, s in enumerate(["train", "test", "val", "dev", "train", "test", "train", "valid", None, "test"])]
    # one file under both sides is no overlap with itself
    rows += [row(50, [function(pick, "alone")[0]], split="train"), row(50, [function(random.Random(21), "alone")[0]], split="test")]
    df = spark.createDataFrame(rows, FILES)
    sides = {i: {side(r[5]) for r in rows if r[0] == i} for i in {r[0] for r in rows}}
    pairs = {tuple(r) for r in overlaps.overlapping_files(df).collect()}
    want = {i for pair in pairs for i in pair if "e" in sides[i] and any(j != i and "t" in sides[j] for j in pair)}
    assert {r.file_id for r in overlaps.repeated_files(df).collect()} == want and want


def test_cross_entropy_decides_alone(spark):
    """Mangled names under a plain path, without a telling comment, in lines of many shapes."""
    pick = random.Random(6)
    texts = [function(pick, f"runThing{i}")[0] for i in range(40)]
    mangled = texts[0]
    for name in sorted(provenance.names_of(provenance.words_of(mangled)), key=len, reverse=True):
        mangled = mangled.replace(name, "".join(pick.choice("qxzjkvwy") for _ in range(7)))
    rows = [row(i, [t], f"src/file{i}.cc") for i, t in enumerate(texts)] + [row(100, [mangled], "src/plain.cc")]
    evidence = {r.file_id: r for r in provenance.file_evidence(spark.createDataFrame(rows, FILES)).collect()}
    assert [i for i, r in evidence.items() if r.mangled] == [100]
    assert not (evidence[100].templated or evidence[100].data or evidence[100].minified or evidence[100].declared or evidence[100].vendored)


def test_models_per_language():
    python = FOREIGN["python"] * 3
    code = provenance.masked(python)
    assert provenance.detected(python, code, provenance.words_of(code).keys()) == "python"
    for text in VALID[:3]:
        code = provenance.masked(text)
        assert provenance.detected(text, code, provenance.words_of(code).keys()) == "c++"
