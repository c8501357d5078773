import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quarryline.functions import patterns, scores, text
from quarryline.operators import clusters, coverage, defuse, intervals, matching, slices, trees, windows
from quarryline.sources import scan, sinks
from quarryline.streaming import ingest


def one(spark, value, kind, column):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "path, reason",
    [("src/a.cc", None), ("./third_party/z/a.cc", "excluded-directory"), ("a\\.git\\b.h", "hidden-directory"), ("cmake-build-debug/a.c", "excluded-directory"), ("src/foo_test.cc", "test-file"), ("src/contest.cc", None),
     ("src/x.pb.cc", "generated-file"), ("src/moc_x.cpp", "generated-file"), ("src/generator/x.cc", None), ("test.cc/a.h", None), (None, None)],
)
def test_exclusion_reasons(spark, path, reason):
    assert one(spark, path, "string", scan.exclusion_reason) == reason


def test_scan_tree_and_manifest(spark, tmp_path):
    for name in ("src/a.cc", "src/b_test.cpp", "build/c.h", "notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("int x;")
    found = {r.path: r.reason for r in scan.scan_tree(spark, str(tmp_path)).collect()}
    assert found == {"src/a.cc": None, "src/b_test.cpp": "test-file", "build/c.h": "excluded-directory"}
    listing = scan.scan_tree(spark, str(tmp_path)).select("path", "byte_count")
    good, bad = spark.createDataFrame([("src/a.cc", "train")], "path string, split string"), spark.createDataFrame([("src/zz.cc", "train")], "path string, split string")
    assert [r.byte_count for r in scan.manifest_scan(good, listing, ["path"]).collect()] == [6]
    with pytest.raises(Exception, match="not listed"):
        scan.manifest_scan(bad, listing, ["path"]).collect()


def test_tokens_and_calls(spark):
    assert one(spark, 'a->b("x y", 0x1F); // c\n/* d */ e >>= 2.5f;', "string", text.code_tokens) == ["a", "->", "b", "(", '"x y"', ",", "0x1F", ")", ";", "e", ">>=", "2.5f", ";"]
    assert one(spark, "if (f(x)) return std::g (y);", "string", text.call_targets) == ["f", "std::g"]
    assert one(spark, "函数abcdefgh", "string", text.approximate_tokens) == 3 and one(spark, None, "string", text.approximate_tokens) == 0
    assert one(spark, " a \n\t b ", "string", text.fold) == "a b"
    assert one(spark, "x <VAR_2> = <LIT_1>;", "string", text.sanitised_template) == "x var_2 = 0;"


def test_extents(spark):
    df = spark.createDataFrame([("2-0-3-5", "1-0-4-1"), ("1-0-4-2", "1-0-4-1"), ("x", "1-0-4-1"), (None, None)], "i string, o string")
    assert [r[0] for r in df.select(text.within(text.extent(F.col("i")), text.extent(F.col("o")))).collect()] == [True, False, None, None]


def test_scores(spark):
    assert one(spark, [10, 2, 4, 1], "array<int>", scores.upper_median) == 4
    assert spark.range(1).select(scores.f1(F.lit(3 / 7), F.lit(1.0))).first()[0] == pytest.approx(0.6) and spark.range(1).select(scores.f1(F.lit(0.0), F.lit(1.0))).first()[0] == 0
    assert spark.range(1).select(scores.ratio(F.lit(1), F.lit(0))).first()[0] == 0
    df = spark.createDataFrame([(v,) for v in (1, 2, 4, 10)], "v int")
    assert list(df.agg(*scores.percentiles("v", (0.25, 0.5, 0.95))).first()) == [1.75, 3.0, 9.1]


def test_ranks_and_tiers(spark):
    df = spark.createDataFrame([("a", 10), ("b", 20), ("c", 20), ("d", 40)], "slug string, v int").withColumn("g", F.lit(1))
    assert {r.slug: r.p for r in df.withColumn("p", windows.average_rank(["g"], "v")).collect()} == {"a": 0, "b": 0.5, "c": 0.5, "d": 1}
    six = spark.createDataFrame([(i, 1) for i in range(6)], "v int, g int")
    assert sorted(r.t for r in six.withColumn("t", windows.tier(["g"], [F.col("v")])).collect()) == [0, 0, 1, 1, 2, 2]


def test_chunks_match_a_loop(spark):
    pick = random.Random(1)
    for sizes in [[], [5], [500], [0, 0, 3]] + [[pick.randrange(60) for _ in range(pick.randrange(20))] for _ in range(15)]:
        done, current = [], 0
        for s in (max(1, s) for s in sizes):
            if current and current + s > 50:
                done.append(current)
                current = 0
            current += s
        assert one(spark, sizes, "array<int>", lambda c: windows.budget_chunks(c, 50)) == done + [current] * (current > 0)


def test_non_overlapping(spark):
    ranges = [(0, 10), (1, 9), (20, 30), (24, 34), (29, 60), (100, 101)]
    got = one(spark, ranges, "array<struct<start int, end int>>", lambda c: windows.non_overlapping(c, 3, 0.6))
    assert [tuple(r) for r in got] == [(0, 10), (20, 30), (29, 60)]


def test_ranges_match_loops(spark):
    pick = random.Random(5)
    data = [(pick.randrange(3), s, s + pick.randrange(0, 9)) for s in (pick.randrange(60) for _ in range(60))] + [(None, 1, 2), (1, None, 3)]
    df = spark.createDataFrame(data, "g int, start int, end int")
    for g in range(3):
        want = set().union(*[range(s, e) for k, s, e in data if k == g and s is not None])
        got = [(r.start, r.end) for r in intervals.merged(df, ["g"]).where(F.col("g") == g).collect()]
        assert set().union(*[range(s, e) for s, e in got]) == want and sum(e - s for s, e in got) == len(want)
    left, right = df.limit(20), df.orderBy(F.desc("start")).limit(20)
    a, b = [tuple(r) for r in left.collect()], [tuple(r) for r in right.collect()]
    full = lambda x: None not in x
    want = sorted(x for x in a if full(x) and any(full(y) and x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for y in b))
    assert sorted(tuple(r) for r in intervals.overlapping(left, right, ["g"]).collect()) == want


def test_as_of_matches_a_loop(spark):
    pick = random.Random(6)
    left = [(pick.randrange(4), pick.randrange(30), i) for i in range(50)] + [(None, 3, 90), (1, None, 91)]
    right = [(pick.randrange(4), pick.randrange(30), pick.randrange(9), "x") for _ in range(30)] + [(None, 3, 1, "x"), (1, None, 1, "x")]
    got = {r.n: r.v for r in intervals.as_of(spark.createDataFrame(left, "k int, at int, n int"), spark.createDataFrame(right, "k int, since int, v int, n string"), "k", "at", "since", "v").collect()}
    for k, at, n in left:
        past = [(s, v) for kk, s, v, _ in right if kk is not None and s is not None and kk == k and at is not None and s <= at]
        assert got[n] == (max(past)[1] if past else None)
    assert len(got) == len(left)


def test_trees_match_a_stack(spark):
    pick = random.Random(2)
    rows, want = [], {}
    for f in range(12):
        depth, stack, depths = 0, [], []
        for i in range(pick.randrange(1, 15)):
            depth = 0 if i == 0 else pick.randrange(1, depth + 2)
            depths.append(depth)
            del stack[depth:]
            want[(f, i)] = stack[-1] if stack else None
            stack.append(i)
            rows.append((f, 0, i, depth, "k"))
    got = trees.with_parents(spark.createDataFrame(rows, "file_id long, func_idx int, node_idx int, depth int, kind string")).collect()
    assert {(r.file_id, r.node_idx): r.parent_idx for r in got} == want
    for r in got:
        inside = [n for f, _, n, d, _ in rows if f == r.file_id and n >= r.node_idx]
        end = next((n for n in inside if n > r.node_idx and any(f == r.file_id and m == n and d <= r.depth for f, _, m, d, _ in rows)), max(inside) + 1)
        assert r.span == end - r.node_idx


def test_diverse_top(spark):
    pick = random.Random(3)
    rows = [(g, pick.choice("abc"), pick.randrange(5), i) for g in range(20) for i in range(pick.randrange(1, 7))]
    got = {}
    for r in trees.diverse_top(spark.createDataFrame(rows, "g int, kind string, s int, i int"), ["g"], "kind", [F.desc("s"), F.col("i")], 2).collect():
        got.setdefault(r.g, set()).add(r.i)
    for g in range(20):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[3]))
        chosen, kinds = [], set()
        for r in order:
            if r[1] not in kinds and len(chosen) < 2:
                chosen.append(r[3])
                kinds.add(r[1])
        chosen += [r[3] for r in order if r[3] not in chosen][: 2 - len(chosen)]
        assert got[g] == set(chosen)


def test_templates(spark):
    df = spark.createDataFrame([("int n = m_rows.size(); n += 2; n += 2;", 1, "t"), ("int k = m_rows.size(); k += 7; k += 7;", 2, "t"), ("int k = m_rows.size(); n += 7; k += 7;", 3, "t"), (None, 4, "t")], "code string, id int, template string").drop("template")
    found = {r.id: r for r in patterns.with_template(df, "code").collect()}
    assert " ".join(found[1].template) == "int <VAR_1> = m_rows . size ( ) ; <VAR_1> += <LIT_1> ; <VAR_1> += <LIT_1> ;"
    assert found[1].template == found[2].template != found[3].template and found[4].template is None and found[1].anchors == ["m_rows", "size"]
    groups = sorted((r.members, r.variants) for r in matching.template_groups(df.withColumn("p", F.lit(1)), "code", ["p"]).collect())
    assert groups == [(1, 1), (2, 2)]


def test_structural_matches_match_all_pairs(spark):
    pick = random.Random(9)
    parts = ["m_rows.push(x);", "if (x > 3) return Do(x);", "++count_;", "for (int i = 0; i < n; ++i) Call(i);", "delete m_old;", "y = x + 1;"]
    code = [" ".join(pick.choice(parts) for _ in range(pick.randrange(1, 7))) for _ in range(25)]
    p = spark.createDataFrame([(i, c) for i, c in enumerate(code[:8])] + [(90, None), (91, "")], "pattern_id long, code string")
    c = spark.createDataFrame([(i, c) for i, c in enumerate(code)] + [(92, None)], "candidate_id long, code string")
    got = {(r.pattern_id, r.candidate_id) for r in matching.structural_matches(p, c).collect()}
    t = {r.candidate_id: r for r in patterns.with_template(c, "code").collect() if r.template}
    words = lambda r, kinds: {x for x in r.template if x in kinds}
    want = set()
    for i in range(8):
        for j, r in t.items():
            a = t[i]
            ok = a.anchors and len(r.template) <= 2.5 * len(a.template) and set(a.anchors) <= set(r.anchors) and words(a, patterns.CONTROL) <= words(r, patterns.CONTROL) and words(a, patterns.OPERATORS) <= words(r, patterns.OPERATORS)
            if ok and sum(b.size for b in SequenceMatcher(None, a.template, r.template, autojunk=False).get_matching_blocks()) / len(a.template) >= 0.72:
                want.add((i, j))
    assert got == want and len(want) > 8


def test_definitions_and_uses(spark):
    code = ["a = f(1);", "b = a + a;", "a += b;", "c = g(a);", "h(c, b);"]
    rows = spark.createDataFrame([(1, 0, i + 1, "expression_statement", x) for i, x in enumerate(code)] + [(1, 0, 9, None, None)], "file_id long, func_idx int, node_idx int, kind string, code_snippet string")
    links = defuse.edges(defuse.facts(rows))
    assert {(r.source, r.target, r.symbol) for r in links.collect()} == {(1, 2, "a"), (1, 3, "a"), (2, 3, "b"), (3, 4, "a"), (4, 5, "c"), (2, 5, "b")}
    near = {}
    for r in defuse.closure(links).collect():
        near.setdefault(r.anchor, set()).add(r.node_idx)
    assert near[4] == {1, 2, 3, 4, 5} and near[1] == {1, 2, 3}


def test_what_defines_a_name(spark):
    rows = [("declaration", "int a;"), ("declaration", "Foo b(c);"), ("expression_statement", "a++;"), ("expression_statement", "--b;"), ("expression_statement", "d = e = a;"), ("expression_statement", "f(a == b);"), (None, "int g;")]
    df = spark.createDataFrame([(1, 0, i, k, c) for i, (k, c) in enumerate(rows)], "file_id long, func_idx int, node_idx int, kind string, code_snippet string")
    got = {(r.node_idx, r.symbol): (r.defines, r.uses) for r in defuse.facts(df).collect()}
    assert {k for k, (d, _) in got.items() if d} == {(0, "a"), (1, "b"), (2, "a"), (3, "b"), (4, "d"), (4, "e")}
    assert got[(2, "a")][1] and got[(1, "c")][1] and not got[(0, "a")][1]


def test_trees_before_they_are_rows(spark):
    pick = random.Random(9)
    trees_ = []
    for f in range(20):
        depth, depths = 0, []
        for i in range(pick.randrange(0, 12)):
            depth = 0 if i == 0 else pick.randrange(1, depth + 3)  # levels may be left out
            depths.append(depth)
        trees_.append((f, [[(d, f"k{i}", "x") for i, d in enumerate(depths)]] if f else None))
    df = spark.createDataFrame(trees_, "file_id long, func_ast array<array<struct<depth int, kind string, code_snippet string>>>")
    got = {(r.file_id, r.node_idx): (r.parent_idx, r.parent_kind, r.span) for r in trees.placed_nodes(df, ("code_snippet",)).collect()}
    want = {}
    for f, functions in trees_:
        for depths in ([x[0] for x in t] for t in functions or ()):
            for i, d in enumerate(depths):
                parent = max((j for j in range(i) if depths[j] == d - 1), default=None)
                end = next((j for j in range(i + 1, len(depths)) if depths[j] <= d), len(depths))
                want[(f, i)] = (parent, None if parent is None else f"k{parent}", end - i)
    assert got == want and len(want) > 60


def test_authored_tokens(spark):
    cases = {
        'u8"a\\"b" R"x(c " d)x" L\'q\'': ['u8"a\\"b"', 'R"x(c " d)x"', "L'q'"],
        "0b1010'1 0xFF'FFu 1'000.5e-3f a.*b": ["0b1010'1", "0xFF'FF", "u", "1'000.5e-3f", "a", ".*", "b"],
        "a<<=b>>c<=>d->*e...": ["a", "<<=", "b", ">>", "c", "<=>", "d", "->*", "e", "..."],
        "<VAR_1> = <LIT_2>; // x\n/* y */ z": ["<VAR_1>", "=", "<LIT_2>", ";", "z"],
        "": [],
    }
    for code, tokens in cases.items():
        assert one(spark, code, "string", text.code_tokens) == tokens
    literal = lambda t: one(spark, t, "string", text.is_literal)
    assert all(map(literal, ['u8"a"', "L'q'", 'R"(x)"', "0b1", "12", "<LIT_1>"])) and not any(map(literal, ["u8", "R", "a", "<VAR_1>", "."]))
    assert one(spark, 'f("// no"); // yes\ng(\'"\'); /* "x */ h("/* no */");', "string", text.stripped) == 'f("// no"); \ng(\'"\');  h("/* no */");'
    assert one(spark, '"' + "a" * 20000 + '"', "string", text.code_tokens) == ['"' + "a" * 20000 + '"']


def test_bytes(spark):
    assert [one(spark, bytearray(b), "binary", text.decoded) for b in ("grün 中".encode(), "grün".encode("latin-1"), "\ufeffgrün".encode("utf-16-le"), "\ufeffgrün".encode("utf-16-be"), b"")] == ["grün 中", "grün", "grün", "grün", ""]
    assert one(spark, "aé中b", "string", lambda c: text.byte_slice(c, F.lit(1), F.lit(6))) == "é中"
    ranges = F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end"), F.lit("<A>").alias("new")), F.struct(F.lit(6).alias("start"), F.lit(7).alias("end"), F.lit("").alias("new")))
    assert one(spark, "aé中bc", "string", lambda c: text.replaced(c, ranges)) == "a<A>中c"
    assert one(spark, [1.0, float("nan"), float("inf"), None], "array<double>", text.json_safe) == [1.0, None, None, None]


def test_spans_of_templates_match_a_loop(spark):
    pick = random.Random(4)
    word = lambda: pick.choice(["a", "b", "Foo", "(", ")", ";", "=", "1", '"s"', "if"])
    patterns_ = [(0, "<VAR_1> = <VAR_1> ;"), (1, "<VAR_1> = <LIT_1>"), (2, "Foo ( <VAR_1> <VAR_2> )"), (3, "<VAR_1>"), (4, None), (5, ""), (6, "if ( a"), (7, "<VAR_1> = <VAR_2> ;")]
    codes = [(i, " ".join(word() for _ in range(pick.randrange(0, 40)))) for i in range(40)] + [(50, None), (51, "a = a ; Foo ( a b ) b = 1 a = b ;")]
    got = {tuple(r) for r in coverage.template_spans(spark.createDataFrame(patterns_, "pattern_id int, code string"), spark.createDataFrame(codes, "code_id int, code string")).collect()}
    name, literal = {"a", "b", "Foo"}, {"1", '"s"'}
    want = set()
    for p, pattern in patterns_:
        parts = (pattern or "").split()
        for c, code in codes:
            tokens = (code or "").split()
            for at in range(len(tokens) - len(parts) + 1):
                bound, ok = {}, any(not x.startswith("<") for x in parts)
                for x, t in zip(parts, tokens[at:]):
                    ok = ok and (bound.setdefault(x, t) == t and t in (name if x[1] == "V" else literal) if x.startswith("<") else x == t)
                if ok:
                    want.add((p, c, at))
    assert got == want and {p for p, _, _ in want} == {0, 1, 2, 6, 7}


NODES = "corpus string, file_id long, func_idx int, node_idx int, span int, kind string, code_snippet string"


def test_node_coverage_of_a_known_case(spark):
    train = spark.createDataFrame([("p", 1, 0, 0, 2, "function_definition", "int source() { if (source) Use(1); }"), ("p", 1, 0, 1, 1, "if_statement", "if (source) Use(1);")], NODES)
    test = [("p", 2, 0, 0, 7, "function_definition", "int other() { x(); }"), ("p", 2, 0, 1, 6, "if_statement", "if (ready) Use(2);"), ("p", 2, 0, 2, 1, "if_statement", "if (ready) Drop(2);")]
    test += [("p", 2, 0, i, 1, "other", None) for i in range(3, 7)] + [("p", 3, 0, 0, 1, "function_definition", "void empty() {}")]
    got = {r.corpus: r for r in coverage.node_coverage(train.where("node_idx = 1"), spark.createDataFrame(test, NODES), least=1).collect()}
    for r in (got["p"], got["all"]):
        assert (r.files, r.nodes, r.covered, r.ic_macro, r.ic_micro, r.patterns, r.matched, r.isp) == (2, 8, 6, round(3 / 7, 6), 0.75, 1, 1, 1.0)
    assert coverage.node_coverage(train.limit(0), train.limit(0)).where("corpus != 'all'").count() == 0


def test_slices(spark):
    code = ["int a = start();", "a += step(a);", "log();", "b = a;", "c = 1;", "return b;"]
    rows = [(1, 0, 0, "function_definition", "int f() {}", "1-0-9-1")] + [(1, 0, i + 1, "declaration" if c.startswith("int") else "expression_statement", c, f"{i + 2}-0-{i + 2}-9") for i, c in enumerate(code)]
    nodes = spark.createDataFrame(rows, "file_id long, func_idx int, node_idx int, kind string, code_snippet string, extent string")
    links = defuse.edges(defuse.facts(nodes.where("node_idx > 0")))
    found = slices.slices(nodes, defuse.closure(links), links).collect()
    best = min(found, key=lambda r: r.position)
    assert len({(r["first"], r["last"]) for r in found}) == len(found) and sorted(r.position for r in found) == list(range(1, len(found) + 1))
    assert all(r.selected >= 2 and r.cohesion >= 0.5 and 2 <= r.lines <= 80 for r in found) and best.position == 1


def test_projects(spark):
    df = spark.createDataFrame([(" A",), ("a",), (".git",), ("x/../y",), (None,), ("",), ("b",)], "project string")
    assert {tuple(r) for r in scan.projects(df).collect()} == {("a", 2), ("b", 1)}
    assert {tuple(r) for r in scan.projects(df, ["B"]).collect()} == {("b", 1)}
    for names in ([], [".git"], ["../x"], [" "]):
        with pytest.raises(ValueError):
            scan.projects(df, names)


def test_first_deliveries_pending_and_preview(spark):
    df = spark.createDataFrame([(1, 5, "b" * 300), (1, 3, "a"), (2, 1, None), (None, 1, "z")], "k int, at int, t string")
    assert {(r.k, r["at"]) for r in scan.first_deliveries(df, "k", "at").collect()} == {(1, 3), (2, 1)}
    assert {r.k for r in scan.pending(df.where("k is not null"), df.where("k = 1"), "k").collect()} == {2}
    shown = sinks.preview(df, ["k", "at"], 4, 10).collect()
    assert [r.t_cut for r in shown if r["at"] == 5] == [True] and max(len(r.t or "") for r in shown) == 10


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", 1, [1, 2]), ("q", 2, None)], "project string, n int, v array<int>")
    sinks.save_table(df, str(tmp_path / "t"))
    sinks.export_csv(df, str(tmp_path / "c"))
    sinks.save_report(df, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "t")).where("project = 'q'").count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).where("v = '[1,2]'").count() == 1
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_stream_takes_up_what_is_new(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    part = lambda rows: spark.createDataFrame(rows, "id long, at string").select("id", F.col("at").cast("timestamp").alias("at"))
    part([(1, "2025-01-01 00:10:00"), (2, "2025-01-01 00:20:00"), (1, "2025-01-01 00:10:00"), (None, "2025-01-01 00:10:00")]).write.parquet(folder)
    stream = lambda: ingest.once(ingest.arrivals(spark, folder, part([(1, None)]).schema), "id", "at")
    write = lambda df, batch: seen.extend(r.id for r in df.collect())
    ingest.drain(stream(), write, str(tmp_path / "c"))
    part([(2, "2025-01-01 00:20:00"), (3, "2025-01-01 01:00:00")]).write.mode("append").parquet(folder)
    ingest.drain(stream(), write, str(tmp_path / "c"))
    assert sorted(seen) == [1, 2, 3]
    counted = []
    ingest.drain(ingest.by_window(ingest.arrivals(spark, folder, part([(1, None)]).schema).withWatermark("at", "1 second"), "at", []), lambda df, b: counted.extend(df.collect()), str(tmp_path / "w"))
    assert sum(r.rows for r in counted) <= 6


def test_directives_become_blanks(spark):
    code = "int a;\n  #define X \\\n  (1)\nint b; // #x\r\n#if 0\r\n"
    got = one(spark, code, "string", text.without_directives)
    assert got == "int a;\n" + " " * 13 + "\n" + " " * 5 + "\nint b; // #x\r\n" + " " * 5 + "\r\n" and len(got) == len(code)


def test_medoids(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 2, [0.9, 0.1]), (1, 3, [0.0, 1.0]), (2, 4, [1.0, 1.0]), (2, 5, [2.0, 2.0]), (3, 6, None)]
    got = {r.c: (r.size, r.medoid) for r in clusters.medoids(spark.createDataFrame(rows, "c int, m long, v array<double>"), "c", "m", "v").collect()}
    assert got == {1: (3, 2), 2: (2, 4)}


def test_choice_prefers_the_strict_gate(spark):
    rows = [("p", 100, 60, 10, 3, 1), ("p", 100, 90, 5, 9, 2), ("p", 100, 65, 5, 3, 3), ("q", 10, 0, 0, 0, 1)]
    got = {r.project: (r["rank"], r.gate) for r in clusters.choose(spark.createDataFrame(rows, "project string, total int, members int, largest int, cross_file int, rank int"), ["project"]).collect()}
    assert got == {"p": (3, 0), "q": (1, 2)}


def test_opening_and_last_rows(spark):
    df = spark.createDataFrame([("a", i, 10 - i) for i in range(8)] + [("b", 1, 1), (None, 2, 2)], "g string, t int, k int")
    got = sorted((r.g or "", r.t, r.opening) for r in windows.opening_and_last(df, ["g"], ["t", "k"], 2).collect())
    assert got == [("", 2, True), ("a", 0, True), ("a", 6, False), ("a", 7, False), ("b", 1, True)]
