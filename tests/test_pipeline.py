import pytest

from quillscan.operators import detectors, findings, graph, report
from quillscan.operators.masking import mask
from quillscan.plans.pipeline import analyse

KIND = "scan_id long, ordinal long, path string, size long, content string"


def files(spark, *units):
    return spark.createDataFrame([(u, k, p, None, t) for u, fs in enumerate(units, 1) for k, (p, t) in enumerate(fs)], KIND)


def found(text, ext=".ts", test=False):
    return [(x[0], x[1]) for x in detectors.detect(ext, test, detectors.source(ext, text))]


@pytest.mark.parametrize(
    ("ext", "text", "category"),
    [
        (".ts", 'const t = "ghp_' + "a1B2c3D4e5" * 4 + '";', "hardcoded_secret"), (".py", "import os\nos.system(cmd)\n", "command_injection"), (".py", "h = hashlib.md5(data)\n", "weak_crypto"), (".ts", "try { a(); } catch (e) {}\n", "empty_handler"),
        (".py", "try:\n    a()\nexcept Exception: pass\n", "empty_handler"), (".rb", "begin\n  a\nrescue\nend\n", "empty_handler"), (".ts", "const limit = 4711;\n", "magic_number"), (".ts", "// TODO later\n", "todo_debt"),
        (".ts", "function f() {\n" + "  a();\n" * 51 + "}\n", "long_function"), (".py", "def f():\n" + "    a()\n" * 51, "long_function"), (".rb", "def f\n" + "  a\n" * 51 + "end\n", "long_function"),
        (".ts", "function f(a) {\n" + "  if (a) { b(); }\n" * 26 + "}\n", "high_complexity"), (".ts", "{" * 6 + "}" * 6, "deep_nesting"), (".ts", "x\n" * 601, "large_file"),
        (".py", "class A:\n" + "    def m(self):\n        pass\n" * 21, "god_class"), (".ts", "class A {\n" + "  m() {\n  }\n" * 21 + "}\n", "god_class"),
    ],
)
def test_detectors_find(ext, text, category):
    assert category in [c for c, _ in found(text, ext)]


@pytest.mark.parametrize(
    ("ext", "text"),
    [
        (".ts", 'exec("ls -la");'), (".ts", 'const c = "ls"; exec(c);'), (".ts", "pattern.exec(text);"), (".ts", "try { a(); } catch (e) { /* ignore */ }"), (".ts", 'const q = "TODO_QUEUE";'), (".ts", "// eval(x)\n"), (".ts", "const a = 500;"),
        (".ts", "function f() {\n" + "  a();\n" * 49 + "}\n"), (".ts", "x\n" * 598), (".ts", "{" * 5 + "}" * 5), (".py", "# os.system(cmd)\n"), (".ts", 'const t = "ghp_example' + "a1B2c3D4e5" * 3 + '";'), (".md", "function f() {" + "{" * 9),
    ],
)
def test_detectors_stay_silent(ext, text):
    assert found(text, ext) == []


def test_severity_falls_in_tests_and_checksums():
    assert found("eval(x)", test=True) == [("command_injection", "medium")]
    assert found("file_hash = hashlib.md5(x)", ".py") == [("weak_crypto", "low")]


def test_mask_keeps_length_and_lines():
    text = 'a = "x // y" // c\n/* b\n */ r = /[/"]+/g; s = 4 / 2;\n"""doc\n"""\n`t\n`'
    for strings in (True, False):
        m = mask(text, strings)
        assert len(m) == len(text) and [k for k, c in enumerate(m) if c == "\n"] == [k for k, c in enumerate(text) if c == "\n"]
    assert "x" not in mask(text) and "x // y" in mask(text, False) and "4 / 2" in mask(text)


def test_pipeline_over_many_units(spark):
    cycle = [(f"src/m{k}.ts", f'import {{ a }} from "./m{(k + 1) % 3}";\n') for k in range(3)] + [("src/z.ts", 'import { a } from "./m0";\n'), ("src/self.ts", 'import { a } from "./self";\n')]
    many = [(f"src/f{k}.py", "x = 1\n") for k in range(6)]
    leak = [("a.py", "import os\nos.system(cmd)\n"), ("node_modules/b.py", "os.system(cmd)\n"), ("a.min.js", "eval(x)"), ("t.test.ts", "it('x', () => { expect(1); });\n"), (None, "x"), ("e.py", None), ("f.py", "")]
    a = analyse(files(spark, cycle, many, leak))
    got = {(r.unit, r.category, r.path) for r in a.capped.collect()}
    assert got == {(1, "circular_dependency", f"src/m{k}.ts") for k in range(3)} | {(2, "missing_tests", "src/f0.py"), (3, "command_injection", "a.py")}
    scores = {r.unit: r for r in a.scores.collect()}
    assert set(scores) == {1, 2, 3} and scores[3].security == 75 and scores[1].architecture < scores[2].architecture
    assert {r.category for r in report.root_causes(a.capped).collect()} == {"circular_dependency", "missing_tests", "command_injection"}


def test_empty_table_and_docs_only(spark):
    a = analyse(spark.createDataFrame([], KIND))
    assert a.raw.count() == 0 and a.scores.count() == 0
    docs = analyse(files(spark, [("README.md", "# hello\n")])).scores.first()
    assert docs.overall == 40 and docs.documentation == 60


def test_cap_orders_by_weight_and_keeps_five(spark):
    rows = [(1, k, "a", "magic_number", "low") for k in range(9)] + [(1, 20, "b", "hardcoded_secret", "critical")]
    out = findings.capped(spark.createDataFrame(rows, "unit long, ev_seq int, path string, category string, severity string")).orderBy("kept_rank").collect()
    assert [r.ev_seq for r in out] == [20, 0, 1, 2, 3, 4]


def test_components_match_brute_force(spark):
    import random

    rng = random.Random(3)
    edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(22)}
    reach = {a: {a} for a in range(14)}
    for _ in range(14):
        for a, b in edges:
            for s in reach.values():
                if a in s:
                    s.add(b)
    want = {frozenset(b for b in reach if b in reach[a] and a in reach[b]) for a in reach}
    df = spark.createDataFrame([(1, f"{a:02}", f"{b:02}") for a, b in edges], "unit long, src string, dst string")
    got = {}
    for r in graph.components(df).collect():
        got.setdefault(r.component, set()).add(int(r.path))
    assert {frozenset(s) for s in got.values()} == {s for s in want if len(s) > 1}


def test_import_resolution(spark):
    fs = [("app/a.ts", 'import x from "../lib/b";\nimport y from "@/util";\nimport z from "react";'), ("lib/b/index.ts", "x"), ("src/util.ts", "x"), ("pkg/m.py", "from pkg.sub import q\nimport os\n"), ("root/pkg/sub.py", "x"), ("r.rb", "require_relative 'h'\n"), ("h.rb", "x"), ("web/p.php", "use App\\Models\\User;\n"), ("lib/User.php", "x")]
    kept, _, imported = detectors.parts(detectors.one_pass(files(spark, fs)).cache())
    got = {(r.src, r.dst) for r in graph.import_edges(imported, kept).collect()}
    assert got == {("app/a.ts", "lib/b/index.ts"), ("app/a.ts", "src/util.ts"), ("pkg/m.py", "root/pkg/sub.py"), ("r.rb", "h.rb"), ("web/p.php", "lib/User.php")}


def test_modules_by_dotted_names(spark):
    fs = [("pkg/a.py", "from util import x\nimport pkg.b\nimport a\n"), ("pkg/b.py", "x"), ("lib/util.py", "x"), ("old/util.py", "x")]
    kept, _, imported = detectors.parts(detectors.one_pass(files(spark, fs)).cache())
    assert {(r.src, r.dst) for r in graph.module_edges(imported, kept).collect()} == {("pkg.a", "lib.util"), ("pkg.a", "pkg.b")}


def test_components_with_self_edges(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (1, "c", "c"), (1, "a", "a"), (2, "x", "y")], "unit long, src string, dst string")
    assert [tuple(r) for r in graph.component_count(e, graph.components(e)).collect()] == [(1, 2)]
    assert {(r.path, r.neighbours) for r in graph.adjacency(e).where("unit = 1").collect()} == {("a", 2), ("b", 1), ("c", 1)}


def test_answers_and_evidence_columns(spark):
    from quillscan.operators import metrics

    texts = [(1, 'Sure:\n```json\n{"sections": [{"title": "T", "body": "B", "confidence": "sure"}, {"title": "", "body": ""}]}\n```'), (2, "plain text"), (3, None), (4, '{"sections": [')]
    got = {r.id: (r.title, r.body, r.confidence) for r in report.answer_sections(spark.createDataFrame(texts, "i long, t string"), "i", "t").collect()}
    assert got == {1: ("T", "B", "medium"), 2: ("Explanation", "plain text", "medium"), 3: ("Explanation", "Empty answer.", "medium"), 4: ("Explanation", '{"sections": [', "medium")}
    units = spark.createDataFrame([(1, 9, 1, 4, 60.0, 2), (2, 3, 0, 0, 5.0, 0)], "unit long, files long, god_classes long, large_files long, mean_function double, long_functions long")
    rows = {r.unit: r for r in metrics.evidence_columns(units, spark.createDataFrame([(1, 2)], "unit long, cycles long")).collect()}
    assert (rows[1].critical, rows[1].high, rows[1].medium, rows[1].recommendations, rows[1].coverage) == (2, 3, 4, 4, 100.0) and rows[1].causes == ["god_class", "circular_dependency", "large_file", "long_method"]
    assert rows[2].causes == [] and rows[2].coverage == 100.0


def test_views(spark):
    from quillscan.operators import views

    df = spark.createDataFrame([(1, " High ", "Split it", "a"), (2, None, "keep", None), (3, "critical", "split", "b")], "ev_seq long, severity string, message string, sprint string")
    assert [r.ev_seq for r in views.ordered(df, "severity").orderBy("row_no").collect()] == [3, 1, 2] and [r.ev_seq for r in views.ordered(df, "message", descending=False).orderBy("row_no").collect()] == [1, 2, 3]
    assert [r.ev_seq for r in views.matching(df, "SPLIT", ("message",)).collect()] == [1, 3] and [r.ev_seq for r in views.matching(df, sprint=None).collect()] == [2]
