import ast
import json
import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillscan.llm import parsing
from quillscan.llm.grammars import BY_EXTENSION

GOOD = {
    "js": ["", "import a, { b as c } from './x';\nexport default class A extends B { #p = 1; static async *m(x = 2, ...r) { yield* x; } get v() { return this.#p } }", "const { a, b: [c] } = f?.(d)?.[0] ?? `t${1}`;\nfor (const [k, v] of m) { if (k) continue; else break }", "x = a\n  ? b : c\n!function(){return /[/]x/g.test(a)}()", "label: for (;;) { do { x++ } while (x < 3); switch (x) { case 1: default: y(); } }\ntry { } catch { } finally { }", "const f = async (a, b) => ({ a, b }), g = x => x * 2;"],
    "ts": ["interface A<T> extends B { readonly a?: string; [k: string]: unknown; m(x: number): void }\ntype U = 'a' | { b: number }[] | (() => void);\nenum E { A = 1, B }\nexport function f(a: number, b?: string): x is string { return (a as any)!.b; }\nabstract class C<T> implements A { constructor(private readonly x: T, public y = 1) { super(); } }\ndeclare const z: Map<string, Array<number>>;"],
    "java": ["package a.b;\nimport static a.B.*;\n@X(a = 1, b = {2}) public final class C<T extends D & E> extends F implements G, H { private int[] a = { 1, 2 }; C() { this(1); } <R> R m(final int x, String... y) throws Z { for (var q : y) { int z = (int) x + q.length(); } return (R) null; } enum K { A(1), B { void m() { } }; } record P(int x) { } }\ninterface I { default void m() { } int n(); }", "class A { void m() { Runnable r = () -> { }; int s = switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; try (var a = b()) { } catch (X | Y e) { } finally { } do { i++; } while (i < 3); List<Map<String, int[]>> l = new ArrayList<>(); A[] q = new A[3]; f(A::new, x -> x + 1); } }"],
    "go": ["package a\n\nimport (\n\t\"fmt\"\n\tx \"y\"\n)\n\ntype T struct {\n\tA int `json:\"a\"`\n\t*B\n}\n\nfunc (t *T) M(a, b int, c ...string) (int, error) {\n\tif v, err := f(a); err != nil {\n\t\treturn 0, err\n\t} else if v > 2 && !ok {\n\t\tx := map[string][]int{\"a\": {1, 2}}\n\t\tfor i, e := range x {\n\t\t\tgo func() { ch <- e }()\n\t\t}\n\t}\n\tswitch y := z.(type) {\n\tcase int, string:\n\tdefault:\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tdefer f(&T{A: 1}, []byte(\"x\")...)\n\treturn a + b*(c[1:2]), nil\n}\n"],
    "rb": ["# c\nrequire 'x'\nmodule A\n  class B < C::D\n    attr_reader :a, :b\n    def m(a, b = 1, *c, k: 2, &blk)\n      return a unless b\n      x = a.map { |y| y * 2 }.select do |z|\n        z > 1 && z != 3\n      end\n      h = { a: 1, 'b' => [1, 2], c: -> (q) { q } }\n      puts \"v #{h[:a]}\" if x.any?\n    rescue E, F => e\n      raise G, 'x'\n    ensure\n      done!\n    end\n  end\nend\ncase x\nwhen 1, 2 then y\nelse z\nend\nt = <<~PEM\n  ((( \" raw\nPEM\na = b ? c : d\n"],
    "py": ["@d(1)\nasync def f(a, /, b: int = 2, *c, d, **e) -> None:\n    async with x as y, z:\n        await q\n    return [i async for i in z if i], {**a, 'b': 1}, {1, *c}, (yield)\n\nclass A(B, metaclass=M): x: int = 3; pass\n\nmatch p:\n    case [1, *r] | {'a': b, **k} if r: pass\n    case _:\n        try:\n            pass\n        except* E as g: pass\n        finally: pass\nx = y if z else lambda q, *a: (w := 2)\nprint(f'{a!r:>{b}}' 'c', *d, e=1, **f); del g[1:2, ...], h\n"],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9\\n"], "b": {}}', "[]", " 7 "],
}
BAD = {
    "js": ["const x = ;", "function (a) {}", "f(1, 2", "if (a) { b()", "a;\n<<<<<<< HEAD\nb;\n=======\nc;\n>>>>>>> x\n", "const a: number = 1;", "x = 'open\n", "}", "def f():\n    pass", "const a;"], "ts": ["function f(a: ) {}", "interface A { b: string", "const x: = 3;"], "java": ["class A { void m() { int x = 1 } }", "class A { void m( { } }", "class A { } }", "import a.b\nclass C { }"],
    "go": ["package a\nfunc f() {\n", "package a\nfunc f( {\n}\n", "func f() {}\n", "package a\nx := 1\n"], "rb": ["def f\n  a\n", "class A\n  def m(\n  end\nend", "a = (1 + 2\n", "end\n", "x = 'open\n"], "py": ["def f()\n    pass\n", "x = (1,\n", "if a:\npass\n", 'print "x"\n', "  x = 1\n y = 2\n", "s = 'open\n", "a = 08\n"], "json": ['{"a": 1,}', "{'a': 1}", '{"a" 1}', "[1, 2", '{"a": 1} x', "[01]"],
}


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, ts in GOOD.items() for t in ts])
def test_accepts(ext, text):
    ok, far = BY_EXTENSION[ext].check(text)
    assert ok or not text, text[max(0, far - 40) : far] + "<<HERE>>" + text[far : far + 40]


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, ts in BAD.items() for t in ts])
def test_refuses(ext, text):
    assert not BY_EXTENSION[ext].check(text)[0]


def test_corpus_agrees_with_the_own_parsers(spark, tables):
    for r in spark.read.parquet(f"{tables}/scan_files.parquet").select("path", "content").where("length(trim(content)) > 0").collect():
        ext = r.path.rsplit(".", 1)[-1]
        if ext in ("py", "json"):
            try:
                ast.parse(r.content) if ext == "py" else json.loads(r.content)
                ok = True
            except (SyntaxError, ValueError):
                ok = False
            assert BY_EXTENSION[ext].check(r.content)[0] == ok, r.path


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from('{}[]",:1ae. -\\tru\n'), max_size=30))
def test_json_agrees_with_the_own_parser(text):
    try:
        json.loads(text)
        ok = True
    except ValueError:
        ok = False
    assert BY_EXTENSION["json"].check(text)[0] == ok


def test_tables(spark):
    rows = [(1, "r", "a.PY", "x = (\n"), (2, "r", "a.py", "x = 1\n"), (3, "r", "b.json", None), (4, "r", "b.json", "  \n"), (5, "r", "c.md", "(("), (6, None, None, "x"), (7, "q", "d.js", "a\n<<<<<<< HEAD\n=======\n>>>>>>> x\n"), (8, "q", "e.json", "[" * 3000 + "]" * 3000), (9, "q", "f.py", "x = [\n" + "1,\n" * 100_000 + "]\n")]
    files = spark.createDataFrame([(*r, True, "clash") for r in rows], "file_id long, repo string, path string, content string, parses boolean, ext string")
    assert {r.file_id for r in parsing.unparsable(files).collect()} == {1, 7}
    causes = {r.id: r.cause for r in parsing.parsed(files).collect()}
    assert causes[1] == "truncated" and causes[7] == "conflict" and causes[9] is None
    scans = spark.createDataFrame([("r", {".py": 2})], "repo string, extension_counts map<string,long>")
    rates = {(r.repo, r.ext): (r.files, r.failed, r.counted_by_scans) for r in parsing.failure_rates(files, scans).collect()}
    assert rates["r", "py"] == (2, 1, 2)
    assert parsing.unparsable(files.limit(0)).count() == 0


VALID = [
    ("py", "def g():\n    yield\n    yield x\n    yield from y\n    z = yield 1\n"), ("py", "f(*a, b, *c, d=1, *e, **k)\nfor a.b[0], (c, *d) in e: pass\n"), ("py", "x = f'a{b!r:>{w}} {c[\"k\"]} {{}} {d=}' rb'q' f\"{f'{1}'}\"\n"), ("py", "def f(*a: int, **k: str) -> None: ...\n"),
    ("rb", "f(<<~A, b: 1)\n  (((\nA\ng :x, 'y' => 2\n"), ("rb", "a.b(c).d(e: f, &g).\n  h\n  .i { |(x, y), z| x / y }\nputs \"a#{b.map { |q| \"<#{q}>\" }.join}\"\n"), ("rb", "ENV.fetch('A')\nx.y = *z\n(a, b), c = d\nThen /it (.*)/ do |s|\nend\n"), ("rb", "begin\n  a\nrescue *B, C => e\n  raise\nend\n"),
    ("js", "const a = `x${`y${z}`}`;\nfor (k in o) continue\na = b\n"), ("js", "export * as n from 'm' with { type: 'json' };\nfunction F() { return new.target }\n"), ("js", "f((a = ')', { b, ...c }) => a);"),
    ("ts", "function f(this: Window, a?: number): asserts a is number { return x ? (a) : b => c }\nlet x!: import('y').Z<string>;\nexport type { A } from 'b';\nexport = f;"), ("ts", "type A<in out T> = T extends `a${infer R extends string}` ? R : never;\ndeclare global { const v: unique symbol }"),
    ("java", "open module a.b { requires transitive c.d; exports e to f, g; }"), ("java", "class A { Object o = f(Thread.State[].class); }"),
]
INVALID = [("js", "const a = `${ `;"), ("js", "`${}`"), ("js", "typeof x = 1"), ("py", "f(a=1, b)\n"), ("py", "f() = 1\n"), ("py", "1 += x\n"), ("py", "x = f'{'\n"), ("py", "for f() in y: pass\n"), ("rb", 'x = "#{"\n'), ("rb", "f(<<~A)\n  b\n")]


@pytest.mark.parametrize(("ext", "text"), VALID)
def test_accepts_more(ext, text):
    ok, far = BY_EXTENSION[ext].check(text)
    assert ok, text[max(0, far - 40) : far] + "<<HERE>>" + text[far : far + 40]
    assert BY_EXTENSION[ext].check(text.replace("\n", "\r\n"))[0]


@pytest.mark.parametrize(("ext", "text"), INVALID)
def test_refuses_more(ext, text):
    assert not BY_EXTENSION[ext].check(text)[0]


def _own(text):
    try:
        ast.parse(text)
    except (SyntaxError, ValueError):
        return False
    return True


def test_no_module_of_the_library_is_refused():
    for p in sorted(Path(ast.__file__).parent.glob("*.py")):
        text = p.read_text("utf-8")
        assert BY_EXTENSION["py"].check(text)[0], p


def test_damaged_modules_agree_with_the_own_parser():
    rng = random.Random(7)
    for p in sorted(Path(ast.__file__).parent.glob("*.py")):
        lines = p.read_text("utf-8").split("\n")
        k = rng.randrange(len(lines))
        text = "\n".join(lines[max(0, k - 40) : k + 40])
        for _ in range(4):
            spots = [i for i, c in enumerate(text) if c in "(){}[];,'\"`:=.+\n"]
            if spots:
                at, how = rng.choice(spots), rng.randrange(3)
                bad = text[:at] + ("", text[at] * 2, "")[how] + (text[at + 1 :] if how < 2 else "")
                assert BY_EXTENSION["py"].check(bad)[0] == _own(bad), bad[max(0, at - 80) : at + 80]


PLAIN = {
    "py": ["a = b\n", "return f(x, 1)\n", 'g("s", h(k + 2))\n', "n += 3\n"], "rb": ["a = b\n", "return f(x, 1)\n", 'g("s", h(k + 2))\n', "n += 3\n"], "go": ["a := b\n", "return f(x, 1)\n", 'g("s", h(k + 2))\n', "n += 3\n"],
    "js": ["const a = b;\n", "return f(x, 1);\n", 'g("s", h(k + 2));\n', "n += 3;\n"], "ts": ["const a: T = b;\n", "return f(x, 1);\n", 'g("s", h(k + 2));\n', "n += 3;\n"], "java": ["var a = b;\n", "return f(x, 1);\n", 'g("s", h(k + 2));\n', "n += 3;\n"],
}
AROUND = {"py": "{}", "rb": "{}", "js": "function q() {{ {} }}", "ts": "function q() {{ {} }}", "go": "package p\nfunc q() {{\n{}}}\n", "java": "class Q {{ void q() {{ {} }} }}"}


@pytest.mark.parametrize("ext", PLAIN)
@settings(max_examples=120, deadline=None)
@given(data=st.data())
def test_runs_taken_in_one_match_are_those_of_the_grammar(ext, data):
    parts = data.draw(st.lists(st.sampled_from(PLAIN[ext]), max_size=5))
    text = list(AROUND[ext].format("".join(parts)))
    for _ in range(data.draw(st.integers(0, 3))):
        at = data.draw(st.integers(0, len(text) - 1)) if text else 0
        text[at : at + 1] = data.draw(st.sampled_from(["", "(", ")", '"', " ", "=", ",", "+", "if", "1", ".", "\n", "x y"]))
    whole = "".join(text)
    assert BY_EXTENSION[ext].check(whole)[0] == BY_EXTENSION[ext].slow.check(whole)[0]


def test_failures_are_told_in_the_original_text():
    for ext, text in [("go", "package a\r\n/* x\ny */ // z\r\nfunc f() {\r\n  x := := 1\r\n}\r\n"), ("rb", "=begin\nx\n=end\na = <<~T\n  q\nT\nb = ) := 1\n"), ("py", "\ufeff# c\r\n\r\nif a:\r\n    # d\r\n    x = := 1\r\n"), ("js", "\ufeff// a\nx = := 1\n")]:
        ok, far, why = parsing.failure(ext, text)
        assert not ok and text[far:].lstrip(") ").startswith(":= 1") and why == "syntax", (ext, far, text[far:])


def test_causes():
    long = "class A:\n    def f(self):\n        return 1\n\nx = A()\n"
    assert parsing.failure("js", long)[2] == "language" and parsing.failure("py", "print 'x'\n")[2] == "syntax" and parsing.failure("py", "<?xml version='1.0'?>\n<a/>")[2] == "language"
    assert parsing.failure("py", "x = 1\ny = 'abc")[2] == "truncated" and parsing.failure("js", "f(1, `a ${b} c")[2] == "truncated" and parsing.failure("js", "a(];\n" + "b();\n" * 40)[2] == "syntax"


def test_depth_is_bounded_by_memory_alone():
    assert BY_EXTENSION["json"].check("[" * 40_000 + "]" * 40_000)[0] and not BY_EXTENSION["json"].check("[" * 40_000 + "]" * 39_999)[0]
    assert BY_EXTENSION["js"].check("x = " + "(" * 3000 + "1" + ")" * 3000)[0]
