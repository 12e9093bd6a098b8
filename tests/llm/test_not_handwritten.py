import pytest

from quillscan.llm import not_handwritten as n

KIND = "file_id long, scan_id long, repo string, path string, content string, owner string, hash string"
CODE = "\n\n".join(f"def step_{k}(a, b):\n    c = a + {k}\n    if b > c:\n        return call_{k}(b, {k * 7})\n    return helper(c - {k}, b)" for k in range(8))
FIELDS = "\n".join(f'exports.f{k} = {{ id: {k}, wire: {k % 4}, label: "f{k}" }};' for k in range(20))


@pytest.mark.parametrize(
    ("path", "text", "reason"),
    [
        ("src/a.py", "# Code generated by x. DO NOT EDIT.\nx = 1\n", "generated"), ("src/a.js", "/*\n * @generated by y\n */\nlet a;", "generated"), ("src/a_pb2.py", "x = 1\n", "generated"), ("src/w.js", "// wire layout 4\n" + FIELDS, "generated"), ("web/package-lock.json", '{"lockfileVersion": 2}', "lock"),
        ("node_modules/a/i.js", "x();", "vendored"), ("lib/z.js", "// Vendored from z 1.2.3, upstream revision ab\nx();", "vendored"), ("a.js", "!function(){" + "var a0=function(x){return x>1?x:2};" * 40 + "}();", "minified"), ("a.css", ".a{color:#fff;margin:1px}" * 40, "minified"),
        ("t.py", "T = [\n" + "  12, 99, 0x1f, 4.5,\n" * 60 + "]\n", "data"), ("t.py", 'T = "' + "QmFzZTY0" * 90 + '"\n', "data"),
        ("a.py", CODE, None), ("a.py", "x = 'Code generated by x. DO NOT EDIT.'\n" + CODE, None), ("a.py", "# this is generated by hand from the old sheet, please edit freely\n" + CODE, None), ("a.json", '{"a": [' + "1," * 300 + "1]}", None), ("README.md", "DO NOT EDIT", None), ("src/generators/a.py", CODE, None), ("src/vendors/a.py", CODE, None),
        ("a.py", 'NOTE = "' + "the old limits were never written down and nobody noticed " * 20 + '"\n', None), ("a.py", "\n", None),
    ],
)
def test_rules(path, text, reason):
    assert n.rule(path, text) == reason


LICENCE = [f"Licensed under the terms of paragraph {k}; see the file LICENCE." for k in range(30)]


@pytest.mark.parametrize(
    ("path", "text", "reason"),
    [
        ("a.go", "\n".join("// " + x for x in LICENCE) + "\n\n// Code generated by x. DO NOT EDIT.\npackage a\n", "generated"), ("a.java", "/*\nCopyright 2020 A\n" + "\n".join(LICENCE) + "\n\nThis file was automatically generated\n*/\nclass A {}\n", "generated"),
        ("a.py", '"""\nNotes on the parts.\n\nGenerated by tool 3.\n"""\nx = 1\n', "generated"), ("a.js", "/* one */\n/*\n two\n*/\n// Vendored from z 1.2.3\nx();\n", "vendored"), ("a.js", "/* one */ x();\n// Code generated by y. DO NOT EDIT.\n", None), ("a.js", "/*\n one\n*/\nx();\n/*\nCode generated by y.\n*/\n", None),
        ("a.py", 'x = 1\n"""\nGenerated by tool 3.\n"""\n', None), ("a.py", '"""One line."""\nimport a\n# generated by hand or from b\n', None),
    ],
)
def test_whole_leading_comments(path, text, reason):
    assert n.rule(path, text) == reason


def test_shared_trees_and_patched_copies(spark):
    patched = CODE.replace("call_3(b, 21)", "call_3(b, 99)").replace("    ", "\t").replace("\n", "\r\n")
    own = CODE.replace("step", "own").replace("helper", "mine").replace("call", "use")
    rows = [
        (1, 1, "a", "src/lib/z/z.py", CODE), (2, 1, "a", "src/lib/z/__init__.py", "v = 1"), (3, 2, "b", "core/ext/z.py", patched), (4, 2, "b", "core/own.py", own), (5, 3, "c", "q/z/z.py", CODE), (6, 3, "c", "q/z/__init__.py", "v = 1"),
        (7, 4, "d", "x.py", own.replace("own", "dee").replace("mine", "dmine").replace("use", "duse")), (8, 4, "d", None, CODE), (9, 4, "d", "e.py", None), (10, 5, "e1", "m.py", own.replace("own", "rel")), (11, 6, "e2", "m.py", own.replace("own", "rel")),
    ]
    files = spark.createDataFrame([(*r, "clash", "clash") for r in rows], KIND)
    catalog = spark.createDataFrame([("e1", "E"), ("e2", "E"), ("a", None)], "name string, org string")
    got = {r.file_id for r in n.not_handwritten(files, catalog).collect()}
    assert got == {1, 2, 3, 5, 6}


def test_copies_of_many_short_blocks(spark):
    forms = ["return {g}{k}(a)", "a += {g}[{k}]", "if a > {k}: raise {g}", "print({g}, {k} - a)", "yield from {g}(a * {k})", "del a[{k}:], {g}", "assert {g}.x != {k}", "global {g}; {g} = {k}", "with {g}() as b: b({k})", "for i in {g}: i({k})", "a = {{{k}: {g}}}", "return [{g} for _ in a][{k}]"]
    body = lambda g: "\n\n".join(f"def {g}{k}(a):\n    " + x.format(g=g, k=k) for k, x in enumerate(forms))
    short, mine = body("go"), body("hi")
    one_block = "# one\n\n" + "\n".join(" " * (k % 5) + x.format(g="lo", k=k) for k, x in enumerate(forms * 2))
    rows = [
        (1, 1, "a", "src/f.py", short), (2, 1, "a", "src/own.py", mine), (3, 2, "b", "q/g.py", short), (4, 2, "b", "q/own.py", mine.replace("hi", "own")), (5, 3, "c", "z/h.py", short.replace("a * 4", "a * 9")),
        (6, 3, "c", "z/x.py", one_block), (7, 1, "a", "src/y.py", one_block), (8, 1, "a", "LICENCE.md", "\n".join(f"{k} terms of {k * 3}" for k in range(60))), (9, 4, "d", "own.py", mine.replace("hi", "dee")), (10, 4, "d", "s.py", "a = 1\n\nb = 2"), (11, 5, "e", "s.py", "a = 1\n\nb = 2"),
    ]
    files = spark.createDataFrame([(*r, "clash", "clash") for r in rows], KIND)
    assert {r.file_id for r in n.not_handwritten(files).collect()} == {1, 3, 5, 6, 7}
    assert {r.file_id for r in n.shared_files(n.scanned(files).withColumn("owner", n.F.col("repo"))).collect()} == {1, 3, 6, 7}


def test_empty_table(spark):
    assert n.not_handwritten(spark.createDataFrame([], KIND)).count() == 0


def test_hot_blocks_and_deep_trees(spark, monkeypatch):
    block = "def shared_helper(value):\n    total = value + 3\n    return total * value - 7  # the same everywhere, word for word\n"
    own = lambda k: f"\n\ndef local_{k}(x):\n    return x + {k}\n"
    rows = [(k, k, f"r{k}", f"src/m{k}.py", block + own(k)) for k in range(30)] + [(100 + k, 100 + k, f"q{k}", f"src/n{k}.py", "def alone(x):\n    return x\n" + own(k) * 3) for k in range(10)]
    deep = "/".join("abcdefgh")
    rows += [(200 + k, 200 + k, f"d{k}", f"{'lib' if k else 'third'}/{deep}/tool{j}.py", f"def tool_{j}(x):\n    return x * {j}\n" * 12) for k in range(2) for j in range(3)]
    rows = [(500 + i, *r[1:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "file_id long, scan_id long, repo string, path string, content string")
    got = {}
    for hot in (1, 1000):
        monkeypatch.setattr(n, "HOT", hot)
        got[hot] = {r.file_id for r in n.not_handwritten(df).collect()}
    assert got[1] == got[1000] == {500 + i for i in range(30)} | {500 + i for i in range(40, 46)}
