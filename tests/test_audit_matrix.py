"""Ground truth: small repositories whose findings are known, all analysed in one job."""

import random
from collections import Counter

import pytest

from quillscan.operators import audit
from quillscan.plans.pipeline import analyse

LANGUAGES = {"ts": "src/{}.ts", "py": "src/{}.py", "go": "src/{}.go", "java": "src/{}.java", "rb": "src/{}.rb"}
# The severity of each category.
SEVERITY = {"hardcoded_secret": "critical", "command_injection": "high", "high_complexity": "high", "god_class": "high", "circular_dependency": "high", "missing_tests": "high", "weak_crypto": "medium", "empty_handler": "medium", "long_function": "medium", "deep_nesting": "medium", "large_file": "medium", "tight_coupling": "medium", "magic_number": "low", "todo_debt": "low"}
rng = random.Random(11)


def token() -> str:
    return "ghp_" + "".join(rng.choice("abcdefghjkABCDEFGHJK23456789") for _ in range(36))


def wrap(lang: str, lines: list[str], name: str = "run", depth: int = 0) -> str:
    """A function of the given lines."""
    body = "".join(f"    {x}\n" for x in lines)
    return {"ts": f"export function {name}(a) {{\n{body}}}\n", "py": f"def {name}(a):\n{body or '    return a' + chr(10)}", "go": f"package app\n\nfunc {name}(a int) {{\n{body}}}\n", "java": f"class App {{\n  public static void {name}(int a) {{\n{body}  }}\n}}\n", "rb": f"def {name}(a)\n{body}end\n"}[lang]


CALL = {"ts": "step();", "py": "step()", "go": "step()", "java": "step();", "rb": "step"}
LINE = {
    "hardcoded_secret": {"ts": lambda: f'const t = "{token()}";', "py": lambda: f't = "{token()}"', "go": lambda: f't := "{token()}"', "java": lambda: f'String t = "{token()}";', "rb": lambda: f't = "{token()}"'},
    "command_injection": {"ts": "execSync(a);", "py": "os.system(a)", "go": "exec.Command(a)", "java": "Runtime.getRuntime().exec(a);", "rb": "system(a)"},
    "weak_crypto": {"ts": 'createHash("md5");', "py": "hashlib.md5(a)", "go": "md5.Sum(a)", "java": 'MessageDigest.getInstance("MD5");', "rb": "Digest::MD5.new"},
    "magic_number": {"ts": "const n = 4711;", "py": "n = 4711", "go": "n := 4711", "java": "int n = 4711;", "rb": "n = 4711"},
    "empty_handler": {"ts": "try { step(); } catch (e) {}", "py": "try: step()\n    except Exception: pass", "go": "defer func() { recover() }()", "java": "try { step(); } catch (Exception e) {}", "rb": "begin\n      step\n    rescue\n    end"},
    "todo_debt": {"ts": "// TODO later", "py": "# TODO later", "go": "// TODO later", "java": "// TODO later", "rb": "# TODO later"},
}


def methods(lang: str, n: int) -> str:
    if lang == "ts":
        return "class Big {\n" + "".join(f"  m{k}() {{ return {k}; }}\n" for k in range(n)) + "}\n"
    if lang == "java":
        return "class Big {\n" + "".join(f"  void m{k}() {{ step(); }}\n" for k in range(n)) + "}\n"
    if lang == "go":
        return "package app\n\ntype Big struct {\n}\n\n" + "".join(f"func (b *Big) M{k}() {{ step() }}\n" for k in range(n))
    if lang == "py":
        return "class Big:\n" + "".join(f"    def m{k}(self): return {k}\n" for k in range(n))
    return "class Big\n" + "".join(f"  def m{k}\n  end\n" for k in range(n)) + "end\n"


def branches(lang: str, n: int) -> str:
    return wrap(lang, [{"ts": "if (a) { step(); }", "py": "if a: step()", "go": "if a > 1 { step() }", "java": "if (a > 1) { step(); }", "rb": "step if a"}[lang]] * n)


def nested(lang: str, n: int) -> str:
    if lang in ("py", "rb"):
        step = "    " if lang == "py" else "  "
        text = "".join(step * (k + 1) + ("if a:\n" if lang == "py" else "if a\n") for k in range(n)) + step * (n + 1) + "step()\n"
        return ("def run(a):\n" + text) if lang == "py" else "def run(a)\n" + text + "".join(step * (n - k) + "end\n" for k in range(n)) + "end\n"
    opened = {"ts": "if (a) {", "go": "if a > 1 {", "java": "if (a > 1) {"}[lang]
    return wrap(lang, [opened] * n + [CALL[lang]] + ["}"] * n)


def imports(lang: str, n: int) -> list[tuple[str, str]]:
    line = {"ts": 'import {{ a }} from "./m{}";', "py": "from src.m{} import a", "go": 'import "src/m{}"', "java": "import src.m{};", "rb": 'require_relative "m{}"'}[lang]
    text = "\n".join(line.format(k) for k in range(n)) + "\n"
    return [(LANGUAGES[lang].format("hub"), text)] + [(LANGUAGES[lang].format(f"m{k}"), wrap(lang, [CALL[lang]])) for k in range(n)] + [("tests/hub_test.py", "assert True\n")]


def bad(category: str, lang: str, name: str) -> list[tuple[str, str]]:
    path = LANGUAGES[lang].format(name)
    if category in LINE:
        line = LINE[category][lang]
        return [(path, wrap(lang, [CALL[lang], line() if callable(line) else line]))]
    if category == "tight_coupling":
        return imports(lang, 16)
    text = {"long_function": lambda: wrap(lang, [CALL[lang]] * 51), "large_file": lambda: "\n".join([CALL[lang]] * 601), "high_complexity": lambda: branches(lang, 26), "deep_nesting": lambda: nested(lang, 6), "god_class": lambda: methods(lang, 21)}[category]()
    return [(path, text)]


CATEGORIES = [*LINE, "long_function", "large_file", "high_complexity", "deep_nesting", "god_class", "tight_coupling"]


def cases() -> list[tuple[str, list[tuple[str, str]], Counter]]:
    out = []
    good = lambda lang, name="ok": (LANGUAGES[lang].format(name), wrap(lang, [CALL[lang]]))
    for lang in LANGUAGES:
        other = "py" if lang != "py" else "ts"
        for c in CATEGORIES:
            one = bad(c, lang, "hot")
            out += [
                (f"{c}-{lang}-clean", [good(lang), good(lang, "more")], Counter()), (f"{c}-{lang}-single", one, Counter([c])), (f"{c}-{lang}-neighbour", [*one, good(other, "near")], Counter([c])), (f"{c}-{lang}-noise", [("README.md", "# Notes\n"), *one, ("data.json", "{}")], Counter([c])),
                (f"{c}-{lang}-multi", [*one, (LANGUAGES[lang].format("todo"), LINE["todo_debt"][lang] + "\n")], Counter([c, "todo_debt"])),
            ]
            if c != "tight_coupling":
                out.append((f"{c}-{lang}-double", [*one, *bad(c, lang, "warm")], Counter({c: 2})))
        ring = [(LANGUAGES[lang].format(f"m{k}"), imports(lang, 3)[0][1].split("\n")[(k + 1) % 3] + "\n") for k in range(3)]
        out += [(f"ring-{lang}", ring, Counter({"circular_dependency": 3})), (f"line-{lang}", ring[:2] + [good(lang, "m2")], Counter()), (f"untested-{lang}", [good(lang, f"f{k}") for k in range(8)], Counter(["missing_tests"]))]
        out += [(f"b-lines-{lang}-{n}", [(LANGUAGES[lang].format("x"), wrap(lang, [CALL[lang]] * n))], Counter(["long_function"] * (n > 50))) for n in (45 if lang == "java" else 49, 51)]  # a Java class around it counts its lines too
        out += [(f"b-file-{lang}-{n}", [(LANGUAGES[lang].format("x"), "\n".join([CALL[lang]] * n))], Counter(["large_file"] * (n > 600))) for n in (599, 601)]
        out += [(f"b-branch-{lang}-{n}", [(LANGUAGES[lang].format("x"), branches(lang, n))], Counter(["high_complexity"] * (n > 25))) for n in (24, 26)]
        out += [(f"b-method-{lang}-{n}", [(LANGUAGES[lang].format("x"), methods(lang, n))], Counter(["god_class"] * (n > 20))) for n in (19, 21)]
        out += [(f"b-nest-{lang}-{n}", [(LANGUAGES[lang].format("x"), nested(lang, n))], Counter(["deep_nesting"] * (n > 5))) for n in (3, 6)]
        out += [(f"b-import-{lang}-{n}", imports(lang, n), Counter(["tight_coupling"] * (n > 15))) for n in (14, 16)]
        fixed = {"ts": 'execSync("ls -la");', "py": 'os.system("ls -la")', "go": 'exec.Command("sh", "-c", "ls")', "java": 'Runtime.getRuntime().exec("ls");', "rb": 'system("ls")'}[lang]
        out.append((f"static-{lang}", [(LANGUAGES[lang].format("x"), wrap(lang, [fixed]))], Counter()))
        out += [(f"artifact-{d}-{lang}", [(f"{d}/x.{lang}", wrap(lang, [LINE["command_injection"][lang]])), good(lang)], Counter()) for d in ("node_modules", "dist", "vendor")]
    traps = {"pattern": ("ts", "const m = pattern.exec(text);"), "comment": ("ts", "// eval(x)"), "name": ("ts", 'const q = "TODO_QUEUE";'), "docs": ("py", '"""os.system(cmd)"""'), "meant": ("ts", "try { step(); } catch (e) { /* ignore: best effort */ }"), "round": ("py", "n = 500"), "sample": ("py", 't = "ghp_example' + "a1" * 18 + '"'), "constant": ("ts", 'const c = "ls"; execSync(c);')}
    return out + [(f"trap-{k}", [(LANGUAGES[lang].format("x"), wrap(lang, [line]))], Counter()) for k, (lang, line) in traps.items()]


def test_every_case_gives_what_it_should(spark):
    every = cases()
    assert len(every) > 450
    rows = [(u, k, p, None, t) for u, (_, files, _) in enumerate(every) for k, (p, t) in enumerate(files)]
    a = analyse(spark.createDataFrame(rows, "scan_id long, ordinal long, path string, size long, content string"))
    raw = a.raw.select("unit", "category", "severity", "snippet", "tags").collect()
    got: dict[int, Counter] = {}
    for r in raw:
        got.setdefault(r.unit, Counter())[r.category] += 1
    wrong = {name: (dict(want), dict(got.get(u, Counter()))) for u, (name, _, want) in enumerate(every) if got.get(u, Counter()) != want}
    assert not wrong
    assert {(r.category, r.severity) for r in raw} <= set(SEVERITY.items()) and all(r.snippet and r.tags for r in raw)
    kind = "unit long, category string"
    expected = spark.createDataFrame([(u, c) for u, (_, _, want) in enumerate(every) for c in want], kind)
    total = audit.precision_recall(audit.compared(expected, a.raw, ["unit"]), ["category"]).collect()
    assert len(total) == len(SEVERITY) and all(r.precision == r.recall == 1.0 for r in total)


@pytest.mark.parametrize(("found", "wanted", "precision", "recall"), [([], [], None, None), (["a"], [], 0.0, 1.0), ([], ["a"], 0.0, 0.0), (["A", "b"], ["a", "a"], 1.0, 1.0)])
def test_precision_and_recall(spark, found, wanted, precision, recall):
    df = lambda xs: spark.createDataFrame([(1, x) for x in xs], "unit long, category string")
    rows = {r.category: (r.precision, r.recall) for r in audit.precision_recall(audit.compared(df(wanted), df(found), ["unit"]), ["category"]).collect()}
    assert rows.get("a") == ((precision, recall) if precision is not None else None)
