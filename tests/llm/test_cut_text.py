from quillscan.llm import cut_text

KIND = "section_id long, run_id long, provider string, body string, source string, state string"
DONE = "The loader reads the whole table and then drops it. Please split this part before the next release."
NEXT = " It also writes the log twice, which nobody needs, and the limit was never written down."


def found(spark, bodies):
    df = spark.createDataFrame([(k, k, p, b, "x", "y") for k, (p, b) in enumerate(bodies)], KIND)
    return {r.section_id for r in cut_text.cut_sections(df).collect()}


def test_endings():
    for text in (DONE, "Is it so?", 'He said "done".', "See above (see src/a.py)", "x\n\nFile: src/a.py", "Steps:\n- run `a`\n- stop `b`", "Code:\n```py\nx = 1\n```", "Fine. ✅"):
        assert cut_text.ending(text)[0] == "closed", text
    for text in ("It writes the \\u00", "Text [truncated]", "Steps:\n- run `a`\n- sto", "Code:\n```py\nx =", "caf\ufffd", "uses `loa"):
        assert cut_text.ending(text)[0] == "cut", text


def test_hidden_limit_under_each_encoding(spark):
    grow = lambda k: f"Run {k}. " + DONE + NEXT * 9
    bodies = [("A ", grow(k)[:300]) for k in range(40)] + [("b", ("é" + grow(k)).encode()[:256].decode("utf-8", "ignore")) for k in range(40)] + [("c", grow(k)[:200] + "…") for k in range(40)] + [(None, DONE)] * 3
    df = spark.createDataFrame([(k, k, p, b, "x", "y") for k, (p, b) in enumerate(bodies)], KIND)
    limits = {(r.source, r.encoding): r["limit"] for r in cut_text.storage_limits(cut_text.sections_pass(df, "section_id", "body", cut_text.source_of(df.provider))).collect()}
    assert limits["a", "chars"] == 300 and limits["b", "bytes"] in (255, 256) and limits["c", "kept:chars"] == 200
    got = found(spark, bodies)
    ends = lambda b: b.rstrip("…").rstrip().endswith(".")
    assert got == {k for k, (p, b) in enumerate(bodies) if not ends(b)}


def test_lower_limits_under_longer_texts(spark):
    plain = "We load the small table first and then the next one goes the same way"
    grow = lambda k, n: (f"Run {k}. " + DONE + NEXT * 9)[: n - len(plain) - 1] + " " + plain
    rows = [("A", "m", "256", grow(k, 300)) for k in range(20)] + [(" a", "m", "512", grow(k, 420)) for k in range(20)] + [("a", "m", None, DONE + NEXT * 9 + f" Run {k}" + " x" * k + ".") for k in range(30)]
    rows += [("a", "m", "", DONE + " " + plain + ".")] * 9 + [("a", "n", "", f"Run {k}. " + DONE + " " + plain) for k in (1, 22, 333)] + [("a", "n", "", DONE + NEXT + " " + plain)] * 12
    df = spark.createDataFrame([(k, k, p, b, "x", "y", m, t) for k, (p, m, t, b) in enumerate(rows)], KIND + ", model string, max_tokens string")
    assert {r.section_id for r in cut_text.cut_sections(df).collect()} == set(range(40))


def test_limit_of_one_group_among_texts_of_all_lengths(spark):
    body = lambda k, n: (f"Run {k}. " + DONE + NEXT * 9)[:n]
    rows = [("a", "x", "y", body(k, 300)) for k in range(12)] + [("a", "z", "y", body(1000 + k, 250 + k % 100)) for k in range(400)]
    df = spark.createDataFrame([(k, k, p, b, "x", "y", m, t) for k, (p, m, t, b) in enumerate(rows)], KIND + ", model string, max_tokens string")
    passed = cut_text.sections_pass(df, "section_id", "body", cut_text.source_of(df.provider), [df.model, df.max_tokens]).where("state != 'x'")
    got = {(r.group, r["limit"]) for r in cut_text.heaps(passed).where("encoding = 'chars'").collect()}
    assert got == {('{"source":"a","p0":"x"}', 300), ('{"source":"a","p0":"x","p1":"y"}', 300)}


def test_labels_blanks_and_repeats(spark):
    bodies = [("a", None), ("a", " \n"), ("a", "No action needed"), ("b", "No action needed"), ("a", "Done"), ("b", DONE + " The old load"), ("b", DONE + " The old load"), ("c", "We will see…"), ("c", DONE)]
    assert found(spark, bodies) >= {5, 6} and not found(spark, bodies) & {0, 1, 2, 3, 8}


def test_rates_and_empty_table(spark):
    df = spark.createDataFrame([(1, 1, "A", DONE, "", ""), (2, 2, "a", DONE + " The loa\\", "", "")], KIND)
    assert [tuple(r) for r in cut_text.cut_rates(df).collect()] == [("a", 2, 1, 0.5)]
    assert cut_text.cut_sections(df.limit(0)).count() == 0
