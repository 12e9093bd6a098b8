import json

from hypothesis import given, settings
from hypothesis import strategies as st

from quillscan.operators import schema_drift as sd

COLUMNS = "stream string, file_no int, payload string, record_id long, path string"


def changes(spark, files):
    rows = [("s", n, json.dumps(r) if r is not None else None, k, "clash") for n, records in files.items() for k, r in enumerate(records)]
    return sorted(tuple(r)[1:] for r in sd.drift(spark.createDataFrame(rows, COLUMNS)).collect())


def record(name, **fields):
    return {"repository": name, "classification": fields}


def test_each_kind_of_change(spark):
    one = [record(f"r{k}", loc=k * 7, stars=k, lang="go", tags=["a"]) for k in range(6)]
    two = [record(f"r{k}", loc_v2=k * 7, stars=str(k), tags=["a"], build="x") for k in range(6)]
    assert changes(spark, {1: one, 2: two, 5: two}) == [
        (2, "added", "", "classification.build"),
        (2, "removed", "classification.lang", ""),
        (2, "renamed", "classification.loc", "classification.loc_v2"),
        (2, "retyped", "classification.stars", "classification.stars"),
    ]


def test_outermost_path_and_array_elements(spark):
    one = [record("a", deep={"x": 1, "y": {"z": 2}}, items=["u"]), record("b", deep={"x": 3, "y": {"z": 4}}, items=["v"])]
    two = [record("a", items=[{"label": "u"}]), record("b", items=[{"label": "v"}])]
    assert changes(spark, {1: one, 2: two}) == [(2, "removed", "classification.deep", ""), (2, "retyped", "classification.items[]", "classification.items[]")]


def test_nulls_repeats_and_text_that_is_no_json(spark):
    one = [record("a", x=1, y=None), record("a", x=1, y=None), None, record("b", x=2)]
    assert changes(spark, {1: one, 2: [record("a", x=1), record("b", x=2, y=None)]}) == []
    bad = spark.createDataFrame([("s", 1, "{", 1, ""), ("s", 2, "[]", 2, ""), (None, 3, "{}", 3, ""), ("s", None, "{}", 4, "")], COLUMNS)
    assert sd.drift(bad).count() == 0


def test_removed_field_that_comes_back_is_added(spark):
    with_, without = [record("a", x=1, y=2)], [record("a", x=1)]
    assert changes(spark, {1: with_, 2: without, 3: with_}) == [(2, "removed", "classification.y", ""), (3, "added", "", "classification.y")]


def test_records_of_every_file_meet_in_one_table(spark):
    def rows(stream, files, start):
        return [(stream, n, json.dumps(r), start + 10 * n + k, "clash", "analysis_result") for n, records in files.items() for k, r in enumerate(records)]

    a = {
        1: [record(f"r{k}", loc=k * 7, stars=k, deep={"x": k, "y": "u"}) for k in range(4)],
        2: [record(f"r{k}", loc_v2=k * 7, stars=str(k), deep={"x": k, "y": "u"}) for k in range(4)],
        3: [record(f"r{k}", lines=k * 7, stars=str(k), deep={"x_new": k, "y": "u"}, loc="made anew") for k in range(4)],
    }
    b = {1: [record("r9", loc="many", stars=5)], 2: [record("r9", loc=1, stars=5)]}
    data = rows("s", a, 0) + rows("t", b, 100) + [("s", 1, json.dumps(a[1][0]), 99, "clash", "analysis_result"), ("s", 2, "{", 98, "", "analysis_result"), ("u", 1, "{}", 97, "", "demo_result")]
    table = sd.migrated(spark.createDataFrame(data, COLUMNS + ", doc_type string"), "analysis_result", "classification")
    assert table.select("classification.*").dtypes == [("deep", "struct<x:bigint,y:string>"), ("loc", "bigint"), ("loc_2", "string"), ("stars", "string")]
    got = {r.record_id: r for r in table.collect()}
    assert len(got) == 15 and got[98].other == "{" and got[98].classification is None
    for n in (1, 2, 3):
        for k in range(4):
            c = got[10 * n + k].classification
            assert (c.loc, c.stars, c.deep.x, c.deep.y, c.loc_2) == (k * 7, str(k), k, "u", "made anew" if n == 3 else None)
            assert json.loads(got[10 * n + k].other) == {"repository": f"r{k}"} and not got[10 * n + k].unfit
    assert got[110].classification.loc is None and got[110].unfit == {"classification.loc": '"many"'} and got[120].classification.loc == 1


def test_casts():
    assert [sd.cast(v, "integer") for v in ("12", 3.0, True, "x", [4], 2**70, 1.5)] == [12, 3, 1, None, 4, None, None]
    assert [sd.cast(v, "string") for v in (1, True, [1, "é"], "a")] == ["1", "true", '[1, "é"]', "a"]
    assert [sd.cast(v, "boolean") for v in ("yes", 0, "maybe")] == [True, False, None] and sd.cast("2.5e3", "decimal") == 2500.0


def test_empty_table(spark):
    assert sd.migrated(spark.createDataFrame([], COLUMNS + ", doc_type string"), "analysis_result", "classification").count() == 0
    assert sd.drift(spark.createDataFrame([], COLUMNS)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 9), max_size=5), st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 9), max_size=5))
def test_steps_account_for_every_field(old, new):
    shape = lambda d: {"root": "object"} | {f"root.{k}": "integer" for k in d}
    same = lambda a, b: int(old[a[-1]] == new[b[-1]])
    out = sd.steps(shape(old), shape(new), {(a, b): (1, same(a, b), same(a, b), same(a, b)) for a, b in sd.candidates(shape(old), shape(new))})
    gone = {a for c, a, _ in out if c in ("removed", "renamed")}
    come = {b for c, _, b in out if c in ("added", "renamed")}
    assert gone == {f"root.{k}" for k in old.keys() - new.keys()}
    assert come == {f"root.{k}" for k in new.keys() - old.keys()}


def test_renames_are_told_by_all_records(spark):
    # 600 records, a third of them of one repository; two fields come and only one holds the old values
    name = lambda k: "big" if k % 3 == 0 else f"r{k}"
    one = [record(name(k), loc=k * 7, empty={}) for k in range(600)]
    two = [record(name(k), size=k * 7, weight=k * 11, empty={}) for k in range(600)]
    assert changes(spark, {1: one, 2: two}) == [(2, "added", "", "classification.weight"), (2, "renamed", "classification.loc", "classification.size")]
    # records without a repository are entities of their own, and other records follow: only the values tell
    three = [{"id": f"a{k}", "classification": {"x": k % 50}} for k in range(400)]
    four = [{"id": f"b{k}", "classification": {"y": k % 50, "z": 1000 + k}} for k in range(400)]
    assert changes(spark, {1: three, 2: four}) == [(2, "added", "", "classification.z"), (2, "renamed", "classification.x", "classification.y")]
