import json

from quillscan.operators import flatten


def rows(df):
    return sorted((r.child_table, r.record_id, r.pos_path) for r in df.collect())


def test_arrays_against_plain_walk(spark):
    kind = "id long, a array<struct<name:string,b:array<string>,c:struct<d:array<long>>>>, child_table string"
    data = [(1, [("x", ["p", None, "q"], ([1],)), None, ("y", None, None), ("z", [], ([None, 2],))], "t"), (2, None, "t"), (3, [], None)]
    got = rows(flatten.flatten_arrays(spark.createDataFrame(data, kind), "id", ["a"]))
    want = []
    for i, a, _ in data:
        for k, e in enumerate(a or []):
            if e is not None:
                want.append(("a", i, f"{k}"))
                want += [("a.b", i, f"{k}.{j}") for j, x in enumerate(e[1] or []) if x is not None]
                want += [("a.c.d", i, f"{k}.{j}") for j, x in enumerate((e[2] or ([],))[0]) if x is not None]
    assert got == sorted(want)


def test_json_of_uneven_shape(spark):
    node = {"id": "n", "metadata": {"refs": [{"e": 1}, None]}}
    texts = {
        1: {"nodes": [node, None, "plain"], "edges": None}, 2: {"nodes": node, "edges": {"id": 1}}, 3: {"nodes": json.dumps([node]), "edges": "[]"}, 4: json.dumps({"nodes": [json.dumps(node)]}),
        5: {"nodes": [{"metadata": None}, {"metadata": {"refs": {"e": 2}}}], "edges": 7},
    }
    data = [(k, json.dumps(v), 0) for k, v in texts.items()] + [(8, None, 0), (9, "", 0), (10, "no json", 0), (11, "null", 0)]
    got = rows(flatten.flatten_json(spark.createDataFrame(data, "id long, g string, element int"), "id", "g"))
    assert got == sorted([
        ("g.nodes", 1, "0"), ("g.nodes", 1, "2"), ("g.nodes.metadata.refs", 1, "0.0"), ("g.nodes", 2, "0"), ("g.nodes.metadata.refs", 2, "0.0"), ("g.edges", 2, "0"), ("g.nodes", 3, "0"), ("g.nodes.metadata.refs", 3, "0.0"),
        ("g.nodes", 4, "0"), ("g.nodes.metadata.refs", 4, "0.0"), ("g.nodes", 5, "0"), ("g.nodes", 5, "1"), ("g.nodes.metadata.refs", 5, "1.0"),
    ])


def test_long_text_and_empty_table(spark):
    big = json.dumps({"nodes": [{"id": "x" * 200_000}] * 3})
    df = spark.createDataFrame([(1, big)], "id long, g string")
    assert flatten.flatten_json(df, "id", "g").count() == 3
    assert flatten.flatten_json(df.limit(0), "id", "g").count() == 0


def test_child_table_links_to_its_parent(spark):
    df = spark.createDataFrame([(7, [([("s", 0.5)],), ([],), ([("t", None), None],)])], "id long, r array<struct<smells:array<struct<smell:string,confidence:double>>>>")
    got = sorted(map(tuple, flatten.child_table(df, "id", "r", "r.smells").collect()))
    assert got == [(7, "0.0", "0", "s", 0.5), (7, "2.0", "2", "t", None)]
