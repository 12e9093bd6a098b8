import random

import pytest

from quillscan.llm import queries, sql, top_items
from tests.oracle import same_rows

KIND = "finding_key long, scan_id long, repo string, id string, severity string, confidence double, file_path string, file string"


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_rows_equal_the_sql(spark, tables, name):
    same_rows(spark, queries.queries()[name], sql.SQL[name], tables)


def brute(rows, n):
    seen, groups = {}, {}
    for r in sorted(rows):
        if None not in r[1:4] and r[1:4] in seen:
            continue
        seen[r[1:4]] = r
        if r[6] is not None:
            path = "/".join(s for s in r[6].replace("\\", "/").split("/") if s not in ("", ".", ".."))
            s = (r[4] or "").strip(" ").lower()
            order = (top_items.SEVERITIES.index(s) if s in top_items.SEVERITIES else 5, -(r[5] if r[5] is not None else -1), r[0])
            groups.setdefault((r[2], path), []).append((order, r[0]))
    return sorted((k, i) for g in groups.values() for i, (_, k) in enumerate(sorted(g)[:n], 1))


@pytest.mark.parametrize("heavy_from", [1, 40, 10**9])
def test_hot_and_cold_groups_agree_with_brute_force(spark, heavy_from):
    rng = random.Random(5)
    rows = [(k, rng.choice([1, 2]), rng.choice(["a", "b", None]), rng.choice([f"i{rng.randrange(300)}", None]), rng.choice([" High", "critical", "LOW ", None, "odd", "info"]), rng.choice([None, 0.5, 0.5, 0.9, 0.1]), rng.choice(["x/y.py", "x\\.\\y.py", "/x/../y.py", None, "z", ""]), "clash") for k in range(600)]
    got = sorted(map(tuple, top_items.top_findings(spark.createDataFrame(rows, KIND), 3, heavy_from).collect()))
    assert got == brute([r[:7] for r in rows], 3)


def test_empty_table(spark):
    assert top_items.top_findings(spark.createDataFrame([], KIND)).count() == 0
