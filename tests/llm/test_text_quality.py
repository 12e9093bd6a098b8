import numpy as np

from quillscan.llm import text_quality as q

PROSE = ["The old report was written before we had a queue, and it still assumes that there is none. Please read the note before you change it.", "DIE DATEI IST SO GROSS, DASS NIEMAND SIE MEHR VERSTEHT. WIR SOLLTEN SIE IN ZWEI TEILE LEGEN.", "> It took us an hour to see why the\n> result was empty, and we should fix\n> it before the next release."]
OTHER = ["a,b,c\n" + "x,12,4.5\n" * 12, "click here " * 20, "17, 99, 4021, 77, 12, 8, 5512, 904, 33, 71, 20, 11", "x9f3a7" * 40, "- src/a.py\n- src/b.py\n- lib/c.rb\n- lib/d.go\n- web/e.ts\n"]


def test_classes_of_a_small_corpus(spark):
    texts = [*PROSE * 4, *OTHER * 4, None, "", " \n"]
    df = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)], "doc_id long, text string, prose double")
    got = {r.id: r.text_class for r in q.classified(df).collect()}
    assert set(got) == set(range(32))
    assert {k for k, v in got.items() if v == "prose"} == set(range(12))
    assert {r.doc_id for r in q.not_prose(df).collect()} == set(range(12, 32))
    assert q.not_prose(df.limit(0)).count() == 0


def test_held_out_documents(spark, tables):
    df = spark.read.parquet(f"{tables}/documents.parquet")
    got = {r.id: (r.text_class, r.common_share) for r in q.classified(df).collect()}
    plain = [c for c, share in got.values() if share > 0.4]
    assert plain.count("prose") >= 0.95 * len(plain)


def test_statistics():
    seen, _ = q.measure("One two three.\nfour;")
    assert seen[1] == 4 and seen[4] == 1.0 and seen[2] == 3.75
    assert all(np.isfinite(q.measure(t)[1]).all() for t in ("x", "漢字", "-", "a" * 50_000, "\t1"))


def test_responsibilities_sum_to_one():
    means, classes = q.start()
    model = {"weights": np.full(len(means), 1 / len(means)), "means": means, "covs": np.array([np.eye(means.shape[1])] * len(means))}
    r = q.responsibilities(means, model)
    assert np.allclose(r.sum(1), 1) and [classes[k] for k in r.argmax(1)] == classes


def test_rounds_end_when_nothing_is_gained(spark, tables):
    stats = q.statistics(spark.read.parquet(f"{tables}/documents.parquet"), "doc_id", "text").cache()
    few, more = q.fit(stats, rounds=40), q.fit(stats, rounds=80)
    assert (few["means"] == more["means"]).all()
