import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quillscan.llm import leaks

WORDS = [a + b for a in "ba ke li mo nu ra se ti vo wu".split() for b in "dan fer gol him jus kap lin mot nes pir".split()]


def sentence(rng, n=26):
    return [rng.choice(WORDS) for _ in range(n)]


def run(spark, docs, items):
    d = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(docs)], "doc_id long, text string, id string")
    i = spark.createDataFrame([(k, p, a) for k, (p, a) in enumerate(items)], "item_id long, prompt string, answer string")
    return {tuple(r) for r in leaks.leaks(d, i).collect()}


def test_forms_of_a_passage(spark):
    rng = random.Random(1)
    w = sentence(rng)
    other = " ".join(sentence(rng, 40))
    p = w[4:20]
    one = p[:7] + ["changed"] + p[8:]
    docs = [
        " ".join(p), f"{other} {' '.join(p).upper()}, {other}", "\n> ".join(p), " ".join(f"**{x}**" for x in p), " ".join(f"<b>{x}</b>" for x in p), "&nbsp;".join(p), " ".join(one), " ".join(p).replace("a", "а").replace("o", "о"), "\\n".join(p), " ".join(x[:2] + "-\n" + x[2:] for x in p[:2]) + " " + " ".join(p[2:]),
        "\u200b".join(" ".join(p)), " ".join(w[4:14]), " ".join(sorted(p)), other, None, "", " ", " ".join(p[:7] + ["a1", "b2", "c3", "d4"] + p[11:]),
    ]
    assert run(spark, docs, [(" ".join(w), None), (None, "short one")]) == {(k, 0) for k in range(11)}


def test_shared_wording_does_not_count(spark):
    rng = random.Random(2)
    intro, a, b = sentence(rng, 20), sentence(rng), sentence(rng)
    items = [(" ".join(intro + a), "x"), (" ".join(intro + b), "y")]
    assert run(spark, [" ".join(intro), " ".join(intro + a[:5]), " ".join(intro + a[:18])], items) == {(2, 0)}
    assert run(spark, [" ".join(a)], []) == set() and run(spark, [], items) == set()


def test_recall_against_brute_force():
    rng = random.Random(3)
    items = [sentence(rng, 40) for _ in range(60)]
    docs, truth = [], []
    for k in range(400):
        w = items[k % 60]
        s = rng.randrange(0, 40 - 16)
        part = list(w[s : s + 16])
        part[rng.randrange(16)] = "zz"
        docs.append(sentence(rng, 30) + part + sentence(rng, 30))
        truth.append(k % 60)
    index = leaks.Items([(k, w, set()) for k, w in enumerate(items)])
    got = index.search(docs)
    assert sum(t in g for t, g in zip(truth, got)) >= 0.98 * len(docs)
    assert sum(len(g) for g in got) <= 1.02 * len(docs)


def test_two_replaced_words_in_twenty_against_brute_force():
    rng = random.Random(4)
    items = [sentence(rng, 40) for _ in range(60)]
    docs, truth = [], []
    for k, (i, j) in enumerate((i, j) for i in range(20) for j in range(i)):
        for n in (19, 20):
            s = rng.randrange(0, 40 - n)
            part = list(items[k % 60][s : s + n])
            part[min(i, n - 1)], part[j] = "zz", "yy"
            docs.append(sentence(rng, 30) + part + sentence(rng, 30))
            same = [x == y for x, y in zip(part, items[k % 60][s : s + n])]
            fits = lambda a, b: sum(same[a:b]) >= (b - a) - (1 if b - a < 20 else (b - a) // 10)
            truth.append({k % 60} if any(fits(a, b) for a in range(n) for b in range(a + 14, n + 1)) else set())
    index = leaks.Items([(k, w, set()) for k, w in enumerate(items)])
    assert index.search(docs) == truth and sum(map(len, truth)) < len(docs)


def test_longer_passage_stays_outside_shared_wording():
    rng = random.Random(5)
    w = sentence(rng, 40)
    part = w[:6] + ["zz", "yy"] + w[8:20]
    docs = [sentence(rng, 30) + p + sentence(rng, 30) for p in (part, part[:13] + part[14:], w[10:16] + ["zz", "zz"] + w[18:36] + ["zz", "zz"] + w[38:])]
    assert leaks.Items([(0, w, set())]).search(docs) == [{0}, set(), {0}]
    assert leaks.Items([(0, w, {0, 1, 2})]).search(docs[:1]) == [set()]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_prefix_distances(a, b):
    got = leaks.prefix_distances(a, b, 2)
    want = [leaks.edit_distance(a[:k], b, 2) if k else 0 for k in range(len(a) + 1)]
    assert got == want[: len(got)] and (len(got) == len(want) or want[len(got)] == 3)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=8), st.lists(st.integers(0, 3), max_size=10))
def test_edit_distance(a, b):
    def plain(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            row = [i] + [0] * len(y) if (old := row) is None else _step(old, i, p, y)
        return row[-1]

    def _step(old, i, p, y):
        new = [i]
        for j, q in enumerate(y, 1):
            new.append(min(new[-1] + 1, old[j] + 1, old[j - 1] + (p != q)))
        return new

    want = min(plain(a, b[:k]) for k in range(len(b) + 1))
    assert leaks.edit_distance(a, b, 2) == min(want, 3)
