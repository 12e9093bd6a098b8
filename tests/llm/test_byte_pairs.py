import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillscan.llm.byte_pairs import PairIndex, encode_ids


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


CASES = [None, "", " ", "aaaa aaaaa", "<|endoftext|>", "x" * 5000, "don't  stop\n\n\tnow", "naïve — 漢字 🎉", "1234567 a1b2", "\u00a0\u200b", "ab" * 4000, "a\r\nb"]


def test_corpus_equals_the_public_encoder(spark, tables, reference):
    df = spark.read.parquet(f"{tables}/documents.parquet")
    got = {r.doc_id: list(r.ids) for r in encode_ids(df).collect()}
    want = {r.doc_id: reference.encode_ordinary(r.text or "") for r in df.collect()}
    assert got == want


def test_special_cases_and_clashing_columns(spark, reference):
    df = spark.createDataFrame([(k, t, "x", [1]) for k, t in enumerate(CASES)], "doc_id long, text string, id string, ids array<int>")
    got = {r.doc_id: list(r.ids) for r in encode_ids(df).collect()}
    assert got == {k: reference.encode_ordinary(t or "") for k, t in enumerate(CASES)}
    assert encode_ids(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcdeth .,'\n0漢é"), max_size=60), max_size=4))
def test_batches_do_not_matter(texts):
    import public_tokenizers as p
    import tiktoken

    index = PairIndex()
    got = [list(x) for t in texts for x in index.batch([t]).to_pylist()]
    assert got == PairIndex().batch(texts).to_pylist()
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=index.ranks, special_tokens={})
    assert got == [enc.encode_ordinary(t) for t in texts]


def test_slices_by_bytes(monkeypatch):
    import pyarrow as pa

    from quillscan.llm import byte_pairs

    monkeypatch.setattr(byte_pairs, "SLICE_BYTES", 10)
    cut = lambda xs: list(byte_pairs.slices(pa.array(xs, pa.string())))
    assert cut(["a" * 4, None, "é" * 3, "b", "c" * 40, "d"]) == [(0, 3), (3, 1), (4, 1), (5, 1)] and cut([]) == [] and cut([None, ""]) == [(0, 2)]
