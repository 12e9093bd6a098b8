"""Problem 8: encode a corpus with a public byte-pair vocabulary.

A partition is encoded word by word, each distinct word once. Within a batch all new
words form one symbol chain with a pair occurrence index: for every mergeable pair the
positions at which it stands. Active ranks are applied in ascending order, each to all
of its positions at once, and only the lists of the neighbouring pairs change.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillscan.session import spread

#: Words kept per Python worker; beyond it the table starts anew (results don't depend on it).
SLICE_BYTES = 16 << 20
WORDS_KEPT = 400_000


@lru_cache(maxsize=2)
def vocabulary(path: str | None) -> tuple[dict[bytes, int], dict[int, bytes], object]:
    import public_tokenizers
    import regex

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ranks, {v: k for k, v in ranks.items()}, regex.compile(public_tokenizers.PATTERN)


class PairIndex:
    """Encodes words; ``known`` maps a word to its number, ``ids``/``starts`` hold the codes."""

    def __init__(self, path: str | None = None):
        self.ranks, self.texts, self.pattern = vocabulary(path)
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat: list[np.ndarray] = []
        self.lengths: list[int] = []

    def rank(self, a: int, b: int) -> int:
        r = self.pair_rank.get((a, b))
        if r is None:
            r = self.pair_rank[(a, b)] = self.ranks.get(self.texts[a] + self.texts[b], -1)
        return r

    def encode(self, words: list[str]) -> list[list[int]]:
        sym: list[int] = []
        ends: list[int] = []
        for w in words:
            sym.extend(self.byte_ids[b] for b in w.encode("utf-8", "surrogatepass"))
            sym.append(-1)
            ends.append(len(sym))
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[int, list[int]] = {}
        rank = self.rank
        for p in range(n - 1):
            a, b = sym[p], sym[p + 1]
            if a >= 0 and b >= 0 and (r := rank(a, b)) >= 0:
                places.setdefault(r, []).append(p)
        active = list(places)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            for p in sorted(places.pop(r)):
                a = sym[p]
                if a < 0:
                    continue
                q = nxt[p]
                b = sym[q]
                if b < 0 or rank(a, b) != r:
                    continue
                sym[p], sym[q] = r, -2
                after = nxt[p] = nxt[q]
                prv[after] = p
                if sym[after] >= 0 and (s := rank(r, sym[after])) >= 0:
                    if s not in places:
                        places[s] = []
                        heapq.heappush(active, s)
                    places[s].append(p)
                before = prv[p]
                if before >= 0 and sym[before] >= 0 and (s := rank(sym[before], r)) >= 0:
                    if s not in places:
                        places[s] = []
                        heapq.heappush(active, s)
                    places[s].append(before)
        out, start = [], 0
        for e in ends:
            out.append([x for x in sym[start : e - 1] if x >= 0])
            start = e
        return out

    def batch(self, texts: list[str | None]) -> pa.ListArray:
        if len(self.known) > WORDS_KEPT:
            self.clear()
        known, fresh, where, counts = self.known, [], [], []
        for t in texts:
            before = len(where)
            for w in self.pattern.findall(t) if t else ():
                k = known.get(w)
                if k is None:
                    k = known[w] = len(known)
                    fresh.append(w)
                where.append(k)
            counts.append(len(where) - before)
        for code in self.encode(fresh):
            self.flat.append(np.asarray(code, np.int64))
            self.lengths.append(len(code))
        lengths = np.asarray(self.lengths, np.int64)
        flat = np.concatenate(self.flat) if self.flat else np.empty(0, np.int64)
        self.flat = [flat]
        starts = np.cumsum(lengths) - lengths
        at = np.asarray(where, np.int64)
        taken = lengths[at] if len(at) else np.empty(0, np.int64)
        ends = np.cumsum(taken)
        total = int(ends[-1]) if len(ends) else 0
        index = np.arange(total) + np.repeat((starts[at] if len(at) else taken) - (ends - taken), taken)
        per_text = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return pa.ListArray.from_arrays(pa.array(per_text.astype(np.int32)), pa.array(flat[index]))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of slices of at most ``SLICE_BYTES`` of text, or of one row.

    A text has no more ids than bytes, so the 32-bit list offsets of a slice hold.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for k, n in enumerate(sizes):
        if k > start and held + n > SLICE_BYTES:
            yield start, k - start
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes) - start


def encode_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    """One row (id, ids) per row of ``df``.

    Null and empty texts give the empty list; strings that look like special tokens are
    ordinary text; other columns are ignored; repeated rows are encoded each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = PairIndex(vocabulary_path)
        for b in batches:
            for k, n in slices(b.column(1)):
                s = b.slice(k, n)
                yield pa.RecordBatch.from_arrays([s.column(0), index.batch(s.column(1).to_pylist())], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(df[id_col].alias("id"), df[text_col].alias("text"))).mapInArrow(run, f"id {kind}, ids array<bigint>").withColumnRenamed("id", id_col)
