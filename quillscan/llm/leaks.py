"""Problem 9: evaluation texts inside a corpus.

Texts become plain word sequences. Every run of 14 words of an item is a window, and so
is every run of 14 words of a document. A CGK random walk (Chakraborty, Goldenberg,
Koucky 2016) embeds a window so that a small edit distance becomes a small Hamming
distance; repeated bit-sampling turns the embedding into keys, and windows that share a
key are compared by exact edit distance. Items are the stated query set: they go out in
blocks of a fixed size, and each block sees every document.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.session import spread

WINDOW = 14
ERRORS = 2  # edits up to which windows are compared; one may count, two count inside a longer passage
PASSAGE = 20  # words from which a passage may hold one edit in ten words
STEPS = 28  # walk steps; half of them advance, so a walk crosses the window once
SAMPLED = 5
REPEATS = 16
SHARED_RUN = 8
#: Items sent to the executors at once; more items go in further passes over the corpus.
BLOCK = 2000

# Letters of other scripts that look like Latin ones.
LOOKALIKE = str.maketrans(
    "аеорсухіјѕԁһԛԝҽәνοαρτικυχηωεσγмтвнкАВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡɑⅼ",
    "aeopcyxijsdhqweavoaptikuxnwesymtbhkABEKMHOPCTYXIJSABEZHIKMNOPTYXigal",
)
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿\U000e0000-\U000e007f]")
BROKEN_WORD = re.compile(r"(?<=\w)[-‐‑]\s*\n[>\s*#|/]*(?=\w)")
INLINE = re.compile(r"</?(?:b|i|u|em|strong|code|span|tt|mark|sub|sup|a|font)(?:\s[^<>]*)?>", re.I)
TAG = re.compile(r"<[/!]?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)
ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\([nrtbf])|\\(.)")
MARKUP = re.compile(r"[*_`~'’‘]+")
WORD = re.compile(r"[^\W_]+")


def _escaped(m: re.Match) -> str:
    if m[1] or m[2]:
        return chr(int(m[1] or m[2], 16))
    return " " if m[3] else m[4]


def words_of(text: str) -> list[str]:
    """The words of a text without case, spacing, punctuation, markup, escapes and look-alikes."""
    s = text
    if "&" in s:
        s = html.unescape(html.unescape(s))
    if "\\" in s:
        s = ESCAPE.sub(_escaped, s.replace("\\\\", "\\"))
    if s.count("%20") > 2:
        s = re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), s)
    if not s.isascii():
        s = INVISIBLE.sub("", unicodedata.normalize("NFKC", s)).translate(LOOKALIKE)
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    s = BROKEN_WORD.sub("", re.sub(r"=\r?\n(?=\S)", "", s) if "=\n" in s or "=\r\n" in s else s)
    if "<" in s:
        s = TAG.sub(" ", INLINE.sub("", s))
    return WORD.findall(MARKUP.sub("", s).lower())


def walk_tables(vocabulary: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The coins of the walks (repeat, step, word) and the sampled steps of each repeat."""
    rng = np.random.default_rng(seed)
    coins = rng.integers(0, 2, (REPEATS, STEPS, vocabulary), np.uint8)
    return coins, np.sort(np.array([rng.choice(STEPS - 4, SAMPLED, replace=False) for _ in range(REPEATS)]), 1)


def walk_keys(ids: np.ndarray, starts: np.ndarray, coins: np.ndarray, sampled: np.ndarray) -> Iterator[np.ndarray]:
    """Per repeat a key of every window: the embedding's symbols at the sampled steps."""
    padded = np.concatenate([ids, np.zeros(WINDOW, ids.dtype)])
    for r in range(REPEATS):
        at = np.zeros(len(starts), np.int64)
        key = np.full(len(starts), r + 1, np.uint64)
        last = sampled[r][-1]
        chosen = set(sampled[r].tolist())
        for j in range(last + 1):
            sym = np.where(at < WINDOW, padded[starts + np.minimum(at, WINDOW - 1)], 0)
            if j in chosen:
                key = (key ^ sym.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            at += coins[r, j][sym]
        yield key


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """The edit distance between ``a`` and the nearest start of ``b`` (its end is free), or ``most`` + 1."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            return most + 1
    return min(row)


def prefix_distances(a: list[int], b: list[int], most: int) -> list[int]:
    """Per start of ``a``, the empty one first, its edit distance to the nearest start of ``b``; stops beyond ``most``."""
    row = list(range(len(b) + 1))
    out = [0]
    for i, x in enumerate(a, 1):
        new = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            new[j] = min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (x != b[j - 1]))
        if (least := min(new)) > most:
            break
        row = new
        out.append(least)
    return out


class Items:
    """A block of items: vocabulary, windows and their keys."""

    def __init__(self, rows: list[tuple[int, list[str], set[int]]]):
        self.vocabulary: dict[str, int] = {}
        self.texts: list[np.ndarray] = []
        self.owner: list[int] = []
        self.shared: list[list[int]] = []  # per text and k: how many of its first k words are shared
        where: list[tuple[int, int]] = []
        for item, words, shared in rows:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)
            k = len(self.texts)
            self.texts.append(ids)
            self.owner.append(item)
            self.shared.append(np.cumsum([0, *(p in shared for p in range(len(words)))]).tolist())
            for s in range(len(words) - WINDOW + 1):
                if sum(p in shared for p in range(s, s + WINDOW)) <= 1:
                    where.append((k, s))
        self.coins, self.sampled = walk_tables(len(self.vocabulary) + 1)
        self.where = np.array(where, np.int64).reshape(-1, 2)
        lengths = np.array([len(t) for t in self.texts], np.int64)
        offsets = np.cumsum(lengths) - lengths
        flat = np.concatenate(self.texts) if self.texts else np.empty(0, np.int64)
        starts = offsets[self.where[:, 0]] + self.where[:, 1] if len(self.where) else np.empty(0, np.int64)
        self.windows = flat[starts[:, None] + np.arange(WINDOW)] if len(starts) else np.empty((0, WINDOW), np.int64)
        self.window_owner = np.array(self.owner, np.int64)[self.where[:, 0]] if len(starts) else starts
        self.keys = []
        for key in walk_keys(flat, starts, self.coins, self.sampled):
            order = np.argsort(key, kind="stable")
            self.keys.append((key[order], order))

    def candidates(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(start of a document's window, number of an item's window) of all pairs that share a key."""
        pairs = []
        for (sorted_keys, order), key in zip(self.keys, walk_keys(ids, starts, self.coins, self.sampled)):
            lo, hi = np.searchsorted(sorted_keys, key, "left"), np.searchsorted(sorted_keys, key, "right")
            hit = np.nonzero(hi > lo)[0]
            n = (hi - lo)[hit]
            own = order[np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            pairs.append(np.repeat(starts[hit], n) * len(self.where) + own)
        return np.unique(np.concatenate(pairs))

    def distances(self, flat: np.ndarray, ends: np.ndarray, starts: np.ndarray, owns: np.ndarray) -> np.ndarray:
        """The exact edit distance of each pair up to ERRORS, else ERRORS + 1."""
        wide = WINDOW + ERRORS
        spots = starts[:, None] + np.arange(wide)
        doc = np.where(spots < ends[:, None], np.concatenate([flat, np.zeros(wide, flat.dtype)])[spots], -1)
        item = self.windows[owns]
        out = np.full(len(starts), ERRORS + 1)
        changed = (doc[:, :WINDOW] != item).sum(1)
        out[changed <= 1] = changed[changed <= 1]
        # a word of the item that the document's window lacks costs an edit
        rest = np.nonzero(changed > 1)[0]
        lacking = (doc[rest][:, None, :] != item[rest][:, :, None]).all(2).sum(1)
        for r in rest[lacking <= ERRORS]:
            out[r] = edit_distance(item[r].tolist(), [x for x in doc[r].tolist() if x >= 0], ERRORS)
        return out

    def holds_passage(self, doc: list[int], s: int, own: int) -> bool:
        """Does a passage of PASSAGE words or more of the item, with at most one edit in ten, lie around a pair of windows?"""
        k, q = self.where[own].tolist()
        text, shared = self.texts[k].tolist(), self.shared[k]
        most = len(text) // 10
        if len(text) < PASSAGE:
            return False
        after = prefix_distances(text[q:], doc[s : s + len(text) - q + most], most)
        before = prefix_distances(text[:q][::-1], doc[max(0, s - q - most) : s][::-1], most)
        for a, x in enumerate(before):
            for b in range(max(WINDOW, PASSAGE - a), len(after)):
                if x + after[b] <= (a + b) // 10 and shared[q + b] - shared[q - a] <= 1:
                    return True
        return False

    def search(self, docs: list[list[str]]) -> list[set[int]]:
        """The items that each document holds."""
        get = self.vocabulary.get
        lengths = np.array([len(d) for d in docs], np.int64)
        flat = np.array([get(w, 0) for d in docs for w in d], np.int64)
        found: list[set[int]] = [set() for _ in docs]
        if len(flat) < WINDOW or not len(self.where):
            return found
        # a window with too many words that no item has can't be within the distance
        foreign = np.concatenate([[0], np.cumsum(flat == 0)])
        starts = np.nonzero(foreign[WINDOW:] - foreign[:-WINDOW] <= ERRORS)[0]
        ends = np.cumsum(lengths)
        owner = np.searchsorted(ends, starts, "right")
        starts, owner = starts[inside := starts + WINDOW <= ends[owner]], owner[inside]
        if not len(starts):
            return found
        at = dict(zip(starts.tolist(), owner.tolist()))
        near: dict[int, dict[int, int]] = {}
        twice: dict[tuple[int, int], list[int]] = {}  # windows of an item two edits from a document's window
        pairs = self.candidates(flat, starts)
        for k in range(0, len(pairs), 20_000):
            first, own = np.divmod(pairs[k : k + 20_000], len(self.where))
            apart = self.distances(flat, ends[np.searchsorted(ends, first, "right")], first, own)
            close = apart <= ERRORS
            for s, o, x, e in zip(first[close].tolist(), own[close].tolist(), self.window_owner[own[close]].tolist(), apart[close].tolist()):
                seen = near.setdefault(s, {})
                seen[x] = min(e, seen.get(x, e))
                if e == ERRORS:
                    twice.setdefault((s, x), []).append(o)
        tally: list[dict[int, list[int]]] = [{} for _ in docs]
        for s, own in near.items():
            least = min(own.values())
            best = [x for x, e in own.items() if e == least]
            for x in best:
                # a window that lies as near to several items is wording that they share
                t = tally[at[s]].setdefault(x, [0, 0, 0, 0])
                t[3 if len(best) > 1 else least] += 1
        for d, seen in enumerate(tally):
            found[d] = {x for x, (exact, one, _, ties) in seen.items() if exact or one > 1 or one and not ties}
        # what two edits in every window hide: passages long enough for them
        wide: dict[tuple[int, int], int] = {}
        bounds = np.concatenate([[0], ends])
        for (s, x), owns in twice.items():
            d = at[s]
            if x in found[d] or min(near[s].values()) < ERRORS or len(near[s]) > 1 or wide.get((d, x), 0) > 1:
                continue
            doc, s = flat[bounds[d] : bounds[d + 1]].tolist(), s - int(bounds[d])
            wide[d, x] = wide.get((d, x), 0) + any(self.holds_passage(doc, s, o) for o in owns)
        for (d, x), n in wide.items():
            if n > 1 or n and not tally[d][x][3]:
                found[d].add(x)
        return found


def _item_texts(items: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(item, part, words) of each text of an item."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(r[0], k, words_of(t)) for r in f.itertuples(index=False) for k, t in enumerate(r[1:]) if t]
            yield pd.DataFrame(rows, columns=["item", "part", "words"])

    return items.select(F.col(id_col).cast("bigint").alias("item"), *text_cols).mapInPandas(run, "item bigint, part int, words array<string>")


def _shared_places(texts: DataFrame) -> DataFrame:
    """(item, part, places): word positions inside a run that several items have."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, s, xxhash.xxh64_intdigest(" ".join(w[s : s + SHARED_RUN])) >> 1) for i, k, w in f.itertuples(index=False) for s in range(len(w) - SHARED_RUN + 1)]
            yield pd.DataFrame(rows, columns=["item", "part", "place", "run"])

    runs = texts.mapInPandas(run, "item bigint, part int, place int, run bigint")
    shared = runs.groupBy("run").agg(F.min("item").alias("a"), F.max("item").alias("b")).where("a < b")
    return runs.join(shared, "run", "left_semi").groupBy("item", "part").agg(F.collect_set("place").alias("places"))


def leaks(corpus: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_texts: list[str] | None = None) -> DataFrame:
    """``doc_id, item_id`` of every document that holds a passage of an item.

    Null, empty and blank texts hold nothing; a null item text is skipped; texts shorter
    than a window have none; an item counts once per document; repeated documents each
    count; with no items the result is empty.
    """
    texts = _item_texts(items, item_col, item_texts or ["prompt", "answer"])
    marked = texts.join(_shared_places(texts), ["item", "part"], "left")
    blocks = max(1, -(-items.count() // BLOCK))
    kind = f"{id_col} bigint, {item_col} bigint"
    out = None
    for b in range(blocks):
        rows = marked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item", "part").select("item", "words", "places").collect()
        block = [(r[0], list(r[1]), {p + k for p in r[2] or () for k in range(SHARED_RUN)}) for r in rows]

        def run(frames: Iterator[pd.DataFrame], block: list = block) -> Iterator[pd.DataFrame]:
            index = Items(block)
            for f in frames:
                for k in range(0, len(f), 500):
                    part = f.iloc[k : k + 500]
                    docs = [words_of(t) if t else [] for t in part["text"]]
                    pairs = [(i, x) for i, xs in zip(part["id"], index.search(docs)) for x in sorted(xs)]
                    yield pd.DataFrame(pairs, columns=[id_col, item_col])

        found = spread(corpus.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))).mapInPandas(run, kind)
        out = found if out is None else out.unionByName(found)
    return out
