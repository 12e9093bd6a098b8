"""Problem 3: text cut off by field limits.

Lengths are recomputed under alternative encodings (characters, bytes, UTF-16 units,
entity and JSON escaping, newline conversion, each with and without an appended cut
mark) and counted per source, model and token limit. A length at which texts heap up in
one encoding, at the top or below it, exposes a hidden limit. Then the endings are inspected: what plainly closes a text is
complete, what plainly breaks off is cut, and the rest is settled by the limits and by
how the corpus itself goes on after the same last words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscan.session import durable, spread

MARK = re.compile(r"(?:\s*(?:\[[^\]\n]*(?:truncat|cut off|snip|cont)[^\]\n]*\]|<[^>\n]*truncat[^>\n]*>|\([^)\n]*truncat[^)\n]*\)|\[(?:…|\.{3})\]))+\s*$", re.I)
ELLIPSIS = re.compile(r"\s*(?:…|\.{3,})\s*$")
CLOSED = re.compile(r"[.!?。！？؟](?:[\"'”’»›)\]*_`]|\s*[^\w\s.,;:!?…(\[{<&\\/'\"“`#$%@=+*|~^�-])*$")
SYMBOL = re.compile(r"(?<=[\w.!?)\"'])\s*[←-⯿\U0001f000-\U0001faff]️?$")
ITEM = re.compile(r"^\s*(?:[-*•+]|\d+[.)])(?:\s+|$)")
LABEL = re.compile(r"(?:\(see\s+[^\s()]+\.(?:{x})\)|^\s*[A-Z][\w ]*:\s+[^\s]+\.(?:{x}))$".replace("{x}", "py|js|ts|tsx|jsx|java|go|rb|rs|c|h|cc|cpp|cs|php|kt|swift|scala|sh|sql|css|html|xml|yml|yaml|toml|ini|md|txt|json|csv|lock"))
TOKEN = re.compile(r"[\w./-]*\w|[.!?…]+|[,;:]")
NAME = re.compile(r"[_/\\]|\w\.\w|[^\W\d_A-Z][A-Z]")
CONTROL = re.compile(r"[\x00-\x07\x0b\x0e-\x1f]")
NOT_ASCII = re.compile(r"[^\x00-\x7f]+")
BROKEN = re.compile(r"(?:�|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|\\|%[0-9A-Fa-f]?|&#?\w{0,6})$")


@lru_cache(maxsize=65536)
def _word(t: str) -> str:
    return "§" if NAME.search(t) else "0" if t.isdigit() else t.lower()


#: The encodings in which a length may be limited; ``kept`` ones leave out an appended cut mark.
ENCODINGS = [f"{kept}{x}" for kept in ("", "kept:") for x in "chars bytes utf16 lf lf_bytes crlf crlf_bytes entity entity_bytes json json_bytes json_ascii".split()]


def _sizes(s: str) -> list[int]:
    """The length of a text in each encoding, counted without encoding it."""
    n, wide = len(s), 0
    size = n if s.isascii() else len(s.encode("utf-8", "surrogatepass"))
    if size > n:
        wide = len(s.encode("utf-16-le", "surrogatepass")) // 2 - n
    dos = s.count("\r\n")
    breaks = s.count("\n")
    entity = 4 * s.count("&") + 3 * (s.count("<") + s.count(">")) + 5 * (s.count('"') + s.count("'"))
    short = sum(map(s.count, '"\\\n\r\t\b\f'))
    quoted = short + 5 * (len(CONTROL.findall(s)) if CONTROL.search(s) else 0)
    # every unit of UTF-16 that isn't ASCII takes six characters
    ascii_json = quoted if size == n else quoted + 6 * (n - len(NOT_ASCII.sub("", s)) + wide) - (n - len(NOT_ASCII.sub("", s)))
    return [n, size, n + wide, n - dos, size - dos, n - dos + breaks, size - dos + breaks, n + entity, size + entity, n + quoted, size + quoted, n + ascii_json]


def lengths(body: str) -> dict[str, int]:
    """The body's length in each encoding."""
    whole = _sizes(body)
    kept = ELLIPSIS.sub("", MARK.sub("", body))
    return dict(zip(ENCODINGS, whole + (whole if kept == body else _sizes(kept))))


def shapes(body: str) -> list[tuple[int, int]]:
    """(encodings as bits, length): the different lengths of a body, each with the encodings that give it."""
    out: dict[int, int] = {}
    for k, n in enumerate(lengths(body).values()):
        out[n] = out.get(n, 0) | 1 << k
    return [(mask, n) for n, mask in out.items()]


def followed(body: str) -> Iterator[tuple[str, str]]:
    """(last three words, what follows): ``end``, ``dots`` or ``more``."""
    for line in re.split(r"[\r\n]+", body):
        seen: list[str] = []
        for t in TOKEN.findall(line):
            if t[0] in ".!?…":
                if seen:
                    yield " ".join(seen[-3:]), "dots" if t in "…" or t.startswith("...") else "end"
                seen = []
            else:
                if seen:
                    yield " ".join(seen[-3:]), "more"
                seen.append(_word(t))


def ending(body: str) -> tuple[str, str]:
    """(state, last words): state ``cut``, ``closed`` or a reason to look further."""
    text = body.rstrip()
    if MARK.search(text):
        return "cut", ""
    dots = bool(ELLIPSIS.search(text))
    if dots:
        text = ELLIPSIS.sub("", text)
    line = re.split(r"[\r\n]+", text)[-1]
    words = [_word(t) for t in TOKEN.findall(line)]
    for k in range(len(words) - 1, -1, -1):
        if words[k][0] in ".!?…":
            words = words[k + 1 :]
            break
    key = " ".join(words[-3:])
    if dots:
        return "dots", key
    if BROKEN.search(text):
        return "cut", key
    if text.count("```") % 2:
        return "cut", key
    if text.endswith("```"):
        return "closed", key
    item = ITEM.match(line)
    if item and not CLOSED.search(text):
        shape = lambda s: re.sub(r"[^\W_][\w.]*|_\w+", "w", ITEM.sub("", s, count=1).strip())
        before = [shape(x) for x in re.split(r"[\r\n]+", text)[:-1] if ITEM.match(x)]
        now = shape(line)
        if not now or line.count("`") % 2:
            return "cut", key
        if before:
            return ("closed" if now == before[-1] or "`" not in before[-1] and len(now) >= len(before[-1]) else "cut"), key
        return ("closed" if line.rstrip().endswith("`") else "open"), key
    if LABEL.search(line.strip()):
        return "closed", key
    if text.count("`") % 2:
        return "cut", key
    if CLOSED.search(text) or SYMBOL.search(text):
        return "closed", key
    if not re.search(r"[.!?]\s", text) and "\n" not in text and len(text.split()) <= 6:
        return "label", key
    return "open", key


def source_of(provider: Column) -> Column:
    return F.lower(F.trim(provider))


def groups_of(source: Column, parts: list[Column]) -> Column:
    """The groups in which a text's length counts: its source, alone and with each choice of ``parts``."""
    named = [p.alias(f"p{k}") for k, p in enumerate(parts)]
    chosen = [[p for k, p in enumerate(named) if bits >> k & 1] for bits in range(1 << len(named))]
    return F.array_distinct(F.array(*(F.to_json(F.struct(source.alias("source"), *c)) for c in chosen)))


def sections_pass(df: DataFrame, id_col: str, text_col: str, source: Column, parts: list[Column] | None = None) -> DataFrame:
    """Per non-blank text: id, source, groups, state, last words, hash of the text, lengths by encoding."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, s, g, *ending(t), xxhash.xxh64_intdigest(t.strip()) >> 1, shapes(t)) for i, s, g, t in f.itertuples(index=False) if t and t.strip()]
            yield pd.DataFrame(rows, columns=["id", "source", "groups", "state", "last", "body", "lengths"])

    picked = df.select(F.col(id_col).cast("bigint").alias("id"), source.alias("source"), groups_of(source, parts or []).alias("groups"), F.col(text_col).alias("text"))
    return spread(picked).mapInPandas(run, "id bigint, source string, groups array<string>, state string, last string, body bigint, lengths array<struct<mask:int,length:int>>")


def continuations(df: DataFrame, text_col: str) -> DataFrame:
    """How often each run of up to three words ends a sentence, trails off or goes on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seen: dict[str, Counter] = {}
            for t in f["text"]:
                for key, what in followed(t) if t else ():
                    seen.setdefault(key, Counter())[what] += 1
            yield pd.DataFrame([(k, c["end"], c["dots"], c["more"]) for k, c in seen.items()], columns=["last", "ends", "dots", "more"])

    counted = spread(df.select(F.col(text_col).alias("text"))).mapInPandas(run, "last string, ends bigint, dots bigint, more bigint")
    return counted.groupBy("last").agg(F.sum("ends").alias("ends"), F.sum("dots").alias("dots"), F.sum("more").alias("more"))


def _names() -> Column:
    return F.array(*map(F.lit, ENCODINGS))


def _each_encoding(counts: DataFrame, keys: list[str], *sums: Column) -> DataFrame:
    """Counts by encodings as bits become counts by encoding; summed before the bits are taken apart."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(len(ENCODINGS) - 1)), lambda k: F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), k)) != 0)
    return counts.withColumn("encoding", F.explode(F.transform(bits, lambda k: F.get(_names(), k)))).groupBy(*keys, "encoding", "length").agg(*sums)


def storage_limits(passed: DataFrame, least: int = 8, times: float = 8.0) -> DataFrame:
    """Per source and encoding the length at which texts heap up at the top.

    A limit holds ``least`` texts or more within three units below it (a cut may drop a
    part of a character), ``times`` as many as the eight lengths below on average, and
    no longer text exists in that encoding.
    """
    shaped = passed.select("source", F.inline("lengths")).groupBy("source", "mask", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = _each_encoding(shaped, ["source"], F.sum("n").alias("n"))
    top = counts.groupBy("source", "encoding").agg(F.max("length").alias("limit"))
    near = counts.alias("c").join(top.alias("t"), (F.col("c.encoding") == F.col("t.encoding")) & F.col("c.source").eqNullSafe(F.col("t.source"))).where("c.length > t.limit - 12").select("c.source", "c.encoding", "t.limit", "c.length", "c.n")
    heap = near.groupBy("source", "encoding", "limit").agg(F.sum(F.when(F.col("length") > F.col("limit") - 4, F.col("n")).otherwise(0)).alias("at_limit"), F.sum(F.when(F.col("length") <= F.col("limit") - 4, F.col("n")).otherwise(0)).alias("below"))
    return heap.where((F.col("at_limit") >= least) & (F.col("at_limit") / 4 >= times * F.col("below") / 8))


def heaps(passed: DataFrame, least: int = 8, times: float = 8.0) -> DataFrame:
    """Per source, group and encoding every length at which broken texts heap up, longer texts or not.

    A heap holds ``least`` different texts or more within three units below its length,
    most of them without a closing end, and at the length itself ``times`` as many as the
    eight lengths below the heap or above it have on average. Equal texts of a source
    count once, so that fixed wording makes no heap. A group's heap that its source has
    too isn't repeated.
    """
    once = passed.withColumn("n", F.row_number().over(Window.partitionBy("source", "body").orderBy("id"))).where("n = 1")
    broken = F.col("state").isin("open", "cut", "dots").cast("int")
    shaped = once.select("source", "groups", broken.alias("broken"), F.inline("lengths")).groupBy("source", "groups", "mask", "length").agg(F.count(F.lit(1)).alias("n"), F.sum("broken").alias("broken"))
    shaped = shaped.select("source", F.posexplode("groups").alias("level", "group"), "mask", "length", "n", "broken")
    sums = [F.min("level").alias("level"), F.sum("n").alias("n"), F.sum("broken").alias("broken")]
    counts = _each_encoding(shaped.groupBy("source", "group", "mask", "length").agg(*sums), ["source", "group"], *sums)
    along = Window.partitionBy("source", "group", "encoding").orderBy("length")
    near = lambda c, a, b: F.coalesce(F.sum(c).over(along.rangeBetween(a, b)), F.lit(0))
    seen = counts.withColumns({"at_limit": near("n", -3, 0), "open": near("broken", -3, 0), "below": near("n", -11, -4), "above": near("n", 1, 8)})
    heap = seen.where((F.col("at_limit") >= least) & (F.col("open") * 2 > F.col("at_limit")) & (F.col("n") * 4 >= F.col("at_limit")) & (F.col("n") >= times * F.greatest("below", "above") / 8))
    top = F.min("level").over(Window.partitionBy("source", "encoding", "length"))
    return heap.withColumn("top", top).where("top > 0 or level = 0").select("source", "group", "encoding", F.col("length").alias("limit"))


def _marked(passed: DataFrame, limits: DataFrame) -> DataFrame:
    """The texts with ``at_limit``: does the length stand at a limit of the source or of one of the text's groups?"""
    bit = (F.array_position(_names(), F.col("encoding")) - 1).cast("int")
    per_source = limits.withColumn("encoding", bit).groupBy("source").agg(F.collect_set(F.struct("group", "encoding", "limit")).alias("limits"))
    same = passed.drop("at_limit").alias("p").join(per_source.alias("l"), F.col("p.source").eqNullSafe(F.col("l.source")), "left").select("p.*", "l.limits")
    sizes = F.array(*(F.lit(4 if "bytes" in e else 1) for e in ENCODINGS))
    at = lambda x, s: (s["mask"].bitwiseAND(F.call_function("shiftleft", F.lit(1), x["encoding"])) != 0) & (s["length"] <= x["limit"]) & (s["length"] > x["limit"] - F.get(sizes, x["encoding"]))
    within = lambda x: F.exists("lengths", lambda s: at(x, s))
    hit = F.exists("limits", lambda x: within(x) & (x["group"].isNull() | F.array_contains("groups", x["group"])))
    return same.withColumn("at_limit", F.coalesce(hit, F.lit(False))).drop("limits")


def judged(df: DataFrame, id_col: str = "section_id", text_col: str = "body", source_col: str = "provider", group_col: str = "run_id", part_cols: tuple[str, ...] = ("model", "max_tokens")) -> DataFrame:
    """``id, source, cut, at_limit`` of every non-blank text.

    Null and blank texts give no row. A null source is a source of its own. Repeated
    rows are judged each. Of ``part_cols``, those that the table has group the lengths.
    """
    parts = [source_of(F.col(c)) for c in part_cols if c in df.columns]
    passed = durable(sections_pass(df, id_col, text_col, source_of(F.col(source_col)), parts))
    top = durable(_marked(passed, storage_limits(passed).withColumn("group", F.lit(None).cast("string"))))
    # what stands at a limit in one encoding would heap up again in others
    rest = top.where("not at_limit")
    rows = _marked(rest, heaps(rest)).unionByName(top.where("at_limit")).drop("lengths", "groups")
    settled = rows.where(F.col("state").isin("cut", "closed")).select("id", "source", (F.col("state") == "cut").alias("cut"), "at_limit")
    unsure = rows.where(~F.col("state").isin("cut", "closed"))
    labels = unsure.where("state = 'label'").select("id", "body")
    runs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(group_col).alias("run"))
    known = labels.join(runs, "id").groupBy("body").agg(F.count_distinct("run").alias("runs"))
    looked = unsure.join(continuations(df, text_col), "last", "left").join(known, "body", "left")
    ends, dots, more = (F.coalesce(F.col(c), F.lit(0)) for c in ("ends", "dots", "more"))
    natural_dots = (dots >= 3) & (dots > more) & ~F.col("at_limit")
    sentence = (ends >= 3) & (ends * 3 >= more) & ~F.col("at_limit")
    fixed = (F.coalesce("runs", F.lit(0)) >= 2) | (F.size(F.split("last", " ")) < 3) & (ends + more == 0) & F.col("last").rlike("^\\S+( \\S+)?$") & ~F.col("at_limit")
    complete = F.when(F.col("state") == "dots", natural_dots).when(F.col("state") == "label", fixed | sentence).otherwise(sentence)
    return settled.unionByName(looked.select("id", "source", (~complete).alias("cut"), "at_limit"))


def cut_sections(sections: DataFrame) -> DataFrame:
    return judged(sections).where("cut").select(F.col("id").alias("section_id"))


def cut_rates(sections: DataFrame) -> DataFrame:
    """Per provider: non-blank sections, cut ones and their share."""
    return judged(sections).groupBy(F.col("source").alias("provider")).agg(F.count(F.lit(1)).alias("sections"), F.sum(F.col("cut").cast("bigint")).alias("cut"), F.avg(F.col("cut").cast("double")).alias("share"))
