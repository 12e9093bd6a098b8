"""Problem 5: generated, minified or vendored files, and data stored as code.

Merkle hashes run bottom-up: blocks of lines make files, files make directories. A
subtree that unrelated repositories share is vendored with all below it; a file most of
whose text lies in shared blocks is a patched copy. Rules on headers, names and layout
find what tools wrote.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.session import durable, spread

BLOCK_CHARS = 80  # shorter blocks (closing lines, imports) recur everywhere: they are hashed with their neighbours
SUBTREE_CHARS = 300  # smaller subtrees (empty packages) aren't evidence
SHARED_PART = 0.4
HOT = 1000  # a block that holds more than one in so many of all blocks is hot: there are fewer hot ones than that

CODE = frozenset("py js ts jsx tsx mjs cjs java go rb css scss less c h cc cpp hpp cs php rs kt swift scala sql sh lua pl r m vue html htm xml svg".split())
LOCK_NAME = re.compile(r"(?:^|/)(?:[\w.-]*[-.]lock(?:\.json|\.ya?ml)?|[\w-]*lock\.json|npm-shrinkwrap\.json|go\.sum|[\w.-]+\.lock)$", re.I)
LOCK_BODY = re.compile(r'"lockfileVersion"|"integrity"\s*:\s*"sha\d|^# THIS IS AN AUTOGENERATED FILE|^checksum = "', re.M)
GENERATED_NAME = re.compile(r"(?:_pb2(?:_grpc)?\.py|\.pb\.\w+|\.g\.\w+|\.gen\.\w+|[._]generated\.\w+|\.designer\.cs)$|(?:^|/)(?:generated|__generated__|autogen)/", re.I)
MINIFIED_NAME = re.compile(r"(?:\.min|\.bundle|-[0-9a-f]{8,})\.(?:m?js|css)$", re.I)
VENDORED_PATH = re.compile(r"(?:^|/)(?:node_modules|bower_components|third_party|vendor|Pods|site-packages|deps/[\w.-]+-\d+\.\d+[\w.]*)/")
_LEAD = r"^\s*(?://+|#+|/?\*+!?|--|<!--|;+|\"\"\"|''')\s*"
GENERATED_HEAD = re.compile(
    _LEAD + r"(?:code generated\b|(?:this|the) (?:file|code|module|source)(?: is| was| has been)? (?:auto(?:matically)?[- ]?)?generated\b(?! by hand)|auto(?:matically)?[- ]?generated\b|@generated\b|<auto-generated|generated (?:by|from|with|using)\b(?! hand)|do not (?:edit|modify)\b"
    r"|bu dosya .*otomatik|diese datei wurde .*(?:generiert|erzeugt)|automatisch (?:generiert|erzeugt)|este archivo .*(?:generado|autom)|ce fichier .*(?:généré|autom)|(?:source|wire|schema): ?[\w./-]+\.(?:schema|proto|thrift|avsc|idl)\s*$)",
    re.I | re.M,
)
VENDORED_HEAD = re.compile(_LEAD + r"(?:vendored from\b|copied from .*upstream|[\w.-]+ v?\d+\.\d+\.\d+(?: - released under\b|\s*$))", re.I | re.M)
NUMBERS = re.compile(r"(?:-?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)[\s,\[\](){};]+){8,}")
BLOB = re.compile(r"(?:[A-Za-z0-9+/=_-]{60,}|(?:\\x[0-9a-fA-F]{2}){12,}|(?:[A-Za-z0-9+/=]{40,}\"?[\s,+\\.]*\"?){3,})")
ROWS = re.compile(r"^[ \t]*(?:[\[({].*[\])}],?|\"(?:[^\"\\\n]|\\.)*\",?|'(?:[^'\\\n]|\\.)*',?)[ \t]*$", re.M)
SKELETON = {c: None for c in range(128) if chr(c).isalnum() or chr(c) in "_ \t$."}


COMMENT = re.compile(r"//|#|/?\*|--|<!--|;|[rRuU]?(?:\"\"\"|''')")
OPENING = re.compile(r"/\*|<!--|[rRuU]?(?:\"\"\"|''')")
CLOSING = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}


def _head(text: str) -> str:
    """The comments and blank lines before the code; lines inside a block comment get a star."""
    out = []
    closing = None
    for line in text.split("\n"):
        s = line.strip()
        if closing is None:
            if s and not COMMENT.match(s):
                break
            out.append(line)
            opened = OPENING.match(s)
            if not opened:
                continue
            closing, s = CLOSING[opened[0][-3:] if opened[0][-1] in "\"'" else opened[0]], s[opened.end() :]
        else:
            out.append(line if COMMENT.match(s) else "* " + s)
        if closing in s:
            # code after the end of a comment ends the region
            code = s[s.index(closing) + len(closing) :].strip()
            closing = None
            if code and not COMMENT.match(code):
                break
    return "\n".join(out)


def rule(path: str, text: str) -> str | None:
    """lock, generated, minified, data or vendored by name, header and layout; None for what may be hand-written."""
    name = path.replace("\\", "/")
    ext = name.rsplit(".", 1)[-1].lower()
    if LOCK_NAME.search(name) and (ext != "json" or LOCK_BODY.search(text)) or ext == "json" and text.count('"integrity"') > 2 and LOCK_BODY.search(text):
        return "lock"
    if VENDORED_PATH.search(name) and ext in CODE:
        return "vendored"
    if ext not in CODE:
        return None
    head = _head(text)
    if head and GENERATED_HEAD.search(head):
        return "generated"
    if head and VENDORED_HEAD.search(head):
        return "vendored"
    if GENERATED_NAME.search(name):
        return "generated"
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return None
    n = len(text)
    longest = max(map(len, lines))
    if ext in ("js", "mjs", "cjs", "css", "ts", "jsx") and (longest > 300 or MINIFIED_NAME.search(name)):
        dense = [x for x in lines if len(x) > 200]
        packed = sum(map(len, dense))
        blank = sum(x.count(" ") for x in dense)
        if packed > 0.7 * n and blank < 0.07 * packed and not any(len(m[0]) > 0.5 * n for m in BLOB.finditer(text)):
            return "minified"
        if MINIFIED_NAME.search(name) and n / len(lines) > 120 and text.count(" ") < 0.08 * n:
            return "minified"
    if n >= 400:
        if sum(map(str.isdigit, text)) > 0.25 * n and sum(len(m[0]) for m in NUMBERS.finditer(text)) > 0.6 * n:
            return "data"
        if longest > 60 and sum(len(m[0]) for m in BLOB.finditer(text)) > 0.5 * n:
            return "data"
    if len(lines) >= 12:
        shapes = Counter(x.translate(SKELETON) for x in lines)
        top = [c for _, c in shapes.most_common(4)]
        # three or four line shapes taking turns: what a tool writes for a list of fields
        if sum(top) > 0.9 * len(lines) and top[0] >= 8 and _repeats(lines):
            return "data" if sum(len(m[0]) for m in ROWS.finditer(text)) > 0.7 * n else "generated"
    return None


def _repeats(lines: list[str]) -> bool:
    """Do full line shapes (names, numbers and strings made equal) repeat all over?"""
    shapes = Counter(re.sub(r"[A-Za-z_]\w*", "a", re.sub(r"\d+", "0", re.sub(r"\"[^\"]*\"|'[^']*'", "s", x.strip()))) for x in lines)
    top = [c for _, c in shapes.most_common(4)]
    return sum(top) > 0.85 * len(lines) and top[0] >= 6


def leaves(text: str) -> tuple[list[tuple[int, int]], int, int]:
    """(hash and length of each block, hash of the file, its length), without indents and line-end kinds."""
    plain = "\n".join(map(str.strip, text.replace("\r\n", "\n").split("\n"))).strip()
    texts = [b for b in plain.split("\n\n") if b]
    blocks = []
    for k, b in enumerate(texts):
        first, end, n = k, k + 1, len(b)
        # a short block's hash covers the blocks after it, at the end of the file those before it
        while n < BLOCK_CHARS and end < len(texts):
            n, end = n + len(texts[end]), end + 1
        while n < BLOCK_CHARS and first > 0:
            first -= 1
            n += len(texts[first])
        if n >= BLOCK_CHARS:
            blocks.append((xxhash.xxh64_intdigest("\n\n".join(texts[first:end])) - (1 << 63), len(b)))
    return blocks, xxhash.xxh64_intdigest(plain) - (1 << 63), len(plain)


def scanned(files: DataFrame) -> DataFrame:
    """Per non-blank file with a path: its rule and its leaves."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, scan, repo, path, text in f.itertuples(index=False):
                if text and text.strip():
                    blocks, whole, size = leaves(text)
                    rows.append((i, scan, repo, path, rule(path, text), [{"h": h, "n": n} for h, n in blocks], whole, size))
            yield pd.DataFrame(rows, columns=["file_id", "scan_id", "repo", "path", "rule", "blocks", "hash", "size"])

    picked = files.select(F.col("file_id").cast("bigint"), F.col("scan_id").cast("bigint"), "repo", "path", "content").where("path is not null and length(content) > 0")
    return spread(picked).mapInPandas(run, "file_id bigint, scan_id bigint, repo string, path string, rule string, blocks array<struct<h:bigint,n:int>>, hash bigint, size int")


def _unrelated(owner: str = "owner") -> Column:
    return F.min(owner) != F.max(owner)


def shared_parts(nodes: DataFrame) -> DataFrame:
    """``file_id, part``: the share of a file's text in blocks that unrelated owners have."""
    blocks = nodes.select("file_id", "owner", "size", F.explode("blocks").alias("b")).select("file_id", "owner", "size", "b.h", "b.n")
    shared = durable(blocks.groupBy("h").agg(_unrelated().alias("s"), F.count(F.lit(1)).alias("rows")).where("s").select("h", "rows"))
    # a block may stand in a third of all files: the few hot ones go to every task, the rest meet by hash
    most = (nodes.agg(F.sum(F.size("blocks"))).first()[0] or 0) / HOT
    hot = blocks.join(F.broadcast(shared.where(F.col("rows") > most)), "h", "left_semi")
    cold = blocks.join(F.broadcast(shared.where(F.col("rows") > most)), "h", "left_anti").join(shared.where(F.col("rows") <= most), "h", "left_semi")
    hits = hot.unionByName(cold)
    return hits.groupBy("file_id").agg((F.sum("n") / F.max("size")).alias("part"))


def shared_files(nodes: DataFrame) -> DataFrame:
    """``file_id`` of each source file whose whole text unrelated owners have."""
    ext = F.lower(F.element_at(F.split("path", "\\."), -1))
    files = nodes.where((F.col("size") >= SUBTREE_CHARS) & ext.isin(sorted(CODE))).select("file_id", "owner", "hash")
    shared = files.groupBy("hash").agg(_unrelated().alias("s")).where("s").select("hash")
    return files.join(shared, "hash", "left_semi").select("file_id")


def shared_subtrees(nodes: DataFrame) -> DataFrame:
    """``scan_id, dir`` of each directory whose Merkle hash unrelated owners share.

    A directory's hash combines its children's names and hashes with xor, so a directory
    of any number of files is hashed by partial aggregates.
    """
    parts = F.filter(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), lambda s: ~s.isin("", "."))
    at = nodes.dropDuplicates(["scan_id", "path"]).select("scan_id", "owner", parts.alias("parts"), "hash", "size").where(F.size("parts") > 1)
    at = durable(at.select("scan_id", "owner", F.size("parts").alias("depth"), F.array_join(F.slice("parts", 1, F.size("parts") - 1), "/").alias("dir"), F.element_at("parts", -1).alias("name"), "hash", F.col("size").cast("bigint").alias("size")))
    deepest = at.agg(F.max("depth")).first()[0] or 0
    found, below = None, None
    for depth in range(deepest, 1, -1):
        level = at.where(F.col("depth") == depth).drop("depth")
        if below is not None:
            up = F.split("dir", "/")
            level = level.unionByName(below.select("scan_id", "owner", F.array_join(F.slice(up, 1, F.size(up) - 1), "/").alias("dir"), F.element_at(up, -1).alias("name"), "hash", "size"))
        # one level at a time: the plan stays as short as a level
        below = durable(level.groupBy("scan_id", "owner", "dir").agg(F.xxhash64(F.bit_xor(F.xxhash64("name", "hash")), F.bit_xor(F.xxhash64("hash", "name", F.lit(1))), F.count(F.lit(1))).alias("hash"), F.sum("size").alias("size")))
        found = below if found is None else found.unionByName(below)
    if found is None:
        return nodes.sparkSession.createDataFrame([], "scan_id bigint, dir string")
    found = found.where(F.col("size") >= SUBTREE_CHARS)
    shared = found.groupBy("hash").agg(_unrelated().alias("s")).where("s").select("hash")
    return found.join(shared, "hash", "left_semi").select("scan_id", "dir").distinct()


def judged(files: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """``file_id, reason`` of every file that no person of the project wrote.

    Repositories of one organisation (``catalog``: name, org) are related; a repository
    without one is related to itself only. Null and blank contents and null paths give
    no row; repeated files are judged each.
    """
    nodes = scanned(files)
    if catalog is not None:
        owners = catalog.where("name is not null").groupBy("name").agg(F.min("org").alias("org")).select(F.col("name").alias("repo"), "org")
        nodes = nodes.join(owners, "repo", "left").withColumn("owner", F.coalesce(F.concat(F.lit("org:"), "org"), "repo", F.lit(""))).drop("org")
    else:
        nodes = nodes.withColumn("owner", F.coalesce("repo", F.lit("")))
    nodes = durable(nodes)
    by_rule = nodes.where("rule is not null").select("file_id", F.col("rule").alias("reason"))
    copies = shared_parts(nodes).where(F.col("part") >= SHARED_PART).select("file_id", F.lit("vendored").alias("reason"))
    parts = F.filter(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), lambda s: ~s.isin("", "."))
    above = nodes.where("rule is null").select("file_id", "scan_id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("dir"))
    inside = above.join(shared_subtrees(nodes), ["scan_id", "dir"], "left_semi").select("file_id", F.lit("vendored").alias("reason"))
    whole = shared_files(nodes).select("file_id", F.lit("vendored").alias("reason"))
    return by_rule.unionByName(copies).unionByName(whole).unionByName(inside).groupBy("file_id").agg(F.min("reason").alias("reason"))


def not_handwritten(files: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    return judged(files, catalog).select("file_id")
