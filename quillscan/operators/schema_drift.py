"""Problem 1: schemas that drift between files.

Every record is fingerprinted once: each path below the chosen roots with its type and
the hashed value of its entity. Per file the fingerprints merge into one schema version,
the types per path. A file's version is compared with the one before it; the differences
are the migration steps: renamed, added, removed, retyped. Whether a path that went is one
that came is told by the values of all records of both files. The steps chain:
``migrated`` composes those of a stream, in file order, into rename, default and cast
rules and applies them to every record, which gives one table per document type.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscan.session import durable

ROOTS = ["classification", "engineering_review"]
SQL_TYPE = {"string": "string", "integer": "bigint", "decimal": "double", "boolean": "boolean"}


def kind_of(v: object) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "integer"
    if isinstance(v, float):
        return "decimal"
    return "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def _walk(v: object, path: str, out: dict[str, tuple[set[str], list]]) -> None:
    if v is None:
        return
    kinds, values = out.setdefault(path, (set(), []))
    kinds.add(kind_of(v))
    if isinstance(v, dict):
        values.append(json.dumps(v, sort_keys=True))
        for k, x in v.items():
            _walk(x, f"{path}.{k}", out)
    elif isinstance(v, list):
        values.append(json.dumps(v, sort_keys=True))
        for x in v:
            _walk(x, f"{path}[]", out)
    else:
        values.append(json.dumps(v))


def _entity(doc: dict) -> str:
    """What a record is about: its repository; without one, the record itself."""
    r = doc.get("repository")
    if isinstance(r, dict):
        r = r.get("name")
    return str(r) if r is not None else str(doc.get("url") or doc.get("id"))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def observed(exports: DataFrame, roots: list[str] = ROOTS) -> DataFrame:
    """``stream, file_no, path, kind, entity, value``: what the records of a file hold at each path, entity and value hashed.

    A row of the empty path stands for the file itself. Rows that a batch would repeat are
    left out; values of all records are kept.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got: dict[tuple, None] = {}
            for stream, no, payload in frame.itertuples(index=False):
                try:
                    doc = json.loads(payload)
                except (TypeError, ValueError, RecursionError):
                    continue
                if not isinstance(doc, dict):
                    continue
                paths: dict[str, tuple[set[str], list]] = {}
                for root in roots:
                    _walk(doc.get(root), root, paths)
                entity = _signed(xxhash.xxh64_intdigest(_entity(doc)))
                got[stream, no, "", None, 0, 0] = None
                for path, (kinds, values) in paths.items():
                    value = _signed(xxhash.xxh64_intdigest("\0".join(values)))
                    got.update(((stream, no, path, kind, entity, value), None) for kind in kinds)
            yield pd.DataFrame(list(got), columns=["stream", "file_no", "path", "kind", "entity", "value"])

    picked = exports.select("stream", F.col("file_no").cast("bigint").alias("file_no"), "payload").where("stream is not null and file_no is not null")
    return picked.mapInPandas(run, "stream string, file_no bigint, path string, kind string, entity bigint, value bigint")


def schemas(seen: DataFrame) -> DataFrame:
    """``stream, file_no, path, kinds``: one row per path of a file; there are six kinds."""
    return seen.groupBy("stream", "file_no", "path").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def _settled(kinds: list[str]) -> str:
    """The type of a path in a file: integers among decimals are decimals; else the mix."""
    k = set(kinds)
    if k == {"integer", "decimal"}:
        return "decimal"
    return "+".join(sorted(k))


def _parent(path: str) -> str:
    return path[: path.rfind(".")] if "." in path else ""


def _bare(path: str) -> str:
    return re.sub(r"[^a-z0-9]", "", path[path.rfind(".") + 1 :].lower())


def _fields(schema: dict[str, str]) -> set[str]:
    return {p for p in schema if not p.endswith("]")}


def _outer(paths: set[str]) -> set[str]:
    return {p for p in paths if _parent(p).rstrip("[]") not in paths and not any(p.startswith((q + ".", q + "[")) for q in paths)}


def candidates(old: dict[str, str], new: dict[str, str]) -> list[tuple[str, str]]:
    """Pairs of a path that went and one that came beside the same siblings with the same type."""
    gone, come = _outer(_fields(old) - _fields(new)), _outer(_fields(new) - _fields(old))
    return [(a, b) for a in sorted(gone) for b in sorted(come) if _parent(a) == _parent(b) and old[a] == new[b]]


def steps(old: dict[str, str], new: dict[str, str], shared: dict[tuple[str, str], tuple[int, int, int, int]]) -> list[tuple[str, str, str]]:
    """The migration steps between two schema versions (path: type), outermost paths only.

    ``shared``, per candidate pair: values of the entities that both files have, how many
    of them agree, how many different values those are, and how many values the two sides
    have in common at all.
    """
    out: list[tuple[str, str, str]] = []
    gone, come = _outer(_fields(old) - _fields(new)), _outer(_fields(new) - _fields(old))
    pairs = []
    for (a, b), (both, same, distinct, common) in shared.items():
        need = 0.9 if old[a] == "boolean" else 0.5  # two booleans agree often by chance
        if both and same / both >= need or not both and common:
            pairs.append((same / max(1, both), distinct, _bare(a) == _bare(b), a, b))
    renamed: dict[str, str] = {}
    for _, _, _, a, b in sorted(pairs, reverse=True):
        if a not in renamed and b not in renamed.values():
            renamed[a] = b
    out += [("renamed", a, b) for a, b in renamed.items()]
    out += [("removed", a, "") for a in gone - renamed.keys()]
    out += [("added", "", b) for b in come - set(renamed.values())]
    changed = {p for p in old.keys() & new.keys() if old[p] != new[p]}
    out += [("retyped", p, p) for p in changed if not any(p != q and p.startswith((q + ".", q + "[")) for q in changed)]
    cut = [p for c, p, _ in out if c == "retyped"]
    return [(c, a, b) for c, a, b in out if c == "retyped" or not any((a or b).startswith((q + ".", q + "[")) for q in cut)]


def drift(exports: DataFrame, roots: list[str] = ROOTS) -> DataFrame:
    """``stream, file_no, change, old_path, new_path`` of every change against the file before.

    Records that aren't JSON objects hold no fields; repeated records change nothing; a
    null stream or file_no belongs to no file; the first file of a stream has no rows. A
    file whose records all lack the roots has an empty schema.
    """
    return _changes(durable(observed(exports, roots)))


def _shared_values(seen: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per candidate pair of ``pairs`` (stream, file_no, before, a, b) the counts that ``steps`` asks for, over all records.

    Both sides are counted in partial aggregates; no entity's or value's rows meet in one task before that.
    """
    pair = ["stream", "file_no", "a", "b"]
    old = seen.withColumnsRenamed({"file_no": "before", "path": "a"}).join(pairs, ["stream", "before", "a"]).select(*pair, "entity", "value", F.lit(1).alias("o"), F.lit(0).alias("n"))
    new = seen.withColumnRenamed("path", "b").join(pairs, ["stream", "file_no", "b"]).select(*pair, "entity", "value", F.lit(0).alias("o"), F.lit(1).alias("n"))
    each = old.unionByName(new).groupBy(*pair, "entity", "value").agg(F.max("o").alias("o"), F.max("n").alias("n"))
    known = each.groupBy(*pair, "entity").agg(F.sum("o").alias("o"), F.sum("n").alias("n"), F.sum(F.col("o") * F.col("n")).alias("s")).where("o > 0 and n > 0")
    agreeing = known.groupBy(*pair).agg(F.sum(F.greatest("o", "n")).alias("both"), F.sum("s").alias("same"))
    values = each.groupBy(*pair, "value").agg(F.max("o").alias("o"), F.max("n").alias("n"), F.max(F.col("o") * F.col("n")).alias("s"))
    common = values.groupBy(*pair).agg(F.sum("s").alias("distinct"), F.sum(F.col("o") * F.col("n")).alias("common"))
    return common.join(agreeing, pair, "left").na.fill(0, ["both", "same"])


def _changes(seen: DataFrame) -> DataFrame:
    versions = schemas(seen).groupBy("stream", "file_no").agg(F.collect_list(F.struct("path", "kinds")).alias("version"))
    order = Window.partitionBy("stream").orderBy("file_no")
    numbers = versions.select("stream", "file_no").withColumn("before", F.lag("file_no").over(order)).where("before is not null")
    then = versions.select("stream", F.col("file_no").alias("before"), F.col("version").alias("earlier"))
    both = durable(numbers.join(versions, ["stream", "file_no"]).join(then, ["stream", "before"]).select("stream", "file_no", "before", "earlier", "version"))

    def shaped(version: list[dict]) -> dict[str, str]:
        return {v["path"]: _settled(v["kinds"]) for v in version if v["path"]}

    def paired(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(s, n, k, *p) for s, n, k, a, b in frame.itertuples(index=False) for p in candidates(shaped(a), shaped(b))]
            yield pd.DataFrame(rows, columns=["stream", "file_no", "before", "a", "b"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for s, n, a, b, shared in frame.itertuples(index=False):
                known = {(x["a"], x["b"]): (x["both"], x["same"], x["distinct"], x["common"]) for x in shared} if shared is not None else {}
                rows += [(s, n, *c) for c in steps(shaped(a), shaped(b), known)]
            yield pd.DataFrame(rows, columns=["stream", "file_no", "change", "old_path", "new_path"])

    pairs = durable(both.mapInPandas(paired, "stream string, file_no bigint, before bigint, a string, b string"))
    shared = _shared_values(seen, pairs).groupBy("stream", "file_no").agg(F.collect_list(F.struct("a", "b", "both", "same", "distinct", "common")).alias("shared"))
    told = both.join(shared, ["stream", "file_no"], "left").select("stream", "file_no", "earlier", "version", "shared")
    return told.mapInPandas(run, "stream string, file_no bigint, change string, old_path string, new_path string")


# --- migration -------------------------------------------------------------------------


def chained(versions: list[tuple[int, dict[str, list[str]]]], changes: dict[int, list[tuple[str, str, str]]]) -> tuple[dict[int, dict[str, str]], dict[str, list[str]]]:
    """The composed rules of a stream: per file the lasting name of each path whose own name differs, and the newest kinds by lasting name.

    A field lasts under the name with which it first came, so that streams that start
    from one layout meet again however each renames it. A field that comes back is the
    same field; one that takes a name given up by a renamed field gets a number.
    """
    names: dict[str, str] = {}  # path in the current layout: lasting name
    taken: set[str] = set()
    rules: dict[int, dict[str, str]] = {}
    newest: dict[str, list[str]] = {}

    def lasting(path: str) -> str:
        if path.endswith("[]"):
            return lasting(path[:-2]) + "[]"
        if path not in names:
            own = f"{lasting(_parent(path))}.{path[path.rfind('.') + 1 :]}" if "." in path else path
            name, n = own, 1
            while name.lower() in taken:
                n += 1
                name = f"{own}_{n}"
            names[path] = name
            taken.add(name.lower())
        return names[path]

    for file_no, version in sorted(versions, key=lambda v: v[0]):
        renamed = {a: b for c, a, b in changes.get(file_no, ()) if c == "renamed"}
        moved = {}
        for a, b in renamed.items():
            for path in [x for x in names if x == a or x.startswith((a + ".", a + "["))]:
                moved[b + path[len(a) :]] = names.pop(path)
        names.update(moved)
        rules[file_no] = {}
        for path in sorted(version):
            name = lasting(path)
            newest[name] = version[path]
            if not path.endswith("[]") and "." in path and name != f"{lasting(_parent(path))}.{path[path.rfind('.') + 1 :]}":
                rules[file_no][path] = name
    return rules, newest


def common_kind(kinds: set[str]) -> str:
    """The type that holds values of all ``kinds``."""
    if len(kinds) == 1:
        return next(iter(kinds))
    if kinds == {"integer", "decimal"}:
        return "decimal"
    return "array" if "array" in kinds and "object" not in kinds else "string"


def table_type(kinds: dict[str, tuple[str, str]], path: str) -> str:
    """The SQL type of the table's field at ``path`` (lower case); ``kinds``: its name and kind."""
    kind = kinds[path][1] if path in kinds else "string"
    if kind == "array":
        return f"array<{table_type(kinds, path + '[]')}>"
    if kind == "object":
        below = [(name, p) for p, (name, _) in sorted(kinds.items()) if not p.endswith("[]") and _parent(p) == path]
        tick = lambda name: "`" + name[name.rfind(".") + 1 :].replace("`", "``") + "`"
        return f"struct<{', '.join(f'{tick(n)}: {table_type(kinds, p)}' for n, p in below)}>" if below else "string"
    return SQL_TYPE[kind]


def cast(v: object, kind: str) -> object:
    """A value that is no container of this kind as ``kind``; None if that would lose it."""
    text = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if kind == "string":
        return text
    if isinstance(v, list):
        return cast(v[0], kind) if len(v) == 1 and v[0] is not None else None
    if isinstance(v, dict):
        return cast(next(iter(v.values())), kind) if len(v) == 1 and None not in v.values() else None
    text = text.strip()
    if kind == "boolean":
        return {"true": True, "false": False, "yes": True, "no": False, "1": True, "0": False}.get(text.lower())
    text = {"true": "1", "false": "0"}.get(text.lower(), text)
    if not re.fullmatch(r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d{1,3})?", text):
        return None
    if kind == "decimal":
        return float(text) if abs(float(text)) < float("inf") else None
    n = int(text) if re.fullmatch(r"[-+]?\d+", text) else int(float(text)) if abs(float(text)) < 2**53 and float(text).is_integer() else None
    return n if n is not None and -(2**63) <= n < 2**63 else None


def moved(v: object, path: str, name: str, rules: dict[str, str], kinds: dict[str, tuple[str, str]], unfit: dict[str, str]) -> object:
    """A record's value at ``path`` under the table's names and types; ``unfit`` takes what has no place there."""
    if v is None:
        return None
    low = name.lower()
    kind = kinds[low][1] if low in kinds else "string"
    if kind == "object" and table_type(kinds, low) == "string":
        kind = "string"
    if kind == "array":
        return [moved(x, path + "[]", name + "[]", rules, kinds, unfit) for x in (v if isinstance(v, list) else [v])]
    if kind == "object" and isinstance(v, list) and len(v) == 1 and isinstance(v[0], dict):
        v, path = v[0], path + "[]"
    if kind == "object" and isinstance(v, dict):
        out: dict[str, object] = {}
        for k, x in v.items():
            if x is None:
                continue
            to = rules.get(f"{path}.{k}", f"{name}.{k}")
            shown = kinds[to.lower()][0] if to.lower() in kinds else to
            key = shown[shown.rfind(".") + 1 :]
            if key in out:
                unfit[f"{path}.{k}"] = json.dumps(x, ensure_ascii=False)
            else:
                out[key] = moved(x, f"{path}.{k}", to, rules, kinds, unfit)
        return out
    if kind == "object":
        # a value that became an object of one field is that field
        below = [(p, n) for p, (n, _) in kinds.items() if not p.endswith("[]") and _parent(p) == low]
        if len(below) == 1 and not isinstance(v, list):
            return {below[0][1][below[0][1].rfind(".") + 1 :]: moved(v, path, below[0][0], rules, kinds, unfit)}
        out = None
    else:
        out = cast(v, kind)
    if out is None:
        unfit[path] = json.dumps(v, ensure_ascii=False)
    return out


def _composed(seen: DataFrame) -> DataFrame:
    """Per stream its files' rules and the newest kinds of its fields."""
    versions = schemas(seen).groupBy("stream").agg(F.collect_list(F.struct("file_no", "path", "kinds")).alias("paths"))
    changes = _changes(seen).groupBy("stream").agg(F.collect_list(F.struct("file_no", "change", "old_path", "new_path")).alias("changes"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for stream, paths, steps_ in frame.itertuples(index=False):
                files: dict[int, dict[str, list[str]]] = {}
                for r in paths:
                    at = files.setdefault(r["file_no"], {})
                    if r["path"]:
                        at[r["path"]] = list(r["kinds"])
                by_file: dict[int, list[tuple[str, str, str]]] = {}
                for r in steps_ if steps_ is not None else ():
                    by_file.setdefault(r["file_no"], []).append((r["change"], r["old_path"], r["new_path"]))
                rules, newest = chained(list(files.items()), by_file)
                rows.append((stream, [{"file_no": n, "rules": json.dumps(x)} for n, x in rules.items()], [{"path": p, "kinds": k} for p, k in newest.items()]))
            yield pd.DataFrame(rows, columns=["stream", "files", "newest"])

    return versions.join(changes, "stream", "left").mapInPandas(run, "stream string, files array<struct<file_no:bigint,rules:string>>, newest array<struct<path:string,kinds:array<string>>>")


def migrated(exports: DataFrame, doc_type: str, root: str) -> DataFrame:
    """``record_id, stream, file_no``, the fields below ``root`` in one layout, ``other`` and ``unfit``: one row per record of a document type.

    Fields have their lasting names (see ``chained``) and the newest type, or the common
    one where streams end with different types; a field that a record lacks is null.
    ``other`` is the JSON of the record outside ``root`` (a payload that is no JSON
    object as it is), ``unfit`` holds the JSON of values that the type can't take, by
    their path. Of repeated records (same stream, file and payload) the smallest
    record_id stays; a null stream or file_no belongs to no file and has no row.
    """
    records = exports.where((F.col("doc_type") == doc_type) & F.col("stream").isNotNull() & F.col("file_no").isNotNull())
    composed = durable(_composed(durable(observed(records, [root]))))
    seen = composed.select(F.explode("newest").alias("f")).select("f.path", F.explode("f.kinds").alias("kind"))
    # one row per field of the document type
    fields = seen.groupBy(F.lower("path").alias("low")).agg(F.min("path").alias("path"), F.collect_set("kind").alias("kinds")).collect()
    kinds = {r["low"]: (r["path"], common_kind(set(r["kinds"]))) for r in fields}
    layout = table_type(kinds, root.lower())
    files = composed.select("stream", F.explode("files").alias("f")).select("stream", "f.file_no", "f.rules")
    once = records.groupBy("stream", F.col("file_no").cast("bigint").alias("file_no"), "payload").agg(F.min(F.col("record_id").cast("bigint")).alias("record_id"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, stream, no, payload, rules in frame.itertuples(index=False):
                try:
                    doc = json.loads(payload)
                except (TypeError, ValueError, RecursionError):
                    doc = None
                if not isinstance(doc, dict):
                    rows.append((i, stream, no, None, payload, {}))
                    continue
                unfit: dict[str, str] = {}
                body = moved(doc.pop(root, None), root, root, json.loads(rules) if rules else {}, kinds, unfit)
                if body is not None and not isinstance(body, str):
                    body = json.dumps(body, ensure_ascii=False)
                rows.append((i, stream, no, body, json.dumps(doc, ensure_ascii=False), unfit))
            yield pd.DataFrame(rows, columns=["record_id", "stream", "file_no", "body", "other", "unfit"])

    body: Column = F.col("body") if layout in SQL_TYPE.values() else F.from_json("body", layout)
    rows = once.join(files, ["stream", "file_no"], "left").select("record_id", "stream", "file_no", "payload", "rules")
    return rows.mapInPandas(run, "record_id bigint, stream string, file_no bigint, body string, other string, unfit map<string,string>").select("record_id", "stream", "file_no", body.alias(root), "other", "unfit")
