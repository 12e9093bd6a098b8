"""Import graph: resolution by ranked candidates, coupling and cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.session import durable

# Endings tried for a target, in order.
ENDINGS = ["", *".ts .tsx .js .jsx .mjs .py .rs .go .rb .cs .java .kt .swift .php .c .cc .cpp .h .hpp".split(), *(f"/index{e}" for e in ".ts .tsx .js .jsx .py .php .rb".split())]


def resolved_path(path: Column) -> Column:
    """A relative path without ``.`` and with ``..`` applied."""
    empty = F.array().cast("array<string>")
    parts = F.aggregate(F.split(path, "/"), empty, lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    return F.array_join(parts, "/")


def import_edges(targets: DataFrame, files: DataFrame) -> DataFrame:
    """``unit, src, dst`` of every resolved import, repeats kept.

    A target meets the files by an equi-join on the path without its ending; the lowest
    rank of base and ending wins. Bare dotted targets may also end a path; among several such
    files the first counts, and a PHP name may be its last part. Unresolved targets give no row.
    """
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    here = lambda x: F.when(folder == "", x).otherwise(F.concat(folder, F.lit("/"), x))
    t, slashed = F.col("target"), F.replace("target", F.lit("."), F.lit("/"))
    root = F.element_at(F.split("path", "/"), 1)
    aliased = F.concat(F.lit("src/"), F.substring(t, F.lit(3), F.length(t)))
    nothing = F.array().cast("array<string>")
    bases = (
        F.when(t.rlike(r"^\.\.?/"), F.array(here(t)))
        .when(t.startswith("@/"), F.array(aliased, F.concat(root, F.lit("/"), aliased)))
        .when(F.col("quoted") & ~F.col("may_be_local") & ~t.contains("/"), nothing)
        .when(F.col("quoted") | t.contains("/"), F.array(t, here(t)))
        .otherwise(F.array(here(t), t, slashed, here(slashed)))
    )
    # a target stands for its path with any of the endings; the files offer their paths without them
    tries = targets.select("unit", "path", "no", F.posexplode(F.transform(bases, resolved_path)).alias("base", "try"))
    ranks = F.create_map(*[x for k, e in enumerate(ENDINGS) for x in (F.lit(e), F.lit(k))])
    p = F.col("path")
    index, ext = F.regexp_extract(p, r"(/index\.[^./]*)$", 1), F.regexp_extract(p, r"(\.[^./]*)$", 1)
    offered = [F.struct(p.alias("try"), F.lit(0).alias("ending")), *(F.struct(F.when(e != "", F.left(p, F.length(p) - F.length(e))).alias("try"), F.try_element_at(ranks, e).alias("ending")) for e in (ext, index))]
    known = files.where("readable").select("unit", p.alias("dst"), F.inline(F.array(*offered))).where("try is not null and ending is not null")
    direct = tries.join(known, ["unit", "try"]).select("unit", "path", "no", (F.col("base") * len(ENDINGS) + F.col("ending")).alias("rank"), "dst")
    parts = F.split(F.regexp_replace("path", r"\.[^./]+$", ""), "/")
    endings_of = files.where("readable").select("unit", F.col("path").alias("dst"), "ordinal", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("try"))
    bare = targets.where(~F.col("quoted") & ~t.rlike(r"^(\.\.?/|@/)")).select("unit", "path", "no", F.when(t.contains("."), slashed).otherwise(t).alias("try"))
    by_end = bare.join(endings_of, ["unit", "try"]).select("unit", "path", "no", (F.lit(1_000_000) + F.col("ordinal")).alias("rank"), "dst")
    # a PHP name with a path may be told by its last part alone
    last = targets.where(~F.col("quoted") & t.contains("/") & F.endswith(F.col("path"), F.lit(".php"))).select("unit", "path", "no", F.element_at(F.split(t, "/"), -1).alias("try"))
    by_last = last.join(endings_of, ["unit", "try"]).where("dst like '%.php'").select("unit", "path", "no", (F.lit(2_000_000_000) + F.col("ordinal")).alias("rank"), "dst")
    best = direct.select("unit", "path", "no", F.col("rank").cast("bigint").alias("rank"), "dst").unionByName(by_end).unionByName(by_last)
    return best.groupBy("unit", "path", "no").agg(F.min_by("dst", "rank").alias("dst")).select("unit", F.col("path").alias("src"), "dst")


def coupling(edges: DataFrame, most: int = 15) -> DataFrame:
    """Files with more than ``most`` resolved imports."""
    return edges.groupBy("unit", F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("imports")).where(F.col("imports") > most)


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges between nodes that have both an incoming and an outgoing edge, down to a fixpoint."""
    n = edges.count()
    while n:
        outs, ins = edges.select("unit", F.col("src").alias("dst")), edges.select("unit", F.col("dst").alias("src"))
        edges = durable(edges.join(outs, ["unit", "dst"], "left_semi").join(ins, ["unit", "src"], "left_semi").select("unit", "src", "dst"))
        m = edges.count()
        if m == n:
            break
        n = m
    return edges, n


def components(edges: DataFrame) -> DataFrame:
    """``unit, path, component``: the strongly connected components of two nodes or more.

    Colours (largest node that reaches a node) part the graph; within a colour the nodes
    that reach its root make a component. Found components leave the graph, and trimming
    drops what can't be in one. A self edge makes no component.
    """
    spark = edges.sparkSession
    graph, left = _trimmed(durable(edges.where("src <> dst").select("unit", "src", "dst").distinct()))
    found = spark.createDataFrame([], "unit bigint, path string, component string")
    while left:
        colour = durable(graph.select("unit", F.col("src").alias("path")).distinct().withColumn("colour", F.col("path")))
        changed = 1
        while changed:
            sent = graph.join(colour.withColumnRenamed("path", "src"), ["unit", "src"]).groupBy("unit", F.col("dst").alias("path")).agg(F.max("colour").alias("sent"))
            after = durable(colour.join(sent, ["unit", "path"], "left").select("unit", "path", F.greatest("colour", F.coalesce("sent", "colour")).alias("colour"), (F.coalesce("sent", "colour") > F.col("colour")).alias("new")))
            changed = after.where("new").count()
            colour = after.drop("new")
        same = graph.join(colour.select("unit", F.col("path").alias("src"), F.col("colour").alias("a")), ["unit", "src"]).join(colour.select("unit", F.col("path").alias("dst"), F.col("colour").alias("b")), ["unit", "dst"]).where("a = b")
        same = durable(same.select("unit", "src", "dst", F.col("a").alias("colour")))
        reach = durable(colour.where("path = colour"))
        fresh = reach
        while True:
            fresh = same.join(fresh.select("unit", F.col("path").alias("dst"), "colour"), ["unit", "dst", "colour"]).select("unit", F.col("src").alias("path"), "colour").distinct().join(reach, ["unit", "path", "colour"], "left_anti")
            fresh = durable(fresh)
            if fresh.isEmpty():
                break
            reach = durable(reach.unionByName(fresh))
        found = durable(found.unionByName(reach.select("unit", "path", F.col("colour").alias("component"))))
        gone = reach.select("unit", "path")
        graph, left = _trimmed(durable(graph.join(gone.withColumnRenamed("path", "src"), ["unit", "src"], "left_anti").join(gone.withColumnRenamed("path", "dst"), ["unit", "dst"], "left_anti").select("unit", "src", "dst")))
    sizes = found.groupBy("unit", "component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return found.join(sizes, ["unit", "component"]).select("unit", "path", "component")


def component_count(edges: DataFrame, found: DataFrame) -> DataFrame:
    """``unit, cycles``: components of two nodes or more, and single nodes with an edge to themselves."""
    loops = edges.where("src = dst").select("unit", F.col("src").alias("path")).distinct().join(found.select("unit", "path"), ["unit", "path"], "left_anti")
    each = found.select("unit", "component").distinct().unionByName(loops.select("unit", F.col("path").alias("component")))
    return each.groupBy("unit").agg(F.count(F.lit(1)).alias("cycles"))


def adjacency(edges: DataFrame) -> DataFrame:
    """``unit, path, neighbours``: how many different nodes an edge of either direction leads to."""
    both = edges.select("unit", F.col("src").alias("path"), F.col("dst").alias("other")).union(edges.select("unit", "dst", "src"))
    return both.groupBy("unit", "path").agg(F.count_distinct("other").alias("neighbours"))


def degrees(edges: DataFrame) -> DataFrame:
    """``unit, path, out_degree, in_degree``."""
    ends = edges.select("unit", F.col("src").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select("unit", F.col("dst").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("unit", "path").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def module_edges(targets: DataFrame, files: DataFrame) -> DataFrame:
    """``unit, src, dst`` between modules by dotted names: an import that names a module, else the first module that it ends, never the importer itself."""
    dotted = lambda p: F.replace(F.regexp_replace(p, r"\.[^./]+$", ""), F.lit("/"), F.lit("."))
    parts = F.split(F.col("module"), r"\.")
    known = files.where("readable").select("unit", dotted(F.col("path")).alias("module"), "ordinal")
    named = known.select("unit", "module", "ordinal", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))).alias("name"))
    asked = targets.select("unit", dotted(F.col("path")).alias("src"), "no", F.regexp_replace("target", r"\.(py|ts|tsx|js|jsx|java|go|rs|cs|kt|php|rb|swift|scala|c|h)$", "").alias("name"))
    met = asked.join(named, ["unit", "name"]).withColumn("rank", F.when(F.col("name") == F.col("module"), -1).otherwise(F.col("ordinal")))
    best = met.groupBy("unit", "src", "no").agg(F.min_by("module", "rank").alias("dst"))
    return best.where("src <> dst").select("unit", "src", "dst").distinct()
