"""Dependency graph: building, name resolution, call resolution and impact."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import hot_join


def reliable(df: DataFrame) -> DataFrame:
    """Cut an iterative plan's lineage in the folder that ``spark.checkpoint.dir`` names.

    Only a local session may leave it unset; on a cluster a temporary folder would be one machine's.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return df.checkpoint()


def normalise_edges(edges: DataFrame) -> DataFrame:
    """Edges with a source, kind and confidence defaulted, one per (from, to, kind, confidence) keeping the first's reason."""
    blank = lambda c, d: F.when(F.coalesce(F.col(c), F.lit("")) == "", d).otherwise(F.col(c))
    rows = edges.where("from is not null and from <> ''").withColumns({"kind": blank("kind", "unknown"), "confidence": blank("confidence", "unresolved")})
    return rows.groupBy("from", "to", "kind", "confidence").agg(F.min_by("reason", "seq").alias("reason"))


def caller_index(calls: DataFrame) -> DataFrame:
    """callee, caller: inverted call lists as distinct rows, so that no callee's callers have to fit in one task."""
    return calls.select(F.explode("calls").alias("callee"), "caller").distinct()


def callers_of(index: DataFrame, asked: list[str]) -> DataFrame:
    """callee, callers: the sorted callers of a few names; only their rows are gathered."""
    return index.where(F.col("callee").isin(*asked)).groupBy("callee").agg(F.array_sort(F.collect_set("caller")).alias("callers"))


def file_index(declarations: DataFrame) -> DataFrame:
    """file, identity: the declarations of each file as distinct rows."""
    return declarations.select("file", "identity").distinct()


def resolve_names(calls: DataFrame, declarations: DataFrame) -> DataFrame:
    """caller, to, confidence: a name with one identity is certain, with several ambiguous, otherwise unresolved (and kept)."""
    names = declarations.groupBy(F.col("name").alias("callee")).agg(F.count_distinct("identity").alias("n"), F.min("identity").alias("identity"))
    out = hot_join(calls, names, "callee", "left")
    to = F.when(F.col("n") == 1, F.col("identity")).otherwise(F.col("callee"))
    sure = F.when(F.col("n") == 1, "certain").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return out.select("caller", to.alias("to"), sure.alias("confidence"))


def resolve_paths(wanted: DataFrame, files: DataFrame, suffixes: list[str]) -> DataFrame:
    """importer, source, target: the first existing candidate of a path with each suffix in order."""
    tried = wanted.select("importer", "source", F.posexplode(F.array(*[F.concat("source", F.lit(s)) for s in suffixes])).alias("pos", "path"))
    found = tried.join(files.select("path"), "path").groupBy("importer", "source").agg(F.min_by("path", "pos").alias("target"))
    return wanted.select("importer", "source").distinct().join(found, ["importer", "source"], "left")


def call_targets(call: Column) -> Column:
    """Candidates of a call as it is written: without subscripts the whole, its last two parts, its last part.

    Blanks around parts and parts without text do not count; a call of one part has only that.
    """
    whole = F.regexp_replace(F.regexp_replace(call, r"(?U)^\s+|\s+$", ""), r"\[[^\]]*\]", "")
    trimmed = F.transform(F.split(whole, r"\."), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    parts = F.filter(trimmed, lambda x: x != "")
    last, second = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    several = F.array_distinct(F.array(whole, F.concat_ws(".", second, last), last))
    return F.when(F.size(parts) > 1, several).otherwise(parts)


def resolve_calls(declarations: DataFrame) -> DataFrame:
    """from, to: the first candidate with any match decides; one match is an edge, of several the only one in the caller's file.

    ``declarations`` has identity, file, name (dotted), calls and, if it likes, callbacks: names that are handed over to be called.
    Self edges go.
    """
    if "callbacks" in declarations.columns:
        named = lambda c: F.coalesce(c, F.array().cast("array<string>"))
        declarations = declarations.withColumn("calls", F.concat(named("calls"), named("callbacks")))
    bare = F.element_at(F.split("name", r"\."), -1)
    index = declarations.select("identity", "file", F.explode(F.array_distinct(F.array("name", bare))).alias("target"))
    calls = declarations.select(F.col("identity").alias("from"), F.col("file").alias("here"), F.explode(F.array_distinct("calls")).alias("call"))
    # What a call means follows from its text and its file, so each is resolved once, however many declarations have it.
    asked = calls.select("here", "call").distinct()
    tried = asked.select("here", "call", F.posexplode(call_targets(F.col("call"))).alias("pos", "target"))
    # Counts by target and by target and file replace the list of matches, so a common name is never multiplied out.
    totals = index.groupBy("target").agg(F.count_distinct("identity").alias("n"), F.min("identity").alias("only"))
    local = index.groupBy("target", F.col("file").alias("here")).agg(F.count_distinct("identity").alias("n_here"), F.min("identity").alias("only_here"))
    hits = hot_join(tried, totals, "target").join(local, ["target", "here"], "left")
    first = hits.groupBy("here", "call").agg(F.min_by(F.struct("n", "only", "n_here", "only_here"), "pos").alias("m"))
    to = F.when(F.col("m.n") == 1, F.col("m.only")).when(F.col("m.n_here") == 1, F.col("m.only_here"))
    asking = F.struct("here", "call").alias("asking")
    meant = first.select(asking, to.alias("to")).where("to is not null")
    return hot_join(calls.select("from", asking), meant, "asking").where("to <> from").select("from", "to").distinct()


def join_dependencies(imports: DataFrame, calls: DataFrame) -> DataFrame:
    """from, to, kind, confidence, reason, seq: import edges (by pos) and caller edges (caller, to, confidence) as one, none dropped."""
    called = calls.select(F.col("caller").alias("from"), "to", F.lit("call").alias("kind"), "confidence", F.lit(None).cast("string").alias("reason"), F.lit(0).alias("seq"))
    return imports.select("from", "to", "kind", "confidence", "reason", F.col("pos").alias("seq")).unionByName(called)


def build_graph(declarations: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, name, file; the first by seq of an id) and distinct edges (of equal ones the first's reason stays).

    ``declarations`` has identity, kind, name, file and seq; edges have to have a source, and a target that is not empty.
    """
    named = declarations.where("identity is not null and identity <> ''").groupBy(F.col("identity").alias("id"))
    nodes = named.agg(F.min_by(F.struct(F.coalesce("kind", F.lit("unknown")).alias("kind"), "name", "file"), "seq").alias("d")).select("id", "d.*")
    return nodes, normalise_edges(edges.where("to is null or to <> ''"))


def impact_graph(imports: DataFrame, current: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of a project: its imports and calls, where calls of declarations that are gone lead to their old identities.

    Declarations have identity, name, kind, file, seq, and the current ones calls; of one in both the current one counts.
    """
    calls = caller_index(current.select(F.col("identity").alias("caller"), "calls"))
    edges = join_dependencies(imports, resolve_names(calls, current))
    gone = baseline.join(current.select("identity"), "identity", "left_anti")
    bare = F.split(F.split(F.split("identity", "::")[1], "#")[0], ":")[0]
    edges = reanchor_deleted(edges, gone.select("identity", bare.alias("name"), "seq"))
    columns = ["identity", "name", "kind", "file", "seq"]
    every = current.select(columns).unionByName(gone.select(columns))
    return build_graph(every, edges)


#: Edges that a depth-first walk may gather; more are an error.
WALKED = 1_000_000
# Kinds that are cut off an identity when its callers are looked up.
_LOOKED_UP = "function|method|class|variable|interface|type|enum|property"


def find_callers(index: DataFrame, callee: str, max_depth: int = 1) -> DataFrame:
    """place, identity, depth, confidence of a callee's callers, and theirs, in the order of a depth-first walk.

    ``index`` has callee (a name), caller, confidence. A caller counts once, at the depth where the walk met it first, which
    need not be its least. The walk depends on its own order, so the calls within ``max_depth`` levels are gathered; more
    than WALKED of them are an error.
    """
    spark = index.sparkSession
    name = F.regexp_replace(F.substring_index("caller", "::", -1), rf":(?:{_LOOKED_UP})(?:#\d+)?$", "")
    back = reliable(index.select(F.col("callee").alias("name"), "caller", "confidence", name.alias("next")))
    seen = front = spark.createDataFrame([(callee,)], "name string")
    near = None
    for _ in range(max_depth if callee else 0):
        step = reliable(back.join(front, "name"))
        near = step if near is None else near.unionByName(step)
        front = reliable(step.select(F.col("next").alias("name")).distinct().join(seen, "name", "left_anti"))
        seen = seen.unionByName(front)
    schema = "place int, identity string, depth int, confidence string"
    if near is None:
        return spark.createDataFrame([], schema)
    near = reliable(near.distinct())
    if near.count() > WALKED:
        raise ValueError(f"more than {WALKED} calls lead to {callee} within {max_depth} levels; use impact_levels")
    calls: dict[str, list[tuple[str, str, str]]] = {}
    for row in near.orderBy("name", "caller").collect():  # WALKED at most
        calls.setdefault(row["name"], []).append((row["caller"], row["confidence"], row["next"]))
    met: dict[str, tuple[int, str]] = {}
    stack = [(1, iter(calls.get(callee, ())))]
    while stack:
        depth, left = stack[-1]
        found = next(left, None)
        if found is None:
            stack.pop()
        elif found[0] not in met:
            met[found[0]] = (depth, found[1])
            if depth < max_depth:
                stack.append((depth + 1, iter(calls.get(found[2], ()))))
    return spark.createDataFrame([(i, c, d, sure) for i, (c, (d, sure)) in enumerate(met.items())], schema)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, callers, callees: distinct in and out degrees, zero included."""
    ins = edges.groupBy(F.col("to").alias("id")).agg(F.count_distinct("from").alias("callers"))
    outs = edges.groupBy(F.col("from").alias("id")).agg(F.count_distinct("to").alias("callees"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.select("id").join(ins, "id", "left").join(outs, "id", "left").select("id", zero("callers"), zero("callees"))


def reanchor_deleted(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges to the bare name of a deleted declaration lead to its old identity again (the first by seq)."""
    names = deleted.groupBy(F.col("name").alias("to")).agg(F.min_by("identity", "seq").alias("old"))
    return hot_join(edges, names, "to", "left").withColumn("to", F.coalesce("old", "to")).drop("old")


def impact_levels(edges: DataFrame, target: str, max_depth: int = 3) -> DataFrame:
    """id, depth of everything that reaches ``target`` within ``max_depth`` edges, at its least depth; the target is left out.

    The edges are computed once; each level joins them with its front, and only what that finds is made distinct.
    """
    spark = edges.sparkSession
    back = reliable(edges.where("to is not null").select(F.col("to").alias("id"), F.col("from").alias("next")))
    seen = front = spark.createDataFrame([(target, 0)], "id string, depth int")
    for depth in range(1, max_depth + 1):
        front = reliable(back.join(front, "id").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def impact_capped(edges: DataFrame, target: str, max_depth: int = 3, max_results: int = 25) -> DataFrame:
    """id, depth, kind, confidence, truncated of one target: ``impact.impact_of_all`` of just that."""
    from .impact import impact_of_all

    found = impact_of_all(edges, edges.sparkSession.createDataFrame([(target,)], "target string"), max_depth, max_results)
    return found.select("id", "depth", "kind", "confidence", "truncated")


def propose_role(nodes: DataFrame, plumbing: list[str]) -> DataFrame:
    """id, role by name words, degrees and facts: vocabulary, machinery, tool or behaviour."""
    role = (
        F.when(F.col("kind") == "data", "vocabulary")
        .when(F.arrays_overlap("words", F.array(*map(F.lit, plumbing))) & (F.col("callers") == 0), "machinery")
        .when((F.col("callers") >= 2) & (F.col("callees") == 0) & (F.col("throws") == 0) & (F.col("awaits") == 0) & (F.col("params") <= 2), "tool")
        .otherwise("behaviour")
    )
    return nodes.select("id", role.alias("role"))


def sibling_families(declarations: DataFrame) -> DataFrame:
    """identity, pattern, size: names of one file, kind and parameter count that differ in one word; the largest bucket wins.

    Among equal sizes the bucket whose first member comes first wins, then the leftmost position.
    """
    words = F.col("words")
    pattern = F.transform(words, lambda w, i: F.concat_ws(" ", F.transform(words, lambda x, j: F.when(i == j, "*").otherwise(x))))
    rows = declarations.select("identity", "seq", "file", "kind", "params", F.posexplode(pattern).alias("pos", "pattern"))
    key = ["file", "kind", "params", "pos", "pattern"]
    sizes = rows.groupBy(*key).agg(F.count_distinct("identity").alias("size"), F.min("seq").alias("first")).where("size > 1")
    best = F.max_by(F.struct("pattern", "size"), F.struct("size", -F.col("first"), -F.col("pos"))).alias("b")
    return rows.join(sizes, key).groupBy("identity").agg(best).select("identity", "b.pattern", "b.size")


def prune_to_ancestors(tree: DataFrame, keep: Column, id_col: str = "id", parent: str = "parent") -> DataFrame:
    """Rows of a forest that match ``keep``, and all their ancestors; each round doubles the levels climbed."""
    up = tree.select(F.col(id_col).alias("id"), F.col(parent).alias("up")).where("id is not null and up is not null").distinct()
    kept = reliable(tree.where(keep).select(F.col(id_col).alias("id")).distinct())
    while True:
        found = reliable(up.join(kept, "id").select(F.col("up").alias("id")).distinct().join(kept, "id", "left_anti"))
        if found.isEmpty():
            break
        kept = reliable(kept.union(found))
        up = reliable(up.join(up.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")).distinct())
    return tree.join(kept.select(F.col("id").alias(id_col)), id_col, "left_semi")
