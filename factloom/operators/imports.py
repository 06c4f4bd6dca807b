"""Resolution of import records to files and declarations, as joins on paths and names.

Paths are relative to the project, with ``/``. An importer's edges start at the file. Where a name may come from several places the
places are candidates with a position, and the first that exists wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions that a module may be written with, in the order in which they are tried.
EXTENSIONS = (".js", ".jsx", ".ts", ".tsx")
_KEY = ["importer", "pos"]
_EDGE = ["from", "pos", "to", "source", "imported", "local", "kind", "target_file", "confidence", "reason"]


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def joined_path(base: Column, relative: Column) -> Column:
    """``relative`` seen from the folder ``base``, without ``.`` and ``..``; null if it leaves the project."""
    parts = F.filter(F.split(F.concat_ws("/", base, relative), "/"), lambda x: (x != "") & (x != "."))
    up = lambda out: F.when(F.size(out) > 0, F.slice(out, F.lit(1), F.size(out) - 1))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when(x == "..", up(out)).otherwise(F.concat(out, F.array(x))))
    return F.array_join(walked, "/")


def module_candidates(path: Column) -> Column:
    """A path as written, with each extension in place of its own, then the index files under it."""
    stem = F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")
    tried = [path, *[F.concat(stem, F.lit(e)) for e in EXTENSIONS], *[F.concat(path, F.lit(f"/index{e}")) for e in EXTENSIONS]]
    return F.array_distinct(F.array(*tried))


def _first_file(tried: DataFrame, files: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys and ``name``: the first of the candidates (array ``tried``) that is a file."""
    each = tried.select(*keys, F.posexplode("tried").alias("_at", "path")).where("path is not null")
    return each.join(files.select("path"), "path").groupBy(*keys).agg(F.min_by("path", "_at").alias(name))


def resolve_modules(records: DataFrame, files: DataFrame) -> DataFrame:
    """``records`` with ``target``: the file that a relative source names, else null."""
    path = joined_path(folder(F.col("importer")), F.col("source"))
    wanted = records.where(F.col("source").startswith(".")).select(*_KEY, module_candidates(path).alias("tried"))
    return records.join(_first_file(wanted, files, _KEY, "target"), _KEY, "left")


def _sole_names(declarations: DataFrame) -> DataFrame:
    """file, name, identity of names that just one declaration of the file has."""
    return declarations.groupBy("file", "name").agg(F.count("*").alias("_n"), F.min("identity").alias("identity")).where("_n = 1").drop("_n")


def exported(declarations: DataFrame, defaults: DataFrame) -> DataFrame:
    """file, name, identity of what a file can be asked for: sole names, ``default``, and identities that begin with the name."""
    named = _sole_names(declarations)
    marked = declarations.join(defaults.select("file", "name").distinct(), ["file", "name"])
    default = marked.groupBy("file").agg(F.count("*").alias("_n"), F.min("identity").alias("identity")).where("_n = 1").select("file", F.lit("default").alias("name"), "identity")
    bare = declarations.select("file", "identity", F.split(F.substring_index("identity", "::", -1), ":")[0].alias("name"))
    fallback = _sole_names(bare).join(named.select("file", "name"), ["file", "name"], "left_anti")
    return named.where("name <> 'default'").unionByName(fallback.where("name <> 'default'")).unionByName(default)


def resolve_scripts(records: DataFrame, files: DataFrame, declarations: DataFrame) -> DataFrame:
    """Edges of JavaScript and TypeScript records; a name that the module only passes on is followed one module further."""
    found = resolve_modules(records.where("what in ('import', 'reexport')"), files.select("path"))
    wanted = found.where("what = 'import'")
    names = exported(declarations, records.where("what = 'default'").select(F.col("importer").alias("file"), F.col("local").alias("name")))
    parsed = files.select(F.col("path").alias("target"), F.col("failed").alias("unparsed"))
    direct = names.select(F.col("file").alias("target"), F.col("name").alias("imported"), F.col("identity").alias("direct"))
    passed = found.where("what = 'reexport' and target is not null").select(F.col("importer").alias("barrel"), "pos", F.col("local").alias("asked"), F.col("target").alias("beyond"), F.col("imported").alias("its_name"))
    passed = passed.join(names.select(F.col("file").alias("beyond"), F.col("name").alias("its_name"), F.col("identity").alias("further")), ["beyond", "its_name"])
    passed = passed.groupBy(F.col("barrel").alias("target"), F.col("asked").alias("imported")).agg(F.min_by(F.struct("beyond", "further"), "pos").alias("hop"))
    out = wanted.join(parsed, "target", "left").join(direct, ["target", "imported"], "left").join(passed, ["target", "imported"], "left")
    whole = F.col("imported") == "*"
    missing, broken = F.col("target").isNull(), F.col("unparsed")
    hopped = F.col("direct").isNull() & F.col("hop").isNotNull()
    reason = (
        F.when(missing & ~F.col("source").startswith("."), "external-or-non-relative").when(missing, "module-not-found")
        .when(whole & (F.col("kind") == "namespace"), "namespace-module-resolved").when(whole, "commonjs-module-resolved")
        .when(broken, "target-parse-failed").when(F.coalesce("direct", "hop.further").isNull(), "target-declaration-not-found").otherwise("relative-module-resolved")
    )
    sure = ~reason.isin("external-or-non-relative", "module-not-found", "target-parse-failed", "target-declaration-not-found")
    to = F.when(sure, F.when(whole, F.col("target")).otherwise(F.coalesce("direct", "hop.further")))
    kind = F.when(missing | ~sure, "import").when(whole, F.col("kind")).when(hopped, "reexport").otherwise("import")
    file = F.when(~missing & (sure | broken), F.when(hopped & ~whole, F.col("hop.beyond")).otherwise(F.col("target")))
    return out.select(F.col("importer").alias("from"), "pos", to.alias("to"), "source", "imported", "local", kind.alias("kind"), file.alias("target_file"), F.when(sure, "certain").otherwise("unresolved").alias("confidence"), reason.alias("reason"))


def python_module(base: Column, dots: Column, module: Column) -> tuple[Column, Column]:
    """The path without ending that a dotted module means for a file in the folder ``base`` (one dot: that folder), and that folder.

    Both are null where the dots lead out of the project.
    """
    parts = F.filter(F.split(base, "/"), lambda x: x != "")
    inside = F.when(dots == 0, F.array().cast("array<string>")).when(dots - 1 <= F.size(parts), F.slice(parts, F.lit(1), F.size(parts) - dots + 1))
    steps = F.when(module.isNull(), F.array().cast("array<string>")).otherwise(F.split(module, r"\."))
    return F.array_join(F.concat(inside, steps), "/"), F.array_join(inside, "/")


def _python_file(records: DataFrame, files: DataFrame, base: Column, dots: Column, module: Column, keys: list[str], name: str) -> DataFrame:
    stem, _ = python_module(base, dots, module)
    tried = F.array(F.when(stem != "", F.concat(stem, F.lit(".py"))), F.when(stem != "", F.concat(stem, F.lit("/__init__.py"))).otherwise(F.when(stem == "", F.lit("__init__.py"))))
    return _first_file(records.select(*keys, tried.alias("tried")), files, keys, name)


def resolve_python(records: DataFrame, files: DataFrame, declarations: DataFrame) -> DataFrame:
    """Edges of Python records: module before package, dots up the folders, names of the module or passed on by its package once."""
    records = records.where("what = 'import'")
    base, dots, module = folder(F.col("importer")), F.col("dots"), F.col("source")
    top = _sole_names(declarations.where(~F.contains("name", F.lit("."))))
    bare = (dots > 0) & module.isNull()
    found = _python_file(records.where(~bare), files, base, dots, module, _KEY, "target")
    below = _python_file(records.where(bare), files, base, dots, F.col("imported"), _KEY, "submodule")
    _, here = python_module(base, dots, F.lit(None).cast("string"))
    init = F.when(bare, F.when(here == "", F.lit("__init__.py")).otherwise(F.concat(here, F.lit("/__init__.py"))))
    out = records.join(found, _KEY, "left").join(below, _KEY, "left").withColumn("init", init)
    out = out.join(files.select(F.col("path").alias("target"), F.col("failed").alias("unparsed")), "target", "left")
    out = out.join(top.select(F.col("file").alias("target"), F.col("name").alias("imported"), F.col("identity").alias("direct")), ["target", "imported"], "left")
    out = out.join(top.select(F.col("file").alias("init"), F.col("name").alias("imported"), F.col("identity").alias("in_init")), ["init", "imported"], "left")
    # One hop: what a package's own file imports under the asked name, seen from the package's folder.
    packages = records.where(F.col("importer").rlike(r"(^|/)__init__\.py$")).withColumn("hop_dots", F.greatest("dots", F.lit(1)))
    hops = packages.join(_python_file(packages, files, base, F.col("hop_dots"), module, _KEY, "beyond"), _KEY)
    hops = hops.select(F.col("importer").alias("target"), "pos", F.col("local").alias("asked"), "beyond", F.coalesce("imported", "local").alias("its_name"))
    hops = hops.join(top.select(F.col("file").alias("beyond"), F.col("name").alias("its_name"), F.col("identity").alias("further")), ["beyond", "its_name"])
    hops = hops.groupBy("target", F.col("asked").alias("imported")).agg(F.min_by(F.struct("beyond", "further"), "pos").alias("hop"))
    tops = files.where(F.col("path").rlike(r"^[^/]+(\.py|/__init__\.py)$")).select(F.regexp_replace("path", r"(\.py|/__init__\.py)$", "").alias("first")).distinct()
    out = out.join(hops, ["target", "imported"], "left").withColumn("first", F.split("source", r"\.")[0]).join(tops.withColumn("ours", F.lit(True)), "first", "left")
    whole, missing = F.col("imported").isNull() | (F.col("imported") == "*"), F.col("target").isNull()
    reason = (
        F.when(bare & F.col("submodule").isNotNull(), "relative-submodule-resolved").when(bare & F.col("in_init").isNotNull(), "package-init-name-found")
        .when(bare | missing & (dots > 0), "relative-import-path-not-found").when(missing & F.col("ours"), "partial-path-matches-project-package").when(missing, "external-or-stdlib")
        .when(whole, "module-resolved").when(F.col("unparsed"), "target-parse-failed").when(F.col("direct").isNotNull(), "declaration-found")
        .when(F.col("hop").isNotNull(), "init-reexport-one-hop").otherwise("module-resolved-name-not-found")
    )
    file = (
        F.when(reason == "relative-submodule-resolved", F.col("submodule")).when(reason == "package-init-name-found", F.col("init"))
        .when(reason == "init-reexport-one-hop", F.col("hop.beyond")).otherwise(F.col("target"))
    )
    to = (
        F.when(reason == "package-init-name-found", F.col("in_init")).when(reason == "declaration-found", F.col("direct")).when(reason == "init-reexport-one-hop", F.col("hop.further"))
        .when(reason != "target-parse-failed", file)
    )
    sure = F.when(reason == "partial-path-matches-project-package", "inferred").when(to.isNull(), "unresolved").otherwise("certain")
    kind = F.when(reason == "init-reexport-one-hop", "reexport").when((reason == "module-resolved") & (F.col("imported") == "*"), "wildcard").otherwise("import")
    return out.select(F.col("importer").alias("from"), "pos", to.alias("to"), "source", "imported", "local", kind.alias("kind"), file.alias("target_file"), sure.alias("confidence"), reason.alias("reason"))


def resolve_imports(records: DataFrame, files: DataFrame, declarations: DataFrame) -> DataFrame:
    """from, pos, to, source, imported, local, kind, target_file, confidence, reason of every import of a project.

    ``records`` are those of ``extract_imports``, ``files`` have path and failed, ``declarations`` identity, file and name.
    Files that cannot be parsed import and pass on nothing.
    """
    python = F.col("importer").rlike(r"(?i)\.py$")
    sound = records.where("not failed").join(files.where("failed").select(F.col("path").alias("importer")), "importer", "left_anti")
    return resolve_scripts(sound.where(~python), files, declarations).select(_EDGE).unionByName(resolve_python(sound.where(python), files, declarations).select(_EDGE))
