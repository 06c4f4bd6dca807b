"""Readers: source trees, snapshots, event logs and small JSON documents."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.events import with_rank
from ..operators.validation import plan_problems
from .store import EventLog, read_rows

# Directory names that are never scanned, source extensions, and the one that is left out.
SKIPPED = ("node_modules", ".git", "dist", "build", "coverage", ".next", "out", ".turbo", ".cache")
SOURCES = r"(?i)\.(?:js|ts|tsx|py)$"
TYPINGS = r"(?i)\.d\.ts$"

EVENT = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.StringType()),
        T.StructField("identity", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("delta", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("sessionId", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("commit", T.StringType()),
        T.StructField("_bad", T.StringType()),
    ]
)
FACTS = "throws int, throwTypes array<string>, returns int, returnsNullish int, calls array<string>, numbers array<double>, awaits int, catches int, emptyCatches int, params int"
SNAPSHOT = f"version int, declarations array<struct<identity:string,file:string,kind:string,properties:struct<{', '.join(x.replace(' ', ':', 1) for x in FACTS.split(', '))}>>>"
SNAPSHOT_LINE = f"identity string, file string, kind string, properties struct<{', '.join(x.replace(' ', ':', 1) for x in FACTS.split(', '))}>"
#: Version of the snapshot format.
VERSION = 2


def is_source(path):
    return path.rlike(SOURCES) & ~path.rlike(TYPINGS)


def should_ignore(path, is_file=None):
    """Whether a watched path is left out: under a skipped directory, a system file, or known to be a file that is no source."""
    plain = F.concat(F.lit("/"), F.translate(path, "\\", "/"))
    skipped = F.exists(F.array(*[F.lit(f"/{d}/") for d in SKIPPED]), lambda d: F.contains(plain, d))
    name = F.substring_index(plain, "/", -1)
    other = F.coalesce(is_file, F.lit(False)) & ~is_source(path) if is_file is not None else F.lit(False)
    known_folder = ~F.coalesce(is_file, F.lit(True)) if is_file is not None else F.lit(False)
    return skipped | ~known_folder & ((name == ".DS_Store") | other)


def git_boundaries(polls: DataFrame, key: str) -> DataFrame:
    """key, ts, kind, head, branch: commits and branch switches from polls of a repository's head and branch.

    A poll that shows another branch is a switch, whatever its head; one that shows another head a commit; a first poll nothing.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("ts")
    first = F.row_number().over(w) == 1
    kind = F.when(first, None).when(~F.lag("branch").over(w).eqNullSafe(F.col("branch")), "branch-switch").when(~F.lag("head").over(w).eqNullSafe(F.col("head")), "commit")
    return polls.select(key, "ts", kind.alias("kind"), "head", "branch").where("kind is not null")


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative, with /) and content of the source files under ``root``, in skipped directories nothing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://")
    path = F.substring(F.col("path"), F.instr(F.col("path"), f"{base}/") + len(base) + 1, F.length("path"))
    rows = files.select(path.alias("path"), F.col("content").cast("string").alias("content"))
    skipped = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED)))
    return rows.where(is_source(F.col("path")) & ~skipped)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """identity, file, kind, properties of a snapshot; another version is an error.

    A snapshot is one JSON document, or the lines that ``write_snapshot`` wrote, of which each has the version.
    """
    first = spark.read.text(path).where(F.trim("value") != "").select(F.try_parse_json("value").isNotNull()).first()
    lines = bool(first and first[0])
    whole = spark.read.text(path, wholetext=not lines).where(F.trim("value") != "")
    whole = whole.select(F.from_json("value", f"{SNAPSHOT}, {SNAPSHOT_LINE}").alias("s")).select("s.*")
    versions = [r[0] for r in whole.select("version").distinct().limit(3).collect()]
    if versions != [VERSION]:
        raise ValueError(f"snapshot version {versions}, expected {VERSION}")
    line = F.array(F.struct("identity", "file", "kind", "properties"))
    each = whole.select(F.explode(F.coalesce("declarations", F.when(F.col("identity").isNotNull(), line), F.slice(line, 1, 0))).alias("d"))
    return each.select("d.*")


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events of a log, and its malformed lines; blank lines count as neither.

    The lines of a ``store.EventLog`` carry their ``seq``. In plain JSON Lines it is the line's place in the log, unless the line
    has one: files by name, then the blocks of a file as they are read, then the lines of a block.
    """
    segments = EventLog.segments(spark, path)
    if segments is not None:
        lines = spark.read.text(segments).where(F.trim("value") != "")
        raw = lines.select(F.from_json("value", EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e")).select("e.*")
        return raw.where("_bad is null").drop("_bad"), raw.where("_bad is not null").select("_bad")
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    numbered = with_rank(lines, ["at"]).where(F.trim("value") != "")
    raw = numbered.select("rank", F.from_json("value", EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e")).select("rank", "e.*")
    good = raw.where("_bad is null").withColumn("seq", F.coalesce("seq", "rank")).drop("_bad", "rank")
    return good, raw.where("_bad is not null").select("_bad")


def read_lines(spark: SparkSession, path: str, schema: str | None = None, strict: bool = False) -> DataFrame | None:
    """Sessions or a history as ``write_sessions`` and ``write_evolution`` write them: a row a JSON line; nothing if there is no such path.

    Without a ``schema`` the lines tell it. Lines that are no JSON are left out, or an error if ``strict``.
    """
    try:
        lines = spark.read.text(path).where(F.trim("value") != "")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    if strict and not lines.where(F.try_parse_json("value").isNull()).isEmpty():
        raise ValueError(f"{path} has a line that is no JSON")
    if schema is None:
        return spark.read.option("mode", "DROPMALFORMED").json(path)
    return lines.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("r")).select("r.*")


def read_sessions(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The sessions that ``write_sessions`` wrote."""
    return read_lines(spark, path, schema)


def read_evolution(spark: SparkSession, path: str, schema: str | None = None, key: str = "id") -> DataFrame | None:
    """The history that ``write_evolution`` or ``store.update_rows`` wrote; a malformed one is an error."""
    stored = read_rows(spark, path, key)
    return stored if stored is not None else read_lines(spark, path, schema, strict=True)


def read_document(spark: SparkSession, path: str, default, strict: bool = False):
    """A small JSON document as Python data; missing or (unless ``strict``) malformed gives ``default``."""
    try:
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    except Exception as error:  # a missing path is known only when the scan is planned
        if "PATH_NOT_FOUND" in str(error):
            return default
        raise
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        if strict:
            raise
        return default


def merged_config(given: dict | None, defaults: dict) -> dict:
    """Two-level merge over the defaults; anything but a mapping gives the defaults."""
    if not isinstance(given, dict):
        return defaults
    return {k: v | given[k] if isinstance(v, dict) and isinstance(given.get(k), dict) else given.get(k, v) for k, v in defaults.items()} | {k: v for k, v in given.items() if k not in defaults}


#: A plan without anything, which stands for one that cannot be read.
EMPTY_PLAN = {"version": 1, "lenses": [], "features": [], "nodes": []}


def read_plan(spark: SparkSession, path: str) -> tuple[dict, list[str]]:
    """A plan document and the problems that made it an empty one: missing is none, malformed and invalid are told."""
    try:
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # a plan is a small document
    except Exception as error:  # a missing path is known only when the scan is planned
        if "PATH_NOT_FOUND" in str(error):
            return EMPTY_PLAN, []
        raise
    problems = [x for r in spark.createDataFrame([(text,)], "d string").select(plan_problems(F.col("d")).alias("p")).collect() for x in r["p"]]
    return (EMPTY_PLAN, problems) if problems else (json.loads(text), [])


FEED = "seq long, ts timestamp, path string, op string, content string"


def change_feed(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """The stream of file events (seq, ts, path, op: add, change or unlink, content) that a watcher appends as JSON lines under ``path``.

    Spark's file stream sees neither edits nor removals, so a watcher has to write them down. Ignored paths are left out.
    """
    feed = spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", True).json(path)
    return feed.where(F.col("op").isin("add", "change", "unlink") & ~should_ignore(F.col("path"), F.lit(True)))
