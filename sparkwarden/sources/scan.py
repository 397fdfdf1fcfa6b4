"""File inventories: binary scan, content hash, manifest, JSON lines."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import profiles as P
from ..functions import columns as C
from ..operators.tables import stored
from ..schemas import STAGE_EVENTS
from ..shipping import ship
from .pyast import module_facts


def _filesystem(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root else Path(root).absolute().as_uri())


#: Bytes of file contents that a task holds together.
CONTENT_BYTES = 16 << 20


def ignored(path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Folders and suffixes of a file of ignore patterns, one a line.  A comment that speaks of
    suffixes, or of directories, says what the lines after it are; folders come first."""
    files, at = _filesystem(path)
    with files.open_input_stream(at) as f:
        lines = [x.strip() for x in f.read().decode("utf-8", "replace").splitlines()]
    found: dict[str, list[str]] = {"directory": [], "suffix": []}
    mode = "directory"
    for line in lines:
        if line.startswith("#"):
            mode = next((m for m in ("suffix", "directory") if m in line.lower()), mode)
        elif line:
            found[mode].append(line.lower() if mode == "suffix" else line.strip("/"))
    return tuple(sorted(set(found["directory"]))), tuple(sorted(set(found["suffix"])))


def list_files(spark: SparkSession, root: str, skip_dirs: tuple[str, ...] = P.SKIP_DIRS, skip_suffixes: tuple[str, ...] = P.SKIP_SUFFIXES) -> DataFrame:
    """path (relative to root), size and modified (nanoseconds; 0 where the file system keeps
    no time) of every file; skipped folders are never listed.

    Folders are listed by the executors, level by level, so no name passes the driver.
    Spark's own file sources leave out empty files and names that begin with an underscore,
    which source trees have.
    """
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, top = _filesystem(root)
        for rows in batches:
            for folder in rows["path"]:
                out = []
                for f in files.get_file_info(fs.FileSelector(f"{top}/{folder}" if folder else top)):
                    inside = f.type == fs.FileType.Directory
                    if f.base_name not in skip_dirs if inside else not f.base_name.lower().endswith(skip_suffixes):
                        out.append((f.path[len(top) :].lstrip("/"), 0 if inside else f.size, f.mtime_ns or 0, inside))
                yield pd.DataFrame(out, columns=["path", "size", "modified", "folder"])

    level = spark.createDataFrame([("",)], "path string")
    found = spark.createDataFrame([], "path string, size long, modified long")
    while True:
        listed = stored(level.repartition(n, "path").mapInPandas(entries, "path string, size long, modified long, folder boolean"), "listing")
        found = found.union(listed.where("not folder").select("path", "size", "modified"))
        level = listed.where("folder").select("path")
        if level.isEmpty():
            return found


def scan_files(spark: SparkSession, root: str, skip_dirs: tuple[str, ...] = P.SKIP_DIRS, skip_suffixes: tuple[str, ...] = P.SKIP_SUFFIXES) -> DataFrame:
    """path (relative to root), size, content of all files but those below skipped folders or
    with a skipped suffix; listed and read by the executors."""
    return read_files(list_files(spark, root, skip_dirs, skip_suffixes), root)


def read_files(listed: DataFrame, root: str) -> DataFrame:
    """path, size, content of listed files; a task holds CONTENT_BYTES of contents together."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, top = _filesystem(root)
        held: list[tuple] = []
        size = 0
        made = lambda rows: pd.DataFrame(rows, columns=["path", "size", "content"])
        for rows in batches:
            for path, n in zip(rows["path"], rows["size"].tolist()):
                with files.open_input_stream(f"{top}/{path}", compression=None) as f:
                    held.append((path, n, f.read()))
                size += n
                if size > CONTENT_BYTES:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)

    return listed.mapInPandas(read, "path string, size long, content binary")


def build_manifest(files: DataFrame, explicit: tuple[str, ...] = ()) -> DataFrame:
    """files (path, size, content) -> manifest rows; only Python files are parsed."""
    ship(files.sparkSession)
    is_py = C.language(F.col("path")) == "python"
    facts = module_facts(F.when(is_py, F.col("content")))
    rows = files.select("path", "size", F.sha2("content", 256).alias("sha256"), C.language(F.col("path")).alias("language"), C.module_name(F.col("path")).alias("module"), facts.alias("f"))
    reasons = C.entrypoint_reasons(F.col("path"), F.col("path").isin(*explicit) if explicit else F.lit(False), F.coalesce(F.col("f.main_guard"), F.lit(False)), F.transform(F.col("f.symbols"), lambda s: s["name"]))
    return rows.select("path", "size", "sha256", "language", "module", "f.imports", "f.symbols", F.when(F.col("language") == "python", reasons).otherwise(F.array().cast("array<string>")).alias("entrypoint_reasons"), F.coalesce("f.ast_error", F.lit("")).alias("ast_error"))


def manifest_summary(manifest: DataFrame, most: int = 1000) -> DataFrame:
    """One row: files, Python files, bytes, entrypoints (how many, and the first most of their
    paths)."""
    starts = manifest.where(F.size("entrypoint_reasons") > 0).select("path").distinct()
    few = starts.orderBy("path").limit(most).agg(F.array_sort(F.collect_list("path")).alias("entrypoints"))
    one = manifest.agg(
        F.count("*").alias("file_count"),
        F.count_if(F.col("language") == "python").alias("python_file_count"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
        F.count_if(F.size("entrypoint_reasons") > 0).alias("entrypoint_count"),
    )
    return one.crossJoin(F.broadcast(few))


def language_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("language").agg(F.count("*").alias("n"))


def is_json_object(text: Column) -> Column:
    """Whether a text is one JSON object and nothing else; of repeated keys the last counts."""
    alone = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string, string>>", {"allowSingleQuotes": "false"})
    return F.coalesce((F.size(alone) == 1) & F.get(alone, F.lit(0)).isNotNull(), F.lit(False))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines that are JSON objects, as rows of the schema: what an object lacks, or holds in
    another kind, is null there, and an object without any of the columns is a row of nulls.
    Blank and malformed lines and lists are left out."""
    rows = spark.read.text(path).where(is_json_object(F.col("value")))
    return rows.select(F.from_json("value", schema).alias("d")).select("d.*")


def grep_lines(files: DataFrame, words: tuple[str, ...], per_file: int = 20) -> DataFrame:
    """path, line, text, word: lines that contain a word, the first per_file of each file (a report)."""
    from pyspark.sql.window import Window

    text = F.decode("content", "UTF-8")
    lines = files.select("path", F.posexplode(F.split(text, "\n")).alias("i", "text"))
    hits = lines.withColumn("word", F.explode(C.any_of(words))).where(F.contains(F.lower("text"), F.lower("word")))
    w = Window.partitionBy("path").orderBy("i", "word")
    return hits.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_file).select("path", (F.col("i") + 1).alias("line"), "text", "word")


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document as a row of the schema; what stands below a key graph is taken as the
    document itself; an empty file is a row of nulls."""
    text = spark.read.option("wholetext", True).text(path)
    whole = F.coalesce(F.nullif(F.trim(F.col("value")), F.lit("")), F.lit("{}"))
    inner = F.get_json_object(whole, "$.graph")
    body = F.when(inner.startswith("{"), inner).otherwise(whole)
    return text.select(F.from_json(body, schema).alias("d")).select("d.*")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (node_id, isolated) and edges (source, target, type, confidence, origin) of a JSON
    document (see read_document; ends called source and target, or from and to, then source is
    the origin), or of Parquet folders nodes and edges."""
    if not path.endswith(".json"):
        return spark.read.parquet(f"{path.rstrip('/')}/nodes"), spark.read.parquet(f"{path.rstrip('/')}/edges")
    edge = "`from`: string, `to`: string, source: string, target: string, type: string, origin: string, confidence: double"
    doc = stored(read_document(spark, path, f"nodes array<struct<id: string, node_id: string, isolated: boolean>>, edges array<struct<{edge}>>"), "document")
    nodes = doc.select(F.explode("nodes").alias("n")).select(F.coalesce("n.node_id", "n.id").alias("node_id"), F.coalesce("n.isolated", F.lit(False)).alias("isolated"))
    ends = doc.select(F.explode("edges").alias("e")).select("e.*")
    return nodes, ends.select(F.coalesce("from", "source").alias("source"), F.coalesce("to", "target").alias("target"), "type", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("origin", F.when(F.col("from").isNotNull(), F.col("source"))).alias("origin"))


def read_resolver(spark: SparkSession, path: str) -> DataFrame:
    """source, target, origin of resolver edges: a JSON document with a list edges (ends as in
    read_graph), or Parquet."""
    if not path.endswith(".json"):
        return spark.read.parquet(path)
    edge = "`from`: string, `to`: string, source: string, target: string, origin: string, type: string"
    ends = read_document(spark, path, f"edges array<struct<{edge}>>").select(F.explode("edges").alias("e")).select("e.*")
    origin = F.coalesce("origin", F.when(F.col("from").isNotNull(), F.col("source")), "type")
    return ends.select(F.coalesce("from", "source").alias("source"), F.coalesce("to", "target").alias("target"), origin.alias("origin"))


def write_json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    """Rows as JSON lines with sorted keys, in place of what is there or after it."""
    rows.select(*sorted(rows.columns)).write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def log_stage(spark: SparkSession, path: str, stage: str, status: str, **details: str) -> None:
    """Adds an event to the log of a run's stages."""
    row = (stage, status, json.dumps(details, sort_keys=True))
    write_json_lines(spark.createDataFrame([row], STAGE_EVENTS).coalesce(1), path, append=True)
