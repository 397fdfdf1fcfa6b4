"""The typed dependency graph of a scanned tree: nodes and IMPORT, CALL, CONFIG edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import resolve


def graph_nodes(static: DataFrame) -> DataFrame:
    """File, function and class nodes (functions by bare name: same names in a file are one)."""
    file = static.select(F.lit("file").alias("kind"), F.col("file_path").alias("path"), F.lit(None).cast("string").alias("name"))
    of = lambda kind, column: static.select(F.lit(kind).alias("kind"), F.col("file_path").alias("path"), F.explode(F.transform(column, lambda x: x["name"])).alias("name"))
    rows = file.union(of("function", "functions")).union(of("class", "classes")).distinct()
    key = (F.col("kind"), F.col("path"), F.col("name"))
    return rows.select(C.node_id(*key).alias("node_id"), *key, C.canonical_id(*key).alias("canonical_id"))


def resolved_imports(static: DataFrame) -> DataFrame:
    """file, module, alias, path: every import, relative ones from their module's package, and
    the file of the longest known prefix of its name (null without one)."""
    module = C.module_name(F.col("file_path"))
    index = static.select(module.alias("module"), F.col("file_path").alias("path"))
    package = F.col("file_path").rlike(r"(^|/)__init__\.py$")
    rows = static.select("file_path", module.alias("own"), package.alias("package"), F.explode("imports").alias("i"))
    rows = rows.select(F.col("file_path").alias("file"), C.absolute_import(F.col("i.module"), F.col("own"), F.col("package")).alias("module"), F.col("i.alias").alias("alias")).where("module is not null")
    found = resolve.longest_prefix(rows.select(F.col("module").alias("id"), F.col("module").alias("name")).distinct(), index)
    return rows.distinct().join(found.select(F.col("id").alias("module"), "path"), "module", "left").select("file", "module", "alias", "path")


def import_edges(static: DataFrame) -> DataFrame:
    """File to the file of the longest known prefix of each imported name."""
    found = resolved_imports(static).where("path is not null and path <> file")
    return found.select(C.node_id(F.lit("file"), F.col("file"), F.lit("")).alias("source"), C.node_id(F.lit("file"), F.col("path"), F.lit("")).alias("target"), F.lit("IMPORT").alias("type"), F.col("module").alias("evidence")).distinct()


def call_edges(static: DataFrame, nodes: DataFrame) -> DataFrame:
    """Caller to callee symbol; callers outside a known symbol are their file."""
    symbols = nodes.where("kind <> 'file'").select("name", "kind", F.col("path").alias("file"), "node_id")
    words = F.split("c.callee", r"\.")
    calls = static.select("file_path", F.explode("calls").alias("c")).select(
        "file_path", F.element_at(F.split("c.caller", r"\."), -1).alias("caller"), F.element_at(words, -1).alias("name"),
        F.when(F.size(words) > 1, F.get(words, F.lit(0))).alias("prefix"), F.col("c.callee").alias("evidence"),
    ).distinct()
    calls = calls.withColumn("call_id", F.concat_ws("\x01", "file_path", "caller", "evidence"))
    context = resolve.import_context(resolved_imports(static))
    targets = resolve.resolve_calls(calls.select("call_id", F.col("file_path").alias("file"), "name", "prefix"), symbols, context).where("target is not null")
    own = symbols.groupBy("file", "name").agg(F.max_by("node_id", F.col("kind") == "function").alias("source"))
    joined = calls.join(targets, "call_id").join(own.select(F.col("file").alias("file_path"), F.col("name").alias("caller"), "source"), ["file_path", "caller"], "left")
    source = F.coalesce("source", C.node_id(F.lit("file"), F.col("file_path"), F.lit("")))
    return joined.select(source.alias("source"), "target", F.lit("CALL").alias("type"), "evidence").distinct()


def config_edges(static: DataFrame, files: DataFrame) -> DataFrame:
    """File to the inventoried file that a literal open() names."""
    known = files.select(C.normalize_path(F.col("path")).alias("path")).distinct()
    refs = static.select("file_path", F.explode("config_references").alias("ref")).select("file_path", C.normalize_path(F.col("ref")).alias("path"))
    return refs.join(known, "path", "left_semi").select(C.node_id(F.lit("file"), F.col("file_path"), F.lit("")).alias("source"), C.node_id(F.lit("file"), F.col("path"), F.lit("")).alias("target"), F.lit("CONFIG").alias("type"), F.col("path").alias("evidence")).distinct()


def build_graph(static: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges."""
    nodes = graph_nodes(static)
    return nodes, import_edges(static).union(call_edges(static, nodes)).union(config_edges(static, files))
