"""Symbol resolution: longest-prefix join, candidate cascade, alias lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def longest_prefix(names: DataFrame, index: DataFrame, separator: str = ".") -> DataFrame:
    """names (id, name) and index (module, path) -> id, name, path of the longest module
    that is the name or a dotted prefix of it (null without one).

    Prefixes are exploded to an equi-join; of repeated modules the last row counts, by the
    index's column seq or, without one, by path.
    """
    modules = index.groupBy("module").agg(F.max_by("path", F.struct(*[c for c in ("seq", "path") if c in index.columns])).alias("path"))
    parts = F.split("name", f"\\{separator}")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("n"), F.array_join(F.slice(parts, 1, i), separator).alias("module")))
    asked = names.select("id", "name", F.explode(prefixes).alias("p")).select("id", "name", "p.n", "p.module")
    return asked.join(modules, "module", "left").groupBy("id", "name").agg(F.max_by("path", F.when(F.col("path").isNotNull(), F.col("n"))).alias("path"))


def unique_choice(n: Column, functions: Column, classes: Column, any_id: Column, function_id: Column, class_id: Column) -> Column:
    """The only match, else the only function, else the only class, else null."""
    return F.when(n == 1, any_id).when(functions == 1, function_id).when(classes == 1, class_id)


def import_context(imports: DataFrame) -> DataFrame:
    """imports (file, module, alias, path) -> file, key, scope, path: under which names a file
    can mean the imported path.

    The module's first, last and last but one word and the alias qualify a call (scope
    prefix); its last word and the alias are also callable themselves (scope symbol).
    """
    parts = F.filter(F.transform(F.split("module", r"\."), lambda x: F.trim(x)), lambda x: x != "")
    entry = lambda key, scope: F.struct(key.alias("key"), F.lit(scope).alias("scope"))
    alias = F.nullif(F.trim(F.coalesce("alias", F.lit(""))), F.lit(""))
    keys = F.array(
        entry(F.get(parts, F.lit(0)), "prefix"),
        entry(F.get(parts, F.size(parts) - 1), "prefix"),
        entry(F.get(parts, F.size(parts) - 2), "prefix"),
        entry(alias, "prefix"),
        entry(F.get(parts, F.size(parts) - 1), "symbol"),
        entry(alias, "symbol"),
    )
    rows = imports.where("path is not null and path <> ''").select("file", "path", F.explode(keys).alias("k")).select("file", "k.key", "k.scope", "path")
    return rows.where("key is not null").distinct()


_COUNTS = ("n", "f", "c", "any_id", "f_id", "c_id")


def _counted(rows: DataFrame, *group: str) -> DataFrame:
    """Symbols a group: all, functions, classes, and the least id of each."""
    function, klass = F.col("kind") == "function", F.col("kind") == "class"
    return rows.groupBy(*group).agg(
        F.count("*").alias("n"), F.count_if(function).alias("f"), F.count_if(klass).alias("c"),
        F.min("node_id").alias("any_id"), F.min(F.when(function, F.col("node_id"))).alias("f_id"), F.min(F.when(klass, F.col("node_id"))).alias("c_id"),
    )


def _choice(scope: str) -> Column:
    return unique_choice(*[F.col(f"{scope}_{x}") for x in _COUNTS])


def resolve_calls(calls: DataFrame, symbols: DataFrame, context: DataFrame) -> DataFrame:
    """calls (call_id, file, name, prefix: the callee's first word or null), symbols (name,
    kind, file, node_id), context (see import_context) -> call_id, target.

    In this order, the unique choice over all symbols of the name, those of the caller's
    file, those in files that the prefix imports, those in files that the name itself
    imports.  Symbols are counted by name, and by name and file, before they meet a call, so
    a name that very many files define costs a call one row and not one a file; calls that
    ask the same are asked once.
    """
    asked = calls.select("file", "name", "prefix").distinct()
    named = lambda rows, scope: [F.col(x).alias(f"{scope}_{x}") for x in _COUNTS]
    by_name = _counted(symbols, "name")
    by_file = _counted(symbols, "name", "file")
    out = asked.join(by_name.select("name", *named(by_name, "all")), "name", "left")
    out = out.join(by_file.select("name", "file", *named(by_file, "own")), ["name", "file"], "left")
    for scope, key in (("prefix", "prefix"), ("symbol", "name")):
        paths = context.where(F.col("scope") == scope).select("file", F.col("key").alias(key), "path").distinct()
        met = asked.select("file", "name", "prefix").join(paths, ["file", key]).join(by_file.withColumnRenamed("file", "path"), ["name", "path"])
        sums = met.groupBy("file", "name", "prefix").agg(*[(F.sum if x in ("n", "f", "c") else F.min)(x).alias(f"{scope}_{x}") for x in _COUNTS])
        sums = sums.select(F.col("file").alias("__file"), F.col("name").alias("__name"), F.col("prefix").alias("__prefix"), *[f"{scope}_{x}" for x in _COUNTS])
        same = (F.col("file") == F.col("__file")) & (F.col("name") == F.col("__name")) & F.col("prefix").eqNullSafe(F.col("__prefix"))
        out = out.join(sums, same, "left").drop("__file", "__name", "__prefix")
    target = F.coalesce(*[_choice(s) for s in ("all", "own", "prefix", "symbol")])
    found = out.select(F.col("file").alias("__file"), F.col("name").alias("__name"), F.col("prefix").alias("__prefix"), target.alias("target"))
    same = (F.col("file") == F.col("__file")) & (F.col("name") == F.col("__name")) & F.col("prefix").eqNullSafe(F.col("__prefix"))
    return calls.select("call_id", "file", "name", "prefix").join(found, same, "left").select("call_id", "target")


def alias_lookup(*frames: DataFrame) -> DataFrame:
    """alias -> node_id over frames (alias, node_id) in order of priority: the first
    registration of an alias holds."""
    rows = None
    for i, f in enumerate(frames):
        part = f.select("alias", "node_id", F.lit(i).alias("priority"))
        rows = part if rows is None else rows.union(part)
    return rows.groupBy("alias").agg(F.min_by("node_id", F.struct("priority", "node_id")).alias("node_id"))


def last_alias(rows: DataFrame) -> DataFrame:
    """rows (alias, node_id, place) -> alias, node_id: of repeated aliases the last place's."""
    return rows.where("alias is not null and alias <> ''").groupBy("alias").agg(F.max_by("node_id", F.struct("place", "node_id")).alias("node_id"))


def source_coverage(edges: DataFrame, final: DataFrame) -> DataFrame:
    """edges (origin, source, target) against final (source, target) -> origin, edges,
    covered, coverage; and for each origin how far its coverage lies from the farthest other."""
    kept = final.select("source", "target").distinct().withColumn("kept", F.lit(True))
    by = edges.select("origin", "source", "target").distinct().join(kept, ["source", "target"], "left").groupBy("origin").agg(F.count("*").alias("edges"), F.count("kept").alias("covered"))
    by = by.withColumn("coverage", F.round(F.col("covered") / F.col("edges"), 6))
    ends = by.agg(F.min("coverage").alias("least"), F.max("coverage").alias("most"))  # one row
    return by.crossJoin(F.broadcast(ends)).select("origin", "edges", "covered", "coverage", F.round(F.greatest(F.col("coverage") - F.col("least"), F.col("most") - F.col("coverage")), 6).alias("divergence"))
