"""The staged audit of a source tree: manifest, static facts, graph, heat, verdict, report."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import canonical_of, module_name, node_path, role
from ..operators import evidence, traces
from ..operators.tables import scratch, stored
from ..sources import pyast, scan
from . import build_graph, diagnose, domains, integrity, report, verify
from .catalog import Catalog, digest, table_digest

STAGES = ("manifest", "static", "graph", "heat", "verification", "diagnostics")
MODES = {"manifest-only": 1, "static-only": 2, "static-analysis": 3, "full-pipeline": 6}


def canonical(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between canonical ids."""
    ids = nodes.select("node_id", "canonical_id")
    s = ids.select(F.col("node_id").alias("source"), F.col("canonical_id").alias("s"))
    t = ids.select(F.col("node_id").alias("target"), F.col("canonical_id").alias("t"))
    return edges.join(s, "source").join(t, "target").select(F.col("s").alias("source"), F.col("t").alias("target"), "type")


def _trace(spark: SparkSession, trace: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """run_id, seq, event, node_id, source, target, file, depth with canonical ids; what a
    trace leaves out is filled in: one run, the node's own file, no depth.  Rows have no order
    of their own, so without seq there is none, and no workflows are made of them."""
    if trace is None:
        return spark.createDataFrame([], "run_id string, seq long, event string, node_id string, source string, target string, file string, depth int")
    have = set(trace.columns)
    column = lambda c, otherwise: F.col(c) if c in have else otherwise
    node = canonical_of(F.col("node_id"))
    return trace.select(
        column("run_id", F.lit("run_000")).cast("string").alias("run_id"), column("seq", F.lit(None)).cast("long").alias("seq"), "event", F.coalesce(node, "node_id").alias("node_id"),
        *[canonical_of(column(c, F.lit(None).cast("string"))).alias(c) for c in ("source", "target")], column("file", node_path(node)).cast("string").alias("file"), column("depth", F.lit(0)).cast("int").alias("depth"),
    )


def _counts(static: DataFrame) -> dict:
    return static.agg(F.sum(F.size("functions")).alias("functions"), F.sum(F.size("classes")).alias("classes"), F.sum(F.size("calls")).alias("calls"), F.count_if(F.col("ast_error") != "").alias("errors")).first().asDict()


def classify(nodes: DataFrame, edges: DataFrame, manifest: DataFrame, calls: DataFrame, synthetic: bool = False) -> tuple[dict[str, DataFrame], dict]:
    """The heat stage over a graph's tables and a trace (see _trace): table heat, and the
    distribution, the runtime signal and what run_verification takes as evidence."""
    flow = calls.where("event = 'call' and source is not null and target is not null").select("source", "target").distinct()
    starts = manifest.where(F.size("entrypoint_reasons") > 0).select("path")
    named = canonical(edges, nodes).withColumn("confidence", F.lit(1.0))
    known = nodes.select(F.col("canonical_id").alias("node_id"))
    gate, reached, executed = domains.runtime_signal(calls, known, named.where("type = 'CALL'"), flow, starts, synthetic)
    signal = gate.first().asDict()
    ids = nodes.select("node_id", F.col("canonical_id").alias("c"))
    of_nodes = lambda rows: rows.join(ids, rows["node_id"] == ids["c"]).drop(rows["node_id"]).drop("c")
    heat = evidence.cap_confidence(evidence.heat(nodes, edges, of_nodes(calls.select("node_id", "event")), of_nodes(reached)))
    entrypoint_domains = executed.withColumn("domain", traces.entrypoint_domain(F.col("path"))).where("domain <> 'other'")
    spread = entrypoint_domains.agg(F.countDistinct("domain").alias("expected"), F.countDistinct(F.when(F.col("executed"), F.col("domain"))).alias("covered")).first()
    n = max(1, signal["nodes"])
    found = {
        "calls": signal["calls"], "unique": signal["unique"], "coverage": signal["hit_nodes"] / n, "reachable": signal["reached"] / n, "overlap": signal["shared_edges"] / max(1, signal["static_edges"]),
        "entrypoints": signal["entrypoints"], "executed": signal["executed"], "expected_domains": spread["expected"], "covered_domains": spread["covered"],
    }

    def summary(tables: dict[str, DataFrame]) -> dict:
        spread_ = evidence.dead_ratio_gate(evidence.heat_distribution(tables["heat"]), not signal["issues"]).first().asDict()
        sanity = traces.graph_sanity(nodes, edges, starts.select(F.concat(F.lit("file:"), "path").alias("node_id"))).first().asDict()
        local = F.col("file").isNotNull() & ~F.col("file").startswith("<")
        meaning = report.runtime_meaning(calls.select("event", "node_id", module_name(F.col("file")).alias("module"), local.alias("local"), "depth"))
        shared = calls.sparkSession.createDataFrame([(signal["static_edges"], signal["shared_edges"])], "static_edges long, shared_edges long")
        truth = report.truth_layer(meaning, shared, sanity["nodes"], sanity["reachable"], sanity["isolated"], evidence.warm_near_hot(tables["heat"], edges)).first().asDict()
        return {"heat": spread_, "runtime": signal, "evidence": found, "sanity": sanity, "truth": truth}

    return {"heat": heat}, summary


def judge(nodes: DataFrame, edges: DataFrame, manifest: DataFrame, static: DataFrame, calls: DataFrame, heat: dict, min_trust: float, allow_call: bool) -> dict:
    """The verification stage: run_verification over the tables of the stages before it."""
    named = canonical(edges, nodes).withColumn("confidence", F.lit(1.0))
    resolver = named.select("source", "target", F.when(F.col("type") == "CONFIG", "CONFIG").otherwise("AST").alias("origin"))
    starts = manifest.where(F.size("entrypoint_reasons") > 0).select(F.concat(F.lit("canonical://file/"), "path").alias("node_id"))
    symbols = nodes.where("kind <> 'file'").select("name", F.col("path").alias("file"))
    ordered = calls.where("event = 'call' and seq is not null").select("run_id", "seq", role(F.col("node_id")).alias("role"))
    steps = None if ordered.isEmpty() else ordered
    known = nodes.select(F.col("canonical_id").alias("node_id"))
    return verify.run_verification(known, named, resolver, starts, heat["evidence"], min_trust, allow_call, files=static.select(F.col("file_path").alias("path")), symbols=symbols, trace=steps)


def run_audit(
    spark: SparkSession, root: str, trace: DataFrame | None = None, mode: str = "full-pipeline", explicit: tuple[str, ...] = (), allow_call: bool = True, min_trust: float = 0.0, synthetic: bool = False, artifacts: str | None = None,
) -> dict:
    """Stage after stage; each one's tables are committed in a catalog (see catalog.Catalog), so
    a run over the same artifacts folder goes on at the first stage whose inputs changed.  The
    contract is one dictionary.

    trace: node_id, event and optionally source, target of runtime call edges, run_id, seq,
    file, depth; without one the verdict rests on static evidence alone.  synthetic: the trace
    was made up, which the runtime gate reports.  artifacts: the folder, which all executors
    reach; by default a fresh one in the shared folder.
    """
    last = MODES[mode]
    store = Catalog(spark, artifacts or scratch(spark, "audit"))
    out: dict = {"mode": mode, "stages": list(STAGES[:last]), "artifacts": store.root, "summary": {}}
    listed = stored(scan.list_files(spark, root), "listing")
    at = digest("manifest", root, sorted(explicit), table_digest(listed))
    files = scan.read_files(listed, root)
    tables, out["summary"]["manifest"] = store.stage("manifest", at, lambda: ({"manifest": scan.build_manifest(files, explicit)}, lambda t: scan.manifest_summary(t["manifest"]).first().asDict()))
    manifest = tables["manifest"]
    if last < 2:
        return out
    at = digest("static", at)
    tables, out["summary"]["static"] = store.stage("static", at, lambda: ({"static": pyast.analyze(files)}, lambda t: _counts(t["static"])))
    static = tables["static"]
    if last < 3:
        return out
    at = digest("graph", at)

    def graph_tables():
        nodes, edges = build_graph.build_graph(static, listed.select("path"))
        return {"nodes": nodes, "edges": edges}, lambda t: {r["type"]: r["n"] for r in t["edges"].groupBy("type").agg(F.count("*").alias("n")).collect()} | {"nodes": t["nodes"].count()}

    tables, out["summary"]["graph"] = store.stage("graph", at, graph_tables)
    nodes, edges = tables["nodes"], tables["edges"]
    if last < 4:
        return out
    at = digest("heat", at, synthetic, table_digest(trace))
    calls = stored(_trace(spark, trace, nodes), "trace")

    def heat_tables():
        frames, summary = classify(nodes, edges, manifest, calls, synthetic)
        return frames | {"trace": calls}, summary

    _, heat = store.stage("heat", at, heat_tables)
    out["summary"] |= {k: heat[k] for k in ("heat", "runtime", "sanity", "truth")}
    at = digest("verification", at, min_trust, allow_call)
    _, result = store.stage("verification", at, lambda: ({}, judge(nodes, edges, manifest, static, calls, heat, min_trust, allow_call)))
    at = digest("diagnostics", at)
    _, diagnostics = store.stage("diagnostics", at, lambda: ({}, diagnose.diagnose(spark, result, canonical(edges, nodes))))
    return out | {"trust": result["trust"], "system_valid": result["system_valid"] and heat["heat"]["sane"], "verification": result, "diagnostics": diagnostics}


def from_artifacts(spark: SparkSession, artifacts: str, what: str, trace: DataFrame | None = None, min_trust: float = 0.0, allow_call: bool = True, entrypoints: tuple[str, ...] = ()) -> dict:
    """A later stage over what an earlier run committed, without its source tree: classify
    (heat), verify, diagnose, or authority (the decision, with at least one entrypoint)."""
    store = Catalog(spark, artifacts)
    if what == "diagnose" or what == "authority":
        result = store.stored("verification")[1]
        if what == "authority":
            return integrity.authority(result, min_trust, entrypoints)
        graph, _ = store.stored("graph")
        return diagnose.diagnose(spark, result, canonical(graph["edges"], graph["nodes"]))
    graph, _ = store.stored("graph")
    manifest = store.stored("manifest")[0]["manifest"]
    if what == "classify":
        calls = stored(_trace(spark, trace, graph["nodes"]), "trace")
        at = digest("classify", store.marker("graph")["inputs"], table_digest(trace))
        return store.stage("classify", at, lambda: classify(graph["nodes"], graph["edges"], manifest, calls))[1]
    tables, heat = store.stored("heat")
    return judge(graph["nodes"], graph["edges"], manifest, store.stored("static")[0]["static"], tables["trace"], heat, min_trust, allow_call)


def write_report(spark: SparkSession, contract: dict, path: str | None = None) -> str:
    """The contract as one JSON document at the path, or in the shared folder; returns its path."""
    path = path or scratch(spark, "report")
    text = json.dumps(contract, sort_keys=True, ensure_ascii=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path
