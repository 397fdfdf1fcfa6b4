"""python -m sparkwarden.cli COMMAND ...: prints one JSON document.

audit: stages over a source tree, resumed in --artifacts.  classify, diagnose, authority and
judge: one stage over the artifacts of an earlier run.  verify (or validate) and analyze (with
diagnostics): a graph and its resolver edges, as Parquet or as JSON documents; legacy: the same
by the older profile.  compare: the contracts of two audits (--output of audit).

Exit codes: 0, 1 (--fail-on-invalid and not valid; authority: not valid), 2 (an error).
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .plans import audit, diagnose, integrity, legacy, report, verify
from .plans.catalog import StageFailed
from .sources import scan

TRACE = "run_id string, seq long, event string, node_id string, source string, target string, file string, depth int"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkwarden")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("audit", help="stages over a source tree")
    a.add_argument("root")
    a.add_argument("--mode", choices=sorted(audit.MODES), default="full-pipeline")
    a.add_argument("--artifacts", help="folder of the stages' tables")
    a.add_argument("--synthetic", action="store_true", help="the trace was made up")
    stored = [sub.add_parser(name, help=f"{name} over stored artifacts") for name in ("classify", "diagnose", "authority", "judge")]
    for x in stored:
        x.add_argument("artifacts")
    for x in (a, stored[0]):
        x.add_argument("--trace", help=f"JSON lines: {TRACE}")
    graphs = [sub.add_parser(name, help="a graph and its resolver edges") for name in ("verify", "validate", "analyze", "legacy")]
    for x in graphs:
        x.add_argument("graph", help="JSON document, or a folder with nodes and edges as Parquet")
        x.add_argument("resolver", help="JSON document, or Parquet of source, target, origin")
        x.add_argument("--paths", help="Parquet of source_path, target_path")
        x.add_argument("--files", help="Parquet of path")
        x.add_argument("--symbols", help="Parquet of name, file")
        x.add_argument("--steps", help="Parquet of run_id, seq, role")
        x.add_argument("--include-validation", action="store_true")
    c = sub.add_parser("compare", help="contracts of two audits")
    c.add_argument("before")
    c.add_argument("after")
    for x in (a, c, *stored, *graphs):
        x.add_argument("--entrypoint", action="append", default=[])
        x.add_argument("--min-trust", type=float)
        x.add_argument("--fail-on-invalid", action="store_true")
        x.add_argument("--output", help="also written there, as one document")
    return p


def _verified(spark: SparkSession, o: argparse.Namespace) -> tuple[dict, DataFrame]:
    nodes, edges = scan.read_graph(spark, o.graph)
    optional = {k: spark.read.parquet(v) if v else None for k, v in (("paths", o.paths), ("files", o.files), ("symbols", o.symbols), ("trace", o.steps))}
    starts = spark.createDataFrame([(e,) for e in o.entrypoint], "node_id string")
    return verify.run_verification(nodes, edges, scan.read_resolver(spark, o.resolver), starts, min_trust=o.min_trust or 0.0, **optional), edges


def _run(spark: SparkSession, o: argparse.Namespace) -> dict:
    trace = spark.read.schema(TRACE).json(o.trace) if getattr(o, "trace", None) else None
    least = o.min_trust or 0.0
    if o.command == "audit":
        out = audit.run_audit(spark, o.root, trace, o.mode, tuple(o.entrypoint), min_trust=least, synthetic=o.synthetic, artifacts=o.artifacts)
        return out | {"report": report.final_report(out)} if "verification" in out else out
    if o.command == "authority":
        return audit.from_artifacts(spark, o.artifacts, "authority", min_trust=integrity.P.MIN_AUTHORITY_TRUST if o.min_trust is None else least, entrypoints=tuple(o.entrypoint))
    if o.command in ("classify", "diagnose", "judge"):
        return audit.from_artifacts(spark, o.artifacts, o.command, trace, least)
    if o.command == "compare":
        return diagnose.compared(*[json.loads(spark.read.option("wholetext", True).text(x).first()[0]) for x in (o.before, o.after)])
    if o.command == "legacy":
        nodes, edges = scan.read_graph(spark, o.graph)
        starts = spark.createDataFrame([(e,) for e in o.entrypoint], "node_id string")
        return legacy.verify_v1(nodes, edges, scan.read_resolver(spark, o.resolver), starts)
    result, edges = _verified(spark, o)
    if o.command != "analyze":
        return result
    found = diagnose.diagnose(spark, result, edges)
    short = {k: result["policy"][k] for k in ("hard", "system_valid")}
    return {"summary": {"status": found["status"], "confidence": found["confidence"], "root_cause": found["primary"]}, "diagnostics": found, "trust": result["trust"], "system_valid": result["system_valid"], "validation": result if o.include_validation else short}


def main(args: list[str] | None = None) -> int:
    o = _parser().parse_args(args)
    spark = SparkSession.builder.appName("sparkwarden").getOrCreate()
    try:
        out = _run(spark, o)
        if o.output:
            audit.write_report(spark, out, o.output)
    except Exception as e:
        # The failure as a document of its own: what was asked for, and where it ended.
        stage = e.stage if isinstance(e, StageFailed) else None
        print(json.dumps({"status": "FAILED", "command": o.command, "stage": stage, "system_valid": False, "trust_score": 0.0, "error": type(e.__cause__ or e).__name__, "message": str(e)[:500]}, sort_keys=True))
        return 2
    print(json.dumps(out, sort_keys=True, default=str))
    if o.command == "authority":
        return int(not out["authority_valid"])
    return int(o.fail_on_invalid and not out.get("system_valid", False))


if __name__ == "__main__":
    sys.exit(main())
