"""Verdict formulas, verification, sources, graph build and streams."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from sparkwarden.functions import scores as S
from sparkwarden.plans import build_graph, verify
from sparkwarden.sources import pyast, scan
from sparkwarden.streaming import trace


def test_execution_confidence():
    low = S.execution_confidence(0.05122, 0.001, 1.0, 1.0, 1.0)
    assert low["raw"] == 0.02 and low["adjusted"] == 0.02
    high = S.execution_confidence(0.40, 0.20, S.call_frequency(120, 40), S.path_centrality(0.2, 0.4), 1.0)
    assert high["raw"] == 1.0 and high["authority"] >= 0.95


def test_scenario_gate():
    assert S.scenario_completeness(0.25, 1 / 3, S.scenario_importance([220, 30], 0.25, 0), 2) < 0.55


def test_trust_gates():
    good = {"structural_integrity": 1.0, "topology_validation": 1.0, "dependency_consistency": 1.0, "semantic_observations": 1.0}
    assert S.trust(good, 1.0, 1.0, 0.4, 0.0)["trust_score"] == 1.0
    assert S.trust(good, 1.0, 1.0, 0.2, 0.0)["trust_score"] == 0.5
    assert S.trust(good, 1.0, 1.0, 0.4, 0.51)["trust_score"] == pytest.approx(0.8)
    assert S.trust(good, 0.02, 1.0, 0.4, 0.0)["trust_score"] < 0.4
    assert S.policy({"coverage": 0.2, "raw_confidence": 1.0, "trust": 1.0})["system_valid"] is False
    assert S.policy({"coverage": 0.4, "raw_confidence": 1.0, "trust": 1.0})["system_valid"] is True


def test_policy_reasons():
    ok = {"coverage": 0.4, "raw_confidence": 1.0, "trust": 1.0, "runtime": True}
    assert S.policy(ok) == {"hard": [], "soft": [], "system_valid": True}
    bad = ok | {"entrypoint_coverage": 0.25, "domain_coverage": 0.3, "expected_domains": 3, "scenario_coverage": 0.5, "drifted": True, "cycles": 1, "architecture_coverage": 0.5, "violation_ratio": 0.7, "architecture_score": 0.1, "valid_nodes": 0}
    got = S.policy(bad | {"semantic_score": 0.5, "collisions": 1, "causal_enforced": True, "causal_score": 0.3})
    assert got["hard"] == ["no_valid_nodes", "architecture_violations_exceeded", "entrypoint_coverage_below_floor"]
    assert got["soft"] == ["domain_coverage_below_minimum", "scenario_coverage_below_minimum", "architecture_drift", "cycles", "architecture_score_low", "semantic_collisions", "causal_score_low"]
    assert S.policy(bad | {"runtime": False, "architecture_coverage": 0.1, "valid_nodes": 1})["hard"] == []


def test_execution_domain():
    from sparkwarden.plans import domains

    none = domains.execution_confidence({})
    assert none.score == 1.0 and none.warnings and not none.issues
    gate = domains.execution_confidence({"calls": 150, "unique": 40, "coverage": 0.4, "overlap": 0.2, "reachable": 0.5, "entrypoints": 4, "executed": 1, "expected_domains": 3, "covered_domains": 1, "priorities": [220.0, 30.0], "scenario_warnings": ["a", "b"]})
    assert [i["type"] for i in gate.issues] == ["ENTRYPOINT_COVERAGE_INCOMPLETE", "DOMAIN_COVERAGE_INCOMPLETE", "SCENARIO_COVERAGE_INCOMPLETE"]
    assert [i["count"] for i in gate.issues] == [3, 2, 1] and len(gate.warnings) == 3
    low = domains.execution_confidence({"calls": 279, "unique": 40, "coverage": 0.05122, "overlap": 0.001, "scenario": 1.0})
    assert low.score == 0.02 and [i["type"] for i in low.issues] == ["LOW_EXECUTION_CONFIDENCE"]


def test_intent_domain(spark):
    from sparkwarden.plans import domains

    paths = [("apps/api/service.py", "infra/db/store.py"), ("domain/core/rules.py", "infra/adapters/mail_adapter.py"), ("services/pay_service.py", "infra/adapters/pay_adapter.py"), ("shared/util.py", "shared/log.py"), ("domain/core/a.py", "domain/core/b.py")]
    d = domains.architectural_intent(spark.createDataFrame(paths, "source_path string, target_path string"))
    assert d.issues[0]["type"] == "ARCHITECTURE_CONSTRAINT_VIOLATION" and d.issues[0]["severity"] == "HIGH" and d.issues[0]["count"] == d.metrics["violation_count"] >= 3
    assert "apps/api/service.py" in d.issues[0]["sample"] and d.score < 0.6 and not d.warnings
    empty = domains.architectural_intent(spark.createDataFrame([], "source_path string, target_path string"))
    assert not empty.issues and empty.warnings


def test_semantic_domain(spark):
    from sparkwarden.plans import domains

    names = ("AuthSessionRouter", "AuthSessionService", "AuthSessionManager")
    files = ["billing/auth/session_login.py", "portal/auth/session_login.py", "kernel/auth/session_login.py", "paint/colour.py"]
    symbols = [(n, f) for n, f in zip(names, files)] + [(x, f) for f in files[:3] for x in ("LoginCheck", "PasswordHash")] + [("Brush", files[3])]
    d = domains.semantic_consistency(spark.createDataFrame([(f,) for f in files], "path string"), spark.createDataFrame(symbols, "name string, file string"))
    assert {i["type"] for i in d.issues} == {"DUPLICATE_INTENT_CLUSTERS", "FAKE_ABSTRACTION_COLLISION"}
    assert d.metrics["cluster_count"] == d.metrics["cross_context_cluster_count"] == d.metrics["duplicate_intent_cluster_count"] == 1 and d.score < 1


def test_causal_domain(spark):
    from sparkwarden.plans import domains

    roles = ["api", "validation", "orchestration", "domain_decision", "side_effect", "persistence"]
    make = lambda rows: spark.createDataFrame(rows, "run_id string, seq long, role string")
    full = domains.causal_flow(make([("r", i, x) for i, x in enumerate(roles)]))
    assert full.score == 1.0 and not full.issues and full.metrics["workflow_count"] == 1
    bare = domains.causal_flow(make([("r", 1, "api"), ("r", 2, "persistence"), ("s", 1, "internal")]))
    assert [i["type"] for i in bare.issues] == ["MISSING_DOMAIN_DECISION_STAGE", "DIRECT_API_TO_PERSISTENCE_PATH"] and bare.issues[1]["severity"] == "LOW"
    none = domains.causal_flow(make([]))
    assert none.score == 1.0 and not none.issues and none.warnings


def test_relative_imports_and_prefixed_calls(spark, tmp_path):
    tree = {"pkg/__init__.py": "from .a import run\n", "pkg/a.py": "from . import b as bb\nfrom .sub.c import go\n\ndef run():\n    bb.go()\n    go()\n", "pkg/b.py": "def go():\n    pass\n", "pkg/sub/__init__.py": "", "pkg/sub/c.py": "from ..b import go as other\nfrom .... import nothing\n\ndef go():\n    other()\n"}
    for p, text in tree.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    files = scan.scan_files(spark, str(tmp_path))
    nodes, edges = build_graph.build_graph(pyast.analyze(files), files)
    got = {(r.source, r.target, r.type) for r in edges.collect()}
    assert {(a, b) for a, b, t in got if t == "IMPORT"} == {("file:pkg/__init__.py", "file:pkg/a.py"), ("file:pkg/a.py", "file:pkg/b.py"), ("file:pkg/a.py", "file:pkg/sub/c.py"), ("file:pkg/sub/c.py", "file:pkg/b.py")}
    # bb.go is the go of the file that bb imports, go itself that of the imported name.
    assert {b for a, b, t in got if t == "CALL" and a == "function:pkg/a.py:run"} == {"function:pkg/b.py:go", "function:pkg/sub/c.py:go"}


def test_divergence_profiles():
    assert S.pair_divergence(0, 0, 0, 0) == 0 and S.pair_overlap(0, 0, 0) == 1 and S.pair_overlap(0, 2, 0) == 0
    assert S.pair_divergence(2, 3, 1, 4) == 0.637 and S.pair_divergence(2, 3, 1, 4, "v1") == 0.5


def test_failure_ranks():
    rows = S.failure_impacts({"structural_integrity": 0.5, "topology_validation": 0.5, "dependency_consistency": 0.5, "causal_flow": 1.0}, drifted=True)
    assert [r["domain"] for r in rows] == ["architecture_drift", "structural_integrity", "dependency_consistency", "topology_validation"][:0] or [r["rank"] for r in rows] == [1, 2, 3, 4]
    assert rows[0]["impact"] == 0.2 and rows[1]["domain"] == "structural_integrity"


def test_verification(spark):
    ids = ["canonical://service/App", "canonical://service/Foo", "canonical://service/Bar", "canonical://service/Alone", "bad-node-id"]
    nodes = spark.createDataFrame([(i, i.endswith("Alone")) for i in ids], "node_id string, isolated boolean")
    s = "canonical://service/"
    e = [(s + "App", s + "Foo"), (s + "Foo", s + "Bar"), (s + "Bar", s + "Foo"), (s + "App", "bad-node-id"), (s + "App", s + "Missing")]
    edges = spark.createDataFrame([(a, b, "IMPORT", 1.0) for a, b in e], "source string, target string, type string, confidence double")
    resolver = spark.createDataFrame([(s + "App", s + "Foo", "AST"), (s + "App", s + "Missing", "DI")], "source string, target string, origin string")
    entry = spark.createDataFrame([(s + "App",)], "node_id string")
    out = verify.run_verification(nodes, edges, resolver, entry)
    kinds = {i["type"]: i["count"] for i in out["issues"]}
    assert kinds["INVALID_NODE_NAMESPACE"] == 1 and kinds["UNRESOLVED_EDGE_REFERENCE"] == 1 and kinds["MISSING_DI_NODES"] == 1
    assert kinds["UNREACHABLE_NODES"] == 1 and "UNEXPECTED_ORPHAN_SUBGRAPH" not in kinds and kinds["CYCLE_POLICY_VIOLATION"] == 2
    assert out["domains"]["structural_integrity"]["score"] == 0.8 and out["system_valid"] is False
    again = verify.run_verification(nodes.repartition(5), edges.repartition(3), resolver, entry)
    assert json.dumps(out, sort_keys=True) == json.dumps(again, sort_keys=True)


SOURCE = '''import os
from pkg.util import helper as h

class Box:
    def open_it(self):
        return h(open("conf/a.yml"))

def main():
    Box().open_it()

if __name__ == "__main__":
    main()
'''


@pytest.fixture()
def tree(tmp_path):
    for p, text in {"pkg/__init__.py": "", "pkg/util.py": "def helper(x):\n    return x\n", "main.py": SOURCE, "conf/a.yml": "a: 1\n", "node_modules/x.py": "y = 1\n", "bad.py": "def (\n", "pic.png": "x"}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    return str(tmp_path)


def test_scan_manifest_and_graph(spark, tree):
    files = scan.scan_files(spark, tree)
    m = {r.path: r for r in scan.build_manifest(files).collect()}
    assert set(m) == {"pkg/__init__.py", "pkg/util.py", "main.py", "conf/a.yml", "bad.py"}
    assert m["main.py"].entrypoint_reasons == ["filename_heuristic", "main_guard", "main_symbol"] and m["main.py"].imports == ["os", "pkg.util.helper"]
    assert m["pkg/__init__.py"].ast_error == "empty_file" and m["bad.py"].ast_error.startswith("syntax_error:1:") and m["pkg/__init__.py"].module == "pkg"
    one = scan.manifest_summary(scan.build_manifest(files)).first()
    assert (one.file_count, one.python_file_count, one.entrypoints) == (5, 4, ["main.py"])
    static = pyast.analyze(files)
    nodes, edges = build_graph.build_graph(static, files)
    assert {r.node_id for r in nodes.collect()} >= {"file:main.py", "class:main.py:Box", "function:main.py:main", "function:main.py:open_it", "function:pkg/util.py:helper"}
    got = {(r.source, r.target, r.type) for r in edges.collect()}
    assert ("file:main.py", "file:pkg/util.py", "IMPORT") in got and ("file:main.py", "file:conf/a.yml", "CONFIG") in got
    assert ("function:main.py:main", "function:main.py:open_it", "CALL") in got and ("file:main.py", "function:main.py:main", "CALL") in got
    hits = scan.grep_lines(files, ("helper",)).collect()
    assert {(r.path, r.line) for r in hits} == {("main.py", 2), ("pkg/util.py", 1)}


def test_json_lines_leaves_out_bad_rows(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"stage": "a", "status": "ok"}\n\n{"stage": \n[1]\n"text"\n{"stage": "b"}\n')
    assert sorted(r.stage for r in scan.read_json_lines(spark, str(f), "stage string, status string").collect()) == ["a", "b"]


def test_documents_logs_and_ignored_names(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"graph": {"nodes": [{"id": "a"}], "edges": []}}')
    (tmp_path / "h.json").write_text('{"nodes": [{"id": "b"}]}')
    (tmp_path / "empty.json").write_text("")
    ids = lambda f: [[n.id for n in r.nodes] if r.nodes else None for r in scan.read_document(spark, str(tmp_path / f), "nodes array<struct<id: string>>").collect()]
    assert ids("g.json") == [["a"]] and ids("h.json") == [["b"]] and ids("empty.json") in ([], [None])
    log = str(tmp_path / "log")
    scan.log_stage(spark, log, "manifest", "ok", files="3")
    scan.log_stage(spark, log, "graph", "failed", reason="x")
    lines = [json.loads(x) for f in Path(log).glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(x["stage"] for x in lines) == ["graph", "manifest"] and all(list(x) == ["details", "stage", "status"] for x in lines)
    (tmp_path / "names").write_text("# directory names\n.git/\nbuild\n# suffixes\n.PNG\n.gz\n")
    assert scan.ignored(str(tmp_path / "names")) == ((".git", "build"), (".gz", ".png"))


def test_integrity(spark):
    from sparkwarden.plans import integrity

    nodes = spark.createDataFrame([("a", "x.py"), ("b", "./x.py"), ("c", "y.py"), ("d", "z.py")], "node_id string, path string")
    edges = spark.createDataFrame([("a", "b", "IMPORT", "AST", 1.0), (" b ", "gone", None, None, 0.0), ("c", "d", "di", None, None)], "source string, target string, type string, origin string, confidence double")
    out = integrity.graph_integrity(nodes, edges)
    assert {i["type"]: (i["count"], i["sample"]) for i in out["issues"]} == {"UNRESOLVED_EDGE_REFERENCE": (1, []), "DISCONNECTED_SUBGRAPHS": (1, ["c"]), "IDENTITY_COLLISION_NAMESPACE_FILEPATH": (1, ["x.py"])}
    assert out["status"] == "INVALID" and out["metrics"] == {"orphan_nodes": 2, "disconnected_clusters": 1, "di_nodes_missing_edges": 1}
    gate = integrity.edge_gate(nodes, edges).first()
    assert (gate.unresolved, gate.underived, gate.code) == (1, 1, "UNRESOLVED_EDGE_REFERENCE")
    fine = edges.where("target = 'b'")
    assert integrity.edge_gate(nodes, fine).first().code == "" and integrity.edge_gate(nodes, edges.where("target = 'd'")).first().code == "DI_NOT_DERIVED_FROM_AST"
    assert {(r.source, r.target, r.type, r.origin, r.confidence) for r in integrity.gated_edges(edges).collect()} == {("a", "b", "IMPORT", "AST", 1.0), ("b", "gone", "IMPORT", "AST", 1.0), ("c", "d", "DI", "AST", 1.0)}
    starts = spark.createDataFrame([("a",)], "node_id string")
    islands = integrity.island_anomalies(nodes, edges, starts)
    assert islands["status"] == "FAIL" and [a["count"] for a in islands["anomalies"]] == [1, 1]
    result = {"policy": {"hard": []}, "trust_score": 0.6, "issues": [], "failures": []}
    assert integrity.authority(result, entrypoints=("a ", "a"))["authority_valid"] and not integrity.authority(result, 0.7, ("a",))["authority_valid"]
    assert not integrity.authority(result | {"policy": {"hard": ["x"]}}, entrypoints=("a",))["authority_valid"]
    with pytest.raises(ValueError):
        integrity.authority(result)


def test_streams(spark, tmp_path):
    rows = []
    for run in ("r1", "r2"):
        for i, (event, node) in enumerate([("call", "a"), ("call", "b"), ("return", "b"), ("call", "c"), ("return", "x"), ("call", "d")]):
            rows.append({"run_id": run, "seq": i, "event": event, "callee_node_id": node, "timestamp": f"2024-01-01T00:{i:02d}:00Z"})
    (tmp_path / "in").mkdir()
    for k in range(0, len(rows), 5):
        (tmp_path / "in" / f"{k}.jsonl").write_text("\n".join(json.dumps(r) for r in rows[k : k + 5]))
    stream = trace.read_trace(spark, str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return spark.table(name).collect()

    assert {r.node_id: r.hits for r in run(trace.node_hits(stream), "complete", "hits")} == {"a": 2, "b": 2, "c": 2, "d": 2}
    assert sum(r.calls for r in run(trace.windowed_hits(stream, late="0 seconds"), "complete", "windows")) == 8


def test_entry_module_without_the_optional_part(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "sparkwarden", tmp_path / "sparkwarden", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'heat_nodes' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


def test_audit_of_a_tree(spark, tree):
    from sparkwarden.plans import audit, diagnose

    calls = spark.createDataFrame([("function:main.py:main", "call", "file:main.py", "function:main.py:main"), ("function:main.py:open_it", "call", "function:main.py:main", "function:main.py:open_it")], "node_id string, event string, source string, target string")
    out = audit.run_audit(spark, tree, calls)
    assert out["stages"] == list(audit.STAGES) and out["summary"]["graph"]["IMPORT"] == 1 and out["summary"]["heat"]["hot"] >= 1
    assert set(out["verification"]["domains"]) == {"structural_integrity", "dependency_consistency", "topology_validation", "semantic_observations", "execution_confidence", "architectural_intent", "semantic_consistency", "causal_flow"}
    assert "runtime_call_events_below_threshold" in out["summary"]["runtime"]["issues"] and out["summary"]["runtime"]["executed"] == 1 and out["summary"]["heat"]["sane"]
    assert out["diagnostics"]["status"] in ("PASS", "DEGRADED", "FAIL") and out["system_valid"] is False
    from sparkwarden.plans import report

    final = report.final_report(out)
    assert set(final["audits"]) == {"structural", "behavioral", "redundancy_overlap", "architectural_quality"} and all(0 <= a["score"] <= 1 and a["findings"] for a in final["audits"].values())
    assert final["design_quality"]["authority"] == "multi_signal_intent_first" and len(final["answers"]) == 3 and final["summary"]["status"] == "FAILED"
    assert report.contract_health(out, audit.STAGES)["passed"] and not report.contract_health({"stages": ["manifest"]}, audit.STAGES)["passed"]
    leaves = lambda x: diagnose.json_leaves(spark.createDataFrame([(1, json.dumps(x))], "id long, json string"))
    a, b = leaves({"a": [1, 2, {"z": "t", "at": 1}], "b": 1, "d": {}, "e": [], "f": None}), leaves({"a": [1, 3, {"z": "t", "at": 2}], "c": 1, "d": {}, "e": [], "f": None})
    assert {r.path: (r.left, r.right) for r in diagnose.differences(a, b, ("at",)).collect()} == {"$['a'][1]": ("2", "3"), "$['b']": ("1", None), "$['c']": (None, "1")}
    assert sorted((r.path, r.value) for r in a.collect()) == [("$['a'][0]", "1"), ("$['a'][1]", "2"), ("$['a'][2]['at']", "1"), ("$['a'][2]['z']", '"t"'), ("$['b']", "1"), ("$['d']", "{}"), ("$['e']", "[]"), ("$['f']", "null")]
    assert set(audit.run_audit(spark, tree, mode="static-only")["summary"]) == {"manifest", "static"}
