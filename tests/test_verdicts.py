"""Causes, their chain and actions; the older profile; ids; summaries of runs."""

import random

import pytest

from sparkwarden.functions import columns as C
from sparkwarden.operators import resolve, sequence, traces
from sparkwarden.plans import diagnose, legacy
from sparkwarden.plans.verdict import issue


def verdict(issues, scores=None, hard=(), failures=()):
    domains = {d: {"score": s, "metrics": {}, "warnings": []} for d, s in (scores or dict.fromkeys(diagnose.HEALTH, 1.0)).items()}
    return {"domains": domains, "issues": issues, "policy": {"hard": list(hard)}, "failures": list(failures)}


def test_causes_are_ranked_with_path_and_action(spark):
    nodes = [f"canonical://file/{x}.py" for x in "abcd"]
    edges = spark.createDataFrame([(nodes[0], nodes[1]), (nodes[0], nodes[2]), (nodes[1], nodes[2]), (nodes[0], nodes[3])], "source string, target string")
    issues = [
        issue("topology_validation", "UNREACHABLE_NODES", "MEDIUM", "lost", 8, nodes[2:]),
        issue("topology_validation", "UNREACHABLE_NODES", "HIGH", " Lost", 2, nodes[:1]),
        issue("dependency_consistency", "MISSING_DI_NODES", "HIGH", "gone", 1, []),
        issue("causal_flow", "NEW_KIND", "LOW", "odd", 40, ["elsewhere"]),
    ]
    out = diagnose.diagnose(spark, verdict(issues, failures=[{"domain": "topology_validation", "impact": 0.4}]), edges)
    got = {c["type"]: c for c in out["root_causes"]}
    # Worst severity and share of impact; mean degree of c, d, a over the most; 10 of at most 40.
    lost = got["UNREACHABLE_NODES"]
    assert lost["count"] == 10 and lost["nodes"] == [*nodes[2:], nodes[0]] and lost["kind"] == "REACHABILITY"
    central = round((2 / 3 + 1 / 3 + 3 / 3) / 3, 3)
    assert lost["severity"] == round(1.0 * 0.5 + central * 0.3 + 0.25 * 0.2, 3)
    assert lost["confidence"] == round(lost["severity"] * 0.65 + min(1, 0.3 + 10 / 40) * 0.35, 3)
    assert got["MISSING_DI_NODES"]["severity"] == round(0.5 + 0.3 * 0.3 + 0.2 * round(1 / 40, 3), 3)
    assert got["NEW_KIND"]["severity"] == round(0.4 * 0.5 + 0 + 0.2, 3) and got["NEW_KIND"]["action"] is None and got["NEW_KIND"]["kind"] == "PROCESS"
    assert [c["id"] for c in out["root_causes"]] == ["rc-01-unreachable_nodes", "rc-02-missing_di_nodes", "rc-03-new_kind"]
    assert got["MISSING_DI_NODES"]["path"][0] == "AST extraction" and lost["path"][0] == "Resolver consistency" and lost["path"][-1] == "Validation failure"
    assert out["recommended_actions"] == [diagnose.ACTIONS["UNREACHABLE_NODES"], diagnose.ACTIONS["MISSING_DI_NODES"]]
    chain = out["causal_chain"]
    assert [s["step"] for s in chain] == [1, 2, 3, 4, 5] and "UNREACHABLE_NODES" in chain[-1]["cause"] and chain[-1]["effect"] == f"verdict {out['status']}"
    assert out["failure_domains"] == ["reachability", "resolver", "process"] and out["stability"] == "FRAGILE" and out["status"] == "DEGRADED"
    assert [t["severity"] for t in out["top_issues"]] == [diagnose.level(c["severity"]) for c in out["root_causes"]]


def test_diagnostics_without_issues(spark):
    edges = spark.createDataFrame([], "source string, target string")
    fine = diagnose.diagnose(spark, verdict([]), edges)
    assert (fine["status"], fine["stability"], fine["causal_chain"], fine["primary"], fine["confidence"]) == ("PASS", "STABLE", [], "none", 0.85)
    hard = diagnose.diagnose(spark, verdict([], hard=["x"]), edges)
    assert hard["status"] == "FAIL" and hard["stability"] == "DEGRADED" and len(hard["causal_chain"]) == 1 and len(hard["recommended_actions"]) == 1
    broken = diagnose.diagnose(spark, verdict([issue("structural_integrity", "MALFORMED_NODE_ID", "HIGH", "m", 3, ["a"])]), spark.createDataFrame([("a", "a")], "source string, target string"))
    assert broken["status"] == "FAIL" and broken["stability"] == "BROKEN"


def brute_v1(nodes, edges, resolver, starts, isolated, allowed):
    ids = sorted({n.strip() for n, *_ in nodes if n.strip()})
    kinds = legacy.P.ALLOWED_EDGE_TYPES["v1"]
    valid, bad = [], 0
    for s, t, k, o in edges:
        s, t, k = (s or "").strip(), (t or "").strip(), (k or "").strip().upper()
        if s and t and k in kinds and s in ids and t in ids:
            valid.append((s, t, k))
        else:
            bad += 1
    out = {i: {b for a, b, _ in valid if a == i} for i in ids}
    seen = {x for x in starts if x in ids}
    while (more := {b for a in seen for b in out[a]} - seen):
        seen |= more
    alive = set(ids)
    while (left := {b for a in alive for b in out[a] if b in alive}) != alive:
        alive &= left
    islands = dict.fromkeys(("isolated_module", "cyclic_island", "orphan_subgraph"), 0)
    todo = set(ids)
    while todo:
        part = {todo.pop()}
        while (more := {b for a in part for b in ids if b in out[a] or a in out[b]} - part):
            part |= more
        todo -= part
        if not part & seen:
            islands["isolated_module" if part <= isolated else "cyclic_island" if part & alive else "orphan_subgraph"] += 1
    lost = set(ids) - seen
    di = [(a, b) for a, b, k in valid if k == "DI"]
    return {
        "valid_nodes": len(ids), "malformed": sum(not n.strip() for n, *_ in nodes), "duplicates": sum(bool(n.strip()) for n, *_ in nodes) - len(ids), "valid_edges": len(valid), "bad": bad, "reachable": len(seen), "unreachable": len(lost),
        "di_edges": len(di), "di_unreachable": sum(a in lost or b in lost for a, b in di), "cycle_nodes": len(alive), "cycle_violations": len(alive - allowed), "missing_entrypoints": len(set(starts) - set(ids)), **islands,
    }


@pytest.mark.parametrize("seed", range(3))
def test_older_profile_against_brute_force(spark, seed):
    r = random.Random(seed)
    ids = [f"canonical://file/{i}" for i in range(16)]
    isolated, allowed = set(r.sample(ids, 5)), set(r.sample(ids, 4))
    nodes = [(i, i in isolated, i in allowed) for i in ids] + [(" ", False, False), (f" {ids[0]}", False, False)]
    edges = [(r.choice(ids), r.choice([*ids, "gone"]), r.choice(["import", " DI", "CALL", "", "ODD"]), "AST") for _ in range(22)]
    resolver = [(r.choice(ids), r.choice([*ids, "gone"]), r.choice(["AST", "DI", "x"])) for _ in range(12)]
    starts = [ids[0], ids[1], "nowhere"]
    got = legacy.verify_v1(
        spark.createDataFrame(nodes, "node_id string, isolated boolean, cycle_allowed boolean"), spark.createDataFrame(edges, "source string, target string, type string, origin string"),
        spark.createDataFrame(resolver, "source string, target string, origin string"), spark.createDataFrame([(s,) for s in starts], "node_id string"),
    )
    f, want = got["figures"], brute_v1(nodes, edges, resolver, starts, isolated, allowed)
    assert {k: f[k] for k in want if k != "bad"} == {k: v for k, v in want.items() if k != "bad"}
    assert f["malformed_edges"] + f["invalid_type_edges"] + f["unresolved_edges"] == want["bad"]
    kinds = {i["type"]: i for i in got["issues"]}
    assert kinds["UNREACHABLE_NODES"]["count"] == want["unreachable"] if want["unreachable"] else "UNREACHABLE_NODES" not in kinds
    assert kinds["MISSING_ENTRYPOINTS"]["sample"] == ["nowhere"] and kinds["INVALID_EDGES"]["count"] == want["bad"]
    assert got["system_valid"] == (not got["policy"]["hard"] and got["trust"]["trust_score"] >= 0.4)


def test_older_trust():
    zero = dict.fromkeys(("malformed_edges", "unresolved_edges", "invalid_type_edges", "malformed", "duplicates", "unreachable", "di_unreachable", "missing_di", "orphan_subgraph_nodes", "cycle_violations"), 0)
    sizes = {"valid_edges": 10, "valid_nodes": 10, "di_edges": 4, "di_nodes": 4, "divergence": 0.0}
    assert legacy.trust(zero | sizes)["trust_score"] == 1.0
    t = legacy.trust(zero | sizes | {"unreachable": 5, "missing_di": 1, "divergence": 0.4, "cycle_violations": 20})
    assert t["penalties"] == {"structural": 0.0, "reachability": 0.15, "resolver": 0.162, "semantic": 0.1, "total": 0.412} or t["penalties"]["resolver"] in (0.162, 0.163)
    assert t["scores"]["structural_integrity"] == 1.0 and t["scores"]["semantic_observations"] == 0.5


IDS = [
    ("file:./a\\b.py", "file:a/b.py", ""), (" Function : a/b.py : run ", "function:a/b.py:run", ""), ("canonical://CLASS/a/b.py/ C ", "canonical://class/a/b.py/C", ""), ("class:a.py", "", "no_name"), ("canonical://function/run", "", "no_name"),
    ("canonical://file", "", "no_kind"), ("service:x", "", "unknown_kind"), ("plain", "", "no_kind"), ("  ", "", "blank"), (None, "", "blank"), ("file:", "", "no_path"), ("file:./", "", "no_path"), ("function:a:b.py:f", "function:a:b.py:f", ""), ("function::f", "", "no_path"),
]


def test_ids_come_with_their_reason(spark):
    df = spark.createDataFrame([(x,) for x, *_ in IDS], "x string")
    assert [tuple(r.n) for r in df.select(C.normalized_id(df.x).alias("n")).collect()] == [(i, why) for _, i, why in IDS]


def test_run_summary_of_nothing(spark):
    empty = lambda s: spark.createDataFrame([], s)
    row = traces.run_summary(empty("run_id long, event string, node_id string"), empty("run_id long, origin string, executed boolean, timed_out boolean, exit_code int"), empty("node_id string"), empty("node_id string")).first()
    assert row.runs == row.call_events == row.hit_nodes == 0 and row.coverage == 0.0 and row.warnings == ["no_runs"]


def test_last_module_wins(spark):
    names = spark.createDataFrame([(1, "a.b.c")], "id long, name string")
    index = spark.createDataFrame([("a.b", "z.py", 1), ("a.b", "m.py", 2), ("a", "q.py", 9)], "module string, path string, seq long")
    assert resolve.longest_prefix(names, index).first().path == "m.py" and resolve.longest_prefix(names, index.drop("seq")).first().path == "z.py"


def test_narrative_and_flow_roles(spark):
    steps = spark.createDataFrame([("r", 0, "api"), ("r", 1, "domain_decision"), ("r", 2, "other")], "run_id string, seq long, role string")
    assert sequence.workflows(steps).first().narrative == "API boundary -> domain decision -> other"
    flow = spark.createDataFrame([("app/api.py", "db/store.py", "RUNTIME_CALL"), ("app/api.py", "db/store.py", None), ("app/api.py", "db/store.py", "IMPORT")], "source string, target string, type string")
    assert {(r.from_role, r.to_role): r.n for r in sequence.transitions(steps, flow).collect()} == {("api", "domain_decision"): 1, ("domain_decision", "other"): 1, ("api", "persistence"): 2}


def test_contracts_are_compared():
    one = {"summary": {"runtime": {"hit_nodes": 2, "nodes": 10, "shared_edges": 1, "static_edges": 4}, "heat": {"hot": 1, "warm": 1}}}
    two = {"summary": {"runtime": {"hit_nodes": 3, "nodes": 10, "shared_edges": 2, "static_edges": 4}, "heat": {"hot": 2, "warm": 1}}}
    assert diagnose.compared(one, two)["score"] == 1.0 and diagnose.compared(two, two) | {"before": 0, "after": 0} == {"before": 0, "after": 0, "regressions": ["coverage_did_not_improve", "overlap_did_not_improve", "hot_and_warm_did_not_improve"], "score": 0.0}
