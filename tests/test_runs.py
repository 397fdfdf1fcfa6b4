"""Runs that are stopped and go on: stored stages, commands over them, a stream with state."""

import json
import random

import pytest

from sparkwarden import cli
from sparkwarden.operators import sequence
from sparkwarden.plans import audit, build_graph, catalog
from sparkwarden.streaming import trace

SOURCES = {"main.py": "import pkg.b\nfrom pkg.b import run\n\ndef main():\n    run()\n\nif __name__ == '__main__':\n    main()\n", "pkg/__init__.py": "", "pkg/b.py": "def run():\n    return helper()\n\ndef helper():\n    return 1\n"}


@pytest.fixture
def tree(tmp_path):
    for name, text in SOURCES.items():
        at = tmp_path / "tree" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return tmp_path / "tree"


def statuses(store):
    out = {}
    for r in store.events().collect():
        out.setdefault(r.stage, []).append(r.status)
    return {k: sorted(v) for k, v in out.items()}


def test_a_stopped_audit_goes_on(spark, tree, tmp_path, monkeypatch, capsys):
    folder = f"file://{tmp_path}/artifacts"
    store = catalog.Catalog(spark, folder)
    calls = spark.createDataFrame([("r", i, "call", f"function:{n}") for i, n in enumerate(["main.py:main", "pkg/b.py:run"])], "run_id string, seq long, event string, node_id string")

    def killed(*_):
        raise MemoryError("lost")

    monkeypatch.setattr(build_graph, "build_graph", killed)
    with pytest.raises(catalog.StageFailed) as e:
        audit.run_audit(spark, str(tree), calls, artifacts=folder)
    assert e.value.stage == "graph" and store.marker("graph") is None
    monkeypatch.undo()
    first = audit.run_audit(spark, str(tree), calls, artifacts=folder)
    assert statuses(store) == {"manifest": ["finished", "reused", "started"], "static": ["finished", "reused", "started"], "graph": ["failed", "finished", "started", "started"]} | {k: ["finished", "started"] for k in ("heat", "verification", "diagnostics")}
    again = audit.run_audit(spark, str(tree), calls, artifacts=folder)
    assert again == first and all(v[-1] != "failed" and "reused" in v for v in statuses(store).values())
    # Another trust only judges anew; another file does all anew.
    before = statuses(store)
    audit.run_audit(spark, str(tree), calls, min_trust=0.99, artifacts=folder)
    assert {k for k, v in statuses(store).items() if v.count("started") > before[k].count("started")} == {"verification", "diagnostics"}
    (tree / "pkg" / "b.py").write_text(SOURCES["pkg/b.py"] + "def more():\n    return run()\n")
    before = statuses(store)
    changed = audit.run_audit(spark, str(tree), calls, artifacts=folder)
    assert all(v.count("started") > before[k].count("started") for k, v in statuses(store).items())
    assert changed["summary"]["static"]["functions"] == first["summary"]["static"]["functions"] + 1

    def run(*args):
        code = cli.main([*args])
        return code, json.loads(capsys.readouterr().out.splitlines()[-1])

    plain = audit.run_audit(spark, str(tree), calls, artifacts=folder)
    code, found = run("diagnose", folder)
    assert code == 0 and found == json.loads(json.dumps(plain["diagnostics"]))
    code, found = run("judge", folder)
    assert code == 0 and found["trust"] == plain["verification"]["trust"] and found["issues"] == plain["verification"]["issues"]
    code, found = run("classify", folder)
    assert code == 0 and found["runtime"]["calls"] == 0 and sum(found["heat"][k] for k in ("hot", "warm", "cold", "dead")) == plain["summary"]["graph"]["nodes"]
    code, found = run("authority", folder, "--entrypoint", "canonical://file/main.py", "--output", f"file://{tmp_path}/decision")
    assert code == int(not found["authority_valid"]) and found["entrypoints_used"] == ["canonical://file/main.py"]
    assert json.loads(spark.read.text(f"file://{tmp_path}/decision").first()[0]) == found
    code, found = run("authority", folder)
    assert code == 2 and found["error"] == "ValueError"
    code, found = run("diagnose", f"file://{tmp_path}/nothing")
    assert code == 2 and found["error"] == "FileNotFoundError" and found["stage"] is None


def test_commands_over_documents(spark, tmp_path, capsys):
    ids = [f"canonical://file/{x}.py" for x in "abc"]
    graph = {"graph": {"nodes": [{"id": i} for i in ids] + [{"id": "canonical://file/lone.py", "isolated": True}], "edges": [{"from": ids[0], "to": ids[1], "type": "IMPORT", "confidence": 1.0}, {"source": ids[1], "target": ids[2], "type": "DI"}]}}
    (tmp_path / "graph.json").write_text(json.dumps(graph))
    (tmp_path / "resolver.json").write_text(json.dumps({"edges": [{"from": ids[0], "to": ids[1], "origin": "AST"}, {"source": ids[1], "target": ids[2], "type": "DI"}]}))
    at = [f"file://{tmp_path}/graph.json", f"file://{tmp_path}/resolver.json", "--entrypoint", ids[0]]
    assert cli.main(["validate", *at]) == 0
    result = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert result["domains"]["structural_integrity"]["metrics"]["valid_nodes"] == 4 and [i["sample"] for i in result["issues"] if i["type"] == "UNREACHABLE_NODES"] == [["canonical://file/lone.py"]]
    assert cli.main(["analyze", *at, "--fail-on-invalid"]) == int(not result["system_valid"])
    out = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert out["trust"] == result["trust"] and set(out["validation"]) == {"hard", "system_valid"} and out["summary"]["status"] == out["diagnostics"]["status"]


def test_table_digests(spark):
    rows = [(i, f"x{i}", [i]) for i in range(50)]
    d = lambda x: catalog.table_digest(spark.createDataFrame(x, "a long, b string, c array<long>"))
    assert d(rows) == d(rows[::-1]) != d(rows[1:]) and d(rows[:1] * 2) != d(rows[:1]) and d([]) != d(rows) and catalog.table_digest(None) == ""


def test_call_depth_of_shuffled_batches_and_a_restart(spark, tmp_path):
    r = random.Random(3)
    rows = []
    for run in ("r1", "r2", "r3"):
        for i in range(40):
            rows.append({"run_id": run, "seq": i, "event": r.choice(["call", "call", "return"]), "callee_node_id": r.choice("abc"), "timestamp": f"2024-01-01T00:{i // 5:02d}:{10 * (i % 5):02d}Z"})
    last = {"run_id": "end", "seq": 0, "event": "call", "callee_node_id": "z", "timestamp": "2024-01-01T03:00:00Z"}
    batch = spark.createDataFrame([(x["run_id"], x["seq"], x["event"], x["callee_node_id"]) for x in rows], "run_id string, seq long, event string, node_id string")
    want = sorted(tuple(x) for x in sequence.call_stacks(batch).collect())
    r.shuffle(rows)
    (tmp_path / "in").mkdir()

    def feed(part, name):
        (tmp_path / "in" / f"{name}.jsonl").write_text("\n".join(json.dumps(x) for x in part))

    def drain():
        q = trace.call_depth(trace.read_trace(spark, f"file://{tmp_path}/in", 1)).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None

    for k in range(0, 60, 20):
        feed(rows[k : k + 20], k)
    drain()
    for k in range(60, 120, 30):
        feed(rows[k : k + 30], k)
    drain()
    feed([last], "last")
    drain()
    got = spark.read.parquet(f"file://{tmp_path}/out").where("run_id <> 'end'").collect()
    assert sorted((x.run_id, x.seq, x.node_id, x.depth) for x in got) == want
