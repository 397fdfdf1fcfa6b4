"""Constants of the current (v2) and the older (v1) scoring profile, as plain values."""

#: Weights and thresholds of heat.
HEAT_WEIGHTS = {"runtime": 0.6, "reachability": 0.25, "reference": 0.15}
HEAT_THRESHOLDS = {"HOT": 0.8, "WARM": 0.3, "COLD": 0.1}
DEAD_WEIGHTS = {"hits": 0.6, "executable": 0.3, "non_executable": 0.1}
MAX_DEAD_RATIO = 0.7
MAX_CONFIDENCE_WITHOUT_HEAT = 0.45
#: Codes of the runtime gate, in the order in which they are reported.
RUNTIME_ISSUES = (
    "synthetic_runtime_trace_not_allowed",
    "runtime_trace_contains_only_import_or_bootstrap_events",
    "runtime_call_events_below_threshold",
    "runtime_unique_callee_nodes_below_threshold",
    "runtime_call_depth_below_threshold",
    "runtime_local_call_count_below_threshold",
    "runtime_calls_exist_but_no_hits_mapped_to_graph_nodes",
    "runtime_coverage_ratio_below_threshold",
    "runtime_reachable_ratio_below_threshold",
    "runtime_static_call_overlap_is_zero",
    "manifest_entrypoints_not_observed_in_runtime",
    "runtime_identity_mapping_failed",
)
#: Issues of causal flow with their severities, in the order in which they are reported.
CAUSAL_ISSUES = {
    "NO_WORKFLOW_RECONSTRUCTION": "HIGH",
    "MISSING_API_BOUNDARY": "MEDIUM",
    "MISSING_DOMAIN_DECISION_STAGE": "MEDIUM",
    "MISSING_SIDE_EFFECT_OR_PERSISTENCE_STAGE": "MEDIUM",
    "DIRECT_API_TO_PERSISTENCE_PATH": "LOW",
}
#: Violation ratios from which the architecture issue is HIGH, MEDIUM.
VIOLATION_LEVELS = (("HIGH", 0.25), ("MEDIUM", 0.10))
#: Least figures of a runtime trace.
RUNTIME_MINIMA = {"call_events": 50, "unique_callees": 10, "call_depth": 3, "local_calls": 1, "coverage": 0.02, "reachable": 0.05}

#: Edge types of both profiles, sources of resolver edges, severities with rank and weight, sizes of samples.
ALLOWED_EDGE_TYPES = {"v2": ("CONFIG", "DI", "DYNAMIC", "IMPORT"), "v1": ("CALL", "CALLS", "CONFIG", "DI", "DYNAMIC", "HEURISTIC", "IMPORT", "IMPORTS", "INSTANTIATE", "INSTANTIATES", "USES")}
RESOLVER_SOURCES = ("AST", "CONFIG", "DI", "DYNAMIC", "HEURISTIC")
SEVERITY_RANK = {"HIGH": 0, "MEDIUM": 1, "LOW": 2, "INFO": 3}
SEVERITY_WEIGHT = {"HIGH": 1.0, "MEDIUM": 0.7, "LOW": 0.4, "INFO": 0.2}
SAMPLE_LIMIT = {"v2": 25, "v1": 50}

#: Weights and order of the verdict's domains.
DOMAIN_WEIGHTS = {"structural_integrity": 0.35, "topology_validation": 0.25, "dependency_consistency": 0.25, "semantic_observations": 0.15}
FAILURE_WEIGHTS = {
    "structural_integrity": 0.3,
    "topology_validation": 0.2,
    "dependency_consistency": 0.2,
    "architecture_drift": 0.2,
    "semantic_observations": 0.1,
    "execution_confidence": 0.2,
    "architectural_intent": 0.12,
    "semantic_consistency": 0.08,
    "causal_flow": 0.1,
}
DOMAIN_ORDER = {
    "structural_integrity": 1,
    "dependency_consistency": 2,
    "architecture_drift": 2,
    "topology_validation": 3,
    "semantic_observations": 4,
    "execution_confidence": 5,
    "architectural_intent": 6,
    "semantic_consistency": 7,
    "causal_flow": 8,
}
#: Least figures of a trace and a graph that mean something, and the greatest share of isolated nodes.
MEANINGFUL = {"modules": 5, "local_modules": 3, "functions": 20, "local_functions": 3, "max_depth": 3, "reachable_nodes": 0.15, "isolated_nodes": 0.35, "confirmed_edges": 0.01}
#: Thresholds of trust and of the scenario gate.
MIN_EXECUTION_CONFIDENCE = 0.3
MIN_AUTHORITY_TRUST = 0.55
COVERAGE_FLOOR, COVERAGE_MULTIPLIER = 0.3, 0.5
DIVERGENCE_LIMIT, DRIFT_PENALTY = 0.5, 0.2
MIN_ENTRYPOINT_COVERAGE, MIN_SCENARIO_COVERAGE, MIN_DOMAIN_COVERAGE = 0.3, 0.55, 0.34

#: Layers that a layer may use.
ALLOWED_LAYERS = {
    "api": ("api", "domain", "orchestration", "shared", "test", "unknown"),
    "orchestration": ("api", "domain", "infra", "orchestration", "shared", "test", "unknown"),
    "domain": ("domain", "shared", "test", "unknown"),
    "infra": ("domain", "infra", "shared", "test", "unknown"),
    "shared": ("api", "domain", "infra", "orchestration", "shared", "test", "unknown"),
    "test": ("api", "domain", "infra", "orchestration", "shared", "test", "unknown"),
    "unknown": ("api", "domain", "infra", "orchestration", "shared", "test", "unknown"),
}
#: Path segments that name a layer; the first layer in this order wins.
LAYER_SEGMENTS = {
    "test": ("test", "tests"),
    "orchestration": ("orchestrator", "orchestration", "workflow", "pipeline"),
    "infra": ("infra", "infrastructure", "adapter", "adapters", "integration", "gateway", "repository", "repositories", "storage", "db", "database", "sql", "cache", "runtime"),
    "api": ("api", "endpoint", "endpoints", "router", "routes", "controller", "presentation", "ui"),
    "domain": ("domain", "core", "model", "models", "policy_engine", "rules", "services"),
    "shared": ("common", "shared", "util", "utils"),
}
#: Segments, suffixes and packages that tell what a file is.
PERSISTENCE_SEGMENTS = ("repository", "repositories", "store", "storage", "db", "database", "sql", "cache")
PERSISTENCE_SUFFIXES = ("repository.py", "store.py", "storage.py", "db.py")
CONTRACT_SEGMENTS = ("contract", "contracts", "interface", "interfaces", "event", "events", "schema", "schemas")
GENERIC_SEGMENTS = ("apps", "archive", "config", "output", "scripts", "src", "state", "tests")
WEB_PACKAGES = ("fastapi", "flask", "starlette", "django", "sanic", "quart", "aiohttp")
CLI_PACKAGES = ("argparse", "click", "typer", "fire", "docopt", "cmd")
#: Categories whose best entrypoint is chosen first, in this order.
PREFERRED_CATEGORIES = ("explicit_config", "web_router", "main_guard", "manifest_entrypoint", "cli_definition", "filename_heuristic", "script_file")
#: Top folders below which the next one owns a file.
TWO_SEGMENT_OWNERS = ("apps", "src", "tests")

#: Substrings that name a role; the first role in this order wins.
ROLE_WORDS = {
    "persistence": ("repository", "store", "storage", "database", "sql", "cache", "idempotency"),
    "side_effect": ("adapter", "integration", "bridge", "publisher", "client", "queue", "event_log", "email", "calendar"),
    "orchestration": ("orchestrator", "workflow", "state_machine", "pipeline", "runtime_router"),
    "api": ("api", "endpoint", "router", "controller", "asgi", "http", "ui_bootstrap"),
    "validation": ("validate", "validation", "schema", "guard", "auth", "admission", "policy"),
    "domain_decision": ("domain", "decision", "engine", "planner", "rules", "service", "intent"),
}
#: Roles that a workflow is expected to have.
EXPECTED_ROLES = ("api", "validation", "orchestration", "domain_decision", "side_effect", "persistence")

#: Words that are no tokens, kinds of abstraction, and words that name a domain.
STOPWORDS = (
    "and", "base", "class", "core", "data", "edge", "edges", "false", "file", "for", "from", "function", "helper", "helpers", "init", "into", "item",
    "items", "main", "module", "node", "nodes", "none", "test", "tests", "that", "the", "this", "true", "util", "utils", "value", "values", "with",
)
ABSTRACTION_SUFFIXES = ("adapter", "builder", "controller", "engine", "gateway", "handler", "manager", "orchestrator", "repository", "router", "service", "store")
DOMAIN_KEYWORDS = {
    "auth": ("auth", "identity", "jwt", "session", "token"),
    "policy": ("compliance", "guard", "policy", "risk", "rules"),
    "runtime": ("event", "executor", "runtime", "scheduler", "trace"),
    "orchestration": ("orchestrator", "pipeline", "state", "transition", "workflow"),
    "integration": ("adapter", "bridge", "client", "integration", "provider"),
    "observability": ("alert", "diagnostic", "logging", "metrics", "telemetry"),
    "data": ("cache", "db", "repository", "sql", "storage", "store"),
}
#: Least shared tokens and likeness of similar files.
MIN_SHARED_TOKENS, MIN_JACCARD = 4, 0.45
#: Mean likeness from which a cluster overlaps highly, and from which one across contexts is a duplicated intent.
HIGH_OVERLAP, DUPLICATE_INTENT = 0.70, 0.55

#: Points of an entrypoint's categories.
CATEGORY_WEIGHTS = {
    "explicit_config": 220.0, "main_guard": 200.0, "manifest_entrypoint": 185.0, "web_router": 170.0,
    "cli_definition": 160.0, "filename_heuristic": 100.0, "script_file": 90.0, "test_file": 30.0,
}
#: Points for an entrypoint below a folder, besides those of its categories.
PATH_BONUS = {"apps/api/": 8.0, "scripts/": 4.0, "tests/": 1.0}
#: File names of entrypoints; folders and suffixes that a scan leaves out.
ENTRYPOINT_FILES = ("__main__.py", "main.py", "app.py", "cli.py", "run.py")
SKIP_DIRS = (".git", ".hg", ".idea", ".svn", ".tmp", ".venv", ".vscode", "__pycache__", "node_modules", "output", "state", "venv")
SKIP_SUFFIXES = (".7z", ".avi", ".class", ".dll", ".dylib", ".exe", ".gif", ".gz", ".ico", ".jar", ".jpeg", ".jpg", ".mov", ".mp3", ".mp4", ".pdb", ".pdf", ".png", ".so", ".tar", ".webp", ".zip")
