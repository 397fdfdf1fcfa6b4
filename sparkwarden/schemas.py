"""Schemas of traces and of the log of stages, as DDL."""

TRACE = "run_id string, seq long, entrypoint string, event string, timestamp string, module string, file string, function string, line int, depth int, caller string, node string, caller_node_id string, callee_node_id string"
STAGE_EVENTS = "stage string, status string, details string"
