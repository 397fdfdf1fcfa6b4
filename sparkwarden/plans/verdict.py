"""What the verdict's domains are made of."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .. import profiles as P


@dataclass
class Domain:
    name: str
    score: float
    metrics: dict
    issues: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def issue(domain: str, kind: str, severity: str, message: str, count: int, nodes: list | None = None) -> dict:
    return {"domain": domain, "type": kind, "severity": severity, "message": message, "count": int(count), "sample": (nodes or [])[: P.SAMPLE_LIMIT["v2"]]}


def sample(rows: DataFrame, column: str) -> list:
    """The first different values, as many as an issue shows."""
    return [r[0] for r in rows.select(column).distinct().orderBy(column).limit(P.SAMPLE_LIMIT["v2"]).collect()]
