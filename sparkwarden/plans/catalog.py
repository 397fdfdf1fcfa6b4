"""Stored stages of a run: tables, commit markers with the digest of their inputs, a log.

A stage's tables are Parquet folders below the catalog's root, which every executor reaches; its
marker, a JSON document, is written when all of them are.  A run that finds a marker with the
digest of the inputs it has reads the stage back instead of doing it again, so a run that was
stopped, or whose later inputs changed, goes on at the first stage that has to be done.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import STAGE_EVENTS
from ..sources import scan

#: Goes into every digest: stages that are done otherwise than before are done again.
VERSION = "1"
LOG = "events"

Work = Callable[[], tuple[dict[str, DataFrame], dict | Callable[[dict[str, DataFrame]], dict]]]


class StageFailed(RuntimeError):
    """A stage that ended with an error; stage names it, the error is the cause."""

    def __init__(self, stage: str, error: BaseException):
        super().__init__(f"{stage}: {error}")
        self.stage = stage


def digest(*parts) -> str:
    """Of anything that JSON can write."""
    return hashlib.sha256(json.dumps([VERSION, *parts], sort_keys=True, default=str).encode()).hexdigest()


def table_digest(rows: DataFrame | None) -> str:
    """Of a table's rows in any order, by sums of two hashes a row; empty without a table."""
    if rows is None:
        return ""
    columns = [F.col(f"`{c}`") for c in sorted(rows.columns)]
    total = lambda salt: F.coalesce(F.sum(F.xxhash64(F.lit(salt), *columns).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return digest(sorted(rows.dtypes), *rows.agg(F.count("*"), total(1), total(2)).first())


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def marker(self, stage: str) -> dict | None:
        """What was committed of a stage: inputs, tables (name to path), summary; None without."""
        path = self._path(stage, "committed")
        # The writer's own sign that the document is whole.
        if not self._exists(f"{path}/_SUCCESS"):
            return None
        rows = self.spark.read.option("wholetext", True).text(path).collect()
        return json.loads(rows[0]["value"]) if rows else None

    def _commit(self, stage: str, mark: dict) -> None:
        text = json.dumps(mark, sort_keys=True, default=str)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(self._path(stage, "committed"))

    def log(self, stage: str, status: str, **details) -> None:
        scan.log_stage(self.spark, self._path(LOG), stage, status, **details)

    def events(self) -> DataFrame:
        """stage, status, details (JSON) of all runs so far."""
        return self.spark.read.schema(STAGE_EVENTS).json(self._path(LOG))

    def tables(self, mark: dict) -> dict[str, DataFrame]:
        return {name: self.spark.read.parquet(path) for name, path in mark["tables"].items()}

    def stored(self, stage: str) -> tuple[dict[str, DataFrame], dict]:
        """A committed stage's tables and summary; an error where there is none."""
        mark = self.marker(stage)
        if mark is None:
            raise FileNotFoundError(f"no committed stage {stage} in {self.root}")
        return self.tables(mark), mark["summary"]

    def stage(self, name: str, inputs: str, work: Work) -> tuple[dict[str, DataFrame], dict]:
        """The stage's tables and summary: read back if it was committed with these inputs, else
        worked out, written and committed.  work returns the frames to write, and the summary: a
        dictionary, or a function that makes it of the written tables."""
        mark = self.marker(name)
        if mark and mark["inputs"] == inputs:
            self.log(name, "reused", inputs=inputs)
            return self.tables(mark), mark["summary"]
        self.log(name, "started", inputs=inputs)
        try:
            frames, summary = work()
            # A folder of its own for each attempt: nothing reads a half-written one.
            paths = {t: self._path(name, uuid.uuid4().hex, t) for t in frames}
            for t, frame in frames.items():
                frame.write.parquet(paths[t])
            tables = {t: self.spark.read.schema(frames[t].schema).parquet(p) for t, p in paths.items()}
            summary = summary(tables) if callable(summary) else summary
        except Exception as e:
            self.log(name, "failed", error=type(e).__name__, message=str(e)[:500])
            raise StageFailed(name, e) from e
        self._commit(name, {"inputs": inputs, "tables": paths, "summary": summary})
        self.log(name, "finished", inputs=inputs)
        # As a later run would read it back.
        return tables, json.loads(json.dumps(summary, default=str))
