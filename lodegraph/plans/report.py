"""Run artifacts: a manifest that refuses degraded runs, and a Markdown report of metrics by arm."""

from __future__ import annotations

import hashlib
import json
import platform

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(spark: SparkSession, name: str, config: dict, counts: dict[str, int], degraded: list[str] | None = None) -> dict:
    """What a run was: its configuration's digest, its counts and platform. A degraded run has no manifest."""
    if degraded:
        raise ValueError("degraded run: " + ", ".join(degraded))
    if not counts or any(v <= 0 for v in counts.values()):
        raise ValueError("a run without rows has no manifest")
    digest = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()
    return {"name": name, "config": config, "config_sha256": digest, "counts": counts, "python": platform.python_version(), "spark": spark.version}


def write_artifact(payload: DataFrame, described: dict, path: str) -> None:
    """The payload as JSON lines and its manifest beside it."""
    payload.write.mode("overwrite").json(f"{path}/payload")
    payload.sparkSession.createDataFrame([(json.dumps(described, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def markdown(results: DataFrame, arm: str, metrics: list[str]) -> str:
    """A table of mean metrics by arm; n/a where an arm has none. Only a row for each arm is collected."""
    rows = results.groupBy(arm).agg(*[F.avg(m).alias(m) for m in metrics]).orderBy(arm).collect()
    cell = lambda v: "n/a" if v is None else f"{v:.3f}"
    lines = ["| " + " | ".join([arm, *metrics]) + " |", "|" + "---|" * (len(metrics) + 1)]
    return "\n".join(lines + ["| " + " | ".join([str(r[arm]), *[cell(r[m]) for m in metrics]]) + " |" for r in rows])
