"""docmill: document processing on Spark."""

from __future__ import annotations

import os
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)


def _with_root(paths: str | None) -> str:
    parts = [p for p in (paths or "").split(os.pathsep) if p]
    return os.pathsep.join(parts if ROOT in parts else [*parts, ROOT])


def on_workers(spark=None) -> None:
    """Let Python workers on this machine import this package, wherever the driver was started: for a session that is made later, and
    for the given or active one. On a cluster the package comes with --py-files or the image."""
    from pyspark import SparkContext

    os.environ["PYTHONPATH"] = _with_root(os.environ.get("PYTHONPATH"))
    context = spark.sparkContext if spark is not None else SparkContext._active_spark_context
    if context is not None:
        context.environment["PYTHONPATH"] = _with_root(context.environment.get("PYTHONPATH"))
