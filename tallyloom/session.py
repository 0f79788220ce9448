"""A session with what the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tallyloom", checkpoints: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew joins, UTC, Arrow; `checkpoints` is a folder that all executors share,
    needed on a cluster, where files go that nothing refers to any more; `conf` (dots as __) overrides."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | ({"spark.checkpoint.dir": checkpoints} if checkpoints else {}) | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()
