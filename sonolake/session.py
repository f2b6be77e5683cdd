"""Sessions, and making the package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "sonolake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and, where the environment names an endpoint, S3A access."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"} | conf
    if endpoint := os.environ.get("S3_ENDPOINT"):
        settings |= {
            "spark.hadoop.fs.s3a.endpoint": endpoint, "spark.hadoop.fs.s3a.path.style.access": "true",
            "spark.hadoop.fs.s3a.access.key": os.environ.get("S3_ACCESS_KEY", ""), "spark.hadoop.fs.s3a.secret.key": os.environ.get("S3_SECRET_KEY", ""),
        }
    return builder.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_sonolake_sent", None) == sc.applicationId:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="sonolake-")) / "sonolake.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(target))
    sc._sonolake_sent = sc.applicationId
