"""Sessions: defaults for local use, and sending the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def session(name: str = "turnstone", cores: str = "*", memory: str = "8g") -> SparkSession:
    """A local session; on a cluster the session comes from outside."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", "8"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def send(spark: SparkSession) -> SparkSession:
    """Give executors this package, once for each application; Spark's file server carries it."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        top = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="turnstone")) / "turnstone_package.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, f"turnstone/{p.relative_to(top)}")
        spark.sparkContext.addPyFile(str(target))
        _sent.add(app)
    return spark
