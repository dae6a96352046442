"""Session settings used by the bench and the tests."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# AQE re-plans joins from the sizes it measures and splits skewed partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", app: str = "emberlog", **extra) -> SparkSession:
    """A local session with as many shuffle partitions as cores."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = dict(SETTINGS)
    settings["spark.sql.shuffle.partitions"] = "8" if cores == "*" else str(cores)
    settings["spark.driver.memory"] = "12g"
    settings.update(extra)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Applications that have the package, with the folder the driver serves it from until it ends.
_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run in workers refer to the package by name; a worker that starts in another
    folder or on another machine finds it in the shipped archive.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.TemporaryDirectory(prefix="emberlog-code-")
    archive = Path(folder.name, "emberlog_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped[app] = folder
