"""Sessions: the settings that the engine expects, and its own modules on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings of a local session. On a cluster these come from its own configuration; the engine sets none of them there.
LOCAL = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8, name: str = "tessera") -> SparkSession:
    conf = LOCAL | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory}
    return SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application: they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return spark
    top = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="tessera-"), "tessera_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, os.path.join(top.name, path.relative_to(top)))
    context.addPyFile(str(archive))
    context._tessera_shipped = True
    return spark
