"""Sessions: settings that the queries rely on, and the package on executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings for reproducible results; sizes are left to the cluster.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}


def build(master: str | None = None, **settings: str) -> SparkSession:
    b = SparkSession.builder.config(map={**SETTINGS, **settings})
    return (b.master(master) if master else b).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each Spark context: Python
    workers import it, wherever they run."""
    sc = spark.sparkContext
    if not getattr(sc, "_corvane_shipped", False):
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="corvane-")  # of the driver, which serves the file to executors
        atexit.register(shutil.rmtree, folder, True)
        path = Path(folder) / "corvane.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(path))
        sc._corvane_shipped = True
    return spark
