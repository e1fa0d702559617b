"""Give executors the package, where it is not installed on them."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application once, like ``--py-files`` does."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    _shipped.add(application)
    path = Path(tempfile.mkdtemp(prefix="spark-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(path))
