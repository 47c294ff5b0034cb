"""Ships this package to the executors of a cluster that doesn't have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's Python path, once an application. Spark serves the file."""
    context = spark.sparkContext
    if context.applicationId in _shipped or not _PACKAGE.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="rillwork-")) / "rillwork-src.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, str(Path(_PACKAGE.name) / path.relative_to(_PACKAGE)))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
