"""The package on the executors: functions that run there are sent by name."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to all executors, once an application; none need it to be installed or on a path."""
    sc = spark.sparkContext
    home = Path(__file__).resolve().parents[1]
    if sc.applicationId in _shipped or not home.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="kinmatch-")) / "kinmatch-modules.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent).as_posix())
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
