"""Send this package to the executors of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's Python files, once an application.

    Workers then import it wherever they run, also without a PYTHONPATH. Where the session
    leaves the rows of an Arrow batch at their default of 10000, they become 2000: rows hold
    whole texts here, and a worker holds a batch or two.
    """
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, "2000")
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="locusmill-")) / "locusmill_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(top.rglob("*.py")):
            z.write(path, path.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
