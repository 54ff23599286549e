"""Sends this package to the executors, so that functions of its modules can run there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()

#: Rows of an Arrow batch at most: texts are long, and a batch is held by the JVM and by Python at a time.
ARROW_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Once for each application; Spark's own file server hands the archive to each executor.

    It also lowers the session's rows of an Arrow batch to ARROW_ROWS.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= ARROW_ROWS:
        spark.conf.set(rows, str(ARROW_ROWS))
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lectern-")) / "lectern.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(archive))
    _sent.add(app)
