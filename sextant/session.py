"""Session defaults, and shipping of this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: mapKeyDedupPolicy: later keys of a marker win. UTC: epoch arithmetic must not depend on the host.
DEFAULTS = {"spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}

#: Python operators get batches of about this size, however long the texts.
ARROW_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")

_SHIPPED: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that the operators rely on."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once for each application, so that Python operators can be imported there."""
    spark.conf.set(*ARROW_BYTES)
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="sextant-")) / "sextant.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*")):
                if f.is_file() and f.suffix != ".pyc":
                    z.write(f, Path(root.name) / f.relative_to(root))
        spark.sparkContext.addPyFile(str(path))
        _SHIPPED.add(app)
    return spark
