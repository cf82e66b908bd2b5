"""Hands this package to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession

#: Rows of an Arrow batch, unless the session or the cluster says otherwise: texts are long, and a batch is held by the
#: executor's JVM and by its Python worker at the same time.
BATCH_ROWS = "2000"
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

_lock = threading.Lock()
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the application's Python files, once for each application."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH_SETTING) == "10000" and sc.getConf().get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, BATCH_ROWS)
    with _lock:
        if sc.applicationId not in _shipped:
            top = os.path.dirname(os.path.abspath(__file__))
            path = os.path.join(tempfile.mkdtemp(prefix="vigilspark-"), "vigilspark.zip")
            with zipfile.ZipFile(path, "w") as z:
                for folder, _, names in os.walk(top):
                    for name in names:
                        if name.endswith(".py"):
                            whole = os.path.join(folder, name)
                            z.write(whole, os.path.join("vigilspark", os.path.relpath(whole, top)))
            sc.addPyFile(path)
            _shipped.add(sc.applicationId)
    return spark
