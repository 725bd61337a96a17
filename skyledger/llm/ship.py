"""Send this package to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import skyledger

_shipped: dict[str, str] = {}
BATCH_ROWS = 1000  # an Arrow batch is held whole by the executor and by its Python worker, and its rows are texts


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application, and bound the session's Arrow batches.

    Spark's own file server hands the archive to every executor, so workers
    import the operators wherever the job was started from.
    """
    sc, rows = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(skyledger.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="skyledger-ship-"), "skyledger.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("skyledger", os.path.relpath(path, root)))
    sc.addPyFile(target)
    _shipped[sc.applicationId] = target
