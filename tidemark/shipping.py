"""What a session needs before a query runs: the package on its executors, and Arrow batches of bounded bytes."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()
#: Bytes of a batch that goes to Python. Spark's own limit of 64 MiB costs each task several times that in both processes.
ARROW_LIMIT, ARROW_BYTES, SPARK_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20, ("67108864b", str(64 << 20), "64MB")


def ship(spark: SparkSession) -> None:
    """Send the package to the executors of this application, once, through Spark's own file server.

    A session whose limit of Arrow batches is still Spark's gets a smaller one; one that has set it keeps it.
    """
    if spark.conf.get(ARROW_LIMIT) in SPARK_DEFAULT:
        spark.conf.set(ARROW_LIMIT, str(ARROW_BYTES))
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # already running from a shipped archive
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-ship-"), "tidemark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _done.add(app)


def shipped(f):
    """A query f(spark, ...) that has the package shipped first."""

    @functools.wraps(f)
    def run(spark, *a, **k):
        ship(spark)
        return f(spark, *a, **k)

    return run
