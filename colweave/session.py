"""Session settings and the one way lineage is cut: a table written to shared storage."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Row bound per group under which a plain window or an exact built-in
# percentile over the group is known to fit in one task.
GROUP_ROW_LIMIT = 1_000_000
# What goes to a Python worker at once; 10,000 long rows would be held several times over, by it and by its executor.
BATCH_BYTES = "2m"

# Bytes of files that a task reads at least, however small the splits are, unless cores would be idle.
TASK_BYTES = 8 * 1024 * 1024

_local_roots: dict[str, str] = {}
_shipped: set[str] = set()
_first = threading.Lock()


def build_session(app: str = "colweave", cores: str = "*", shuffle_partitions: int = 8,
                  **conf: str) -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_batches(spark: SparkSession) -> None:
    """From now on rows reach the Python workers of ``spark`` in batches of about ``BATCH_BYTES``, a longer row alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would lose data with its executor.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    with _first:
        if sc.applicationId not in _local_roots:
            _local_roots[sc.applicationId] = tempfile.mkdtemp(prefix="colweave-")
    return _local_roots[sc.applicationId]


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, survives executor loss, and gives the optimizer the table's
    true size: a join against it is broadcast only when it is below
    ``spark.sql.autoBroadcastJoinThreshold`` and is a shuffle join beyond.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/colweave/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(calls: list[Callable[[], Any]], most: int = 4) -> list:
    """The results of independent calls in their order, run by up to ``most`` threads; many small jobs leave cores idle."""
    if len(calls) < 2:
        return [call() for call in calls]
    with ThreadPoolExecutor(most) as pool:
        running = [pool.submit(inheritable_thread_target(call)) for call in calls]
        try:
            return [run.result() for run in running]
        except BaseException:
            for run in running:
                run.cancel()
            raise


def few_tasks(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """``df`` over files, with small splits read one after the other by a task; a split's rows stay together.

    Its files are those of ``source``, a plain read, or its own.
    """
    size = int(str((source or df)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))


def max_group_rows(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group: one aggregate, one number to the driver."""
    top = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return int(top or 0)


def ready_workers(df: DataFrame) -> DataFrame:
    """``df``, after its Python workers were given this package (once per application)."""
    sc = df.sparkSession.sparkContext
    with _first:
        if sc.applicationId not in _shipped:
            package = os.path.dirname(os.path.abspath(__file__))
            target = os.path.join(tempfile.mkdtemp(prefix="colweave-"), "colweave.zip")
            with zipfile.ZipFile(target, "w") as archive:
                for folder, _, names in os.walk(package):
                    for name in sorted(n for n in names if n.endswith(".py")):
                        path = os.path.join(folder, name)
                        archive.write(path, os.path.relpath(path, os.path.dirname(package)))
            sc.addPyFile(target)
            _shipped.add(sc.applicationId)
    return df
