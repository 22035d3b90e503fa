"""Session helpers: a tuned local session and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: dict[str, str] = {}
_SCOPES: list[list[str]] = []


def local_session(app: str = "plumbline", cpus: int | str = "*", shuffle: int = 8) -> SparkSession:
    """Session used by tests and the benchmark. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PLUMBLINE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local folder would vanish with its executor, so there the
    setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIR:
        _LOCAL_DIR[app] = tempfile.mkdtemp(prefix="plumbline-")
    return _LOCAL_DIR[app]


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to a parquet table in the shared folder and read it back.

    For narrow tables (ids, scores, labels) that several passes read: the text
    scan behind them then runs once, later passes prune columns and push
    filters into parquet, and a lost executor never forces the scan again.
    """
    spark = df.sparkSession
    path = f"{_stored_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    for scope in _SCOPES:
        scope.append(path)
    return spark.read.parquet(path)


def _stored_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/plumbline/{spark.sparkContext.applicationId}/stored"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def remove_stored(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. Frames that read them must be done."""
    remove(spark, _stored_dir(spark))


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """A scope whose stored tables are deleted at its end; write or collect results inside it."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            remove(spark, path)


PIN_ROWS = 100_000


def pin(df: DataFrame) -> DataFrame:
    """Evaluate a small lookup once and hold it as a local relation.

    Used for tables with a few rows per stratum (cut points, quotas). Spark then
    knows the exact size and its own threshold decides on broadcasting. The size
    is checked: anything larger than ``PIN_ROWS`` is written as a table instead
    and joins by shuffle, to the same result.
    """
    rows = df.limit(PIN_ROWS + 1).toArrow()
    if rows.num_rows > PIN_ROWS:
        return settle(df)
    return df.sparkSession.createDataFrame(rows, schema=df.schema)
