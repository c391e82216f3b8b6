"""Session helpers: settings, and durable cuts of a plan in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import math
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


FILE_ROWS = 50_000
#: By thread: the lists of paths of the blocks of ``released`` that are open.
_MADE = threading.local()


def builder(app: str = "lodestone", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the bench share."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset (local tests) a temporary folder takes its place, and the
    session is told of it, so that every later call finds the same one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, local, True)
        root = f"file://{local}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder; it goes when the driver's Python ends."""
    path = f"{shared_root(spark)}/lodestone/{kind}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    for made in getattr(_MADE, "scopes", []):
        made.append(path)
    return path


@contextlib.contextmanager
def released(spark: SparkSession, keep: list[str] | None = None):
    """What this thread names by ``new_path`` inside the block goes at its end, but for ``keep`` (as it is then).

    For work whose outcome has been written by then: plans that still read those tables fail.
    """
    made: list[str] = []
    scopes = _MADE.__dict__.setdefault("scopes", [])
    scopes.append(made)
    try:
        yield
    finally:
        scopes[:] = [s for s in scopes if s is not made]
        for path in made:
            if path not in (keep or ()):
                remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what ``new_path`` named; a session that has ended already is no error."""
    with contextlib.suppress(Exception):
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def durable(df: DataFrame, kind: str = "cut", keep: list | None = None, rows: int | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and returns a plan that only reads it back.

    Unlike a local checkpoint it survives the loss of any executor, and its size is known to
    the optimiser, which therefore broadcasts it only when it is truly small. ``keep`` gets
    the path, for an iteration that wants to drop its predecessor's table. ``rows``, where the
    caller knows about how many there are, keeps small tables in few files, ``FILE_ROWS`` each.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, math.ceil(rows / FILE_ROWS)))
    path = new_path(spark, kind)
    df.write.option("compression", "zstd").parquet(path)
    if keep is not None:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)
