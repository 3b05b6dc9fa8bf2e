"""Session helpers: a local session for tests and the checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A local session with adaptive execution, UTC and few shuffle partitions (tests and bench)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("intentlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.

    ``spark.checkpoint.dir`` of the session wins; only where it is unset and nothing was set on the
    context (a local test) a temporary folder is used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _temporary(f"intentlake-{os.getpid()}-")
    sc.setCheckpointDir(path)
    return path


def _temporary(prefix: str) -> str:
    """A folder on this machine that goes when the process ends."""
    path = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there afterwards."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder beside the checkpoints, which all executors share. Spark deletes checkpoint folders no more than this one: whoever runs the cluster does."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a compressed table in the shared folder and read from there. Unlike a checkpoint, later reads take only the columns they need."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of narrow tables (ids, keys, short lists) that are sent to every executor at most.
BROADCAST_ROWS = 1 << 19


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is. For tables that are cheap to count, as after ``cut_lineage``."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ensure_importable(spark: SparkSession) -> None:
    """Let the Python workers import this package, once for each context.

    Nothing is done where PYTHONPATH names the package's folder, as workers inherit it; else the package
    is packed and added to the context, which hands it to every executor.
    """
    root = Path(__file__).resolve().parent.parent
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if _SHIPPED.get("context") == sc.applicationId:
        return
    packed = Path(_temporary("intentlake-package-")) / "intentlake.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted((root / "intentlake").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(packed))
    _SHIPPED["context"] = sc.applicationId


_SHIPPED: dict[str, str] = {}
