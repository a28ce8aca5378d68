"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new path under ``spark.checkpoint.dir``, removed when the driver ends. Where that is unset, under a temporary folder if driver and
    executors are one process (``local`` masters, as in tests); a cluster is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = got.get() if got.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='tonequarry-')}")
        named = _own[0]
    path = f"{named.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _made:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone; the folder is then left to its owner
            return


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: what several steps read is worked out once, and a lost executor undoes nothing."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
