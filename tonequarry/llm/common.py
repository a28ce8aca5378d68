"""Helpers shared by the corpus operators: the shared folder, cut lineage, clustered batches."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a folder of its own if driver and
    executors are one process (``local`` masters, as in tests); on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = got.get() if got.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.gettempdir()}/checkpoints/tonequarry-{os.getuid()}"
    return named.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tq-{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone; the folder is then left to its owner
            return


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lost executors can't undo it, and nothing runs twice."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tq_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made and that nothing reads any more; shuffles of finished steps leave the executors' disks."""
    for t in tables:
        spark = t.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._tq_path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if tables:
        # shuffle files go once the driver has collected the plans that made them
        tables[0].sparkSession.sparkContext._jvm.System.gc()
        give_back(tables[0].sparkSession)


def give_back(spark: SparkSession) -> None:
    """Executors collect their garbage, a task for each, so that the heap a finished step has filled is there for Python workers."""
    n = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is among them
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).collect()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_crc(col: str, mod: int):
    """crc32 of the id as text modulo ``mod``; a null id counts as the empty text (crc32 zero)."""
    return F.coalesce(F.crc32(F.col(col).cast("string")), F.lit(0)) % mod


def clustered(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup batches that arrive sorted by ``keys`` so that no key is cut between two tables.

    Holds one batch and the rows of one key: callers bound the rows of a key.
    """
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if held and any(held[-1][k][-1] != b[k][0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        # the rows of the last key may go on in the next batch
        cut = b.num_rows
        last = [b[k][-1] for k in keys]
        if not all(b[k][0] == v for k, v in zip(keys, last, strict=True)):
            cut = _first_of_last(b, keys, last)
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _first_of_last(b: pa.RecordBatch, keys: list[str], last: list) -> int:
    lo, hi = 0, b.num_rows - 1  # rows with the last key are a suffix
    while lo < hi:
        mid = (lo + hi) // 2
        if all(b[k][mid] == v for k, v in zip(keys, last, strict=True)):
            hi = mid
        else:
            lo = mid + 1
    return lo


def by_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    def run(batches):
        for b in batches:
            yield f(b)

    return run
