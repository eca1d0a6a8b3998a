"""Sessions, and shipping this package to the Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "wireloom", **config: str) -> SparkSession:
    """A session with the settings that the operators are made for.

    UTC (driver tables hold naive timestamps), adaptive execution with its
    skew-join splitting, and filter pushdown into the capture source.
    """
    b = SparkSession.builder.appName(name)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for k, v in (base | config).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, once a session."""
    sc = spark.sparkContext
    if sc.getLocalProperty("wireloom.ship") == sc.applicationId:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="wireloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    out = Path(folder) / f"wireloom-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    sc.addPyFile(str(out))
    sc.setLocalProperty("wireloom.ship", sc.applicationId)


_local: list[str] = []
_mine: list[tuple[SparkSession, str]] = []


def _local_dir() -> str:
    """This process's temporary folder, removed when the process ends."""
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="wireloom-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return "file://" + _local[0]


def hadoop(spark: SparkSession, path: str):
    """(path, file system) as Hadoop has them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    ``spark.checkpoint.dir`` of the session decides.  Only where it is unset
    is a folder chosen here: a temporary one in single-process local mode, else a
    folder in the warehouse, which then must not be a local path of each machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] == "local":
            return _local_dir()
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_wireloom_shared"
        if hadoop(spark, base)[1].getScheme() == "file":
            raise ValueError(f"set spark.checkpoint.dir: the warehouse {base} is a local folder, which the machines of a cluster don't share")
    return base.rstrip("/")


def _leave() -> None:
    """Removes this process's intermediate tables at its end, if the JVM is still there."""
    for spark, path in _mine:
        try:
            p, fs = hadoop(spark, path)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended before: its folder has the application's name
            return


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, under the application's name; it is removed when this process ends."""
    if not _mine:
        atexit.register(_leave)
    path = f"{shared_dir(spark)}/wireloom/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
    _mine.append((spark, path))
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    This cuts the lineage: a lost executor costs one task of the reader, never
    the work of the stages before.  The rows are whole files of a commit, so
    a retried task can't leave half a table.
    """
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._wireloom_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes a table that :func:`written` made and that nothing reads any more."""
    path = getattr(df, "_wireloom_path", None)
    if path:
        p, fs = hadoop(df.sparkSession, path)
        fs.delete(p, True)
        _mine[:] = [x for x in _mine if x[1] != path]


#: Inputs up to this size may be dealt out anew before work that takes long a row.
SMALL = 64 << 20
#: What Spark says of a leaf whose size it doesn't know is above this.
_UNKNOWN = 1 << 50


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of all that ``df`` reads, as the planner estimates them; None if it doesn't know.  Nothing is run for it."""
    total, leaves = 0, df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    while leaves.hasNext():
        size = int(str(leaves.next().stats().sizeInBytes()))
        if size >= _UNKNOWN:
            return None
        total += size
    return total


def parts_for(df: DataFrame) -> int:
    """How many parts ``df`` should be dealt out to: as many as a plain scan of its input has splits, the cores at least."""
    conf, cores = df.sparkSession.conf, df.sparkSession.sparkContext.defaultParallelism
    split = int(df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get("spark.sql.files.maxPartitionBytes")))
    return max(cores, -(-(input_bytes(df) or 0) // max(1, split)))


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over all cores if all that it reads is small.

    A small table is often one row group of one file, which one task would
    read and work through alone.  Anything larger comes in enough splits and is
    left as it is, so nothing of size is ever shuffled for this.  The decision
    rests on the planner's sizes of the inputs alone; no part of the plan is run.
    """
    if df.isStreaming:
        return df
    size = input_bytes(df)
    return df if size is None or size > SMALL else df.repartition(df.sparkSession.sparkContext.defaultParallelism)
