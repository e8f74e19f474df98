"""Session helpers: a test session, the package for the Python workers, and the shared folder for intermediates."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}


def local_session(cores: int | str = 8, app: str = "crivo", memory: str = "16g", **conf) -> SparkSession:
    """Session for tests and the bench. On a cluster, pass your own session instead."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context; an installed package needs no shipping."""
    context = spark.sparkContext
    if getattr(context, "_crivo_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(here)))
    path = os.path.join(tempfile.mkdtemp(prefix="crivo-"), "crivo.zip")
    with open(path, "wb") as f:
        f.write(packed.getvalue())
    context.addPyFile(path)
    context._crivo_shipped = True


def release() -> None:
    """Give memory that Arrow has no use for back to the system: a Python worker waits for further tasks beside the others."""
    pa.default_memory_pool().release_unused()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`. A temporary folder serves only a one-process session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    path = tempfile.mkdtemp(prefix="crivo-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: a cut in the lineage that outlives its executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish(spark: SparkSession, temporary: str, final: str) -> bool:
    """Rename a finished file or folder to its name; false, and nothing happens, if the name is taken."""
    jvm = spark._jvm
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (temporary, final))
    conf = spark._jsc.hadoopConfiguration()
    target = target.getFileSystem(conf).makeQualified(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    target.getFileSystem(conf).mkdirs(target.getParent())
    try:
        context.rename(source, target, no_options)
    except Py4JJavaError as e:
        if context.util().exists(target):
            return False
        raise e
    return True


@atexit.register
def discard() -> None:
    """Delete every intermediate written so far; results that still read one must have been saved before."""
    for path, spark in list(_WRITTEN.items()):
        _WRITTEN.pop(path)
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone: its folder is the cluster's to clear
            pass
