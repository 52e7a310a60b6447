"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group, all of which a writing task holds in memory.
GROUP = 16 << 20
_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in that of ``spark.checkpoint.dir``; it goes when the application ends.

    Where the setting is absent, one machine takes a temporary folder; on a
    cluster executors would not see each other's files there, so that raises
    RuntimeError.
    """
    context = spark.sparkContext
    app, where = context.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if app in _FOLDERS:
        return _FOLDERS[app]
    if where:
        path = context._jvm.org.apache.hadoop.fs.Path(f"{where.rstrip('/')}/strandlake-{app}")
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS[app] = path.toString()
    elif context.master.split("[")[0] == "local":
        own = tempfile.mkdtemp(prefix="strandlake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _FOLDERS[app] = f"file://{own}"
    else:
        raise RuntimeError("spark.checkpoint.dir is not set; it names the folder that the driver and all executors share")
    return _FOLDERS[app]


def stash(df: DataFrame, name: str, codec: str = "zstd", options: dict[str, int] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, with the writer's ``options``, and read it again.

    The result has no lineage behind it: a lost executor costs a re-read of a
    file, never a recomputation of what went before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).option("parquet.block.size", GROUP).options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
