"""Intermediate tables in the folder that driver and executors share."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_MADE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary folder; a cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="veilscan-")
        where = _OWN[app]
    return where.rstrip("/")


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A path in the shared folder that nothing has used, in a folder of the application that goes when the driver's JVM ends."""
    top = f"{shared_dir(spark)}/veilscan-{spark.sparkContext.applicationId}"
    if top not in _MADE:
        hadoop, system = _file_system(spark, top)
        system.mkdirs(hadoop)
        system.deleteOnExit(hadoop)
        _MADE.add(top)
    return f"{top}/{kind}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: it cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``written`` made and no later frame reads."""
    for df in tables:
        for path in {os.path.dirname(f) for f in df.inputFiles()}:
            hadoop, system = _file_system(df.sparkSession, path)
            system.delete(hadoop, True)


def broadcast_if_small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A written table of at most ``most`` short rows goes to every task; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
