"""Table access and the shared scratch folder in which long lineages are cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Only where the setting is absent (tests on local[n]) a temporary folder of this
    machine is made, once for each application, and set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodegraph-")
        atexit.register(shutil.rmtree, folder, True)
        _LOCAL_DIRS[app] = "file://" + folder
        spark.sparkContext.setCheckpointDir(_LOCAL_DIRS[app])
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables of this application, once no frame over them is needed any
    more; how many there were."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    hadoop = spark._jsc.hadoopConfiguration()
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hadoop).delete(p, True)
    return len(paths)


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: the plan after it starts at a scan.

    Written files outlive a lost executor, and unlike an RDD checkpoint they keep
    column pruning and pushed filters.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
