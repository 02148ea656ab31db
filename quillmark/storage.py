"""Cutting lineage on storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A local session that names
    none, as in tests, gets a temporary folder of this machine, set there; on a cluster, where
    such a folder is lost with its machine, that is an error."""
    named = spark.conf.get(SETTING, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set(SETTING, named)
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df, computed once, written as Parquet to the shared folder and read again. A lost
    executor costs no recomputation of what lies before; the files last as long as the folder."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._shared_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes what `written` wrote for df; df can't be read after this."""
    path = getattr(df, "_shared_path", None)
    if path:
        jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(session.sessionState().newHadoopConf()).delete(at, True)
