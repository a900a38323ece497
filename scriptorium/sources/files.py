"""The shared scratch folder, where written files are visible to all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The folder that the cluster names; one of our own only on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _own.get("dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a small table that several steps read to the scratch folder, so that it is made once and its size is known."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
