"""Tables written between steps into the folder that all executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where none is set and all executors are in this machine's process, as in tests."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="foliograph-"))
    return _own_folder[0]


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet and read again: it is computed once, the lineage ends here, and what depends on its partitioning stays as it was when executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/foliograph-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
