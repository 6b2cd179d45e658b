"""Intermediate and domain tables as Parquet in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Domain tables already written: (application, folder of the source tables, its files, name) to path.
_WRITTEN: dict[tuple[str, str, str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own in local sessions alone, as a cluster's executors would not share it."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = os.path.join(tempfile.gettempdir(), "echoloom-shared")
    return place.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write and read again: cuts the lineage, so that a plan that uses a table several times scans it and no more."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def listing(spark: SparkSession, source: str) -> str:
    """What a folder of tables holds: names, sizes and times of its files, one level of folders deep."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for table in fs.listStatus(path):
        for f in fs.listStatus(table.getPath()) if table.isDirectory() else [table]:
            found.append(f"{table.getPath().getName()}/{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}")
    return "\n".join(sorted(found))


def stored(spark: SparkSession, source: str, name: str, build) -> DataFrame:
    """The domain table ``name`` over the tables in ``source``, built and written once per application and state of their files."""
    key = (spark.sparkContext.applicationId, source, listing(spark, source), name)
    if key not in _WRITTEN:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])
