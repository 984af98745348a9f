"""Tables written to the cluster's shared folder, to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, kind: str = "table") -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, a session on one machine gets a local one, and a cluster an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="studyflow-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again, so that its lineage ends there."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with more columns, each made once a row: behind a generator, no later expression makes it again wherever it is used."""
    return df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_made")).select(*df.columns, "_made.*")


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a column that is made once, however often it occurs there."""
    return F.get(F.transform(F.array(c), use), 0)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """The rows dealt by key to as many tasks as a shuffle of the session has, for work per row that its bytes do not tell."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *key)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if there is no such folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
