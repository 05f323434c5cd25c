"""Table access helpers: even scans and durable intermediate tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


#: Session setting: deal the rows of a text table to so many partitions. For test tables of one row group, which
#: Spark cannot split; unset (the default), tables are read as they are split.
SPREAD = "spark.loomdex.spread"


def spread(df: DataFrame) -> DataFrame:
    parts = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(parts)) if parts else df


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor can reach: ``spark.checkpoint.dir``, else one in the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and re.match(r"file:|/", warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share: the warehouse is local to each machine")
    return f"{warehouse}/_loomdex"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later scans prune columns and push filters, and a lost executor costs a
    re-read instead of the whole lineage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
