"""Tables written once for what is read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; only a local master may leave it unset."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def once(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, so that plans that read it several times compute it once; a table of this kind as it is."""
    if getattr(df, "_once", False):
        return df
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/once-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._once = True
    return out
