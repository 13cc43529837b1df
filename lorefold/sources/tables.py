"""Reading the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of few files below the first size stay in one task; up to the second, a core, are dealt anew; larger ones are read as their files are cut.
SMALL_BYTES, SPREAD_BYTES = 1 << 20, 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables. Where it has fewer files than the cluster has cores, and no more than SPREAD_BYTES a core, its rows are dealt to all cores."""
    path = f"{str(sf_dir).rstrip('/')}/{name}.parquet"
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores:
        size = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).agg(F.sum("length")).first()[0] or 0
        if SMALL_BYTES < size <= SPREAD_BYTES * cores:
            return df.repartition(cores)
    return df
