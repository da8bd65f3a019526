"""Small helpers of the tests."""

from pyspark.sql import functions as F


def plan(df, mode="formatted"):
    jvm = df.sparkSession._jvm
    explain = jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    return df._jdf.queryExecution().explainString(explain)


def children(spark, rows, columns):
    """Child rows (projectID, seq, …) with ``ord`` and ``seg``."""
    df = spark.createDataFrame(rows, columns)
    return df.withColumn("ord", F.struct("seq")).withColumn("seg", F.col("seq").cast("long"))
