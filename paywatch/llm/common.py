"""Inputs and expressions that several operators share."""

import os

from pyspark.sql import functions as F

from paywatch.session import use_utc

#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of text in one Arrow batch. Ten thousand long texts would be too much memory for one worker.
BATCH_ROWS = 1000


def table(spark, folder, name):
    """A given table; texts go to Python in small batches."""
    use_utc(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def remainder(column, divisor):
    """crc32 of the column's text modulo ``divisor``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % divisor


def shuffle_partitions(spark):
    """The cluster's own measure of the work: parts that follow the data are derived from it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
