"""Session settings and the shared folder for checkpoints and written tables."""

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build(app="paywatch", master=None, shuffle_partitions=None, memory=None):
    """A session with the settings the jobs rely on; cluster values (master, memory) stay the cluster's."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    return builder.getOrCreate()


def use_utc(spark):
    """Event times are UTC without a zone, so casts must not depend on the machine's zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark):
    """The folder every executor can reach, as the session names it."""
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    return folder


def local_shared(spark):
    """Gives a bare local session a folder of its own, as tests and the driver contract need; a cluster must name one."""
    local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    if local and not (spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="paywatch-"))
    return spark


_OPEN = []


@contextlib.contextmanager
def scratch(spark):
    """Deletes, at its end, what was written to the shared folder meanwhile: wrap a job that writes its result elsewhere."""
    written = []
    _OPEN.append(written)
    try:
        yield
    finally:
        _OPEN.remove(written)
        for path in written:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def new_path(spark, name):
    """A fresh path in the shared folder."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    for written in _OPEN:
        written.append(path)
    return path


def materialize(df, name):
    """Writes a result that several branches read, so that it is computed once and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
