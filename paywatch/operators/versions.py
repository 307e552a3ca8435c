"""Trained models by version: a folder per version, and beside them the ensembles' nodes as a table.

A version counts once its table of nodes is whole (every row says how many there are) and the table is written after the
model, so a reader beside a writer, or after a writer that was lost, takes the version before. The table is what other
engines need to repeat a score: its size is set by trees and depth, not by the data. Null, infinite and missing features
are cleaned before a model sees them. A folder that is missing or has no whole version gives None; writing a version
again replaces it.
"""

import os

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from paywatch.operators import model as model_ops

VERSION = "version"
SCHEMA = (
    "tree int, weight double, node int, feature int, threshold double, left_node int, right_node int, output double,"
    " nodes int"
)


def node_rows(table):
    """The ensemble as tuples of ``SCHEMA``. A row goes left where its value is at most the threshold; leaves have only an output."""
    total = sum(len(nodes) for _, nodes in table)
    for tree, (weight, nodes) in enumerate(table):
        for node, (feature, cut, left, right, output, *_) in enumerate(nodes):
            test = (int(feature), float(cut), int(left), int(right)) if feature >= 0 else (None,) * 4
            yield (tree, float(weight), node, *test, float(output), total)


def model_path(path, version):
    return os.path.join(path, "models", f"{VERSION}={int(version)}")


def store(spark, trained, path, version):
    """Writes a trained model as a version; versions are numbers, the largest whole one is in force."""
    trained.write().overwrite().save(model_path(path, version))
    rows = spark.createDataFrame(list(node_rows(model_ops.tree_table(trained))), SCHEMA)
    rows.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "nodes", f"{VERSION}={int(version)}"))


def nodes(spark, path):
    """The nodes of all versions."""
    folder = os.path.join(path, "nodes")
    return spark.read.schema(f"{SCHEMA}, {VERSION} long").option("basePath", folder).parquet(folder)


def newest(spark, path):
    """Number of the version in force, None if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "nodes"))
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    whole = nodes(spark, path).groupBy(VERSION).agg(F.expr("count(1) = max(nodes) as whole")).where("whole")
    return whole.agg(F.max(VERSION).alias("v")).first()["v"]


class InForce:
    """The model in force of a folder, asked anew for each micro-batch and loaded when its version changes."""

    def __init__(self, path):
        self.path, self.version, self.model = path, None, None

    def get(self, spark):
        """(version, model), both None while there is no whole version."""
        version = newest(spark, self.path)
        if version is not None and version != self.version:
            self.version, self.model = version, PipelineModel.load(model_path(self.path, version))
        return self.version, self.model
