"""Query of near-duplicate detection."""

from pyspark.sql import functions as F

from paywatch.llm import near_dedup
from paywatch.llm.common import table
from paywatch.llm.registry import query


@query("op3_near_dedup")
def near_dedup_all(spark, folder):
    """The class of every document: the smallest id among its near duplicates, itself included."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near_dedup.labelled(docs).select(F.col("near_doc").alias("doc_id"), F.col("near_class").alias("class_id"))
