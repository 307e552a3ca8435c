"""Query of benchmark decontamination."""

from pyspark.sql import functions as F

from paywatch.llm import decontaminate
from paywatch.llm.common import table
from paywatch.llm.registry import query


@query("op7_decontaminate")
def decontaminate_all(spark, folder):
    """Every benchmark item found in a document: where its best match starts, in words, and its edit distance."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.matched(docs, table(spark, folder, "benchmark"))
    rows = found.select("doc_id", F.explode("leaks").alias("leak"))
    return rows.select("doc_id", F.col("leak.item").alias("item_id"), F.col("leak.start").alias("start_word"), F.col("leak.distance").alias("distance"))
