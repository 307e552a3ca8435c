"""Query of language identification."""

from pyspark.sql import functions as F

from paywatch.llm import language
from paywatch.llm.common import remainder, table
from paywatch.llm.registry import query

FOLDS, HELD_OUT = 4, 2


@query("op4_language_id")
def language_id(spark, folder):
    """Language and score of every text; texts of the held-out fold are never learned from."""
    docs = table(spark, folder, "documents")
    model = language.fit(docs.where(remainder("doc_id", FOLDS) != HELD_OUT))
    return language.predicted(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.bits").alias("code_bits"),
    )
