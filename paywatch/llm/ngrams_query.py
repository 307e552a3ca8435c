"""Query of language-model scoring."""

from pyspark.sql import functions as F

from paywatch.llm import ngrams
from paywatch.llm.common import remainder, table
from paywatch.llm.registry import query

FOLDS, HELD_OUT = 7, 2


@query("op1_lm_score")
def lm_score(spark, folder):
    """Log10 probability of every text, and that of single words with one added to each count."""
    docs = table(spark, folder, "documents")
    scored = ngrams.score(docs, remainder("doc_id", FOLDS) == HELD_OUT)
    return scored.select(
        F.col("doc").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens",
        F.col("base").alias("base_score"), "score",
    )
