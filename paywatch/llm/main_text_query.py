"""Query of main-text extraction."""

from pyspark.sql import functions as F

from paywatch.llm import main_text
from paywatch.llm.common import table
from paywatch.llm.registry import query


@query("op9_main_text")
def main_text_all(spark, folder):
    """The main text of every page and its length in code points."""
    pages = main_text.extract(table(spark, folder, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
