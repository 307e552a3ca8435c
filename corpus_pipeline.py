"""From raw documents to a mixed training corpus: every stage works on what its predecessor has kept.

Language ID drops documents whose language cannot be told (no letters, or no language more likely than all others
together). Line dedup removes lines that a document with a smaller id holds. Near-dedup keeps one document of each class.
Decontamination drops documents that hold a benchmark item. Mixing emits the rest source by source in the target shares.
"""

from pyspark.sql import functions as F

from paywatch.llm import decontaminate, language, line_dedup, mixing, near_dedup
from paywatch.llm.common import table
from paywatch.llm.registry import query
from paywatch.session import materialize

#: A document stays if its language holds more than this share of the probability.
LEAST_SCORE = 0.5


def identify(spark, docs, sf_dir):
    """Documents whose language is told; texts of the labelled documents themselves teach the languages."""
    judged = language.predicted(docs, language.fit(docs), result="__language")
    known = (F.col("__language.lang") != language.UNDETERMINED) & (F.col("__language.score") > LEAST_SCORE)
    return judged.where(known).select(*docs.columns)


def drop_lines(spark, docs, sf_dir):
    """Documents without the lines that another document keeps; ``n_chars`` follows the text."""
    cleaned = line_dedup.dedup(docs, result="__lines").withColumn("text", F.col("__lines.text"))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def drop_copies(spark, docs, sf_dir):
    """One document of each near-duplicate class: the one with the smallest id."""
    return near_dedup.first_of_each(docs)


def drop_leaks(spark, docs, sf_dir):
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark, docs, sf_dir):
    """Sources to target weights: a document comes out as often as the mix takes it, numbered by ``mix_copy``."""
    return mixing.emit(docs)


STAGES = [
    ("language_id", identify), ("line_dedup", drop_lines), ("near_dedup", drop_copies), ("decontaminate", drop_leaks), ("mix", mix),
]
#: Language models decide in the first stage, which SQL cannot say; tests compare the stages with brute force.
ORACLE_SQL = None


@query("pipeline")
def run(spark, sf_dir):
    """The stages one after another over ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
