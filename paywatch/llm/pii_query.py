"""Query of personal-data detection."""

from pyspark.sql import functions as F

from paywatch.llm import pii
from paywatch.llm.common import table
from paywatch.llm.registry import query


def written(spans):
    kinds = F.array(*[F.lit(k) for k in pii.KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def of_kind(spans, kind):
    """How many spans are of the kind. A second parameter of the function would be the place in the array."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query("op5_personal_data")
def personal_data(spark, folder):
    """Spans of every document; counts and digest are those of the patterns alone."""
    docs = pii.found(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: ~s["added"])
    counts = [of_kind(base, k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return docs.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("pii")).alias("spans"))
