"""Query of the WARC round trip and its SQL."""

from pyspark.sql import functions as F

from paywatch.llm import warc
from paywatch.llm.common import table
from paywatch.llm.registry import query


@query("op2_warc", f"""
with given as (select page_id, coalesce(html, '') as body from pages),
equal as (select body, min(page_id) as first, count(*) as copies from given where strlen(body) >= {warc.LEAST_REVISIT} group by body)
select g.page_id, strlen(g.body)::bigint as payload_bytes, sha256(g.body) as payload_digest,
  case when e.copies > 1 and g.page_id <> e.first then 'revisit' else 'response' end as record_type,
  case when e.copies > 1 and g.page_id <> e.first then e.first end as refers_to
from given g left join equal e using (body)""")
def warc_round_trip(spark, folder):
    """Pages written as WARC records and read back; a revisit has no payload, so its header tells that of its response."""
    found = warc.read(spark, warc.write(table(spark, folder, "pages")))
    again = F.col("kind") == "revisit"
    return found.select(
        warc.number("name").alias("page_id"),
        F.when(again, F.col("stated_bytes").cast("long")).otherwise(F.col("body")).alias("payload_bytes"),
        F.when(again, F.regexp_extract("stated_digest", "^sha256:([0-9a-f]+)$", 1)).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"), warc.number("refers").alias("refers_to"),
    )
