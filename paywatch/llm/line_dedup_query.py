"""Query of line dedup and its SQL."""

from pyspark.sql import functions as F

from paywatch.llm import line_dedup
from paywatch.llm.common import table
from paywatch.llm.registry import query

ABC = "abcdefghijklmnopqrstuvwxyz"


@query("op6_line_dedup", f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i
  from documents),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{ABC.upper()}', '{ABC}') as key from lines),
shared as (select key, min(doc_id) as keeper from keyed where length(key) >= {line_dedup.MIN_CHARS} group by key having count(distinct doc_id) >= 2)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from (select k.*, s.key is not null and s.keeper <> k.doc_id as gone from keyed k left join shared s using (key))
group by doc_id""")
def line_dedup_all(spark, folder):
    """Lines, dropped lines and the digest of what stays of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs).select(
        "doc_id", F.col("line_result.lines").alias("n_lines"), F.col("line_result.dropped").alias("n_dropped"),
        F.sha2(F.col("line_result.text"), 256).alias("kept_sha256"),
    )
