"""Query of the mixing operator and its SQL."""

from pyspark.sql import functions as F

from paywatch.llm import mixing
from paywatch.llm.common import table
from paywatch.llm.registry import query

SIZES = r"select *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as mix_size from {documents}"


def mixed_sql(documents="documents", weights=(1, 2, 3), most=3):
    """DuckDB text of ``mixing.systematic``: all rows with the operator's columns."""
    return f"""
with sized as ({SIZES.format(documents=documents)}),
goals as (
  select *, max(mix_level) over () as level from (
    select *, (total - stopped) / open_weight as mix_level from (
      select *, sum(mix_source_size) over () as total,
        coalesce(sum(mix_limit) over (order by mix_limit / mix_weight, mix_source nulls last rows between unbounded preceding and 1 preceding), 0.0) as stopped,
        sum(mix_weight) over (order by mix_limit / mix_weight, mix_source nulls last rows between current row and unbounded following) as open_weight
      from (
        select mix_source, mix_source_size, mix_source_size * {float(most)}::double as mix_limit,
          [{', '.join(f'{float(w)}::double' for w in weights)}][(row_number() over (order by encode(mix_source) nulls last) - 1) % {len(weights)} + 1] as mix_weight
        from (select source as mix_source, sum(mix_size)::bigint as mix_source_size from sized group by 1))))),
placed as (
  select s.*, g.mix_source_size, least(mix_limit, mix_weight * level) as mix_target,
    md5(coalesce(doc_id::varchar, '')) as mix_md5,
    case when mix_size <= 0 then 0 else length(bin(mix_size)) * 8 + (mix_size >> greatest(length(bin(mix_size)) - 4, 0)::bigint) % 8 end as mix_class,
    (('0x' || substr(md5('mix:' || coalesce(source, '')), 1, {mixing.HEX_DIGITS}))::bigint % {mixing.OFFSET_STEPS}) / {float(mixing.OFFSET_STEPS)}::double as mix_offset
  from sized s join goals g on s.source is not distinct from g.mix_source),
lined as (
  select *, case when mix_source_size > 0 then mix_target / mix_source_size else 0.0 end as rate,
    row_number() over (partition by source order by mix_class, mix_md5, doc_id nulls first, mix_size) as place
  from placed)
select *, (floor(mix_offset + place * rate) - floor(mix_offset + (place - 1) * rate))::bigint as mix_copies from lined"""


@query("op10_systematic_mix", f"""
select doc_id, mix_size as size, mix_source_size as source_size, mix_target as target, mix_copies * mix_size as taken
from ({mixed_sql()})""")
def systematic_mix(spark, folder):
    """Size, source's size and target, and the words the mix takes of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.systematic(docs).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )
