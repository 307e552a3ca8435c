"""Query of spelling variants and its SQL."""

from paywatch.llm import variants
from paywatch.llm.common import table
from paywatch.llm.manifest_query import crc32_sql
from paywatch.llm.registry import query


@query("op13_spelling_variants", f"""
with recursive runs as (
  select doc_id, translate(run, '{variants.UPPER}', '{variants.LOWER}') as run, count(*) as times
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) as run from documents) group by 1, 2),
hashed as (select *, {crc32_sql("coalesce(doc_id::varchar, '') || ':' || run")} as h from runs),
counted as (
  select case when h % {variants.DIVISOR} = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word,
    sum(times)::bigint as n
  from hashed group by 1),
words as (select word, n from counted where length(word) >= {variants.MIN_LENGTH} and n >= {variants.MIN_COUNT}),
cuts as (
  select word, n, i, left(word, i) || substr(word, i + 2) as rest
  from (select word, n, unnest(range(length(word)))::int as i from words)),
near as (
  select a.word, b.word as near, b.n as near_n from cuts a join cuts b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from cuts a join words b on a.rest = b.word
  union select b.word, a.word, a.n from cuts a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, arg_min(struct_pack(near, near_n), struct_pack(less := -near_n, near := near)) as top from near group by word),
formed as (
  select word, w.n, coalesce(n_near, 0) as n_near, case when top.near_n >= {variants.RATIO} * w.n then top.near end as form,
    case when top.near_n >= {variants.RATIO} * w.n then top.near_n end as form_n
  from words w left join best using (word)),
walks as (
  select word, word as root, form as next from formed
  union all select w.word, f.word, f.form from walks w join formed f on w.next = f.word)
select word, form, root, n, n_near, form_n from formed join (select word, root from walks where next is null) using (word)""")
def spelling_variants(spark, folder):
    """Every counted word with its near words, the form it is a variant of, and the end of that chain."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return variants.forms(variants.vocabulary(docs)).select("word", "form", "root", "n", "n_near", "form_n")
