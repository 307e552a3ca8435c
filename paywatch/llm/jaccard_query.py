"""Query of the n-gram Jaccard join and its SQL."""

from pyspark.sql import functions as F

from paywatch.llm import jaccard
from paywatch.llm.common import table
from paywatch.llm.registry import query

ABC = "abcdefghijklmnopqrstuvwxyz"


@query("op12_jaccard_join", rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, '{ABC.upper()}', '{ABC}'), '[^\x20\x09-\x0D]+') as w from documents),
runs as (
  select doc_id, list_distinct(list_transform(range(greatest(len(w) - {jaccard.WORDS - 1}, 1)), lambda i: array_to_string(w[i + 1:i + {jaccard.WORDS}], ' '))) as s
  from words where len(w) > 0),
sizes as (select d.doc_id, coalesce(len(s), 0) as n from documents d left join runs using (doc_id)),
classes as (select min(doc_id) over (partition by list_sort(s)) as rep, doc_id, s from runs),
items as (select rep, unnest(s) as x from classes where rep = doc_id),
shared as (select rep, x from items where x in (select x from items group by x having count(*) > 1)),
pairs as (
  select a.rep as a, b.rep as b, count(*) as common from shared a join shared b on a.x = b.x and a.rep < b.rep group by 1, 2),
linked as (
  select a, b from pairs p join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)),
edges as (select a, b from linked union select b, a from linked),
reached as (select rep as node, rep as root from classes union select e.b, r.root from reached r join edges e on e.a = r.node where r.root < e.b),
least as (select node, min(root) as root from reached group by node)
select s.doc_id, n as n_shingles, coalesce(l.root, s.doc_id) as component_id
from sizes s left join classes c using (doc_id) left join least l on l.node = c.rep""")
def jaccard_join(spark, folder):
    """Size of every document's set, and the smallest document that links lead to."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return jaccard.joined(docs).select(
        F.col("join_doc").alias("doc_id"), F.col("join_n").alias("n_shingles"), F.col("join_component").alias("component_id")
    )
