"""Query of the Merkle manifest and its SQL."""

from pyspark.sql import functions as F

from paywatch.llm import manifest
from paywatch.llm.common import remainder, table
from paywatch.llm.registry import query

ABC = "abcdefghijklmnopqrstuvwxyz"
#: One row in so many is changed before it is verified.
TAMPER = 5


def crc32_sql(data):
    """DuckDB text of the unsigned crc32 of a text's UTF-8 bytes, bit by bit from the polynomial."""
    octets = f"list_transform(range(octet_length(encode({data}))), lambda i: ('0x' || substr(hex(encode({data})), 2 * i + 1, 2))::bigint)"
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda c, b: {bits}), 4294967295::bigint)"


def _leaf(text):
    fields = ["doc_id::varchar", "source", "lang", "n_chars::varchar", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f}))::varchar || ':' || {f}, '-')" for f in fields) + ")"


def _tree(name, nodes):
    return f"""
{name} as (
  select 0 as height, grp, slot, size, digest from {nodes}
  union all
  select any_value(height) + 1, grp, slot // 16, (any_value(size) + 15) // 16, sha256(string_agg(digest, '' order by slot))
  from {name} where size > 1 group by grp, slot // 16),
{name}_sides as (
  select *,
    coalesce(string_agg(digest, '') over (partition by height, grp, slot // 16 order by slot rows between unbounded preceding and 1 preceding), '') as before,
    coalesce(string_agg(digest, '') over (partition by height, grp, slot // 16 order by slot rows between 1 following and unbounded following), '') as after
  from {name} where size > 1)"""


def _folds(name, start, tree):
    return f"""
{name} as (
  select 0 as height, key, grp, slot, size, found, proof from {start}
  union all
  select s.height + 1, key, grp, slot // 16, (size + 15) // 16, sha256(before || found || after), proof || before || after
  from {name} f join {tree}_sides s using (height, grp, slot, size))"""


@query("op11_merkle_manifest", f"""
with recursive leaves as (
  select *, {_leaf('text')} as digest,
    case when {crc32_sql("coalesce(doc_id::varchar, '')")} % {TAMPER} = 0 then {_leaf(f"translate(text, '{ABC.upper()}', '{ABC}')")} end as changed,
    coalesce('=' || source, '-') as grp, row_number() over () as key
  from documents),
nodes as (
  select *, row_number() over (partition by grp order by doc_id nulls first, digest) - 1 as slot, count(*) over (partition by grp) as size
  from leaves),
{_tree('tree', 'nodes')},
heads as (select '' as grp, grp as name, digest, row_number() over (order by grp) - 1 as slot, count(*) over () as size from tree where size = 1),
{_tree('upper', 'heads')},
starts as (select key, grp, slot, size, coalesce(changed, digest) as found, '' as proof from nodes),
{_folds('lower_folds', 'starts', 'tree')},
middles as (
  select key, '' as grp, h.slot, h.size, found, proof from lower_folds f join heads h on h.name = f.grp where f.size = 1),
{_folds('upper_folds', 'middles', 'upper')}
select n.doc_id, n.digest as leaf, h.digest as subroot, (select digest from upper where size = 1) as root,
  sha256(proof) as proof_sha256, found as folded_root, found = (select digest from upper where size = 1) as verified
from upper_folds f join nodes n using (key) join heads h on h.name = n.grp where f.size = 1""")
def merkle_manifest(spark, folder):
    """Leaf, roots and proof of every document, and whether the document, where tampered with, still leads to the root."""
    docs = table(spark, folder, "documents").select(*manifest.FIELDS)
    lowered = F.translate("text", ABC.upper(), ABC)
    changed = F.when(remainder("doc_id", TAMPER) == 0, lowered).otherwise(F.col("text"))
    rows = manifest.manifest(docs, tampered={"text": changed})
    root = manifest.folded(F.coalesce("merkle_found", "merkle_leaf"), F.col("merkle_path"))
    return rows.select(
        F.col("merkle_order").alias("doc_id"), F.col("merkle_leaf").alias("leaf"), F.col("merkle_subroot").alias("subroot"),
        F.col("merkle_root").alias("root"), F.sha2(manifest.proof(F.col("merkle_path")), 256).alias("proof_sha256"),
        root.alias("folded_root"), (root == F.col("merkle_root")).alias("verified"),
    )
