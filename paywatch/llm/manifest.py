"""Merkle manifest of a dataset: leaf digests, a tree for each group (source), a tree over the groups' roots, and proofs.

A leaf is the SHA-256 of the row's fields, each written as its UTF-8 length, a colon and the value, or ``-`` for a null.
Digests travel and are hashed as lower-case hex.

1. Leaves are sorted by (group, order, leaf) over ranges that Spark cuts by the data, so that a hot group spans as many
   tasks as it needs. A row's place is its place inside its range plus the rows of the group in earlier ranges; only the
   ranges' counts meet.
2. Per level, nodes are windowed by their run of ``ARITY`` places. Lag and lead columns at the fixed offsets 1 to
   ``ARITY`` - 1, masked by slot and run length, are a node's siblings; the run's first child hashes itself and its leads
   into the parent. Every level is written, so that a lost executor costs one level and no more.
3. The groups' roots, sorted the same way, go through the same levels up to the root.
4. Going down again, each run learns the siblings of its ancestors (at most ``ARITY`` - 1 digests a level, of which there
   are as many as the logarithm of the rows); a row's proof is its own siblings and those.

Defined results: a null group is a group of its own and the first one, other groups follow by their UTF-8 bytes; a null
order value comes first; rows with equal group and order are placed by their leaf, so that repeated rows take neighbouring
places and reruns agree; a lone leaf is its group's root and a lone group's root is the root, with no siblings; a run of one
node is hashed by itself; an empty text is ``0:``, a null one ``-``; texts are hashed whole; an empty table has no rows.
Extra columns take no part.
"""

from pyspark.sql import functions as F

from paywatch.session import materialize

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(columns):
    """SHA-256 of the columns in order, each with its length in bytes, so that no two rows read alike."""
    parts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]), 256)


def _group_key(column):
    """A string without nulls that sorts as the group does, the null group first."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def placed(nodes, order):
    """Adds ``slot`` (0-based place in its ``grp`` by ``order``) and ``size`` (nodes of the group) to the written rows."""
    ranged = nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    # The high bits of the id number the range, the low bits the place in it.
    ranged = materialize(ranged.withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    parts = ranged.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    offsets = parts.selectExpr(
        "grp", "part", "first",
        "coalesce(sum(n) over (partition by grp order by part rows between unbounded preceding and 1 preceding), 0) as earlier",
        "sum(n) over (partition by grp) as size",
    )
    joined = ranged.join(offsets, ["grp", "part"])
    return joined.withColumn("slot", F.expr("earlier + at - first")).drop("at", "part", "first", "earlier")


def _runs(nodes, arity):
    """Adds the run, and the digests before and after each node in it, joined to one text a side."""
    window = "over (partition by grp, run order by slot)"
    marked = nodes.selectExpr("*", f"slot div {arity} as run", f"int(slot % {arity}) as place").selectExpr(
        "*", f"int(least({arity}, size - run * {arity})) as many"
    )
    sides = marked.selectExpr(
        "*",
        *[f"if(place >= {k}, lag(digest, {k}) {window}, '') as lag_{k}" for k in range(1, arity)],
        *[f"if(place + {k} < many, lead(digest, {k}) {window}, '') as lead_{k}" for k in range(1, arity)],
    )
    before = ", ".join(f"lag_{k}" for k in reversed(range(1, arity)))
    after = ", ".join(f"lead_{k}" for k in range(1, arity))
    return sides.selectExpr(*nodes.columns, "run", "place", f"concat({before}) as before", f"concat({after}) as after")


def _parents(nodes, arity):
    """One node for each run: its first child hashes the run."""
    first = _runs(nodes, arity).where("place = 0")
    return first.selectExpr("grp", "run as slot", f"(size + {arity - 1}) div {arity} as size", "sha2(concat(digest, after), 256) as digest")


def _levels(nodes, arity):
    """Levels of the nodes of groups that are not yet one node, and (grp, digest, depth) of the root of every group."""
    levels, roots = [], nodes.where("size = 1").selectExpr("grp", "digest", "0 as depth")
    most = nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        levels.append(nodes.where("size > 1"))
        nodes = materialize(_parents(levels[-1], arity), "merkle-level")
        roots = roots.unionByName(nodes.where("size = 1").selectExpr("grp", "digest", f"{len(levels)} as depth"))
        most = -(-most // arity)
    return levels, materialize(roots, "merkle-roots")


def _paths(nodes, levels, tops, arity):
    """``nodes`` with ``path``: the sides of each node and of its ancestors from below, then those that ``tops`` has.

    ``tops`` (grp, depth, path and any others): what lies above the group's root, and the levels below it.
    """
    carried = [c for c in tops.columns if c not in ("grp", "depth", "path")]
    path = None
    for height in reversed(range(len(levels))):
        # The last level of a group is one run, which hangs from what is above the group.
        above = tops.where(f"depth = {height + 1}").selectExpr("grp", "0L as run", "path as upper", *carried)
        if path is not None:
            above = above.unionByName(path.selectExpr("grp", "slot as run", "path as upper", *carried))
        sided = _runs(levels[height], arity).join(above, ["grp", "run"])
        path = sided.selectExpr(
            *levels[height].columns, "concat(array(named_struct('before', before, 'after', after)), upper) as path", *carried
        )
    lone = nodes.where("size = 1").join(tops.drop("depth"), "grp").select(*nodes.columns, "path", *carried)
    return lone if path is None else path.select(*lone.columns).unionByName(lone)


def manifest(docs, fields=FIELDS, group="source", order="doc_id", tampered=None, arity=ARITY):
    """One row per row of ``docs``: (merkle_order, merkle_group, merkle_leaf, merkle_subroot, merkle_root, merkle_path,
    merkle_found), where ``merkle_path`` lists (before, after) of every level from the leaf up.

    ``tampered`` maps field names to the expressions that stand in the rows to be verified; ``merkle_found`` is the leaf
    of such a row, null where it is the leaf itself. The tree is always that of the rows as they are.
    """
    found = F.lit(None).cast("string") if tampered is None else leaf_digest([tampered.get(f, F.col(f)) for f in fields])
    leaves = docs.select(
        _group_key(F.col(group)).alias("grp"), F.col(group).alias("merkle_group"), F.col(order).alias("merkle_order"),
        leaf_digest([F.col(f) for f in fields]).alias("digest"), found.alias("found"),
    ).withColumn("found", F.expr("nullif(found, digest)"))
    nodes = placed(leaves, ["merkle_order", "digest"])
    levels, roots = _levels(nodes, arity)
    heads = placed(roots.selectExpr("'' as grp", "grp as name", "digest", "depth as below"), ["name"])
    upper, root = _levels(heads, arity)
    top = root.selectExpr("grp", "depth", "cast(array() as array<struct<before: string, after: string>>) as path", "digest as root")
    tops = materialize(
        _paths(heads, upper, top, arity).selectExpr("name as grp", "below as depth", "path", "digest as subroot", "root"), "merkle-tops"
    )
    return _paths(nodes, levels, tops, arity).selectExpr(
        "merkle_order", "merkle_group", "digest as merkle_leaf", "subroot as merkle_subroot", "root as merkle_root",
        "path as merkle_path", "found as merkle_found",
    )


def folded(leaf, path):
    """The root that a leaf (a column) leads to along its path."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof(path):
    """All siblings of a path from below, left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")
