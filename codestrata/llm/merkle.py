"""Merkle manifest of a table: nested-interval labels, proofs and their verification.

A row's leaf is the hash of its fields (null `-`, else UTF-8 length, `:`, value). The leaves of a
group (null is a group) ascend by key, null first; while several nodes remain, runs of `fanout`
neighbours become the hash of their digests' hex text. Group roots, in the order of the groups, are
hashed into one root the same way; a lone leaf or group root is its own root.

Every node carries the interval [lo, hi) of leaf ranks that it covers. An ancestor is a node whose
interval contains one's own, found by a join on the bucket of the level (lo div fanout**level) and
containment; the children of that ancestor minus one's own interval are the siblings. Ancestors are
attached from the top down, a level a join, so a parent meets `fanout` rows at most and the steps
that neighbours share are carried once for a run.

Ranks come from ranges of (group, key, leaf), stored, and their counts, so that no group is sorted
in one task; equal rows are dealt over ranges by a row number. Rows of one key are ordered by leaf;
equal rows are leaves of their own. An empty table has no rows and no root. Only the named columns
are read, so others may have any name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import cut
from codestrata.operators.ranking import numbered

FANOUT = 16


def field(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def joined(digests: Column) -> Column:
    """The digests of an array of nodes as one text."""
    return F.array_join(F.transform(digests, lambda c: c["digest"]), "")


def _runs(nodes: DataFrame, level: int, fanout: int, *carried: str) -> DataFrame:
    """(tree, n, lo, hi, children, digest) of the nodes one level up; a lone node stays as it is."""
    child = F.struct("lo", "hi", "digest", *carried)
    return (nodes.groupBy("tree", "n", F.expr(f"lo div {fanout ** level}").alias("run"))
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_list(child)).alias("children"))
            .withColumn("digest", F.when(F.col("n") > 1, F.sha2(joined(F.col("children")), 256))
                        .otherwise(F.col("children")[0]["digest"]))
            .drop("run"))


def _climb(leaves: DataFrame, most: int, fanout: int, *carried: str) -> list[DataFrame]:
    """The runs of each level, stored, up to the level at which the largest tree has one node."""
    levels = [cut(_runs(leaves, 1, fanout, *carried))]
    while fanout ** len(levels) < most:
        level = len(levels)
        below = levels[-1].filter(F.col("n") > fanout ** level).select("tree", "n", "lo", "hi", "digest")
        levels.append(cut(_runs(below, level + 1, fanout)))
    return levels


def _step(children: Column, lo: Column, hi: Column) -> Column:
    """The siblings on both sides of the interval within its parent."""
    left, right = F.filter(children, lambda c: c["hi"] <= lo), F.filter(children, lambda c: c["lo"] >= hi)
    return F.struct(joined(left).alias("before"), joined(right).alias("after"))


def _descend(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The runs of the first level with `path`, the steps from each run to the root, lowest first.

    `tops` has a row a tree: tree, subroot and what follows for all its nodes, among it the path
    above the tree's own root."""
    shared = [c for c in tops.columns if c != "tree"]
    above = None
    for level in range(len(levels), 0, -1):
        runs = levels[level - 1]
        whole = runs.filter("hi - lo = n").join(tops, "tree")
        here = whole.select(*runs.columns, *shared)
        if above is not None:
            bucket = F.expr(f"lo div {fanout ** (level + 1)}")
            parents = above.select(
                F.col("tree").alias("_tree"), bucket.alias("_bucket"), F.col("lo").alias("_lo"),
                F.col("hi").alias("_hi"), F.col("children").alias("_children"), *shared)
            parts = runs.filter("hi - lo < n")
            inside = (F.col("tree") == F.col("_tree")) & (bucket == F.col("_bucket")) & (
                (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi")))
            step = _step(F.col("_children"), F.col("lo"), F.col("hi"))
            below = parts.join(parents, inside).withColumn("path", F.concat(F.array(step), F.col("path")))
            here = here.unionByName(below.select(*runs.columns, *shared))
        above = here
    return above


def manifest(rows: DataFrame, key: str, group: str, fields: Sequence[Column],
             changed: Sequence[Column] | None = None, when: Column | None = None,
             fanout: int = FANOUT) -> DataFrame:
    """key, group, rank, leaf, subroot, root, siblings and claimed of each row.

    `siblings` is an array of steps {before, after}, from the leaf's run to the root: the digests
    left and right of the path as one text each (a lone leaf is no run and has no step). `claimed` is the leaf to verify: that of the fields `changed` where `when` holds, else
    the leaf itself."""
    leaf = leaf_digest(fields)
    claimed = F.when(F.coalesce(when, F.lit(False)), leaf_digest(changed)) if changed is not None else F.lit(None).cast("string")
    leaves = cut(rows.select(
        F.col(key).alias("id"), F.col(group).alias("grp"), leaf.alias("digest"), claimed.alias("claimed"),
        F.monotonically_increasing_id().alias("row")))
    order = [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), "digest", "row"]
    ranked = cut(numbered(leaves, order, "number"))
    trees = ranked.groupBy("grp").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    trees = cut(numbered(trees, [F.col("grp").asc_nulls_first()], "tree"))
    most, count = trees.agg(F.max("n"), F.count("*")).first()
    own = trees.select(F.col("grp").alias("_grp"), "first", "n", (F.col("tree") - 1).cast("long").alias("tree"))
    placed = ranked.join(own, F.col("grp").eqNullSafe(F.col("_grp"))).select(
        "tree", "n", (F.col("number") - F.col("first")).cast("long").alias("lo"),
        (F.col("number") - F.col("first") + 1).cast("long").alias("hi"), "digest", "claimed", "id", "grp")
    levels = _climb(placed, most or 1, fanout, "claimed", "id", "grp")

    # the group roots are the leaves of one tree above
    roots = levels[0].filter("hi - lo = n").select("tree", "digest")
    for level in levels[1:]:
        roots = roots.union(level.filter("hi - lo = n").select("tree", "digest"))
    upper = roots.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"),
                         F.col("tree").alias("lo"), (F.col("tree") + 1).alias("hi"), "digest")
    upper = _climb(upper, count, fanout)
    none = F.array().cast("array<struct<before:string,after:string>>")
    top = upper[-1].select("tree", F.col("digest").alias("root"), none.alias("path"))
    up = _descend(upper, top, fanout).select("n", "children", "root", "path", F.explode("children").alias("c"))
    step = F.when(F.col("n") > 1, F.array(_step(F.col("children"), F.col("c.lo"), F.col("c.hi")))).otherwise(none)
    tops = up.select(F.col("c.lo").alias("tree"), F.col("c.digest").alias("subroot"), "root",
                     F.concat(step, F.col("path")).alias("path"))

    runs = _descend(levels, tops, fanout)
    each = runs.select("n", "children", "subroot", "root", "path", F.explode("children").alias("c"))
    own_step = F.when(F.col("n") > 1, F.array(_step(F.col("children"), F.col("c.lo"), F.col("c.hi")))).otherwise(none)
    return each.select(
        F.col("c.id").alias(key), F.col("c.grp").alias(group), F.col("c.lo").alias("rank"), F.col("c.digest").alias("leaf"),
        F.coalesce("c.claimed", "c.digest").alias("claimed"), "subroot", "root",
        F.concat(own_step, F.col("path")).alias("siblings"))


def proof_digest(siblings: Column) -> Column:
    """The hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(siblings, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf: Column, siblings: Column) -> Column:
    """The root that the leaf and these siblings give."""
    return F.aggregate(siblings, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))
