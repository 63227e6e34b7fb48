"""Near-duplicate detection by an inverted join of signature coordinates.

1. Each text becomes a signature: for 64 hash functions the least hash of its word shingles. Texts
   with equal shingle sets are one class, named by its least doc_id; only classes go on.
2. Classes are posted under each (coordinate, value). Similar classes agree in at least `matches`
   coordinates (the chance that a pair at the similarity bound does not is `miss_chance`), so they
   share a list among any 64 - matches + 1 of them. These prefixes are taken rarest value first;
   values met once match nothing, and the long lists are skipped.
3. The lists' members are merged by the lists' hubs, the members whose values are commonest. A member
   that collides with a hub in prefix lists is counted against it over all coordinates, the skipped
   lists by lookup in both signatures. Pairs with enough matches are confirmed on the full shingle
   sets; the confirmed are links, whose components follow.
4. Families (members of the lists of one hub) that still hold several components are compared in
   blocks, each pair in the first family that it shares and only while its ends are unconnected; what
   is above the match threshold is confirmed on the full sets there and then. So every pair of a
   prefix list has been compared or is connected, and no task lists the pairs of a group.

Words are runs other than space and U+0009 to U+000D, A-Z folded. A text of fewer words than a
shingle has is one shingle; without words (or null) a text has none and is linked with nothing. Rows
that share a doc_id are one document; a null doc_id is never a class's name, and rows of a class
without any doc_id have no component and are kept. Only the two named columns are read."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import cut, slices
from codestrata.llm.components import components
from codestrata.llm.words import Words, mix, random_words

COORDINATES = 64
SHINGLE = 5
#: Members of a family that are compared with as many others in one task.
BLOCK = 128
#: Greatest chance that a pair at the similarity bound stays below the match threshold.
MISS = 1e-8


def miss_chance(matches: int, percent: int, coordinates: int = COORDINATES) -> float:
    p = percent / 100
    return sum(comb(coordinates, i) * p ** i * (1 - p) ** (coordinates - i) for i in range(matches))


def match_threshold(percent: int, coordinates: int = COORDINATES) -> int:
    """The most matches that a pair of this similarity falls short of with a chance of MISS at most."""
    return max(m for m in range(1, coordinates + 1) if m == 1 or miss_chance(m, percent, coordinates) <= MISS)


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    return random_words(11, n) | np.uint64(1), random_words(12, n)


def shingles(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes, in text order, and the bounds of each text among them."""
    h, text = Words(data, bounds, fold=True).shingles(width)
    return h, np.searchsorted(text, np.arange(len(bounds)))


def signatures(docs: DataFrame, key: str, text: str, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (a 128-bit name of the shingle set), signature."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, flip = _functions(COORDINATES)
        for batch in batches:
            for first, end, data, bounds in slices(batch.column(1)):
                h, at = shingles(data, bounds, width)
                n = end - first
                sizes, names = np.zeros(n, np.int64), np.zeros((2, n), np.uint64)
                values = np.zeros((n, COORDINATES), np.int32)
                own = np.flatnonzero(np.diff(at))
                for i in own:
                    distinct = np.unique(h[at[i]:at[i + 1]])
                    sizes[i] = len(distinct)
                    names[0, i], names[1, i] = mix(distinct).sum(), mix(distinct ^ flip[0]).sum()
                for k in range(COORDINATES if len(own) else 0):
                    least = np.minimum.reduceat((h ^ flip[k]) * factor[k], at[own])
                    values[own, k] = (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, n), pa.array(sizes), pa.array(names[0].view(np.int64)),
                    pa.array(names[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * COORDINATES),
                                             pa.array(values.ravel()))],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(
        sign, "doc_id long, n_shingles long, set_a long, set_b long, signature array<int>")


def shingle_sets(docs: DataFrame, key: str, text: str, ids: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(id, shingles): the sorted full shingle sets of these documents, 8 bytes a shingle."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for first, end, data, bounds in slices(batch.column(1)):
                h, at = shingles(data, bounds, width)
                ids, sets = [], []
                for i, a, b in zip(batch.column(0).slice(first, end - first).to_pylist(), at[:-1], at[1:], strict=True):
                    one = np.unique(h[a:b]).tobytes()
                    if (i, hash(one)) not in seen:  # repeated rows bring a set once
                        seen.add((i, hash(one)))
                        ids.append(i)
                        sets.append(one)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["id", "shingles"])

    wanted = docs.select(F.col(key).cast("long").alias("id"), F.col(text)).join(ids, "id", "left_semi")
    return wanted.mapInArrow(gather, "id long, shingles binary")


def prefix_postings(classes: DataFrame, matches: int) -> DataFrame:
    """(id, list, members, weight): the rarest 64 - matches + 1 lists of each class, without lists of
    one member; weight is how common the class's values are."""
    value = F.expr("transform(signature, (v, k) -> shiftleft(CAST(k AS LONG), 32) | (CAST(v AS LONG) & 4294967295L))")
    postings = classes.select("id", F.explode(value).alias("list"))
    shared = postings.groupBy("list").agg(F.count("*").alias("members")).filter("members > 1")
    per_class = postings.join(shared, "list").groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("members", "list"))).alias("lists"),
        F.sum("members").alias("weight"))
    # lists of one member are the rarest: they fill the prefix first
    return per_class.select("id", "weight", F.explode(F.expr(
        f"slice(lists, 1, greatest(0, size(lists) - {matches - 1}))")).alias("x")).select(
        "id", "weight", "x.list", "x.members")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def families(postings: DataFrame) -> DataFrame:
    """(hub, id, met): the members of all lists that have the same hub, which is one of them, and in
    how many lists each meets it. Those who share a list share a family."""
    hubs = postings.groupBy("list").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("hub"))
    return postings.join(hubs, "list").groupBy("hub", "id").agg(F.count("*").alias("met"))


def hub_pairs(family: DataFrame, classes: DataFrame, matches: int, percent: int) -> DataFrame:
    """(a, b): members and their hubs, with enough matches."""
    met = family.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    x = classes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("x"))
    y = classes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("y"))
    alike = F.expr("aggregate(zip_with(x, y, (p, q) -> int(p = q)), 0, (s, e) -> s + e)")
    return (met.join(x, "a").join(y, "b")
            .filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
            .filter(alike >= matches).select("a", "b"))


def meetings(family: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """(hub, id, component, own, others): the block of each member of a mixed family and those it meets.

    Members of a family's largest component are connected already: their blocks meet the blocks of
    the rest only, so a family of m members with s outside that component moves some 2 m s / block rows."""
    named = family.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    mixed = named.groupBy("hub", "component").agg(F.count("*").alias("members")).groupBy("hub").agg(
        F.max_by("component", F.struct("members", "component")).alias("main"),
        F.max("members").alias("inside"), F.sum("members").alias("size"), F.count("*").alias("n")
    ).filter("n > 1").select(
        "hub", "main", F.expr(f"CAST(ceil(inside / {block}) AS INT)").alias("first"),
        F.expr(f"CAST(ceil(inside / {block}) + ceil((size - inside) / {block}) AS INT)").alias("blocks"))
    return named.join(mixed, "hub").select(
        "hub", "id", "component",
        F.expr("IF(component = main, pmod(xxhash64(id), first), first + pmod(xxhash64(id), blocks - first))").cast("int").alias("own"),
        F.expr("sequence(IF(component = main, first, 0), blocks - 1)").alias("others"))


def rest_links(family: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame,
               matches: int, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b): links between components that meet in a family, at least one for each two of them.

    A pair is looked at in the first family that it shares. Only links leave the task."""
    own_hubs = family.groupBy("id").agg(F.array_sort(F.collect_list("hub")).alias("hubs"))
    dealt = (meetings(family, labels, block).join(own_hubs, "id").join(classes, "id").join(sets, "id")
             .withColumn("other", F.explode("others"))
             .select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     "own", "id", "component", "hubs", "signature", "shingles"))

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ids, component, own = (rows.column(c).to_numpy().copy() for c in ("id", "component", "own"))
        this, i, j = (rows.column(c)[0].as_py() for c in ("hub", "i", "j"))
        values = rows.column("signature").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        earlier = [np.array([x for x in r if x < this], np.int64) for r in rows.column("hubs").to_pylist()]
        holder = np.repeat(np.arange(len(ids)), [len(e) for e in earlier])
        earlier_hubs = np.concatenate(earlier)
        hashes = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.column("shingles").combine_chunks()]
        sizes = np.array([len(x) for x in hashes])
        at = np.concatenate(([0], np.cumsum(sizes)))
        names, flat = np.unique(np.concatenate(hashes), return_inverse=True)
        mine = np.zeros(len(names), bool)
        out = []
        for r in np.flatnonzero(own == i):
            maybe = (component != component[r]) & (own == j) & (
                100 * np.minimum(sizes, sizes[r]) >= percent * np.maximum(sizes, sizes[r]))
            if i == j:
                maybe &= ids > ids[r]
            maybe[holder[np.isin(earlier_hubs, earlier[r])]] = False
            rest = np.flatnonzero(maybe)
            rest = rest[(values[rest] == values[r]).sum(1) >= matches]
            if not len(rest):
                continue
            mine[flat[at[r]:at[r + 1]]] = True
            both = np.array([np.count_nonzero(mine[flat[at[x]:at[x + 1]]]) for x in rest])
            mine[flat[at[r]:at[r + 1]]] = False
            hits = rest[100 * both >= percent * (sizes[rest] + sizes[r] - both)]
            if len(hits):
                joined, first = np.unique(component[hits], return_index=True)
                out += [(min(ids[r], ids[x]), max(ids[r], ids[x])) for x in hits[first]]
                component[np.isin(component, joined)] = component[r]
        return pa.table({"a": pa.array([int(x) for x, _ in out], pa.int64()),
                         "b": pa.array([int(y) for _, y in out], pa.int64())})

    return dealt.groupBy("hub", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85,
                    width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), kept (it is the least).

    Two documents are linked if the similarity of their shingle sets is `percent` or more."""
    matches = match_threshold(percent)
    signed = cut(signatures(docs, key, text, width))
    sets = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b", "n_shingles").agg(
        F.min("doc_id").alias("id"), F.first("signature").alias("signature"))
    sets = cut(sets)
    classes = sets.select("id", F.col("n_shingles").alias("n"), "signature")
    family = cut(families(cut(prefix_postings(classes, matches))))
    full = cut(shingle_sets(docs, key, text, family.select("id").distinct(), width))
    links = cut(confirmed(hub_pairs(family, classes, matches, percent), full, percent))
    more = rest_links(family, components(links), classes, full, matches, percent)
    labels = components(links.union(more))
    named = sets.drop("signature").join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        "set_a", "set_b", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return (signed.drop("signature").join(named, ["set_a", "set_b", "n_shingles"], "left")
            .select("doc_id", "n_shingles", F.expr("CASE WHEN n_shingles = 0 THEN doc_id ELSE component_id END").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
