import hashlib
import string
import zlib

import pytest
from pyspark.sql import functions as F

from codestrata.llm import merkle
from codestrata.llm.queries import REGISTRY

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text=None):
    values = [row[0], row[2], row[3], row[4], row[1] if text is None else text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def fold(nodes, place, fanout=16):
    """(root, siblings left and right level by level) of the node at this place."""
    steps = []
    while len(nodes) > 1:
        runs = [nodes[i:i + fanout] for i in range(0, len(nodes), fanout)]
        run, at = runs[place // fanout], place % fanout
        steps.append((run[:at], run[at + 1:]))
        nodes, place = [h("".join(r)) for r in runs], place // fanout
    return nodes[0], steps


def plain(rows, fanout=16):
    """The rows of the query: (doc_id, text, lang, source, n_chars) as documents, source is row[2] here."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    roots = []
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        roots.append(fold([x[2] for x in groups[g]], 0, fanout)[0])
    out = []
    for number, g in enumerate(order):
        leaves = [x[2] for x in groups[g]]
        for place, (_, _, own, row) in enumerate(groups[g]):
            subroot, steps = fold(leaves, place, fanout)
            root, above = fold(roots, number, fanout)
            steps = steps + above
            proof = h("".join("".join(a + b) for a, b in steps))
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[1] is not None
            acc = leaf(row, row[1].translate(LOWER)) if tampered else own
            for a, b in steps:
                acc = h("".join(a) + acc + "".join(b))
            out.append((row[0], own, subroot, root, proof, acc, acc == root))
    return sorted(out, key=repr)


def documents(n, source, first=0):
    return [(i, f"Text Number {i} é", source, "en", i % 7 or None) for i in range(first, first + n)]


CASES = {
    "one row": documents(1, "a"),
    "one group": documents(300, "a"),
    "group sizes at the fanout": documents(16, "a") + documents(17, "b", 100) + documents(1, None, 200) + documents(257, "z", 300),
    "groups beyond the fanout": [r for g in range(40) for r in documents(1 + g % 3, f"g{g}", 10 * g)],
    "nulls, ties, repeated rows": [
        (None, None, None, None, None), (None, "X", None, None, 1), (5, "B", "s", "en", 1), (5, "A", "s", "en", 1), (5, "A", "s", "en", 1),
        (5, "A", "s", None, 1), (7, "", "", "", 0), (7, None, "", "", 0), (-3, "Long " * 20_000, "é", "en", 9), (-1, "ABC", "É", "en", 3)] * 3,
}


@pytest.mark.parametrize("case", CASES)
def test_query_equals_a_plain_tree(spark, tmp_path, case):
    rows = CASES[case]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(3)
    # further columns, with names that the operator uses itself
    frame.withColumn("leaf", F.lit(1)).withColumn("tree", F.lit("x")).withColumn("lo", F.lit(0)).write.parquet(f"{tmp_path}/documents.parquet")
    out = REGISTRY["op11_merkle_manifest"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, out.collect()), key=repr) == plain(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert REGISTRY["op11_merkle_manifest"](spark, str(tmp_path)).count() == 0


def test_other_fanout_and_rank(spark):
    rows = documents(30, "a") + documents(5, "b", 50)
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    out = merkle.manifest(frame, "doc_id", "source", fields, fanout=3)
    got = {r.doc_id: (r.rank, r.leaf, r.subroot, r.root, r.claimed) for r in out.collect()}
    want = {r[0]: r for r in plain(rows, 3)}
    assert all((leaf_, sub, root) == want[i][1:4] and claimed == leaf_ for i, (_, leaf_, sub, root, claimed) in got.items())
    assert [got[i][0] for i in range(30)] == list(range(30)) and [got[50 + i][0] for i in range(5)] == list(range(5))


def test_parents_meet_their_children_alone(spark):
    """Nothing is joined on the group: the runs of one group spread over its buckets."""
    frame = spark.createDataFrame(documents(2000, "a"), "doc_id long, text string, source string, lang string, n_chars long")
    out = merkle.manifest(frame, "doc_id", "source", [F.col("text")])
    assert out.count() == 2000 and out.select("root").distinct().count() == 1
    assert out.select(F.max(F.size("siblings"))).first()[0] == 3
    assert "CartesianProduct" not in out._jdf.queryExecution().toString()
