from collections import Counter

import pytest
from pyspark.sql import functions as F

from codestrata.llm import sharding


def shards(spark, n, weights, **kw):
    return {r.id: r.shard for r in sharding.assign(spark.range(n), ["id"], weights, **kw).collect()}


def test_more_shards_take_records_only_into_themselves(spark):
    few, many = shards(spark, 5000, [1.0] * 7), shards(spark, 5000, [1.0] * 8)
    moved = [k for k in few if few[k] != many[k]]
    assert {many[k] for k in moved} == {7} and 450 < len(moved) < 800


def test_weights(spark):
    n = Counter(shards(spark, 20_000, [1.0, 3.0]).values())
    assert abs(n[1] / 20_000 - 0.75) < 0.02
    heavier = shards(spark, 5000, [1.0, 2.0, 1.0])
    same = shards(spark, 5000, [1.0, 1.0, 1.0])
    assert {heavier[k] for k in same if same[k] != heavier[k]} == {1}
    with pytest.raises(ValueError):
        sharding.rendezvous_shard(["id"], [1.0, 0.0])


def test_the_key_alone_decides(spark):
    a = shards(spark, 300, [1.0] * 5)
    b = {r.id: r.shard for r in sharding.assign(spark.range(100, 200).repartition(3), ["id"], [1.0] * 5).collect()}
    assert all(a[k] == v for k, v in b.items())


def test_slots_have_no_gap(spark):
    rows = spark.range(1000).withColumn("slot", F.lit("clash")).unionAll(spark.range(50).withColumn("slot", F.lit("x")))
    rows = rows.unionAll(spark.createDataFrame([(None, "n"), (None, "n")], "id long, slot string"))
    for bucket_rows in (20_000, 10):
        out = sharding.with_slots(sharding.assign(rows, ["id"], [1.0] * 4), "shard", ["id"], bucket_rows=bucket_rows).collect()
        assert len(out) == 1052
        for s in range(4):
            slots = sorted(r.slot for r in out if r.shard == s)
            assert slots == list(range(len(slots)))
    empty = sharding.assign(spark.range(0), ["id"], [1.0] * 4)
    assert sharding.with_slots(empty, "shard", ["id"]).count() == 0


def test_null_and_equal_keys_are_dealt_over_the_buckets(spark):
    """A third of the rows has no key, a third one key: no bucket holds much more than its share."""
    keys = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id"))
    rows = sharding.assign(spark.range(6000).select(keys.alias("key"), F.col("id").alias("other")), ["key"], [1.0] * 3)
    out = sharding.with_slots(rows, "shard", ["key"], bucket_rows=500)
    for s, group in out.toPandas().groupby("shard"):
        assert sorted(group.slot) == list(range(len(group)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan
    numbered = [c for c in plan.split("\n") if "row_number" in c]
    assert numbered and all("__bucket" in c for c in numbered)
    stored = out.select("key", "shard").count()
    assert stored == 6000


def test_query_follows_its_law(spark, docs, tmp_path):
    """The registered query against crc32, sizes and the draws of a plain loop."""
    import zlib
    texts = [(i, t, "en", "s") for i, t in enumerate(["a", None, "", "é" * 30, "x" * 5000] * 20)] + [(None, "n", "en", "s")] * 40 + [(5, "n", "en", "s")] * 40
    docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    from codestrata.llm.queries import REGISTRY
    out = REGISTRY["op2_rendezvous_shards"](spark, str(tmp_path)).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in texts)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want and {r.law for r in out} == {"key"}
    by_key = {}
    for r in out:
        by_key.setdefault(r.doc_id, set()).add((r.shard, r.grown_shard))
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    assert all(len(v) == 1 for v in by_key.values())
    for shard in {r.shard for r in out}:
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots)))
