"""Rendezvous hashing of record keys over weighted shards.

Each shard draws a number for a key from a hash of both; with u uniform in (0, 1), the shard of
largest -weight / ln(u) wins. The key, the weights and the seed alone decide, whatever else the
table holds, and a new shard takes only the records in which it outdraws all others. The draws are
one expression over the row; no shuffle is needed.

`with_slots` numbers a shard's rows from 0 without a gap: rows are dealt into buckets of about equal
size by a row number, not by their key, and stored; the buckets' counts are summed up in a small
table. So no shard, and no group of rows with a null or equal key, is sorted in one task.

A null key is a key like others (its hash is the seed's). Repeated rows go to the same shard and to
slots of their own, in any order. Added columns replace columns of the same name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import cut

#: Rows of a bucket, over all shards, that are numbered together.
BUCKET_ROWS = 20_000
SEED = 20_240_601


def rendezvous_shard(keys: Sequence[str], weights: Sequence[float], seed: int = SEED) -> Column:
    """The shard (0 to len(weights) - 1) of the key in these columns."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")

    def draw(shard: int) -> Column:
        h = F.xxhash64(F.lit(seed), F.lit(shard), *map(F.col, keys))
        u = (F.shiftrightunsigned(h, 12).cast("double") + 0.5) * F.lit(2.0 ** -52)
        return F.struct((F.lit(float(weights[shard])) / -F.log(u)).alias("score"), F.lit(-shard).alias("shard"))

    if len(weights) == 1:
        return F.lit(0)
    return -F.greatest(*(draw(s) for s in range(len(weights))))["shard"]


def assign(df: DataFrame, keys: Sequence[str], weights: Sequence[float], into: str = "shard") -> DataFrame:
    return df.withColumn(into, rendezvous_shard(keys, weights))


def with_slots(df: DataFrame, shard: str, order: Sequence[str], into: str = "slot",
               bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows with their number in the shard, from 0 without a gap.

    One count of the table sets the number of buckets; within a bucket rows follow `order`."""
    bucket, first = "__bucket", "__first"
    # stored, for a second evaluation might give the rows other numbers
    rows = cut(df.withColumn(bucket, F.monotonically_increasing_id()))
    put = rows.withColumn(bucket, F.pmod(F.xxhash64(F.lit(SEED), F.col(bucket)), F.lit(rows.count() // bucket_rows + 1)))
    counts = put.groupBy(shard, bucket).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(
        shard, bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(first))
    number = F.row_number().over(Window.partitionBy(shard, bucket).orderBy(*order))
    return (put.withColumn(into, number - 1)
            .join(firsts, [shard, bucket])
            .withColumn(into, (F.col(into) + F.col(first)).cast("long"))
            .drop(bucket, first))
