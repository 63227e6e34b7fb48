"""From raw documents to packed windows: five stages, each over all that the one before kept.

Each function takes (spark, docs, sf_dir) and returns a table that is stored and read again as the
next one's docs. All but the last return the columns of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import minhash, packing, pii, quality_rules, suffix_dedup
from codestrata.llm.common import cut, importable, shared_folder, table
from codestrata.llm.queries import PSEUDONYM_KEY, VOCABULARY

#: Near duplicates of the pipeline share 80 in 100 of their five-word shingles.
SIMILAR = 80
#: Bytes of a repeated passage that the pipeline removes (the first copy stays).
PASSAGE = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the thresholds of their language and source."""
    importable(spark)
    # a verdict follows from text, language and source, so these name the rows that go; ids need not be unique
    docs_ = docs.withColumn("__text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    rejected = quality_rules.judge(docs_, key="__text").filter(~F.col("kept")).select(
        F.col("doc_id").alias("_text"), F.col("lang").alias("_lang"), F.col("source").alias("_source")).distinct()
    same = (F.col("__text") == F.col("_text")) & F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    return docs_.join(rejected, same, "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of the least doc_id (null last), then the least row key.

    The key is a hash of id and text, so rows that share it are equal but for other columns; one of
    them stays. Texts without shingles are in no group and stay."""
    importable(spark)
    keyed = docs.withColumn("__key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    groups = minhash.near_duplicates(keyed, key="__key", percent=SIMILAR).filter("n_shingles > 0").select(
        F.col("doc_id").alias("__key"), "component_id").distinct()
    rows = cut(keyed.groupBy("__key").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")).join(groups, "__key"))
    order = F.struct(F.col("id").isNull(), "id", "__key")
    least = rows.groupBy("component_id").agg(F.min(order).alias("x")).select(F.col("x.__key").alias("__key"), F.lit(True).alias("stays"))
    named = cut(rows.join(least, "__key", "left").filter("stays IS NULL OR n > 1").select("__key", "stays"))
    single = keyed.join(named.select("__key"), "__key", "left_anti").select(docs.columns)
    repeated = named.filter("stays").select("__key")
    if repeated.isEmpty():
        return single
    # equal rows meet after a first choice in each task, not by the key of the join
    again = (keyed.join(repeated, "__key", "left_semi").withColumn("__one", F.col("__key").cast("string"))
             .dropDuplicates(["__one"]))
    return single.unionByName(again.select(docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier document or part holds."""
    importable(spark)
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cleaned = suffix_dedup.remove_repeats(docs, length=PASSAGE, keep_first=True, rest=(*rest, "text")).withColumn(
        "text", F.when(F.col("text").isNotNull(), F.decode("kept", "UTF-8")))
    if "n_chars" in rest:
        cleaned = cleaned.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return cleaned.select(docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal numbers, dates and addresses replaced."""
    importable(spark)
    return pii.pseudonymise(docs, PSEUDONYM_KEY, found="__findings").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents, in windows of several sizes."""
    importable(spark)
    return packing.pack(docs, VOCABULARY)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates),
          ("repeated passages", repeated_passages), ("pseudonyms", pseudonyms), ("packing", pack)]

#: Suffix arrays, keyed hashes and BPE have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each stored below the shared folder and read again."""
    importable(spark)
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
