"""The registered queries over whole tables: thin digests of what the operators return."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import (
    bpe, html_text, knn, language_id, lexical, merkle, minhash, packing, pii, quality_rules, sharding,
    sketch, suffix_dedup,
)
from codestrata.llm.common import importable, table

#: The vocabulary of the queries; any file of byte-level BPE will do.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The key of the pseudonyms; a secret in production.
PSEUDONYM_KEY = "example key"
SHARDS = 24

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return f(spark, sf_dir)

    REGISTRY[f.__name__] = run
    return f


@query
def op1_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query
def op2_rendezvous_shards(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"))
    dealt = sharding.assign(sharding.assign(docs, ["doc_id"], [1.0] * SHARDS),
                            ["doc_id"], [1.0] * (SHARDS + 1), "grown_shard")
    return sharding.with_slots(dealt, "shard", ["doc_id"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query
def op3_feistel_pseudonyms(spark, sf_dir):
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY).select(
        "doc_id", "text", *pii.counts())


@query
def op4_adaptive_quality(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op5_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(
        table(spark, sf_dir, "documents"), length=400, keep_first=False, whole_characters=False,
    ).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
             F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


@query
def op6_hierarchical_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
        "offset", "tier", "step_group")


@query
def op7_rank_order_language(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


@query
def op8_cover_tree_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return knn.top_k(vectors, vectors.filter("vec_id % 20 = 0"))


@query
def op9_minimum_cut_text(spark, sf_dir):
    return html_text.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op10_bpe_automaton(spark, sf_dir):
    docs = bpe.encode_documents(
        table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY, decoded="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return docs.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op11_merkle_manifest(spark, sf_dir):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    folded = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    rows = merkle.manifest(
        table(spark, sf_dir, "documents"), "doc_id", "source", [*fields, F.col("text")],
        changed=[*fields, folded], when=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    return rows.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("siblings")).alias("proof_sha256"),
        merkle.folded(F.col("claimed"), F.col("siblings")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op12_scaled_sketch(spark, sf_dir):
    return sketch.against_edits(table(spark, sf_dir, "documents"))


@query
def op13_hybrid_ranked_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
