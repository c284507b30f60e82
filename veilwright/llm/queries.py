"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_tokens, decontamination, exact_dedup, hard_negatives, html_text, jaccard_join, language_id, packing, pii, sentencepiece_codec, sharding, spelling, warc
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, _ = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, "contaminated")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    pages = html_text.extract(pages, weights=html_text.fit_weights(pages))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_components(table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, as a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = byte_tokens.count_tokens(docs, vocabulary("byte_bpe_50k.tiktoken"), pattern())
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))
    out, _ = language_id.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def _equals(k: int):
    return lambda x: x == k


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    names = F.transform("base", lambda x: x["k"])
    counts = [F.size(F.filter(names, _equals(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS[:4])]
    plain = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end")))
    return found.select("doc_id", *counts, F.sha2(pii.listed(plain), 256).alias("base_sha256"), pii.listed(pii.all_spans(F.col("base"), F.col("terms"))).alias("spans"))


def op9_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packs = packing.pack(docs, vocabulary("byte_bpe_50k.tiktoken"), pattern())
    return packs.withColumn("position_resets", F.slice("cu_seqlens", F.lit(1), F.size("cu_seqlens") - 1))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sentencepiece_codec.encode_and_decode(docs, vocabulary("piece_bpe_32k.model"))
    return out.select("doc_id", "n_pieces", F.sha2("ids", 256).alias("ids_sha256"), "exact")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"), slips=199)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.prepared(vectors.withColumn("label", label)))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sharding.assign(docs, "doc_id", [1.0] * 16, [1.0]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "grown_shard", "order")
    return sharding.place(rows, "doc_id", ["size", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
