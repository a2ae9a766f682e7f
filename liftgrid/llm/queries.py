"""One query per operator, with production settings over whole tables, and SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftgrid.llm import (
    convrepair,
    decontam,
    embedgroups,
    packing,
    quality,
    secretscan,
    sharding,
    simhash,
    suffixdedup,
    urlfilter,
    vectorcodes,
    warc,
    wordcodes,
)
from liftgrid.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 16

RULES = [
    urlfilter.subtree("block", "net/"),
    urlfilter.subtree("allow", "example.net/en/"),
    urlfilter.subtree("block", "example.com/de/"),
    urlfilter.subtree("allow", "org/fr/"),
]


def op1_proportional_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards that match the mixture of sources."""
    docs = table(spark, folder, "documents").select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return sharding.interleave(docs, F.col("source"), order, SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_capture_index(spark: SparkSession, folder: str) -> DataFrame:
    """Write every page to archives, index them, and read each back through the index."""
    pages = table(spark, folder, "pages")
    captures = warc.write_archives(pages, "page_id", "url", F.col("html").cast("binary"))
    index = warc.build_index(captures)
    wanted = pages.select(warc.surt(F.col("url")).alias("surt"), F.col("page_id").alias("k")).distinct()
    parts = warc.parts_for(captures)
    return warc.read_records(warc.lookup(index, wanted, parts), parts).select(
        F.col("k").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP2_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), g AS (
  SELECT page_id, octet_length(payload) AS n, sha1(payload) AS hash, min(page_id) OVER (PARTITION BY payload) AS first FROM p
)
SELECT page_id, n AS payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
      (CAST('0x' || substr(hash, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31)::INT, 1)
    FOR i IN range(32)], 'string_agg', '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM g
"""


def op3_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.93 within a label."""
    found = embedgroups.near_vectors(table(spark, folder, "embeddings"), "vec_id", "embedding", "label", least=0.93)
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), "kept")


def op4_sparse_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the bytes of repeated strings."""
    found = suffixdedup.remove_repeats(table(spark, folder, "documents"), "doc_id", "text")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_wildcard_urls(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every page's URL."""
    return urlfilter.filter_urls(table(spark, folder, "pages"), "page_id", "url", RULES)


def op6_bin_slack(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in windows of 2048 ids."""
    tokenizer, ranks = map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
    _, packed = packing.pack_documents(table(spark, folder, "documents"), "doc_id", "text", tokenizer, ranks)
    return packed.select(
        F.col("k").alias("doc_id"),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op7_latent_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    docs, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontam.find_leaks(docs, "doc_id", "text", benchmark, "item_id", "text").select("doc_id", "item_id", "cosine", "share", "answer")


def op8_secret_field(spark: SparkSession, folder: str) -> DataFrame:
    """All spans of secrets in every document."""
    docs = table(spark, folder, "documents")
    found = secretscan.scan(docs, "doc_id", "text", secretscan.fit(docs, "doc_id", "text"))
    named = F.transform("spans", lambda s: F.concat_ws(":", s.kind, s.start, s.end))
    base = F.transform(
        F.filter("spans", lambda s: s.kind != "crf"), lambda s: F.concat_ws(":", s.kind, s.start, s.end)
    )

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(named, ",").alias("spans"),
    )


METADATA = ["lang", "source", "n_chars"]


def op9_cotrained_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality and toxicity of every document, and whether it stays."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    models = quality.train(docs, labels, "doc_id", "text", METADATA)
    return quality.judge(docs, models, "text", METADATA).select("doc_id", "p_quality", "p_toxic", "keep")


def op10_simhash_pivots(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    found = simhash.near_duplicates(table(spark, folder, "documents"), "doc_id", "text", words=3, max_bits=2)
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op11_word_transducer(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document, and what they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = wordcodes.encode(table(spark, folder, "documents"), "doc_id", "text", path)
    coded = coded.select("k", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return wordcodes.decode(coded, "k", "ids", path, "n_tokens", "ids_sha256").select(
        F.col("k").alias("doc_id"), "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )


def op12_active_codes(spark: SparkSession, folder: str) -> DataFrame:
    """The code of every vector in 16 parts of 64 entries after two rounds."""
    coded, books = vectorcodes.encode(table(spark, folder, "embeddings"), "vec_id", "embedding", "label")
    digest = F.lit(None).cast("string")
    for length, book in books.items():
        digest = F.when(F.col("length") == length, F.lit(book.digest())).otherwise(digest)
    return vectorcodes.with_label_error(coded).select(
        F.col("k").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256")
    )


def op13_conversation_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and the cheapest repair of every conversation."""
    pieces = convrepair.repair(table(spark, folder, "conversations"), "conv_id", "turn", "role", "text")
    return convrepair.digests(pieces).select(
        F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


OP5_SQL = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rule, verdict, suffix, start) AS (
  VALUES ('net/', 'block', '.net', '/'), ('example.net/en/', 'allow', '.example.net', '/en/'),
         ('example.com/de/', 'block', '.example.com', '/de/'), ('org/fr/', 'allow', '.org', '/fr/')
), hits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON ends_with('.' || host, suffix) AND starts_with(path, start)
  GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN hits h USING (page_id)
"""

QUERIES: dict[str, Query] = {
    "op1_proportional_shards": op1_proportional_shards,
    "op2_capture_index": op2_capture_index,
    "op3_multi_index": op3_multi_index,
    "op4_sparse_suffixes": op4_sparse_suffixes,
    "op5_wildcard_urls": op5_wildcard_urls,
    "op6_bin_slack": op6_bin_slack,
    "op7_latent_leaks": op7_latent_leaks,
    "op8_secret_field": op8_secret_field,
    "op9_cotrained_quality": op9_cotrained_quality,
    "op10_simhash_pivots": op10_simhash_pivots,
    "op11_word_transducer": op11_word_transducer,
    "op12_active_codes": op12_active_codes,
    "op13_conversation_paths": op13_conversation_paths,
}

ORACLE: dict[str, str] = {"op2_capture_index": OP2_SQL, "op5_wildcard_urls": OP5_SQL}
