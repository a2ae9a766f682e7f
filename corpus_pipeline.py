"""From raw documents to packed training sequences, in five stages.

Each stage gets what the one before it kept, stored as Parquet, and all but the last return the columns
of ``documents``. SQL cannot express the classifier or the field, so there is none.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftgrid.llm import decontam, packing, quality, secretscan, simhash
from liftgrid.llm.common import discard, store, table
from liftgrid.llm.queries import METADATA

ORACLE_SQL = None

#: Near copies: fingerprints of two-word shingles at six bits or fewer. That is the distance at
#: which texts are expected whose five-word shingles have a similarity of 0.8; fingerprints of five
#: words would be nine bits apart, which no exact search over many documents can reach.
SHINGLE_WORDS, MAX_BITS = 2, 6


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers accept: of good quality and not toxic.

    Null and empty texts are judged by their metadata, in which a null is a value; repeated rows are judged alike. Columns
    named as the classifiers' results stay as they are. An empty table gives an empty table.
    """
    models = quality.train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", METADATA)
    hidden = {c: fresh(docs, f"_{c}") for c in ("p_quality", "p_toxic", "keep") if c in docs.columns}
    judged = quality.judge(docs.withColumnsRenamed(hidden), models, "text", METADATA).where("keep")
    return judged.select(*[F.col(hidden.get(c, c)).alias(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of exact and near copies; a null id is larger than any.

    Of rows alike in id and text one stays; rows with one id and different texts are documents of their own. Null and empty
    texts are copies of each other. An empty table gives an empty table.
    """
    key = fresh(docs, "key")
    name = F.struct(
        F.col("doc_id").isNull().alias("none"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.sha2(F.to_json(F.struct("text")).cast("binary"), 256).alias("digest"),
    )
    keyed = docs.withColumn(key, name)
    found = simhash.near_duplicates(keyed, key, "text", SHINGLE_WORDS, MAX_BITS)
    first = found.where(F.col(key) == F.col("component")).select(key).distinct()
    return keyed.join(first, key, "left_semi").dropDuplicates([key]).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, copied or paraphrased.

    What a row holds follows from its text, so rows go by its digest: an id may be null or repeated. Null and empty texts
    stay, as do all documents where there is no benchmark item. An empty table gives an empty table.
    """
    digest = fresh(docs, "digest")
    rows = docs.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    leaks = decontam.find_leaks(rows, digest, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return rows.join(leaks.select(digest).distinct(), digest, "left_anti").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and ``n_chars`` that of the masked text; both stay null for a null text.

    Repeated rows are masked alike. An empty table gives an empty table.
    """
    clean = secretscan.redact(docs, "text", secretscan.fit(docs, "doc_id", "text"))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in windows of 2048 ids.

    A null or empty text has its end id only; repeated rows are packed each. An empty table gives no pieces.
    """
    tokenizer, ranks = map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
    _, packed = packing.pack_documents(docs, "doc_id", "text", tokenizer, ranks)
    return packed.drop("row").withColumnRenamed("k", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_copies", drop_copies),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on ``documents``. A stage's table goes once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
