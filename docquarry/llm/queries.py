"""The subpackage's queries, one ``opN_<name>`` for each operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import chat, decontaminate, jaccard, lm, packing, pii, quality, reshard, topk, warc
from docquarry.llm.common import documents_only, table

#: The target mixture: equal parts of twenty sources.  Others follow when these are used up.
MIXTURE = {f"src{i}": 1.0 for i in range(20)}

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, with the items and their tiled coverage."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of documents linked by Jaccard 0.5 or more of their word 3-grams, and its links."""
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op3_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written as uneven shards, in one more and equal shards, the fewest bytes moved."""
    return reshard.evened(table(spark, sf_dir, "documents")).select("doc_id", "old_shard", "new_shard", "moved", F.length("text").alias("n_chars"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted in windows of 256 tokens with limited history."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier selects, with expected grade and tail probability."""
    docs = documents_only(table(spark, sf_dir, "documents"))
    return quality.select(docs, table(spark, sf_dir, "labels")).drop("text")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors, among all, of every vector whose id is divisible by 100."""
    return topk.nearest(table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed in windows of 2,048 tokens at equal shares of the named sources, whatever the corpus has of each."""
    return packing.pack(table(spark, sf_dir, "documents"), MIXTURE)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through WARC files that are read by byte ranges."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log-likelihood under the recurrent model trained on all documents."""
    return lm.log_likelihood(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold personal data: spans by label, and the redacted text."""
    return pii.entities(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_jaccard": op2_jaccard,
    "op3_reshard": op3_reshard,
    "op4_chat": op4_chat,
    "op5_quality": op5_quality,
    "op6_topk": op6_topk,
    "op7_packing": op7_packing,
    "op8_warc": op8_warc,
    "op9_lm": op9_lm,
    "op10_pii": op10_pii,
}

ORACLE_SQL: dict[str, str] = {
    "op2_jaccard": jaccard.ORACLE_SQL,
    "op3_reshard": reshard.ORACLE_SQL,
    "op4_chat": chat.ORACLE_SQL,
    "op6_topk": topk.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
}
