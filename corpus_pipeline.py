"""From raw documents to packed training windows, in five stages.

Each stage takes all that the one before kept.  Stages but the last return the columns of
``documents``; the last returns windows with their documents' ids and pieces of text.

Defined cases: every stage judges rows by their own text, so ids may be null or repeat.  Texts without a word (null, empty,
white space or marks alone) have no quality and go with the first stage.  Of repeated rows the second stage keeps one; rows of
a null id are no copies of others and stay there, and are redacted and packed with the rest.  Of ties for the
least id of a group any one row stays.  Very long texts are read whole by every stage.  Extra columns, whatever their
names, pass through all stages but the last.  An empty table gives no window; without labels every text with words
stays, without a benchmark none is contaminated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import decontaminate, jaccard, packing, pii, quality
from docquarry.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier selects; low grades go."""
    return quality.kept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of copies and near copies, that of the least id."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its label."""
    return pii.redact(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens in windows at the corpus's proportions of sources."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", select_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack_windows),
]

#: SQL can express neither the classifier nor the random field; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
