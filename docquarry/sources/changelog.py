"""The change log and its fold into a state.

Rows are ``(seq, op, index, doc_id, doc, settings)``.  Folding is idempotent: replaying a log over a snapshot that already
holds part of it gives the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "seq long, op string, index string, doc_id string, doc string, settings string"
CREATE_INDEX, DELETE_INDEX, UPDATE_SETTINGS, ADD_DOC, DELETE_DOC = "CREATE_INDEX", "DELETE_INDEX", "UPDATE_SETTINGS", "ADD_DOC", "DELETE_DOC"


def read_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON lines; blank and malformed ones are skipped."""
    return spark.read.schema(SCHEMA).json(path, mode="DROPMALFORMED").where("op is not null")


def _lives(log: DataFrame) -> DataFrame:
    """``(index, born)`` of the indexes that exist at the end: created after they were last deleted."""
    marks = log.groupBy("index").agg(F.max(F.when(F.col("op") == DELETE_INDEX, F.col("seq"))).alias("gone"))
    made = log.where(F.col("op") == CREATE_INDEX).select("index", "seq").join(marks, "index").where("gone is null or seq > gone")
    return made.groupBy("index").agg(F.min("seq").alias("born"))


def fold_documents(log: DataFrame) -> DataFrame:
    """``(index, doc_id, doc)`` that the log leaves: the last word on each document of each living index."""
    words = log.where(F.col("op").isin(ADD_DOC, DELETE_DOC)).where("op = 'DELETE_DOC' or doc is not null").join(_lives(log), "index").where("seq > born")
    last = Window.partitionBy("index", "doc_id").orderBy(F.desc("seq"))
    return words.withColumn("_n", F.row_number().over(last)).where((F.col("_n") == 1) & (F.col("op") == ADD_DOC)).select("index", "doc_id", "doc")


def fold_settings(log: DataFrame) -> DataFrame:
    """``(index, settings)`` of each living index; null where none were set."""
    lives = _lives(log)
    last = Window.partitionBy("index").orderBy(F.desc("seq"))
    given = log.where(F.col("op") == UPDATE_SETTINGS).join(lives, "index").where("seq > born").withColumn("_n", F.row_number().over(last)).where("_n = 1").select("index", "settings")
    return lives.select("index").join(given, "index", "left")


def after(log: DataFrame, snapshot_seq: int) -> DataFrame:
    """What a snapshot leaves of the log."""
    return log.where(F.col("seq") > snapshot_seq)
