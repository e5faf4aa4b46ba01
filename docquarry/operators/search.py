"""Term expansion, boolean retrieval, scores, vectors and highlights, for any number of queries in one plan.

``query_id`` runs through every step, so a batch of queries is one job: two aggregations by document and no
loop over queries.  The query relation is broadcast while it is small; the expanded terms are left to the
optimizer, since a short prefix may match much of the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions.geo import cosine_column
from docquarry.functions.text import osa_column, osa_possible, osa_within_one
from docquarry.plans.query import QueryTerm

#: Query terms broadcast at most; a larger batch is joined by shuffle.
BROADCAST_TERMS = 10_000
VECTOR_WEIGHT = 20.0
RANK = ("score", "words", "typos", "exact")


def query_relation(spark: SparkSession, terms: Sequence[QueryTerm]) -> DataFrame:
    rows = spark.createDataFrame([(t.query_id, t.kind, t.ord, t.term, t.k) for t in terms], "query_id int, kind string, ord int, query_term string, k int")
    return F.broadcast(rows) if len(terms) <= BROADCAST_TERMS else rows


def expand(queries: DataFrame, bigrams: DataFrame, most_typos: int = 2, exact_only: bool = False) -> DataFrame:
    """``(query_id, kind, ord, term, dist)``: vocabulary terms that a query term matches.

    Candidates share the query term's first two characters somewhere; of these match the term itself, terms it
    begins (at any distance, even with no typo allowed) and terms within its typos.  With ``exact_only``, a query term that
    is in the vocabulary matches itself alone; one that is not matches as before.
    """
    found = _expanded(queries, bigrams, most_typos)
    if not exact_only:
        return found
    direct = Window.partitionBy("query_id", "kind", "ord")
    return found.withColumn("_best", F.min("dist").over(direct)).where("dist = 0 or _best > 0").drop("_best")


def _expanded(queries: DataFrame, bigrams: DataFrame, most_typos: int) -> DataFrame:
    key = F.substring("query_term", 1, 2)
    pairs = queries.join(bigrams, F.col("bigram") == key).drop("bigram")
    q, t, k = F.col("query_term"), F.col("term"), F.col("k")
    prefix = (F.octet_length(q) >= 2) & t.startswith(q)
    native = F.when(q == t, 0).when(prefix, F.length(t) - F.length(q)).when((k >= 1) & osa_within_one(q, t), 1)
    pairs = pairs.withColumn("dist", native)
    columns = ["query_id", "kind", "ord", "term", "dist"]
    near = pairs.where("dist is not null").select(columns)
    if most_typos < 2:
        return near
    further = pairs.where(F.col("dist").isNull() & (k >= 2) & osa_possible(q, t, 2)).withColumn("dist", osa_column(q, t)).where("dist <= k")
    return near.unionByName(further.select(columns))


def exact_terms(queries: DataFrame) -> DataFrame:
    """Matches of the query terms alone."""
    return queries.select("query_id", "kind", "ord", F.col("query_term").alias("term"), F.lit(0).alias("dist"))


def token_matches(matched: DataFrame, postings: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Per query token and document: fewest typos, whether exact, greatest field weight and their score."""
    weight = F.lit(1.0)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("field") == name, F.lit(float(value))).otherwise(weight)
    hits = postings.select("term", "doc_id", weight.alias("w")).join(matched, "term")
    found = hits.groupBy("query_id", "kind", "ord", "doc_id").agg(F.min("dist").cast("long").alias("typos"), F.max("w").alias("w"), F.max((F.col("dist") == 0).cast("long")).alias("exact"))
    return found.withColumn("score", (10 - F.col("typos") + 2 * F.col("exact")) * F.col("w"))


def combine(found: DataFrame, queries: DataFrame) -> DataFrame:
    """Documents with all words that must match, or with any alternative; none with an excluded word.

    A document counts the words that must match only if it has all of them; alternatives add to it or admit
    it by themselves.
    """
    needed = queries.where("kind = 'must'").groupBy("query_id").agg(F.count("*").alias("needed"))
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, F.lit(1)).otherwise(0)).cast("long")
    total = lambda name, kind: F.sum(F.when(F.col("kind") == kind, F.col(name)).otherwise(F.lit(0)))
    sums = [total(n, k).alias(f"{k}_{n}") for n in ("score", "typos", "exact") for k in ("must", "or")]
    docs = found.groupBy("query_id", "doc_id").agg(part("must").alias("must_words"), part("or").alias("or_words"), part("not").alias("not_words"), *sums)
    docs = docs.join(needed, "query_id", "left")
    all_must = F.coalesce(F.col("needed"), F.lit(0)) == F.col("must_words")
    whole = all_must & (F.col("must_words") > 0)
    docs = docs.where((F.col("not_words") == 0) & (whole | (F.col("or_words") > 0)))
    value = lambda name: (F.when(whole, F.col(f"must_{name}")).otherwise(F.lit(0)) + F.col(f"or_{name}")).alias(name)
    return docs.select("query_id", "doc_id", value("words"), value("typos"), value("exact"), value("score"))


def text_search(queries: DataFrame, postings: DataFrame, bigrams: DataFrame | None, weights: dict[str, float] | None = None, most_typos: int = 2) -> DataFrame:
    """Scores of all text matches; without bigrams only the terms themselves match."""
    matched = exact_terms(queries) if bigrams is None else expand(queries, bigrams, most_typos)
    return combine(token_matches(matched, postings, weights), queries)


def exact_search(spark: SparkSession, postings: DataFrame, terms: Iterable[str]) -> DataFrame:
    """Ids of documents that hold every word as it is, unranked."""
    chosen = sorted(set(terms))
    if not chosen:
        return postings.select("doc_id").limit(0)
    hits = postings.where(F.col("term").isin(chosen)).select("doc_id", "term").distinct()
    return hits.groupBy("doc_id").count().where(F.col("count") == len(chosen)).select("doc_id")


def vector_scores(docs: DataFrame, vector: Sequence[float], column: str = "_vector") -> DataFrame:
    """20 times the cosine for every document whose vector has the query's length."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    own = F.col(column).cast("array<double>")
    return docs.where(F.size(own) == len(vector)).select("doc_id", (VECTOR_WEIGHT * cosine_column(own, q)).alias("score"))


def vector_search(docs: DataFrame, vector: Sequence[float], column: str = "_vector", query_id: int = 0) -> DataFrame:
    zero = F.lit(0).cast("long")
    return vector_scores(docs, vector, column).select(F.lit(query_id).alias("query_id"), "doc_id", zero.alias("words"), zero.alias("typos"), zero.alias("exact"), "score")


def hybrid(text: DataFrame, docs: DataFrame, vector: Sequence[float], column: str = "_vector") -> DataFrame:
    """Text matches with the vector's score added where there is one."""
    more = vector_scores(docs, vector, column).withColumnRenamed("score", "_more")
    return text.join(more, "doc_id", "left").withColumn("score", F.col("score") + F.coalesce("_more", F.lit(0.0))).drop("_more")


def rank_order(tie: str = "doc_id") -> list[Column]:
    return [F.desc("score"), F.desc("words"), F.asc("typos"), F.desc("exact"), F.asc(tie)]


def top(scored: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of each query's ranking, with ``rank`` from one."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*rank_order())))
    return ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def matched_terms(matched: DataFrame, postings: DataFrame) -> DataFrame:
    """Terms to highlight in each document: those of words wanted, in order of the words, then of the alphabet."""
    hits = postings.select("term", "doc_id").distinct().join(matched.where("kind <> 'not'"), "term")
    order = F.struct(F.when(F.col("kind") == "must", 0).otherwise(1).alias("a"), F.col("ord").alias("b"), F.col("dist").alias("c"), F.col("term").alias("term"))
    return hits.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_set(order)).alias("t")).select("query_id", "doc_id", F.array_distinct(F.transform("t", lambda x: x["term"])).alias("terms"))
