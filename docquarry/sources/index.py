"""An index in a folder: postings and bigrams, written once and searched often.

Both are sorted inside each file, postings by term and bigrams by bigram, so that the minima and maxima of row groups and
pages let a search read little but what it looks for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import search as srch
from docquarry.operators.postings import bigrams, postings, vocabulary
from docquarry.plans.query import QueryTerm, parse_query, query_terms
from docquarry.plans.settings import Settings

#: Matched terms that are looked up by name; a search of more is a join.
LOOKUP_TERMS = 2000


def write_postings(found: DataFrame, path: str) -> DataFrame:
    found.sortWithinPartitions("term", "doc_id").write.parquet(path)
    return found.sparkSession.read.schema(found.schema).parquet(path)


def write_bigrams(found: DataFrame, path: str) -> DataFrame:
    """Of written postings."""
    grams = bigrams(vocabulary(found))
    grams.sortWithinPartitions("bigram", "term").write.parquet(path)
    return found.sparkSession.read.schema(grams.schema).parquet(path)


@dataclass(frozen=True)
class Index:
    """Postings and bigrams to search in."""

    spark: SparkSession
    postings: DataFrame
    bigrams: DataFrame
    settings: Settings

    @staticmethod
    def build(docs: DataFrame, settings: Settings, path: str) -> Index:
        found = write_postings(postings(docs, settings), f"{path}/postings")
        return Index(docs.sparkSession, found, write_bigrams(found, f"{path}/bigrams"), settings)

    def terms(self, queries: Sequence[str], fuzziness: str = "") -> list[QueryTerm]:
        return [t for i, q in enumerate(queries) for t in query_terms(i, parse_query(q, self.settings.stop_words), self.settings, fuzziness)]

    def matched(self, terms: Sequence[QueryTerm], relation: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Vocabulary terms that the query terms match, and the postings of these."""
        keys = sorted({t.term[:2] for t in terms})
        grams = self.bigrams.where(F.col("bigram").isin(keys)) if len(keys) <= LOOKUP_TERMS else self.bigrams
        matched = srch.expand(relation, grams, max((t.k for t in terms), default=0))
        rows = matched.limit(LOOKUP_TERMS + 1).collect()
        if len(rows) > LOOKUP_TERMS:
            return matched, self.postings
        matched = F.broadcast(self.spark.createDataFrame(sorted(set(rows)), matched.schema))
        return matched, self.postings.where(F.col("term").isin(sorted({r["term"] for r in rows})))

    def search(self, queries: Sequence[str], fuzziness: str = "") -> DataFrame:
        """``(query_id, doc_id, words, typos, exact, score)`` of any number of queries in one plan."""
        terms = self.terms(queries, fuzziness)
        relation = srch.query_relation(self.spark, terms)
        matched, found = self.matched(terms, relation)
        return srch.combine(srch.token_matches(matched, found, self.settings.field_weights), relation)

    def search_exact(self, words: Sequence[str]) -> DataFrame:
        return srch.exact_search(self.spark, self.postings, words)
