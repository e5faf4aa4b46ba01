"""Postings, vocabulary and bigrams from documents.

Documents are either typed columns or a JSON object per row (column ``doc``, a variant); ``Fields`` reads
both.  Searchable fields are the settings' own, or else every top-level string field.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.text import bigrams_column, filter_text_of_number, number_of_text, number_text, words_column
from docquarry.plans.settings import Settings

POSTINGS = "doc_id string, field string, position int, term string"


@dataclass(frozen=True)
class Fields:
    """How to read a document's top-level fields: from columns, or from the variant ``doc``."""

    schema: T.StructType
    variant: bool

    @staticmethod
    def of(docs: DataFrame) -> Fields:
        variant = "doc" in docs.columns and isinstance(docs.schema["doc"].dataType, T.VariantType)
        return Fields(docs.schema, variant)

    def has(self, name: str) -> bool:
        return self.variant or (name in self.schema.names and name != "doc_id")

    def _type(self, name: str) -> T.DataType:
        return self.schema[name].dataType

    def _path(self, name: str) -> str:
        return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"

    def _kind(self, name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("doc", self._path(name), "variant"))

    def _string(self, name: str) -> Column:
        """The value if it is a string."""
        if self.variant:
            return F.when(self._kind(name) == "STRING", F.try_variant_get("doc", self._path(name), "string"))
        return F.col(f"`{name}`") if isinstance(self._type(name), T.StringType) else F.lit(None).cast("string")

    def _number(self, name: str) -> Column:
        """The value if it is a number."""
        if self.variant:
            return F.when(self._kind(name).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get("doc", self._path(name), "double"))
        return F.col(f"`{name}`").cast("double") if isinstance(self._type(name), T.NumericType) else F.lit(None).cast("double")

    def _other(self, name: str) -> Column:
        """Text of a value that is neither."""
        if self.variant:
            return F.when(~self._kind(name).rlike("^(STRING|BIGINT|DOUBLE|FLOAT|DECIMAL|VOID)"), F.to_json(F.try_variant_get("doc", self._path(name), "variant")))
        kind = self._type(name)
        if isinstance(kind, (T.StringType, T.NumericType)):
            return F.lit(None).cast("string")
        if isinstance(kind, (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.col(f"`{name}`").cast("string")
        return F.to_json(F.col(f"`{name}`")) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{name}`").cast("string")

    def text(self, name: str) -> Column:
        """A string field's value."""
        return self._string(name) if self.has(name) else F.lit(None).cast("string")

    def numeric(self, name: str) -> Column:
        """The value as a number: a number, or a string that spells one; booleans are none."""
        return F.coalesce(self._number(name), number_of_text(self._string(name)))

    def shown(self, name: str) -> Column:
        """The value's text in facets and sorts; null if the field is missing."""
        if not self.has(name):
            return F.lit(None).cast("string")
        return F.coalesce(self._string(name), number_text(self._number(name)), self._other(name))

    def compared(self, name: str) -> Column:
        """The value's text for a filter; empty for lists and objects."""
        if self.variant:
            boolean = F.when(self._kind(name) == "BOOLEAN", F.try_variant_get("doc", self._path(name), "string"))
        else:
            boolean = F.col(f"`{name}`").cast("string") if isinstance(self._type(name), (T.BooleanType, T.DateType, T.TimestampType)) else F.lit(None).cast("string")
        return F.coalesce(self._string(name), filter_text_of_number(self._number(name)), boolean, F.when(self.shown(name).isNotNull(), F.lit("")))

    def only_number(self, name: str) -> Column:
        return self._number(name) if self.has(name) else F.lit(None).cast("double")

    def point(self, name: str) -> tuple[Column, Column]:
        """Latitude and longitude of an object with both, else nulls."""
        if self.variant:
            parts = [F.try_variant_get("doc", self._path(name) + f".{p}", "string") for p in ("lat", "lng")]
            return parts[0].try_cast("double"), parts[1].try_cast("double")
        kind = self._type(name) if self.has(name) else None
        if not isinstance(kind, T.StructType) or not {"lat", "lng"} <= set(kind.names):
            return F.lit(None).cast("double"), F.lit(None).cast("double")
        return F.col(f"`{name}`.lat").cast("double"), F.col(f"`{name}`.lng").cast("double")

    def texts(self, settings: Settings) -> Column:
        """Map from searchable field to its string."""
        if settings.searchable_fields:
            names = [n for n in settings.searchable_fields if self.has(n)]
            pairs = [F.struct(F.lit(n).alias("field"), self.text(n).alias("text")) for n in names]
        elif self.variant:
            every = F.from_json(F.to_json("doc"), "map<string,variant>")
            entries = F.transform(F.map_entries(every), lambda e: F.struct(e["key"].alias("field"), F.when(F.schema_of_variant(e["value"]) == "STRING", F.try_variant_get(e["value"], "$", "string")).alias("text")))
            return entries
        else:
            pairs = [F.struct(F.lit(f.name).alias("field"), F.col(f"`{f.name}`").alias("text")) for f in self.schema if isinstance(f.dataType, T.StringType) and f.name != "doc_id"]
        return F.array(*pairs) if pairs else F.expr("cast(array() as array<struct<field:string,text:string>>)")


def tokens(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each word of each searchable field, stop words left out but counted in positions."""
    field = F.explode(Fields.of(docs).texts(settings)).alias("field")
    out = docs.select("doc_id", field).where("field.text is not null").select("doc_id", F.col("field.field").alias("field"), F.posexplode(words_column(F.col("field.text"))).alias("position", "term"))
    return out.where(~F.col("term").isin(sorted(settings.stop_words))) if settings.stop_words else out


def postings(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Tokens with their synonyms, as they stand in the settings, at the same positions."""
    return _with_synonyms(tokens(docs, settings), settings)


def _with_synonyms(found: DataFrame, settings: Settings) -> DataFrame:
    if not settings.synonyms:
        return found
    known = F.create_map(*[F.lit(x) for term, others in settings.synonyms.items() for x in (term, list(others))])
    return found.withColumn("term", F.explode(F.concat(F.array("term"), F.coalesce(F.element_at(known, F.col("term")), F.expr("cast(array() as array<string>)")))))


def vocabulary(found: DataFrame) -> DataFrame:
    return found.select("term").distinct()


def vocabulary_of(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The vocabulary of ``postings(docs, settings)`` without postings: each different piece between spaces is folded and split once.

    A space is no part of a word and changes no character beside it, so pieces have the words of their text.
    """
    texts = docs.select(F.explode(Fields.of(docs).texts(settings)).alias("field")).select(F.col("field.text").alias("text"))
    pieces = texts.select(F.explode(F.split("text", " ")).alias("piece")).distinct()
    found = pieces.select(F.explode(words_column(F.col("piece"))).alias("term"))
    if settings.stop_words:
        found = found.where(~F.col("term").isin(sorted(settings.stop_words)))
    return vocabulary(_with_synonyms(vocabulary(found), settings))


def bigrams(vocab: DataFrame) -> DataFrame:
    """``(bigram, term)``: the blocking key of approximate matching."""
    return vocab.select(F.explode(bigrams_column(F.col("term"))).alias("bigram"), "term")
