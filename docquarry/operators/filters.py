"""Filters, facets, sort keys and projection over documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.geo import haversine_column
from docquarry.functions.text import highlight_column, parse_number
from docquarry.operators.postings import Fields
from docquarry.plans.query import Filter, geo_arguments
from docquarry.plans.settings import Settings

_COMPARE = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
}


def filter_column(fields: Fields, f: Filter) -> Column:
    """A clause as a predicate; a document without the field fails it, whatever the operator."""
    geo = geo_arguments(f.field)
    if geo is not None:
        lat, lng = fields.point(geo[0])
        away = haversine_column(lat, lng, geo[1], geo[2])
        return F.coalesce(_COMPARE[f.operator](away, F.lit(parse_number(f.value) or 0.0)), F.lit(False))
    if not fields.has(f.field):
        return F.lit(False)
    value, number = fields.compared(f.field), parse_number(f.value)
    if f.operator == "=":
        text = F.lower(value) == F.lower(F.lit(f.value))
    elif f.operator == "!=":
        text = F.lower(value) != F.lower(F.lit(f.value))
    else:  # an order between texts is not defined: only equal ones pass
        text = value == F.lit(f.value)
    if number is None:
        return F.coalesce(text, F.lit(False))
    own = fields.numeric(f.field)
    return F.coalesce(F.when(own.isNotNull(), _COMPARE[f.operator](own, F.lit(number))).otherwise(text), F.lit(False))


def apply_filters(docs: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Documents that pass every clause."""
    fields = Fields.of(docs)
    return docs.where(reduce(lambda a, b: a & b, [filter_column(fields, f) for f in filters])) if filters else docs


def facets(docs: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(field, value, count)`` over all given documents, all fields in one pass; missing values are not counted."""
    if not names:
        return docs.sparkSession.createDataFrame([], "field string, value string, count long")
    fields = Fields.of(docs)
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), fields.shown(n).alias("value")) for n in names])
    return docs.select(F.explode(pairs).alias("f")).select("f.*").where("value is not null").groupBy("field", "value").count()


def facet_order(counts: DataFrame) -> DataFrame:
    return counts.orderBy("field", F.desc("count"), "value")


def sort_keys(fields: Fields, keys: Sequence[tuple[str, bool]]) -> list[Column]:
    """Order by fields: numbers by value, else by text; missing first when ascending, last when descending.

    In a field of both, texts come before numbers when ascending.  (Comparing each two values as numbers if both
    are and as texts otherwise, as a sort by comparisons can, is no order: 10 < "9" < 9 < 10.)
    """
    out = []
    for name, down in keys:
        if not fields.has(name):
            continue
        for value in (fields.only_number(name), fields.shown(name)):
            out.append(value.desc_nulls_last() if down else value.asc_nulls_first())
    return out


def project(page: DataFrame, settings: Settings) -> DataFrame:
    """Displayed fields of a page, the id always."""
    if settings.displayed_fields is None:
        return page
    return page.select("doc_id", *[c for c in page.columns if c in settings.displayed_fields and c != "doc_id"])


def highlight_fields(page: DataFrame, names: Sequence[str], terms: str = "terms") -> DataFrame:
    """``_highlights``: each named string field with the matched terms marked; empty without a text match."""
    pairs = [x for n in names for x in (F.lit(n), highlight_column(F.col(f"`{n}`"), F.col(terms)))]
    nothing = F.expr("cast(map() as map<string,string>)")
    marked = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else nothing
    return page.withColumn("_highlights", F.when(F.size(terms) > 0, marked).otherwise(nothing))
