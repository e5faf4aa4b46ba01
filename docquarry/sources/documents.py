"""Documents in and out: JSON ingest with the id rule, upserts, deletes, listings, a generator, sitemaps."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.plans.query import DEFAULT_LIMIT, MAX_LIMIT
from docquarry.plans.settings import Settings, SitemapSettings

MAX_BODY_BYTES = 64 << 20
SITEMAP_LIMIT = 50_000
RAW = "seq long, doc_id string, doc string"


def decode_body(body: bytes | str, array_only: bool = False) -> list[Any]:
    """The documents of a request body: an array, or one object unless an uploaded file is read."""
    data = body.encode() if isinstance(body, str) else body
    if len(data) > MAX_BODY_BYTES:
        raise ValueError("the body is too large")
    value = json.loads(data)
    if array_only or data.lstrip()[:1] == b"[":
        if not isinstance(value, list):
            raise ValueError("an array of documents is expected")
        return value
    return [value]


def document_id(doc: Any) -> str | None:
    """``id`` if the key is there, else ``_id``; only a non-empty string is one."""
    if not isinstance(doc, dict):
        return None
    value = doc["id"] if "id" in doc else doc.get("_id")
    return value if isinstance(value, str) and value else None


def id_column(json_column: str = "doc") -> F.Column:
    """The id rule over a column of JSON text."""
    v = F.try_parse_json(json_column)
    own = F.try_variant_get(v, "$.id", "variant")
    chosen = F.when(F.array_contains(F.json_object_keys(json_column), "id"), own).otherwise(F.try_variant_get(v, "$._id", "variant"))
    text = F.when(F.schema_of_variant(chosen) == "STRING", F.try_variant_get(chosen, "$", "string"))
    return F.when(F.length(text) > 0, text)


def bodies(rows: DataFrame, body: str = "value") -> DataFrame:
    """``(doc_id, doc)`` of request bodies in a column, each an array of documents or a single one; a body that is no JSON has none."""
    text = F.ltrim(F.col(body), F.lit(" \t\r\n"))
    array = F.from_json(F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), "array<variant>")
    docs = rows.select(F.explode(array).alias("v")).select(F.to_json("v").alias("doc"))
    return docs.select(id_column().alias("doc_id"), "doc").where("doc_id is not null")


def read_json(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """``(doc_id, doc)`` from JSON lines, or from files that hold an array each; rows without an id are left out."""
    lines = spark.read.text(path, wholetext=whole_file)
    docs = lines.select(F.explode(F.from_json("value", "array<variant>")).alias("v")).select(F.to_json("v").alias("doc")) if whole_file else lines.select(F.col("value").alias("doc"))
    return docs.select(id_column().alias("doc_id"), "doc").where("doc_id is not null")


def with_variant(raw: DataFrame) -> DataFrame:
    """JSON text parsed; ``_vector`` as doubles where every element is a number."""
    docs = raw.withColumn("doc", F.try_parse_json("doc"))
    own = F.transform(F.try_variant_get("doc", "$._vector", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$", "double"), F.try_variant_get(x, "$", "string").try_cast("double")))
    return docs.withColumn("_vector", F.when(F.forall(own, lambda x: x.isNotNull()), own))


def latest(changes: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "seq") -> DataFrame:
    """The last row of each key."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    return changes.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def upsert(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """``docs`` with the last change of each id in place of what was there."""
    new = latest(changes)
    return docs.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new, allowMissingColumns=True)


def delete(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of documents or postings whose document is not among ``ids``."""
    return rows.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def listing(docs: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """A page of documents by id, bytewise."""
    return docs.orderBy("doc_id").offset(max(0, offset)).limit(min(limit, MAX_LIMIT) if limit > 0 else DEFAULT_LIMIT)


def sitemap_entries(docs: DataFrame, url: F.Column, settings: SitemapSettings) -> DataFrame:
    """``(doc_id, loc, changefreq)`` of the first 50,000 documents by id, escaped for XML."""
    if not settings.base_url:
        raise ValueError("the sitemap needs a base_url")
    path = F.coalesce(F.when(url != "", url), F.col("doc_id"))
    loc = F.concat(F.lit(settings.base_url.rstrip("/") + "/"), F.ltrim(path, F.lit("/")))
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        loc = F.replace(loc, F.lit(plain), F.lit(escaped))
    return docs.select("doc_id", loc.alias("loc"), F.lit(settings.changefreq).alias("changefreq")).orderBy("doc_id").limit(SITEMAP_LIMIT)


def sitemap_xml(entries: DataFrame, today: str) -> str:
    urls = "".join(f"<url><loc>{r['loc']}</loc><lastmod>{today}</lastmod><changefreq>{r['changefreq']}</changefreq></url>" for r in entries.toLocalIterator())
    return f'<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{urls}</urlset>'


def robots_txt(host: str, indexes: Sequence[str]) -> str:
    return "\n".join(["User-agent: *", "Allow: /", *(f"Sitemap: {host.rstrip('/')}/indexes/{quote(n, safe='')}/sitemap.xml" for n in sorted(indexes))]) + "\n"


def generated_products(spark: SparkSession, n: int = 100_000) -> DataFrame:
    """Synthetic products for trials; a product follows from its number alone."""
    at = F.col("id")

    def pick(names: list[str], step: int) -> F.Column:
        return F.element_at(F.array(*[F.lit(x) for x in names]), (F.floor(at * step / 7) % len(names) + 1).cast("int"))

    return spark.range(n).select(
        F.concat(F.lit("prod_"), at).alias("doc_id"),
        F.concat_ws(" ", pick(["Compact", "Classic", "Light", "Smart", "Solid"], 3), pick(["lamp", "speaker", "bottle", "camera", "chair", "keyboard"], 5), at.cast("string")).alias("name"),
        pick(["Acme", "Borealis", "Cobalt", "Dune"], 11).alias("brand"), pick(["home", "audio", "office", "outdoor"], 13).alias("category"),
        ((at * 7919 % 50_000) / 100 + 5).alias("price"), ((at * 31 % 41) / 10 + 1).alias("rating"), (at * 17 % 200).cast("double").alias("stock"),
    )
