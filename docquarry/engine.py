"""Indexes and searches: the API that a client of the search engine uses, over tables in a folder.

An index is a list of segments.  A change writes one small segment, its documents, postings, bigrams and the ids that it replaces
or deletes, and then the index's entry in the catalogue, so readers see one version or the other and a change costs
what it brings, whatever the index holds.  A row is dead if a later segment names its id.  ``TIER`` segments of like
size are merged into one, which drops dead rows, so every row is rewritten a few times at most.  The change log is appended
first; opening a folder applies what the catalogue has not seen.
"""

from __future__ import annotations

import contextlib
import datetime
import json
import math
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.text import highlight
from docquarry.operators import filters as flt
from docquarry.operators import search as srch
from docquarry.operators.postings import POSTINGS, Fields, postings
from docquarry.plans.query import SearchRequest, parse_facets, parse_filters, parse_query, parse_sort, query_terms, query_words
from docquarry.plans.settings import Settings
from docquarry.sources import changelog
from docquarry.sources.documents import RAW, document_id, latest, listing, robots_txt, sitemap_entries, sitemap_xml, with_variant
from docquarry.sources.index import Index, write_bigrams, write_postings

CACHE_ENTRIES = 1024
#: Segments of like size that are merged.
TIER = 8
_SEGMENT = ", segment long"


class IndexExists(ValueError):
    """An index of the name is there."""


class NoIndex(KeyError):
    """No index of the name is there."""


@dataclass
class SearchResult:
    query: str
    hits: list[dict[str, Any]]
    total_hits: int
    facets: dict[str, dict[str, int]]
    limit: int
    offset: int


class ResultCache:
    """The results used last, by request."""

    def __init__(self, size: int = CACHE_ENTRIES):
        self.size, self.entries = size, OrderedDict()

    def get(self, key: tuple) -> SearchResult | None:
        if key in self.entries:
            self.entries.move_to_end(key)
        return self.entries.get(key)

    def put(self, key: tuple, value: SearchResult) -> None:
        self.entries[key] = value
        self.entries.move_to_end(key)
        while len(self.entries) > self.size:
            self.entries.popitem(last=False)

    def invalidate(self, index: str) -> None:
        for key in [k for k in self.entries if k[0] == index]:
            del self.entries[key]

    def clear(self) -> None:
        self.entries.clear()


def checked_name(name: str) -> str:
    name = name.strip()
    if not name or len(name.encode()) > 255 or any(x in name for x in ("/", "\\", "..")):
        raise ValueError("an index name has 1 to 255 bytes and no slash or double dot")
    return name


@dataclass
class Engine:
    """All indexes of a folder that every executor can read: a URI, or a path that is mounted everywhere."""

    spark: SparkSession
    root: str
    catalogue: dict[str, dict[str, Any]] = field(default_factory=dict)
    cache: ResultCache = field(default_factory=ResultCache)
    seq: int = 0
    dropped: list[str] = field(default_factory=list)
    _held: dict[str, dict[str, str | None]] | None = None
    _held_from: int | None = None
    _leaving: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if "://" not in self.root:
            self.root = "file://" + os.path.abspath(self.root)
        self._files, self._base = pafs.FileSystem.from_uri(self.root)

    @staticmethod
    def open(spark: SparkSession, root: str) -> Engine:
        """Open a folder: its catalogue, and then what the log has beyond it."""
        engine = Engine(spark, root)
        engine._files.create_dir(f"{engine._base}/log", recursive=True)
        if (saved := engine._saved()) is not None:
            engine.catalogue, engine.seq, engine.dropped = saved["indexes"], saved["seq"], saved["dropped"]
        engine._replay()
        return engine

    def _saved(self) -> dict[str, Any] | None:
        path = f"{self._base}/catalogue.json"
        if self._files.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        with self._files.open_input_stream(path) as f:
            return json.loads(f.read())

    def _put(self, path: str, text: str) -> None:
        """A whole file or none."""
        with self._files.open_output_stream(path + ".part") as f:
            f.write(text.encode())
        if isinstance(self._files, pafs.LocalFileSystem):
            with open(path + ".part", "rb+") as f:
                os.fsync(f.fileno())
        self._files.move(path + ".part", path)

    def _log_files(self) -> dict[str, int | None]:
        """Log files with the number of their last row, which their names tell; None for files of others."""
        out = {}
        for info in self._files.get_file_info(pafs.FileSelector(f"{self._base}/log")):
            if info.base_name.endswith(".json"):
                parts = info.base_name.split("-")
                out[info.base_name] = int(parts[1]) if len(parts) > 2 and parts[1].isdigit() else None
        return out

    def _append(self, rows: list[tuple]) -> None:
        """Rows ``(op, index, doc_id, doc, settings)``, durable before the change is made."""
        names, last = ("seq", "op", "index", "doc_id", "doc", "settings"), self.seq + len(rows)
        lines = [json.dumps(dict(zip(names, (self.seq + 1 + i, *row), strict=True))) for i, row in enumerate(rows)]
        self._put(f"{self._base}/log/{self.seq + 1:020d}-{last:020d}-{uuid.uuid4().hex}.json", "\n".join(lines) + "\n")
        self.seq = last

    def _save(self) -> None:
        """Write the catalogue; what the one before last still needed is deleted."""
        gone, self.dropped, self._leaving = self.dropped, self._leaving, []
        seq = self.seq if self._held_from is None else self._held_from  # held changes are still to be applied
        self._put(f"{self._base}/catalogue.json", json.dumps({"seq": seq, "indexes": self.catalogue, "dropped": self.dropped}))
        for path in gone:
            with contextlib.suppress(FileNotFoundError):
                self._files.delete_dir(self._base + path.removeprefix(self.root))

    def _replay(self) -> None:
        """Apply log rows that the catalogue has not seen: for each index one segment, or a new build if settings changed."""
        late = [name for name, last in self._log_files().items() if last is None or last > self.seq]
        if not late:
            return
        log = changelog.after(changelog.read_log(self.spark, [f"{self.root}/log/{n}" for n in late]), self.seq)
        new = log.agg(F.max("seq")).first()[0]
        if new is None:
            return
        marks = log.where(~F.col("op").isin(changelog.ADD_DOC, changelog.DELETE_DOC)).orderBy("seq").collect()
        born: dict[str, int] = {}
        chosen: dict[str, Settings] = {}
        for row in marks:
            name = row["index"]
            if row["op"] == changelog.DELETE_INDEX and name in self.catalogue:
                self._forget(name)
                chosen.pop(name, None)
            elif row["op"] == changelog.CREATE_INDEX and name not in self.catalogue:
                self._enter(name, Settings())
                born[name] = row["seq"]
            elif row["op"] == changelog.UPDATE_SETTINGS and name in self.catalogue:
                chosen[name] = Settings.from_json(row["settings"])
        changes = log.where(F.col("op").isin(changelog.ADD_DOC, changelog.DELETE_DOC) & ((F.col("op") == changelog.DELETE_DOC) | F.col("doc").isNotNull()))
        touched = {r["index"] for r in changes.select("index").distinct().collect()}
        for name in self.list_indexes():
            if name in chosen:
                self._reindex(name, chosen[name])
            if name in touched:
                own = latest(changes.where((F.col("index") == name) & (F.col("seq") > born.get(name, self.seq))))
                self._change(name, own.where(F.col("op") == changelog.ADD_DOC).select("seq", "doc_id", "doc"), own.select("doc_id"))
        self.seq = new
        self._save()

    def truncate_log(self) -> int:
        """Delete log files that the catalogue holds in full; returns how many."""
        saved = self._saved()
        done = [n for n, last in self._log_files().items() if saved is not None and last is not None and last <= saved["seq"]]
        for name in done:
            self._files.delete_file(f"{self._base}/log/{name}")
        return len(done)

    # Segments of an index.

    def _entry(self, name: str) -> dict[str, Any]:
        if name not in self.catalogue:
            raise NoIndex(name)
        return self.catalogue[name]

    def _enter(self, name: str, settings: Settings) -> None:
        self.catalogue[name] = {"settings": settings.to_json(), "segments": [], "next": 1}

    def _forget(self, name: str) -> None:
        self._leaving += [s["path"] for s in self.catalogue.pop(name)["segments"]]
        self.cache.invalidate(name)

    def _read(self, name: str, table: str, schema: str, only: Sequence[int] | None = None) -> DataFrame:
        paths = [f"{s['path']}/{table}" for s in self._entry(name)["segments"] if only is None or s["id"] in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _alive(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows whose document no later segment replaces or deletes."""
        first = min((s["id"] for s in self._entry(name)["segments"]), default=0)
        later = [s["id"] for s in self._entry(name)["segments"] if s["gone"] and s["id"] > first]
        if not later:
            return rows.drop("segment")
        gone = self._read(name, "gone", "doc_id string" + _SEGMENT, later).groupBy("doc_id").agg(F.max("segment").alias("_gone"))
        return rows.join(gone, "doc_id", "left").where("_gone is null or segment >= _gone").drop("_gone", "segment")

    def raw(self, name: str) -> DataFrame:
        return self._alive(name, self._read(name, "docs", RAW + _SEGMENT))

    def documents(self, name: str) -> DataFrame:
        return with_variant(self.raw(name))

    def postings(self, name: str) -> DataFrame:
        return self._alive(name, self._read(name, "postings", POSTINGS + _SEGMENT))

    def index(self, name: str) -> Index:
        """What searches read; bigrams may name terms that no living document has, which then match nothing."""
        return Index(self.spark, self.postings(name), self._read(name, "bigrams", "bigram string, term string"), self.settings(name))

    def _segment(self, name: str, number: int, docs: DataFrame, gone: DataFrame | None, found: DataFrame | None = None) -> None:
        """Write documents ``(seq, doc_id, doc)`` and the ids they replace as a segment, with given or new postings."""
        path, mark = f"{self.root}/indexes/{uuid.uuid4().hex}", F.lit(number).cast("long").alias("segment")
        docs.select("seq", "doc_id", "doc", mark).write.parquet(f"{path}/docs")
        docs = self.spark.read.schema(RAW + _SEGMENT).parquet(f"{path}/docs")
        found = postings(with_variant(docs), self.settings(name)) if found is None else found
        write_bigrams(write_postings(found.select("doc_id", "field", "position", "term", mark), f"{path}/postings"), f"{path}/bigrams")
        if gone is not None:
            gone.write.parquet(f"{path}/gone")
        entry = self._entry(name)
        entry["segments"].append({"id": number, "path": path, "docs": docs.count(), "gone": gone is not None})
        self.cache.invalidate(name)

    def _change(self, name: str, new: DataFrame, ids: DataFrame) -> None:
        """Rows of ``ids`` out, ``new`` in."""
        entry = self._entry(name)
        number, entry["next"] = entry["next"], entry["next"] + 1
        first = not entry["segments"]
        self._segment(name, number, new, None if first else ids.select("doc_id", F.lit(number).cast("long").alias("segment")).distinct())
        tiers: dict[int, list[int]] = {}
        for s in entry["segments"]:
            tiers.setdefault(int(math.log(s["docs"] + 1, TIER)), []).append(s["id"])
        for segments in tiers.values():
            if len(segments) >= TIER:
                self._merge(name, segments)

    def _merge(self, name: str, segments: Sequence[int]) -> None:
        """One segment in place of several; ids that they name stay named for older segments."""
        entry = self._entry(name)
        old = [s for s in entry["segments"] if s["id"] in segments]
        oldest = min((s["id"] for s in entry["segments"] if s["id"] not in segments), default=None)
        docs = self._alive(name, self._read(name, "docs", RAW + _SEGMENT, segments))
        found = self._alive(name, self._read(name, "postings", POSTINGS + _SEGMENT, segments))
        named = [s["id"] for s in old if s["gone"] and oldest is not None and s["id"] > oldest]
        gone = self._read(name, "gone", "doc_id string" + _SEGMENT, named) if named else None
        self._segment(name, max(segments), docs, gone, found)
        entry["segments"] = [s for s in entry["segments"] if s not in old]
        self._leaving += [s["path"] for s in old]

    def compact(self, name: str) -> None:
        """All of an index in one segment, without dead rows."""
        if len(self._entry(name)["segments"]) > 1:
            self._merge(name, [s["id"] for s in self._entry(name)["segments"]])
            self._save()

    def _reindex(self, name: str, settings: Settings) -> None:
        entry, docs = self._entry(name), self.raw(name)
        old = list(entry["segments"])
        entry["settings"] = settings.to_json()
        if old:
            self._segment(name, max(s["id"] for s in old), docs, None)
        entry["segments"] = entry["segments"][len(old) :]
        self._leaving += [s["path"] for s in old]
        self.cache.invalidate(name)

    # Indexes.

    def create_index(self, name: str, settings: Settings = Settings()) -> None:
        name = checked_name(name)
        if name in self.catalogue:
            raise IndexExists(name)
        self._append([(changelog.CREATE_INDEX, name, None, None, None), (changelog.UPDATE_SETTINGS, name, None, None, settings.to_json())])
        self._enter(name, settings)
        self._save()

    def delete_index(self, name: str) -> None:
        """Its files go with the next change."""
        self._entry(name)
        self._append([(changelog.DELETE_INDEX, name, None, None, None)])
        self._forget(name)
        if self._held is not None:
            self._held.pop(name, None)
        self._save()

    def list_indexes(self) -> list[str]:
        return sorted(self.catalogue)

    def settings(self, name: str) -> Settings:
        return Settings.from_json(self._entry(name)["settings"])

    def replace_settings(self, name: str, settings: Settings | dict[str, Any]) -> None:
        """All settings at once; a dict without typo_tolerance turns it off.  Postings are made anew."""
        self._entry(name)
        chosen = Settings.of(settings, typo_default=False) if isinstance(settings, dict) else settings
        self._append([(changelog.UPDATE_SETTINGS, name, None, None, chosen.to_json())])
        self._reindex(name, chosen)
        self._save()

    def merge_settings(self, name: str, **changes: Any) -> None:
        self.replace_settings(name, self.settings(name).merged(**changes))

    def health(self) -> dict[str, Any]:
        """One job, however many indexes there are."""
        tables = [self.raw(n).select("doc_id") for n in self.catalogue]
        return {"status": "ok", "indexes": len(tables), "documents": reduce(DataFrame.unionAll, tables).count() if tables else 0}

    # Documents.

    @contextlib.contextmanager
    def hold(self) -> Iterator[None]:
        """Changes inside are logged at once and applied together at the end, as a segment for each index."""
        if self._held is not None:  # an outer one applies them
            yield
            return
        self._held = {}
        try:
            yield
        finally:
            held, self._held = self._held, None
            for name, docs in held.items():
                self._apply(name, docs)
            self._held_from = None
            self._save()

    def _apply(self, name: str, docs: dict[str, str | None]) -> None:
        """The last word on each document, null for a deleted one."""
        rows = [(self.seq, i, d) for i, d in docs.items()]
        if not rows:
            return
        given = self.spark.createDataFrame(rows, RAW)
        self._change(name, given.where("doc is not null"), given.select("doc_id"))
        self._save()

    def _told(self, name: str, rows: list[tuple]) -> None:
        """Log changes, and apply or hold them."""
        before, docs = self.seq, {r[2]: r[3] for r in rows}
        self._append(rows)
        if self._held is None:
            self._apply(name, docs)
            return
        if self._held_from is None:
            self._held_from = before
        own = self._held.setdefault(name, {})
        for i, d in docs.items():
            own.pop(i, None)
            own[i] = d

    def add_documents(self, name: str, docs: Sequence[Any]) -> tuple[int, int]:
        """Add or replace documents; returns how many had an id and how many were skipped."""
        self._entry(name)
        known = [(i, json.dumps(d)) for d in docs if (i := document_id(d)) is not None]
        if known:
            self._told(name, [(changelog.ADD_DOC, name, i, d, None) for i, d in known])
        return len(known), len(docs) - len(known)

    def add_table(self, name: str, docs: DataFrame, order: str | None = None) -> None:
        """Add documents from a DataFrame with ``doc_id`` and other columns, or with JSON in ``doc``; not logged row by row.

        Of rows of one id the one with the greatest ``order`` counts; without it, any.
        """
        at = F.col(order).cast("long") if order else F.lit(self.seq)
        if "doc" not in docs.columns:
            docs = docs.withColumn("doc", F.to_json(F.struct(F.col("doc_id").alias("id"), *[c for c in docs.columns if c not in ("doc_id", "id", order)])))
        new = latest(docs.select(at.alias("seq"), F.col("doc_id").cast("string").alias("doc_id"), "doc").where("doc_id is not null"))
        self._change(name, new, new.select("doc_id"))
        self._save()

    def delete_document(self, name: str, doc_id: str) -> None:
        """Also of an id that is not there."""
        self._entry(name)
        self._told(name, [(changelog.DELETE_DOC, name, doc_id, None, None)])

    def get_document(self, name: str, doc_id: str) -> dict[str, Any] | None:
        row = self.raw(name).where(F.col("doc_id") == doc_id).first()
        return json.loads(row["doc"]) if row else None

    def list_documents(self, name: str, limit: int = 20, offset: int = 0) -> tuple[list[dict[str, Any]], int]:
        return [json.loads(r["doc"]) for r in listing(self.raw(name), limit, offset).collect()], self.count(name)

    def count(self, name: str) -> int:
        return self.raw(name).count()

    # Searches.

    def exact_matches(self, name: str, query: str) -> DataFrame:
        """Ids of documents that hold every word as it is, as a table."""
        return self.index(name).search_exact(query_words(query, self.settings(name).stop_words))

    def search_exact(self, name: str, query: str, limit: int | None = None) -> list[str]:
        found = self.exact_matches(name, query).orderBy("doc_id")
        return [r["doc_id"] for r in (found if limit is None else found.limit(limit)).collect()]

    def scores(self, name: str, queries: Sequence[str], fuzziness: str = "") -> DataFrame:
        """Text scores of many queries in one plan: ``(query_id, doc_id, words, typos, exact, score)``."""
        return self.index(name).search(queries, fuzziness)

    def search(self, name: str, request: SearchRequest | str = "", **options: Any) -> SearchResult:
        """Search, filter, count facets, sort, cut the page and mark its matches."""
        request = (SearchRequest(query=request, **options) if isinstance(request, str) else request).checked()
        key = (name, tuple(s["path"] for s in self._entry(name)["segments"]), request)
        if (known := self.cache.get(key)) is not None:
            return known
        result = self._search(name, request)
        self.cache.put(key, result)
        return result

    def _search(self, name: str, request: SearchRequest) -> SearchResult:
        settings, names = self.settings(name), parse_facets(request.facets)
        parsed = parse_query(request.query, settings.stop_words)
        terms = query_terms(0, parsed, settings, request.fuzziness)
        wanted = bool(parsed.must or parsed.any_of)
        if not wanted and not request.vector:
            return SearchResult(request.query, [], 0, {} if not request.query else {n: {} for n in names}, request.limit, request.offset)
        matched = None
        if wanted:
            relation = srch.query_relation(self.spark, terms)
            matched, found = self.index(name).matched(terms, relation)
            scored = srch.combine(srch.token_matches(matched, found, settings.field_weights), relation)
            docs = with_variant(self.raw(name).join(scored.select("doc_id"), "doc_id", "left_semi"))  # only what is found is parsed
            if request.vector:
                scored = srch.hybrid(scored, docs, request.vector)
        else:
            docs = self.documents(name)
            scored = srch.vector_search(docs, request.vector)
        fields = Fields.of(docs)
        clauses = parse_filters(request.filter)
        hits = flt.apply_filters(docs, clauses).join(scored.drop("query_id"), "doc_id").cache()
        try:
            counts: dict[str, dict[str, int]] = {n: {} for n in names}
            for r in flt.facets(hits, names).collect() if names else ():
                counts[r["field"]][r["value"]] = r["count"]
            page = hits.orderBy(*flt.sort_keys(fields, parse_sort(request.sort)), *srch.rank_order()).offset(request.offset).limit(request.limit)
            rows = page.select("doc_id", "score", F.to_json("doc").alias("doc")).collect()
            total = hits.count()
            marks: dict[str, list[str]] = {}
            if matched is not None and rows:
                shown = found.where(F.col("doc_id").isin([r["doc_id"] for r in rows]))
                marks = {r["doc_id"]: r["terms"] for r in srch.matched_terms(matched, shown).collect()}
        finally:
            hits.unpersist()
        out = []
        for r in rows:
            whole = json.loads(r["doc"])
            shown_doc = whole if settings.displayed_fields is None else {k: whole[k] for k in settings.displayed_fields if k in whole} | {"id": r["doc_id"]}
            own = marks.get(r["doc_id"])
            out.append({"id": r["doc_id"], "score": r["score"], "document": shown_doc, "highlights": {k: highlight(v, own) for k, v in shown_doc.items() if isinstance(v, str)} if own else {}})
        return SearchResult(request.query, out, total, counts, request.limit, request.offset)

    # Sinks.

    def sitemap(self, name: str) -> str:
        settings = self.settings(name).sitemap
        docs = self.documents(name)
        today = datetime.datetime.now(datetime.UTC).date().isoformat()
        return sitemap_xml(sitemap_entries(docs, Fields.of(docs).text(settings.url_field), settings), today)

    def robots(self, host: str) -> str:
        return robots_txt(host, self.list_indexes())
