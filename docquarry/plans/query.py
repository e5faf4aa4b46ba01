"""The query languages: words with OR and minus, filters, sort keys, facets, vectors, requests.

All of it runs on the driver and yields small values; no data are touched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from docquarry.functions.text import parse_number, words
from docquarry.plans.settings import Settings, TypoTolerance

MAX_QUERY_BYTES = 1000
DEFAULT_LIMIT, MAX_LIMIT = 20, 1000
FUZZINESS = ("", "0", "1", "2", "AUTO")
_SPACE = re.compile(r"[\s\u0085 ]+")
OPERATORS = (">=", "<=", "!=", ">", "<", "=", ":")


@dataclass(frozen=True)
class ParsedQuery:
    must: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


def query_words(text: str, stop_words: frozenset[str] = frozenset()) -> list[str]:
    return [w for w in words(text) if w not in stop_words]


def parse_query(raw: str, stop_words: frozenset[str] = frozenset()) -> ParsedQuery:
    """``a OR b`` takes the last word before and all words after it, ``-a`` excludes, the rest must match.

    With nothing to choose from or exclude, the whole text counts as words that must match.
    """
    must: list[str] = []
    any_of: list[str] = []
    exclude: list[str] = []
    parts = [p for p in _SPACE.split(raw) if p]
    i = 0
    while i < len(parts):
        part = parts[i]
        if part == "OR" and i + 1 < len(parts):
            any_of += query_words(parts[i + 1], stop_words)
            if must:
                any_of.append(must.pop())
            i += 1
        elif part.startswith("-") and len(part) > 1:
            exclude += query_words(part[1:], stop_words)
        else:
            must += query_words(part, stop_words)
        i += 1
    if not any_of and not exclude:
        must = query_words(raw, stop_words)
    return ParsedQuery(tuple(must), tuple(any_of), tuple(exclude))


def max_typos(term: str, typo: TypoTolerance, fuzziness: str = "") -> int:
    """Edits that a word of the query allows."""
    if fuzziness in ("0", "1", "2"):
        return int(fuzziness)
    if not typo.enabled or len(term) < typo.min_word_length_one_typo:
        return 0
    return 1 if len(term) < typo.min_word_length_two_typos else 2


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: str


def parse_filter(clause: str) -> Filter | None:
    for op in OPERATORS:
        at = clause.find(op)
        if at > 0:
            return Filter(clause[:at].strip(), "=" if op == ":" else op, clause[at + len(op) :].strip())
    return None


def parse_filters(raw: str) -> list[Filter]:
    """Clauses between commas that no parenthesis encloses; those without an operator are dropped."""
    clauses, depth, part = [], 0, []
    for c in raw:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            clauses.append("".join(part))
            part = []
        else:
            part.append(c)
    clauses.append("".join(part))
    return [f for f in (parse_filter(c.strip()) for c in clauses if c.strip()) if f is not None]


def geo_arguments(name: str) -> tuple[str, float, float] | None:
    """Field, latitude and longitude of ``distance(field,lat,lng)``; unreadable numbers are zero."""
    if not (name.startswith("distance(") and name.endswith(")")):
        return None
    parts = [p.strip() for p in name[len("distance(") : -1].split(",")]
    if len(parts) != 3:
        return None
    return parts[0], parse_number(parts[1]) or 0.0, parse_number(parts[2]) or 0.0


def parse_sort(raw: str) -> list[tuple[str, bool]]:
    """(field, descending) for each key; parts are not trimmed."""
    out = []
    for key in raw.split(",") if raw else []:
        name, _, direction = key.partition(":")
        out.append((name, direction.lower() == "desc"))
    return out


def parse_facets(raw: str) -> list[str]:
    return list(dict.fromkeys(raw.split(","))) if raw else []


def parse_vector(raw: str) -> list[float]:
    return [x for x in (parse_number(p.strip()) for p in raw.split(",")) if x is not None] if raw else []


@dataclass(frozen=True)
class SearchRequest:
    query: str = ""
    filter: str = ""
    fuzziness: str = ""
    sort: str = ""
    facets: str = ""
    limit: int = DEFAULT_LIMIT
    offset: int = 0
    vector: tuple[float, ...] = field(default=())

    @staticmethod
    def of(parameters: dict[str, Any], body: dict[str, Any] | None = None) -> SearchRequest:
        """URL parameters with a body over them: its values win where given, its offset always."""

        def whole(value: Any, default: int) -> int:
            try:
                return int(value)
            except (TypeError, ValueError):
                return default

        values: dict[str, Any] = {
            "query": str(parameters.get("q", "")), "filter": str(parameters.get("filter", "")), "fuzziness": str(parameters.get("fuzziness", "")),
            "sort": str(parameters.get("sort", "")), "facets": str(parameters.get("facets", "")), "vector": tuple(parse_vector(str(parameters.get("vector", "")))),
            "limit": whole(parameters.get("limit"), 0), "offset": whole(parameters.get("offset"), 0),
        }
        if body is not None:
            for name, key in (("query", "q"), ("filter", "filter"), ("fuzziness", "fuzziness"), ("sort", "sort"), ("facets", "facets")):
                if body.get(key):
                    values[name] = ",".join(body[key]) if isinstance(body[key], list) else str(body[key])
            if body.get("vector"):
                values["vector"] = tuple(float(x) for x in body["vector"])
            if body.get("limit"):
                values["limit"] = whole(body["limit"], 0)
            values["offset"] = whole(body.get("offset"), 0)
        return SearchRequest(**values).checked()

    def checked(self) -> SearchRequest:
        if len(self.query.encode()) > MAX_QUERY_BYTES:
            raise ValueError(f"the query has more than {MAX_QUERY_BYTES} bytes")
        if self.fuzziness not in FUZZINESS:
            raise ValueError("fuzziness must be 0, 1, 2 or AUTO")
        limit = min(self.limit, MAX_LIMIT) if self.limit > 0 else DEFAULT_LIMIT
        return SearchRequest(self.query, self.filter, self.fuzziness, self.sort, self.facets, limit, max(0, self.offset), self.vector)


@dataclass(frozen=True)
class QueryTerm:
    """A row of the query relation."""

    query_id: int
    kind: str
    ord: int
    term: str
    k: int


def query_terms(query_id: int, parsed: ParsedQuery, settings: Settings, fuzziness: str = "") -> list[QueryTerm]:
    out = []
    for kind, terms in (("must", parsed.must), ("or", parsed.any_of), ("not", parsed.exclude)):
        out += [QueryTerm(query_id, kind, i, t, max_typos(t, settings.typo_tolerance, fuzziness)) for i, t in enumerate(terms)]
    return out
