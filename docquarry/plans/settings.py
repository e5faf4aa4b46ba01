"""Index settings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any


@dataclass(frozen=True)
class TypoTolerance:
    enabled: bool = True
    min_word_length_one_typo: int = 4
    min_word_length_two_typos: int = 8


@dataclass(frozen=True)
class SitemapSettings:
    base_url: str = ""
    url_field: str = "url"
    changefreq: str = "weekly"


@dataclass(frozen=True)
class Settings:
    """What decides how an index tokenizes, matches, weighs and shows documents.

    ``ranking_rules`` are kept for clients; the order of results is fixed.
    """

    searchable_fields: tuple[str, ...] | None = None
    displayed_fields: tuple[str, ...] | None = None
    ranking_rules: tuple[str, ...] = ("exactness", "typo", "proximity", "attribute")
    stop_words: frozenset[str] = frozenset()
    synonyms: dict[str, tuple[str, ...]] = field(default_factory=dict)
    typo_tolerance: TypoTolerance = TypoTolerance()
    field_weights: dict[str, float] = field(default_factory=dict)
    sitemap: SitemapSettings = SitemapSettings()

    def to_json(self) -> str:
        raw = asdict(self)
        raw["stop_words"] = sorted(self.stop_words)
        return json.dumps(raw, sort_keys=True)

    @staticmethod
    def of(raw: dict[str, Any], typo_default: bool = True) -> Settings:
        """From decoded JSON; stop words may be a list or a map of booleans.

        ``typo_default`` is what a missing ``typo_tolerance`` means: a replaced settings object loses it.
        """
        known = {f.name for f in fields(Settings)}
        values: dict[str, Any] = {k: v for k, v in raw.items() if k in known and v is not None}
        for name in ("searchable_fields", "displayed_fields", "ranking_rules"):
            if name in values:
                values[name] = tuple(values[name]) or None
        if values.get("ranking_rules", 1) is None:
            del values["ranking_rules"]
        stop = values.get("stop_words", ())
        values["stop_words"] = frozenset(w for w, on in stop.items() if on) if isinstance(stop, dict) else frozenset(stop)
        values["synonyms"] = {k: tuple(v) for k, v in values.get("synonyms", {}).items()}
        values["field_weights"] = {k: float(v) for k, v in values.get("field_weights", {}).items()}
        typo = values.get("typo_tolerance")
        values["typo_tolerance"] = TypoTolerance(bool(typo.get("enabled", False)), int(typo.get("min_word_length_one_typo", 0)), int(typo.get("min_word_length_two_typos", 0))) if typo is not None else TypoTolerance() if typo_default else TypoTolerance(False, 0, 0)
        if isinstance(values.get("sitemap"), dict):
            values["sitemap"] = SitemapSettings(**{k: v for k, v in values["sitemap"].items() if k in ("base_url", "url_field", "changefreq") and v})
        return Settings(**values)

    @staticmethod
    def from_json(text: str | None) -> Settings:
        return Settings.of(json.loads(text)) if text else Settings()

    def merged(self, **changes: Any) -> Settings:
        return replace(self, **changes)
