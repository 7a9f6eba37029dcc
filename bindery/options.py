"""Options of a run, checked when they are made; unknown names and wrong types are refused."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints


class Invalid(ValueError):
    """An option that has no such name, type or value."""


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise Invalid(what)


def _finite(x: float, what: str, low: float = 0.0, high: float = math.inf) -> None:
    _check(isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x) and low <= x <= high, what)


@dataclass(frozen=True)
class Detection:
    min_reference_rows: int = 3
    min_aligned_ratio: float = 0.45
    alignment_tolerance: float = 18.0
    min_page_score: float = 7.0
    max_interrupted_pages: int = 1

    def __post_init__(self) -> None:
        _check(self.min_reference_rows >= 1 and self.max_interrupted_pages >= 0, "rows and pages")
        _finite(self.min_aligned_ratio, "min_aligned_ratio", 0, 1)
        _finite(self.alignment_tolerance, "alignment_tolerance")
        _finite(self.min_page_score, "min_page_score", -math.inf)


@dataclass(frozen=True)
class Parsing:
    row_tolerance: float = 5.0
    column_separation: float = 0.25
    wrap_gap: float = 1.8
    root_indent: float = 8.0
    child_indent: float = 16.0

    def __post_init__(self) -> None:
        for f in fields(self):
            _finite(getattr(self, f.name), f.name)
        _check(0 < self.column_separation < 1 and self.child_indent > self.root_indent, "column_separation, indents")


@dataclass(frozen=True)
class Mapping:
    footer_band: float = 0.15
    header_band: float = 0.10
    heading_band: float = 0.25
    max_requests: int = 500
    require_target_confirmation: bool = True

    def __post_init__(self) -> None:
        for name in ("footer_band", "header_band", "heading_band"):
            _finite(getattr(self, name), name, 0, 1)
        _check(self.max_requests >= 0, "max_requests")


@dataclass(frozen=True)
class Search:
    first_pages: int = 40
    more_pages: int = 20
    max_pages: int = 200
    max_evidence_pages: int = 500
    max_rounds: int = 6
    ocr_budget: int = 64

    def __post_init__(self) -> None:
        _check(0 < self.first_pages <= self.max_pages and self.more_pages > 0, "pages")
        _check(min(self.max_evidence_pages, self.max_rounds, self.ocr_budget) >= 0, "budgets")


@dataclass(frozen=True)
class PlanPolicy:
    allow_partial: bool = False
    flat_outline: bool = False
    title_style: str = "printed"

    def __post_init__(self) -> None:
        _check(self.title_style in ("printed", "chapter"), "title_style")


@dataclass(frozen=True)
class Metadata:
    title_block_ratio: float = 0.7
    title_prominence: float = 1.5
    first_year: int = 1450
    last_year: int = 2100

    def __post_init__(self) -> None:
        _finite(self.title_block_ratio, "title_block_ratio", 0, 1)
        _finite(self.title_prominence, "title_prominence", 1)
        _check(0 < self.first_year <= self.last_year, "years")


@dataclass(frozen=True)
class Raster:
    dpi: float = 300.0
    max_pixels: int = 80_000_000
    max_bytes: int = 320_000_000
    max_dimension: int = 20_000

    def __post_init__(self) -> None:
        _finite(self.dpi, "dpi", 1)
        _check(min(self.max_pixels, self.max_bytes, self.max_dimension) > 0, "limits")


@dataclass(frozen=True)
class Options:
    """All groups; ``Options.of(text)`` reads them from JSON."""

    detection: Detection = field(default_factory=Detection)
    parsing: Parsing = field(default_factory=Parsing)
    mapping: Mapping = field(default_factory=Mapping)
    search: Search = field(default_factory=Search)
    plan: PlanPolicy = field(default_factory=PlanPolicy)
    metadata: Metadata = field(default_factory=Metadata)
    raster: Raster = field(default_factory=Raster)

    @classmethod
    def of(cls, text: str) -> Options:
        from bindery.sources.strict import check

        fault, at = check(text)
        _check(fault is None, f"{fault} at byte {at}")
        return _made(cls, json.loads(text), "options")


def _made(kind: type, value: Any, where: str) -> Any:
    _check(isinstance(value, dict), f"{where} must be an object")
    hints = get_type_hints(kind)
    out = {}
    for name, x in value.items():
        _check(name in hints, f"{where} has no {name}")
        want = hints[name]
        if is_dataclass(want):
            out[name] = _made(want, x, f"{where}.{name}")
            continue
        right = isinstance(x, bool) if want is bool else isinstance(x, str) if want is str else isinstance(x, int) and not isinstance(x, bool) and -(2**31) <= x < 2**31 if want is int else isinstance(x, int | float) and not isinstance(x, bool)
        _check(right, f"{where}.{name} must be {want.__name__}")
        out[name] = x
    return kind(**out)
