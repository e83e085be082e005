"""Analysis requests: what to measure, over which days, split by what."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class TimeWindow:
    """Closed interval of days; either end may be open."""

    start: str | None = None
    end: str | None = None
    label: str | None = None

    @property
    def text(self) -> str:
        return self.label or f"{self.start} to {self.end}"


@dataclass(frozen=True)
class AnalysisSpec:
    """One analysis request.

    ``analysis_type`` is ``compare_periods``, ``contribution``, ``volume_price_decomp``,
    ``anomaly_detection``; anything else is a plain metric over ``current``.
    """

    spec_id: str
    analysis_type: str
    metric: str
    date_col: str | None = None
    current: TimeWindow = TimeWindow()
    baseline: TimeWindow = TimeWindow()
    dimensions: tuple[str, ...] = ()
    filters: dict[str, Any] = field(default_factory=dict)
    assumption_ids: tuple[str, ...] = ()
