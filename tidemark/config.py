"""Settings from the environment, and the name under which a configuration keeps its progress."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields

ANALYSES = (
    "temperature", "rain-duration", "frost-days", "temperature-ranking", "blizzard", "rapid-temperature-change",
    "tourism-weather-quality", "temperature-forecast", "maritime-routing", "wet-dry-period", "weather-regimes",
)
#: Of each analysis, the settings that change its results: with another value it starts from the beginning.
SHAPES = {
    "rain-duration": ("rain_duration_year",),
    "frost-days": ("frost_count_year",),
    "temperature-ranking": ("temperature_ranking_year",),
    "blizzard": ("blizzard_year", "blizzard_window_hours", "blizzard_advance_hours", "blizzard_grace_minutes", "blizzard_freezing_threshold_c", "blizzard_wind_threshold_mps", "grace_by_record"),
    "rapid-temperature-change": ("rapid_change_year", "rapid_change_window_hours", "rapid_change_grace_minutes", "grace_by_record"),
    "tourism-weather-quality": ("tourism_quality_year", "tourism_quality_window_hours", "tourism_quality_grace_minutes", "grace_by_record"),
    "temperature-forecast": ("forecast_window_days", "forecast_advance_days", "forecast_grace_minutes", "grace_by_record"),
    "maritime-routing": ("maritime_routing_year", "maritime_routing_join_window_minutes", "wave_weight", "buoy_stations", "marine_days"),
    "wet-dry-period": ("wet_dry_period_year",),
    "weather-regimes": ("weather_regime_year", "weather_regime_cluster_count", "weather_regime_horizon"),
}
LONGEST_ID = 72


def analyses(text: str | None) -> tuple[str, ...]:
    """A comma list of analyses; nothing or `all` are all of them, _ counts as -."""
    names = [n.strip().lower().replace("_", "-") for n in (text or "").split(",") if n.strip()]
    if not names or "all" in names:
        return ANALYSES
    unknown = [n for n in names if n not in ANALYSES]
    if unknown:
        raise ValueError(f"unknown analysis {unknown[0]!r}; there are {', '.join(ANALYSES)}")
    return tuple(n for n in ANALYSES if n in names)


def boolean(text: str) -> bool:
    if text.strip().lower() in ("1", "true", "yes", "on"):
        return True
    if text.strip().lower() in ("0", "false", "no", "off"):
        return False
    raise ValueError(f"{text!r} is neither true nor false")


@dataclass(frozen=True)
class Config:
    stream_pattern: tuple[str, ...] = ANALYSES
    input_topics: tuple[str, ...] = ("weather.raw",)
    application_id: str = ""
    application_id_prefix: str = "weather-patterns"
    rain_duration_year: int = 2025
    frost_count_year: int = 2025
    temperature_ranking_year: int = 2025
    blizzard_year: int = 2025
    blizzard_window_hours: int = 24
    blizzard_advance_hours: int = 1
    blizzard_grace_minutes: int = 10
    blizzard_freezing_threshold_c: float = 0.0
    blizzard_wind_threshold_mps: float = 12.0
    rapid_change_year: int = 2025
    rapid_change_window_hours: int = 24
    rapid_change_grace_minutes: int = 10
    tourism_quality_year: int = 2025
    tourism_quality_window_hours: int = 24
    tourism_quality_grace_minutes: int = 10
    forecast_window_days: int = 30
    forecast_advance_days: int = 1
    forecast_grace_minutes: int = 10
    wet_dry_period_year: int = 2025
    weather_regime_year: int = 2025
    weather_regime_cluster_count: int = 6
    weather_regime_horizon: int = 10_000
    maritime_routing_year: int = 2025
    maritime_routing_join_window_minutes: int = 30
    wave_weight: float = 22.0
    buoy_stations: str = ""
    marine_days: str = ""
    file_glob: str = ""
    grace_by_record: bool = False
    dashboard_sink_enabled: bool = True

    @staticmethod
    def from_env(env: Mapping[str, str] = os.environ) -> Config:
        """A field's variable is its name in capitals; a blank one counts as unset."""
        given = {}
        for f in fields(Config):
            text = env.get(f.name.upper(), "").strip()
            if not text:
                continue
            if f.name == "stream_pattern":
                given[f.name] = analyses(text)
            elif isinstance(f.default, bool):
                given[f.name] = boolean(text)
            elif isinstance(f.default, tuple):
                given[f.name] = tuple(t.strip() for t in text.split(",") if t.strip())
            else:
                given[f.name] = type(f.default)(text)
        return Config(**given)

    @property
    def needs_stations(self) -> bool:
        """Only the marine analysis does without the station list."""
        return self.stream_pattern != ("maritime-routing",)

    def shape(self, analysis: str) -> str:
        """The settings that matter; texts and switches that aren't set say nothing."""
        values = [(name, getattr(self, name)) for name in SHAPES.get(analysis, ())]
        return "-".join([analysis, *[f"{name}{v if isinstance(v, str) else format(v, 'g')}" for name, v in values if v != "" and v is not False]])

    def progress_id(self) -> str:
        """Names the checkpoint folder: the same for equal inputs, analyses and settings that matter, in any order."""
        if self.application_id:
            return self.application_id
        names = sorted(self.stream_pattern)
        read = [f"file_glob{self.file_glob}"] * bool(self.file_glob and self.needs_stations)
        state = _short_hash("-".join([*sorted(self.input_topics), *read, *[self.shape(n) for n in names]]))
        full = safe_id(f"{self.application_id_prefix}-{'-'.join(names)}-{state}")
        return full if len(full) <= LONGEST_ID else safe_id(f"{self.application_id_prefix}-{_short_hash('-'.join(names))}-{state}")


def _short_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:8]


def safe_id(text: str, default: str = "weather-patterns") -> str:
    out = re.sub(r"-+", "-", re.sub(r"[^a-z0-9._-]+", "-", text.lower()))
    return re.sub(r"^[-.]+|[-.]+$", "", out) or default
