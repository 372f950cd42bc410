"""Settings as frozen dataclasses. Plan builders read them, so that every setting becomes a literal in the plan."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from typing import Any

LOW, MEDIUM, HIGH, PARANOID = "Low", "Medium", "High", "Paranoid"
LEVELS = (LOW, MEDIUM, HIGH, PARANOID)
BLOCK, ALLOW, WARN = "Block", "Allow", "AllowWithWarning"
CLOSED, OPEN = "FailClosed", "FailOpen"


def by_level(level: str, low: float, medium: float, high: float, paranoid: float) -> float:
    return dict(zip(LEVELS, (low, medium, high, paranoid), strict=True))[level]


@dataclass(frozen=True)
class Language:
    enabled: bool = True
    supported: tuple[str, ...] = ("en",)
    on_unsupported: str = BLOCK
    min_confidence: float = 0.7
    min_length: int = 20
    on_short: str = ALLOW
    on_low_confidence: str = BLOCK


@dataclass(frozen=True)
class Patterns:
    enabled: bool = True
    early_exit: float = 0.9
    built_in: bool = True
    disabled: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()
    sensitivity: str = MEDIUM
    #: Confidence of a pattern that is given up, and the steps after which it is, by functions/regexes.py's estimate.
    timeout: float = 0.3
    step_budget: float = 1e9

    @property
    def multiplier(self) -> float:
        return by_level(self.sensitivity, 0.85, 1.0, 1.1, 1.2)

    @property
    def exit_threshold(self) -> float:
        t = self.early_exit
        return by_level(self.sensitivity, min(1.0, t + 0.05), t, max(0.5, t - 0.05), max(0.4, t - 0.1))

    @property
    def timeout_contribution(self) -> float:
        t = self.timeout
        return by_level(self.sensitivity, t * 0.7, t, min(1.0, t * 1.3), min(1.0, t * 1.6))


@dataclass(frozen=True)
class Heuristics:
    enabled: bool = True
    definitive_threat: float = 0.85
    definitive_safe: float = 0.15
    sensitivity: str = MEDIUM
    directive_words: int = 3
    punctuation: float = 0.15
    alphanumeric: float = 0.5
    allowed: tuple[str, ...] = ()
    blocked: tuple[str, ...] = ()
    exclusions: tuple[str, ...] = ()
    compound: bool = True

    @property
    def multiplier(self) -> float:
        return by_level(self.sensitivity, 0.7, 1.0, 1.2, 1.5)

    @property
    def directive_threshold(self) -> int:
        return max(1, self.directive_words + int(by_level(self.sensitivity, 2, 0, -1, -2)))


@dataclass(frozen=True)
class Ml:
    enabled: bool = True
    threshold: float = 0.8
    max_sequence: int = 512
    model_weight: float = 0.7
    sensitivity: str = MEDIUM
    weights: dict[str, float] = field(default_factory=dict)
    allowed: tuple[str, ...] = ()
    disabled: tuple[str, ...] = ()
    min_contribution: float = 0.1

    @property
    def multiplier(self) -> float:
        return by_level(self.sensitivity, 0.7, 1.0, 1.3, 1.6)


@dataclass(frozen=True)
class Semantic:
    enabled: bool = False
    deployment: str | None = None
    endpoint: str | None = None
    api_key: str | None = field(default=None, repr=False)
    api_version: str | None = None
    threshold: float = 0.7
    max_input: int = 8000
    max_retries: int = 2
    custom_prompt: str | None = None
    context: str | None = None
    allowed: tuple[str, ...] = ()
    sensitivity: str = MEDIUM

    @property
    def adjusted(self) -> float:
        t = self.threshold
        return by_level(self.sensitivity, min(1.0, t + 0.1), t, max(0.3, t - 0.1), max(0.2, t - 0.2))


@dataclass(frozen=True)
class Aggregation:
    patterns: float = 0.4
    heuristics: float = 0.6
    ml: float = 0.8


@dataclass(frozen=True)
class Telemetry:
    """What an analysed stream tells: counters, spans' tags, and events; and whether events hold the text."""

    metrics: bool = True
    tracing: bool = True
    logging: bool = True
    log_content: bool = False

    @property
    def any(self) -> bool:
        return self.metrics or self.tracing or self.logging


@dataclass(frozen=True)
class Config:
    threat_threshold: float = 0.75
    max_length: int = 50_000
    include_breakdown: bool = True
    on_error: str = CLOSED
    language: Language = Language()
    patterns: Patterns = Patterns()
    heuristics: Heuristics = Heuristics()
    ml: Ml = field(default_factory=Ml)
    semantic: Semantic = Semantic()
    aggregation: Aggregation = Aggregation()
    telemetry: Telemetry = Telemetry()

    def __post_init__(self) -> None:
        if self.max_length <= 0:
            raise ValueError("max_length must be positive")
        for part in (self.patterns, self.heuristics, self.ml, self.semantic):
            if part.sensitivity not in LEVELS:
                raise ValueError(f"unknown sensitivity {part.sensitivity!r}")
        for name, value in (("threat_threshold", self.threat_threshold), ("ml.threshold", self.ml.threshold), ("patterns.early_exit", self.patterns.early_exit)):
            if not 0 <= value <= 1:
                raise ValueError(f"{name} must be between 0 and 1")

    @classmethod
    def of(cls, settings: dict[str, Any]) -> Config:
        """From nested dicts, as read from JSON; unknown names are errors."""

        def build(kind: type, values: dict[str, Any]) -> Any:
            known = {f.name: f for f in dataclasses.fields(kind)}
            if extra := set(values) - set(known):
                raise ValueError(f"unknown settings: {sorted(extra)}")
            parts = {"language": Language, "patterns": Patterns, "heuristics": Heuristics, "ml": Ml, "semantic": Semantic, "aggregation": Aggregation, "telemetry": Telemetry}
            return kind(**{k: build(parts[k], v) if kind is cls and k in parts else tuple(v) if isinstance(v, list) else v for k, v in values.items()})

        return build(cls, settings)
