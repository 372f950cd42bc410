"""A builder that gathers settings, patterns, analyzers and handlers, and gives an engine."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from textward.config import Config
from textward.operators.patterns import Pattern
from textward.plans import cascade


@dataclass
class Engine:
    config: Config = field(default_factory=Config)
    patterns: list[Pattern] = field(default_factory=list)
    analyzers: list[Callable[[Column], Column]] = field(default_factory=list)
    detector: Callable[[Column], Column] | None = None
    handlers: list[Callable[[DataFrame], None]] = field(default_factory=list)

    def configure(self, **settings: object) -> Engine:
        self.config = Config.of(settings)
        return self

    def add_patterns(self, rows: Sequence[Pattern]) -> Engine:
        self.patterns += [r for r in rows if r not in self.patterns]
        return self

    def add_analyzer(self, analyzer: Callable[[Column], Column]) -> Engine:
        self.analyzers.append(analyzer)
        return self

    def add_handler(self, handler: Callable[[DataFrame], None]) -> Engine:
        self.handlers.append(handler)
        return self

    def use_detector(self, detector: Callable[[Column], Column]) -> Engine:
        self.detector = detector
        return self

    def analyze(self, df: DataFrame, text: str = "text") -> DataFrame:
        out = cascade.analyze(df, text, self.config, self.patterns, self.analyzers, self.detector)
        for handle in self.handlers:
            handle(out)
        return out
