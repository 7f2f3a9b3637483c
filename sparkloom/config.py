"""Configuration in nine sections: defaults < file (TOML, YAML, JSON) < environment, then validation.

A later layer sets a value even if it equals the default. Environment values that can't be read are reported
in `warnings` and left out. Validation stops at the first error.
"""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, get_type_hints


class ConfigError(ValueError):
    """A value, file or key that can't be used; names near keys where one is unknown."""


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(word: str, known: list[str]) -> str | None:
    best = min(known, key=lambda k: (edit_distance(word, k), k), default=None)
    return best if best is not None and edit_distance(word, best) <= 3 else None


def _between(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ConfigError(f"{name} is {value}, not within {low} to {high}")


@dataclass
class Core:
    include: list[str] = field(default_factory=lambda: ["**/*"])
    exclude: list[str] = field(default_factory=list)
    auto_index: bool = True

    def check(self) -> None:
        if not self.include:
            raise ConfigError("core.include is empty")


@dataclass
class SearchSection:
    mode: str = "hybrid"
    top_k: int = 10

    def check(self) -> None:
        if self.mode not in ("lexical", "semantic", "hybrid"):
            raise ConfigError(f"search.mode is {self.mode!r}")
        _between("search.top_k", self.top_k, 1, 1000)


@dataclass
class Ranking:
    lexical: float = 0.6
    vector: float = 0.4
    graph: float = 0.2
    symbol: float = 0.15

    def check(self) -> None:
        for f in dataclasses.fields(self):
            _between(f"ranking.{f.name}", getattr(self, f.name), 0, 1)
        if abs(self.lexical + self.vector - 1) > 0.01:
            raise ConfigError("ranking.lexical and ranking.vector don't sum to 1")


@dataclass
class Bm25:
    k1: float = 1.2
    b: float = 0.75
    avg_len: float = 50

    def check(self) -> None:
        _between("bm25.k1", self.k1, 0.5, 3)
        _between("bm25.b", self.b, 0, 1)
        _between("bm25.avg_len", self.avg_len, 1e-9, float("inf"))


@dataclass
class Graph:
    max_depth: int = 4
    decay: float = 0.5
    path_weight: float = 1.0
    edge_weights: dict[str, float] = field(default_factory=lambda: {"defines": 1.25, "calls": 1.0, "imports": 0.75, "contains": 0.6})

    def check(self) -> None:
        _between("graph.max_depth", self.max_depth, 1, 10)
        _between("graph.decay", self.decay, 0, 1)


@dataclass
class Chunking:
    max_tokens: int = 512
    overlap: int = 50
    strategy: str = "split"
    ast: bool = True
    max_chars: int = 2000

    def check(self) -> None:
        if self.strategy not in ("truncate", "split", "hierarchical"):
            raise ConfigError(f"chunking.strategy is {self.strategy!r}")
        _between("chunking.max_tokens", self.max_tokens, 1, 1e9)
        _between("chunking.overlap", self.overlap, 0, self.max_tokens - 1)


@dataclass
class Embedding:
    backend: str = "hashing"
    model: str = "hashing"
    dim: int = 64
    batch: int = 512

    def check(self) -> None:
        _between("embedding.dim", self.dim, 1, 65536)


@dataclass
class Agent:
    per_step: int = 6
    observations: int = 10
    tokens: int = 800
    max_steps: int = 12
    lines: int = 600
    timeout: int = 30

    def check(self) -> None:
        for f in dataclasses.fields(self):
            _between(f"agent.{f.name}", getattr(self, f.name), 1, 1e9)


@dataclass
class Llm:
    model: str = "stub"
    max_tokens: int = 800
    timeout_secs: int = 60

    def check(self) -> None:
        _between("llm.timeout_secs", self.timeout_secs, 1, 1e9)


@dataclass
class Config:
    core: Core = field(default_factory=Core)
    search: SearchSection = field(default_factory=SearchSection)
    ranking: Ranking = field(default_factory=Ranking)
    bm25: Bm25 = field(default_factory=Bm25)
    graph: Graph = field(default_factory=Graph)
    chunking: Chunking = field(default_factory=Chunking)
    embedding: Embedding = field(default_factory=Embedding)
    agent: Agent = field(default_factory=Agent)
    llm: Llm = field(default_factory=Llm)
    warnings: list[str] = field(default_factory=list)

    def validate(self) -> Config:
        for f in dataclasses.fields(self):
            if f.name != "warnings":
                getattr(self, f.name).check()
        return self


def _typed(kind: Any, text: str) -> Any:
    if kind is bool:
        if text.lower() in ("true", "1", "yes", "on"):
            return True
        if text.lower() in ("false", "0", "no", "off"):
            return False
        raise ValueError(text)
    if kind in (int, float, str):
        return kind(text)
    return json.loads(text) if text[:1] in "[{" else [x.strip() for x in text.split(",") if x.strip()]


def overlay(config: Config, values: dict) -> Config:
    sections = [f.name for f in dataclasses.fields(config) if f.name != "warnings"]
    for section, body in values.items():
        if section not in sections:
            hint = near(section, sections)
            raise ConfigError(f"unknown section {section!r}" + (f"; did you mean {hint!r}?" if hint else ""))
        part = getattr(config, section)
        names = [f.name for f in dataclasses.fields(part)]
        for name, value in (body or {}).items():
            if name not in names:
                hint = near(name, names)
                raise ConfigError(f"unknown key {section}.{name}" + (f"; did you mean {hint!r}?" if hint else ""))
            setattr(part, name, value)
    return config


def parse(text: str, kind: str) -> dict:
    try:
        if kind == "json":
            return json.loads(text)
        if kind == "toml":
            import tomllib

            return tomllib.loads(text)
        if kind in ("yaml", "yml"):
            import yaml

            return yaml.safe_load(text) or {}
    except Exception as e:
        raise ConfigError(f"{kind}: {e}") from e
    raise ConfigError(f"unknown configuration format {kind!r}")


def load(path: str | None = None, env: dict[str, str] | None = None, prefix: str = "SPARKLOOM_") -> Config:
    config = Config()
    if path:
        overlay(config, parse(Path(path).read_text(), Path(path).suffix.lstrip(".").lower()))
    env = dict(os.environ) if env is None else env
    for f in dataclasses.fields(config):
        if f.name == "warnings":
            continue
        part = getattr(config, f.name)
        kinds = get_type_hints(type(part))
        for g in dataclasses.fields(part):
            text = env.get(f"{prefix}{f.name}_{g.name}".upper())
            if text is not None:
                try:
                    setattr(part, g.name, _typed(kinds[g.name], text))
                except ValueError:
                    config.warnings.append(f"{f.name}.{g.name}: {text!r} can't be read")
    return config.validate()
