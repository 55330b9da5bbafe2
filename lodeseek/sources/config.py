"""Configuration in layers: a global YAML file, a collection's, the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path

from .scan import EXCLUDE, MAX_FILE_SIZE

PROVIDERS = ("openai", "local")
PREFIX = "LODESEEK_"


@dataclass(frozen=True)
class EmbedderConfig:
    provider: str = "openai"
    model: str = "text-embedding-3-small"
    api_key_env: str = "OPENAI_API_KEY"
    dimensions: int = 1536


@dataclass(frozen=True)
class LanguageModelConfig:
    provider: str = "openai"
    model: str = "gpt-5-nano"
    api_key_env: str = "OPENAI_API_KEY"


@dataclass(frozen=True)
class ChunkerConfig:
    max_tokens: int = 900
    overlap: float = 0.15


@dataclass(frozen=True)
class ScannerConfig:
    exclude: list[str] = field(default_factory=lambda: list(EXCLUDE))
    max_file_size: int = MAX_FILE_SIZE


@dataclass(frozen=True)
class Config:
    embedder: EmbedderConfig = EmbedderConfig()
    llm: LanguageModelConfig = LanguageModelConfig()
    chunker: ChunkerConfig = ChunkerConfig()
    scanner: ScannerConfig = field(default_factory=ScannerConfig)

    def as_dict(self) -> dict:
        return asdict(self)


#: Settings that the environment may give, as LODESEEK_<SECTION>_<KEY>.
FROM_ENVIRONMENT = [("embedder", k) for k in ("provider", "model", "api_key_env", "dimensions")] + [("llm", k) for k in ("provider", "model", "api_key_env")] + [("chunker", k) for k in ("max_tokens", "overlap")] + [("scanner", "max_file_size")]


def merged(low: Mapping, high: Mapping) -> dict:
    """Maps are merged key by key; lists and values of ``high`` replace those of ``low``."""
    out = dict(low)
    for k, v in high.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def _typed(kind, value, name: str):
    try:
        value = kind(value) if kind in (int, float, str) and not isinstance(value, bool) else value
    except (TypeError, ValueError):
        raise ValueError(f"{name}: {value!r} is no {kind.__name__}") from None
    if name.endswith("provider") and value not in PROVIDERS:
        raise ValueError(f"{name}: {value!r} is none of {', '.join(PROVIDERS)}")
    if kind is int and value <= 0:
        raise ValueError(f"{name} must be positive")
    if name == "chunker.overlap" and not 0 <= value <= 1:
        raise ValueError(f"{name} must be between 0 and 1")
    if kind is list and not (isinstance(value, list) and all(isinstance(x, str) for x in value)):
        raise ValueError(f"{name} must be a list of strings")
    return value


def built(raw: Mapping) -> Config:
    """Checks the values; keys that aren't known are left out."""
    parts, kinds = {}, {"int": int, "float": float, "str": str, "list[str]": list}
    for section in fields(Config):
        default = getattr(Config(), section.name)
        assert is_dataclass(default)
        given = raw.get(section.name) or {}
        parts[section.name] = type(default)(**{f.name: _typed(kinds[f.type], given.get(f.name, getattr(default, f.name)), f"{section.name}.{f.name}") for f in fields(default)})
    return Config(**parts)


def load_config(home: str | Path, collection: str | None = None, environment: Mapping[str, str] | None = None) -> Config:
    env, raw = os.environ if environment is None else environment, {}
    paths = [Path(home) / "config.yaml", *([Path(home) / "collections" / f"{collection}.yaml"] if collection else [])]
    for p in paths:
        if p.exists():
            import yaml

            raw = merged(raw, yaml.safe_load(p.read_text()) or {})
    for section, key in FROM_ENVIRONMENT:
        if value := env.get(f"{PREFIX}{section}_{key}".upper()):
            raw = merged(raw, {section: {key: value}})
    return built(raw)
