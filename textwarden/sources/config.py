"""Configuration: settings, ban-list files (JSON, a small YAML), environment lists, profiles and validation."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace
from pathlib import PurePath

from ..functions.dialect import validate

MODES = ("fast", "balanced", "deep")
LISTS = ("ban_substrings", "ban_topics", "ban_competitors", "custom_regex")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    mode: str = "balanced"
    allowed_domains: tuple[str, ...] = ()
    strict: bool = False
    block_threshold: int = 0
    service_url: str = ""
    service_timeout_s: float = 5.0
    service_retries: int = 0
    service_circuit_failures: int = 0
    service_circuit_cooldown_s: float = 0.0
    max_input: int = 0
    max_decode_depth: int = 0
    max_decoded_variants: int = 0
    allow_output_code: bool = False
    ban_output_code: bool = False
    #: None: on in fast and balanced, off in deep mode.
    debias: bool | None = None
    ban_substrings: tuple[str, ...] = ()
    ban_topics: tuple[str, ...] = ()
    ban_competitors: tuple[str, ...] = ()
    custom_regex: tuple[str, ...] = ()
    config_file: str = ""
    merge_domain: bool = field(default=True)

    @property
    def debiases(self) -> bool:
        return self.mode != "deep" if self.debias is None else self.debias


def parse_mode(name: str | None, strict: bool = False) -> str:
    """A mode by name; an unknown one is ``balanced``, or an error if ``strict``; an empty one always ``balanced``."""
    found = (name or "").strip().lower()
    if found in MODES:
        return found
    if strict and found:
        raise ConfigError(f"unknown mode: {name}")
    return "balanced"


def distinct(values) -> tuple[str, ...]:
    """Trimmed, without empties, once regardless of case; the first spelling stays."""
    out: dict[str, str] = {}
    for v in values:
        if v.strip():
            out.setdefault(v.strip().lower(), v.strip())
    return tuple(out.values())


def parse_lists(text: str) -> dict[str, list[str]]:
    """The small YAML: ``key:`` lines and ``  - item`` lines; blank lines and comments are passed over."""
    out: dict[str, list[str]] = {}
    key = ""
    for n, line in enumerate(text.split("\n"), 1):
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        if bare.endswith(":"):
            key = bare[:-1].strip()
            if key not in LISTS:
                raise ConfigError(f'unsupported YAML key "{key}" at line {n}')
        elif line.startswith("  - "):
            if not key:
                raise ConfigError(f"YAML list item without key at line {n}")
            value = line[4:].strip().strip('"').strip("'").strip()
            if value:
                out.setdefault(key, []).append(value)
        else:
            raise ConfigError(f"unsupported YAML line format at line {n}")
    return out


def load_file(path: str) -> dict[str, list[str]]:
    """The lists of a ban-list file, read on the driver."""
    kind = PurePath(path).suffix.lower()
    if kind not in (".json", ".yaml", ".yml"):
        raise ConfigError(f"unsupported config file extension: {kind or path}")
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if kind != ".json":
        return parse_lists(text)
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ConfigError("a config file must hold an object")
    return {k: list(found.get(k) or []) for k in LISTS}


def env_lists(prefix: str, environ: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Comma-separated lists of variables PREFIX_BAN_SUBSTRINGS and so on; never read unless asked for."""
    env = os.environ if environ is None else environ
    return {k: [x.strip() for x in env.get(f"{prefix}_{k.upper()}", "").split(",") if x.strip()] for k in LISTS}


def table_lists(bans, kind: str = "kind", value: str = "value", most: int = 10_000) -> dict[str, list[str]]:
    """The lists of a table of bans: rows of a kind (substring, topic, competitor, regex) and a value.

    They become part of the plan, so more than ``most`` distinct rows are an error.  Null and blank values are passed over; an
    unknown kind is an error."""
    rows = bans.select(kind, value).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ConfigError(f"a ban list may have {most} rows")
    names = {"substring": "ban_substrings", "topic": "ban_topics", "competitor": "ban_competitors", "regex": "custom_regex"}
    out: dict[str, list[str]] = {k: [] for k in LISTS}
    for k, v in sorted((r[0] or "", r[1]) for r in rows if (r[1] or "").strip()):
        if k not in names:
            raise ConfigError(f"unknown kind of ban: {k}")
        out[names[k]].append(v)
    return out


def resolved(cfg: Config, extra: dict[str, list[str]] | None = None) -> Config:
    """The config with its file's and further lists merged, and checked."""
    lists = {k: list(getattr(cfg, k)) for k in LISTS}
    for more in ([load_file(cfg.config_file)] if cfg.config_file.strip() else []) + ([extra] if extra else []):
        for k in LISTS:
            lists[k] += more.get(k, [])
    out = replace(cfg, mode=parse_mode(cfg.mode), config_file="", **{k: distinct(v) for k, v in lists.items()})
    for r in out.custom_regex:
        validate(r)
    return out


def with_profile(cfg: Config, profile: str | None) -> Config:
    """Defaults of the production profile where nothing is set."""
    name = (profile or "").strip().lower()
    if name in ("", "default"):
        return cfg
    if name not in ("production", "prod"):
        raise ConfigError(f'invalid profile "{profile}": expected default or production')
    base = {"max_input": 256 * 1024, "max_decode_depth": 2, "max_decoded_variants": 20, "service_retries": 1, "service_circuit_failures": 3, "service_circuit_cooldown_s": 15.0}
    return replace(cfg, strict=True, **{k: getattr(cfg, k) if getattr(cfg, k) > 0 else v for k, v in base.items()})
