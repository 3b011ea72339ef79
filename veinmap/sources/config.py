"""Settings: veinmap.yml files from the repository's root down to the project, nearer ones winning key by key."""

from __future__ import annotations

import shlex
from dataclasses import dataclass, field, fields
from pathlib import Path

from ..operators.rules import PRESETS, RULES, SEVERITIES, severities

FILE = "veinmap.yml"
LOG_LEVELS = ("mirror", "debug")


class ConfigError(Exception):
    """A settings file that cannot be read, or says what is not known."""


@dataclass
class Config:
    preset: str | None = None
    rules: dict[str, str] = field(default_factory=dict)
    defer_target: str | None = None
    defer_state: str | None = None
    against: str | None = None
    log_level: str | None = None
    log_retention_days: int | None = None
    dbt_command: str | None = None
    dbt_args: str | None = None
    tool: str | None = None

    def severities(self) -> dict[str, str]:
        return severities(self.preset or "default", self.rules)

    def over(self, base: Config) -> Config:
        """This file's settings on top of those of a file further up; rules are merged one by one."""
        out = {f.name: mine if (mine := getattr(self, f.name)) is not None else getattr(base, f.name) for f in fields(self)}
        return Config(**out | {"rules": base.rules | self.rules})


def _text(raw: dict, key: str, path: Path) -> str | None:
    value = raw.get(key)
    if value is not None and not isinstance(value, str):
        raise ConfigError(f"{path}: {key} should be text")
    return value


def read(path: Path) -> Config:
    """One file; a missing one sets nothing. Keys that are not known are passed over."""
    import yaml

    if not path.exists():
        return Config()
    try:
        raw = yaml.safe_load(path.read_text())
    except OSError as e:
        raise ConfigError(f"could not read {path}: {e}") from e
    except yaml.YAMLError as e:
        raise ConfigError(f"{path} is not valid YAML: {e}") from e
    if raw is None:
        return Config()
    if not isinstance(raw, dict):
        raise ConfigError(f"{path} is not valid YAML: a mapping is expected")
    preset = _text(raw, "preset", path)
    if preset is not None and preset not in PRESETS:
        raise ConfigError(f"{path}: unknown preset {preset!r}")
    rules = raw.get("rules") or {}
    for rule, severity in rules.items():
        if rule not in RULES:
            raise ConfigError(f"{path}: unknown rule {rule!r}")
        if severity not in SEVERITIES:
            raise ConfigError(f"{path}: invalid severity {severity!r} for rule {rule!r}")
    defer, log = raw.get("defer") or {}, raw.get("log") or {}
    level, days = log.get("level"), log.get("retention_days")
    if level is not None and level not in LOG_LEVELS:
        raise ConfigError(f"{path}: invalid log level {level!r}")
    if days is not None and (not isinstance(days, int) or isinstance(days, bool) or days < 0):
        raise ConfigError(f"{path} is not valid YAML: log.retention_days should be a whole number")
    return Config(preset, dict(rules), _text(defer, "target", path), _text(defer, "state", path), _text(raw, "against", path), level, days, _text(raw, "dbt-command", path), _text(raw, "dbt-args", path), _text(raw, "tool", path))


def load(project_dir: Path) -> Config:
    """All files from the ancestor that holds .git down; without one, the project's own alone."""
    start = Path(project_dir).absolute()
    chain = [start, *start.parents]
    top = next((k for k, d in enumerate(chain) if (d / ".git").exists()), 0)
    config = Config()
    for d in reversed(chain[: top + 1]):
        config = read(d / FILE).over(config)
    return config


def split_words(text: str, what: str) -> list[str]:
    try:
        return shlex.split(text)
    except ValueError as e:
        raise ConfigError(f"could not parse {what} {text!r}: {e}") from e
