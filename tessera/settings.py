"""Settings from defaults, a TOML file and TESSERA_* environment variables (in this order), and JSON-lines logging."""

from __future__ import annotations

import json
import logging
import os
import tomllib
from dataclasses import dataclass, fields
from datetime import UTC, datetime
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    root: str = "data"
    region: str = "us"
    asset_class: str = "stocks"
    interval: str = "1d"
    connector: str = "files"
    log_level: str = "INFO"
    min_breadth: int = 20


def load(path: str | None = None, environment: dict | None = None) -> Settings:
    """Unknown keys of the file are an error; a value is cast to its default's type."""
    found = tomllib.loads(Path(path).read_text()) if path else {}
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    if unknown := set(found) - set(kinds):
        raise ValueError(f"unknown settings {sorted(unknown)}")
    environment = os.environ if environment is None else environment
    found |= {n: environment[f"TESSERA_{n.upper()}"] for n in kinds if f"TESSERA_{n.upper()}" in environment}
    return Settings(**{n: kinds[n](v) for n, v in found.items()})


class JsonLines(logging.Formatter):
    """One JSON object a line: time, level, logger, message and whatever `extra` gave under `fields`."""

    def format(self, record: logging.LogRecord) -> str:
        row = {"utc": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            row["error"] = self.formatException(record.exc_info)
        return json.dumps(row | getattr(record, "fields", {}), default=str)


def logger(name: str = "tessera", level: str = "INFO", path: str | None = None) -> logging.Logger:
    """A logger that writes JSON lines to a file, or to standard error; set up once."""
    made = logging.getLogger(name)
    made.setLevel(level)
    if not made.handlers:
        handler = logging.FileHandler(path) if path else logging.StreamHandler()
        handler.setFormatter(JsonLines())
        made.addHandler(handler)
        made.propagate = False
    return made
