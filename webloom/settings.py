"""Defaults of crawls, and settings read from a file: what doesn't fit its kind or bounds is left at its default."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

#: Bounds of numbers: least and greatest.
BOUNDS = {"concurrency": (1, 256), "per_host": (1, 64), "timeout": (0.1, 600.0), "start_delay": (0.0, 60.0), "most_delay": (0.0, 600.0), "cache_days": (0, 3650)}


@dataclass(frozen=True)
class Settings:
    concurrency: int = 16
    per_host: int = 8
    timeout: float = 15.0
    verify_ssl: bool = True
    respect_robots: bool = True
    start_delay: float = 0.25
    most_delay: float = 10.0
    cache: str = ""
    cache_days: int = 7
    headers: dict = field(default_factory=lambda: {"User-Agent": "webloom"})
    proxies: dict = field(default_factory=dict)

    def problems(self) -> list[str]:
        """What is wrong with these settings, a line each."""
        out = []
        for f in fields(self):
            value, wanted = getattr(self, f.name), type(getattr(DEFAULTS, f.name)) if DEFAULTS else None
            number = wanted in (int, float)
            if wanted and (isinstance(value, bool) != (wanted is bool) or not isinstance(value, (int, float) if wanted is float else wanted)):
                out.append(f"{f.name}: {value!r} is no {wanted.__name__}")
            elif number and not BOUNDS[f.name][0] <= value <= BOUNDS[f.name][1]:
                out.append(f"{f.name}: {value!r} isn't from {BOUNDS[f.name][0]} to {BOUNDS[f.name][1]}")
        return out

    def target(self) -> float:
        """Requests at once that pauses aim at, by host."""
        return self.concurrency / 4

    def merged_headers(self, *more: dict | None) -> dict:
        """The settings' headers under those of a crawl and of a request: the later go first, whatever the case of their names."""
        out = {k.lower(): (k, v) for h in (self.headers, *more) for k, v in (h or {}).items()}
        return dict(out.values())


DEFAULTS: Settings | None = None
DEFAULTS = Settings()


def place() -> Path:
    """Where settings are kept: below XDG_CONFIG_HOME, or ~/.config."""
    return Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "webloom" / "settings.json"


def load(path: Path | None = None) -> Settings:
    """Settings of a JSON file: unknown names are left out, bad values and unreadable files give defaults."""
    try:
        read = json.loads((path or place()).read_text())
    except (OSError, ValueError):
        return DEFAULTS
    out = DEFAULTS
    for k, v in read.items() if isinstance(read, dict) else ():
        if k in {f.name for f in fields(Settings)}:
            new = replace(out, **{k: v})
            if not new.problems():
                out = new
    return out


def save(settings: Settings, path: Path | None = None) -> None:
    if found := settings.problems():
        raise ValueError("; ".join(found))
    at = path or place()
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(json.dumps({f.name: getattr(settings, f.name) for f in fields(settings)}, indent=1))


class Told(logging.LoggerAdapter):
    """A logger of messages with key=value pairs: those it was made with (depth, op, url, ...), then those of the call."""

    def process(self, msg, kwargs):
        own = {k: v for k, v in kwargs.items() if k not in ("exc_info", "stack_info", "stacklevel", "extra")}
        pairs = {**(self.extra or {}), **own}
        text = " ".join(f"{k}={json.dumps(v, ensure_ascii=False) if isinstance(v, str) and (' ' in v or not v) else v}" for k, v in pairs.items())
        return f"{msg} {text}".rstrip(), {k: v for k, v in kwargs.items() if k not in own}

    def bound(self, **pairs) -> Told:
        return Told(self.logger, {**(self.extra or {}), **pairs})


def log(name: str = "webloom", **pairs) -> Told:
    return Told(logging.getLogger(name), pairs)
