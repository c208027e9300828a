"""Configuration: TOML text, typed literals and excluded directories."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field

from .schema import EXCLUDED, FLAVORS

_BYTES = {"": 1, "b": 1, **{x: 1024**p for p, n in enumerate("kmgt", 1) for x in (n, n + "b", n + "ib")}}
_MS = {"ms": 1, "": 1000, "s": 1000, "sec": 1000, "m": 60_000, "min": 60_000, "h": 3_600_000, "hr": 3_600_000, "d": 86_400_000, "day": 86_400_000}


class ConfigError(ValueError):
    pass


def _scaled(text: str, units: dict[str, int], bits: int) -> int:
    m = re.fullmatch(r"\s*([0-9]+)\s*([^0-9\s]*)\s*", text)
    if not m or m[2].lower() not in units:
        raise ConfigError(f"cannot read {text!r}")
    n = int(m[1]) * units[m[2].lower()]
    if n >= 1 << bits:
        raise ConfigError(f"{text!r} is too large")
    return n


def parse_bytes(text: str) -> int:
    return _scaled(text, _BYTES, 64)


def parse_duration_ms(text: str) -> int:
    return _scaled(text, _MS, 63)


def parse_window(text: str) -> tuple[int, int]:
    """Start and end minute of a daily window; it may pass midnight, and equal ends are an error."""
    m = re.fullmatch(r"\s*(\d+)\s*:\s*(\d+)\s*-\s*(\d+)\s*:\s*(\d+)\s*", text)
    if not m or any(int(h) > 23 for h in (m[1], m[3])) or any(int(x) > 59 for x in (m[2], m[4])):
        raise ConfigError(f"cannot read the window {text!r}")
    a, b = int(m[1]) * 60 + int(m[2]), int(m[3]) * 60 + int(m[4])
    if a == b:
        raise ConfigError(f"the window {text!r} is empty")
    return a, b


def excluded_dirs(flavor: str = "generic", extra: list[str] | None = None) -> list[str]:
    """The ordered union of the common list, the flavour's and the user's."""
    return list(dict.fromkeys([*EXCLUDED, *FLAVORS[flavor], *(extra or [])]))


@dataclass(frozen=True)
class Config:
    min_size: int = 64 << 20
    chunks: int = 16
    chunk_len: int = 1 << 20
    settle_ms: int = 15 * 60_000
    flavor: str = "generic"
    exclude_dirs: list[str] = field(default_factory=list)
    roots: list[tuple[int, str, str]] = field(default_factory=list)

    @classmethod
    def from_toml(cls, text: str) -> Config:
        """Unknown keys are errors; roots are numbered from 1, local ones first."""
        raw = tomllib.loads(text)
        known = {"min_size", "chunks", "chunk_len", "settle_delay", "flavor", "exclude_dirs", "roots", "remote_roots"}
        if unknown := raw.keys() - known:
            raise ConfigError(f"unknown keys: {sorted(unknown)}")
        paths = [(p, "local") for p in raw.get("roots", [])] + [(p, "remote") for p in raw.get("remote_roots", [])]
        if len({p for p, _ in paths}) < len(paths):
            raise ConfigError("a root is listed twice")
        if not 2 <= raw.get("chunks", 16) <= 64:
            raise ConfigError("chunks must be 2 to 64")
        return cls(
            min_size=parse_bytes(raw.get("min_size", "64MiB")),
            chunks=raw.get("chunks", 16),
            chunk_len=parse_bytes(raw.get("chunk_len", "1MiB")),
            settle_ms=parse_duration_ms(raw.get("settle_delay", "15m")),
            flavor=raw.get("flavor", "generic"),
            exclude_dirs=list(raw.get("exclude_dirs", [])),
            roots=[(i, p, k) for i, (p, k) in enumerate(paths, 1)],
        )
