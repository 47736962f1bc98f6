"""Settings: defaults, and overrides from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from .functions.latency import PROFILES, Latency
from .schema import ConfigError

PREFIX = "SHOALKV_"


@dataclass(frozen=True)
class Config:
    root: str = "lake"
    wal_dir: str = "wal"
    wal_segment_bytes: int = 64 << 20
    memtable_max_bytes: int = 64 << 20
    max_frozen: int = 2
    cache_bytes: int = 256 << 20
    row_group_rows: int = 8192
    bloom_filters: bool = True
    latency: str = "none"
    get_latency: Latency | None = None
    put_latency: Latency | None = None
    #: Whether charged latency passes, or is only counted.
    latency_sleeps: bool = False

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Config:
        """Numbers that don't parse leave the default; an unknown latency profile is an error; a latency override needs
        both its p50 and its p99."""
        env = os.environ if env is None else env
        text = lambda name, default: env.get(PREFIX + name, default)

        def number(name: str, default: int) -> int:
            try:
                return int(env[PREFIX + name])
            except (KeyError, ValueError):
                return default

        def fitted(op: str) -> Latency | None:
            try:
                return Latency.fit(float(env[f"{PREFIX}LATENCY_{op}_P50_MS"]), float(env[f"{PREFIX}LATENCY_{op}_P99_MS"]))
            except (KeyError, ValueError):
                return None

        latency = text("LATENCY", cls.latency)
        if latency not in PROFILES:
            raise ConfigError(f"{PREFIX}LATENCY is {latency!r}, not one of {', '.join(PROFILES)}")
        return cls(
            root=text("ROOT", cls.root),
            wal_dir=text("WAL_DIR", cls.wal_dir),
            wal_segment_bytes=number("WAL_SEGMENT_BYTES", cls.wal_segment_bytes),
            memtable_max_bytes=number("MEMTABLE_MAX_BYTES", cls.memtable_max_bytes),
            max_frozen=number("MAX_FROZEN", cls.max_frozen),
            cache_bytes=number("CACHE_BYTES", cls.cache_bytes),
            row_group_rows=number("ROW_GROUP_ROWS", cls.row_group_rows),
            bloom_filters=text("BLOOM", "on").lower() not in ("off", "false", "0"),
            latency=latency,
            get_latency=fitted("GET"),
            put_latency=fitted("PUT"),
            latency_sleeps=text("LATENCY_SLEEPS", "off").lower() in ("on", "true", "1"),
        )
