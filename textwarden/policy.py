"""Policies, resolved when a plan is built."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from textwarden.rules import DEFAULT_PATH_PATTERNS

# Operating limits and their defaults.
SCHEMA_VERSION = 2
SANITIZER_VERSION = "redactor-v1"
ENCODING = "utf-8-lossy"
DAY = 24 * 60 * 60
MAX_TTL = 7 * DAY
MAX_INDEX_ENTRIES = 1_000_000
MAX_PATTERN_BYTES = 1_024
MAX_LINES_PER_QUERY = 2_000
MAX_MATCHES = 100
MAX_SCAN_BYTES = 64 * 1024 * 1024
MAX_MATCH_LINE_CHARS = 16 * 1024
MANIFEST_OVERHEAD_BYTES = 4 * 1024
INDEX_ENTRY_BYTES = 48
SWEEP_RECORD_LIMIT = 100
GREP_MAX_LINES = 200
DEFAULT_RETRIEVE_LINES = 50

PATH_ACTIONS = ("Block", "Redact", "Allow")
INJECTION_ACTIONS = ("Warn", "Block")


@dataclass(frozen=True)
class Policy:
    """What to block, what to redact and how much text to pass on."""

    blocked_patterns: tuple[str, ...] = DEFAULT_PATH_PATTERNS
    action: str = "Block"
    prompt_injection_action: str = "Block"
    timeout_seconds: int = 30
    max_chars: int = 12_000
    path_prefixes: tuple[str, ...] = ()
    workspace_root: str | None = None

    def __post_init__(self) -> None:
        if self.action not in PATH_ACTIONS:
            raise ValueError(f"unknown path action {self.action!r}")
        if self.prompt_injection_action not in INJECTION_ACTIONS:
            raise ValueError(f"unknown injection action {self.prompt_injection_action!r}")

    @classmethod
    def from_json(cls, text: str | None, **overrides) -> "Policy":
        """Missing keys take their default; text that is no valid policy is ignored."""
        chosen = {}
        try:
            parsed = json.loads(text) if text else {}
            known = {f.name for f in fields(cls)}
            chosen = {k: v for k, v in parsed.items() if k in known}
            for name in ("blocked_patterns", "path_prefixes"):
                if name in chosen:
                    chosen[name] = tuple(chosen[name])
            cls(**chosen)
        except (ValueError, TypeError, AttributeError):
            chosen = {}
        chosen.update({k: v for k, v in overrides.items() if v is not None})
        return cls(**chosen)


@dataclass(frozen=True)
class StoragePolicy:
    """Retention limits."""

    ttl_seconds: int = DAY
    tombstone_ttl_seconds: int = DAY
    max_stream_bytes: int = 64 * 1024 * 1024
    max_total_bytes: int = 1024 * 1024 * 1024
    max_records: int = 1_000

    @classmethod
    def from_settings(cls, ttl=None, tombstone_ttl=None) -> "StoragePolicy":
        def bounded(value) -> int:
            try:
                seconds = int(value)
            except (TypeError, ValueError):
                return DAY
            return seconds if 1 <= seconds <= MAX_TTL else DAY

        return cls(ttl_seconds=bounded(ttl), tombstone_ttl_seconds=bounded(tombstone_ttl))
