"""Options of the ledger, in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LedgerConfig:
    # fixed values that results depend on
    ttl_seconds: int = 7200
    ttl_floor: int = 1800
    tombstone_seconds: int = 86_400
    inline_max_bytes: int = 32 * 1024
    text_max_bytes: int = 100 * 1024
    hard_cap_bytes: int = 50 * 1024 * 1024
    binary_probe_bytes: int = 8 * 1024
    log_cut_bytes: int = 32 * 1024
    payload_max_bytes: int = 4 * 1024 * 1024
    replay_keep: int = 500
    replay_limit: int = 50
    glob_limit: int = 1000
    window_lines: int = 2000
    cert_window_seconds: int = 300
    max_hunks: int = 6
    max_changed_pct: float = 0.40
    max_span: int = 200
    span_hunks: int = 3
    diff_trailer_lines: int = 200
    toc_hunks: int = 6
    compress_min_bytes: int = 1024
    min_body_lines: int = 15
    price_per_mtok: float = 3.0
    co2_g_per_ktok: float = 0.4
    ghost_threshold: int = 50
    registry_age_seconds: int = 30 * 86_400
    history_days: int = 30
    top_n: int = 10
    tag: str = "ledger"
    registry_enabled: bool = True
    certificates: bool = True

    @property
    def ttl(self) -> int:
        return max(self.ttl_seconds, self.ttl_floor)


DEFAULT = LedgerConfig()


def parse_duration(text: str) -> int:
    """Seconds of ``30d``, ``12h``, ``90m``, ``45s`` or bare digits; ValueError otherwise."""
    text = text.strip()
    unit = {"d": 86_400, "h": 3600, "m": 60, "s": 1}.get(text[-1:], None)
    digits = text[:-1] if unit else text
    if not (digits.isascii() and digits.isdigit()):
        raise ValueError(f"not a duration: {text!r}")
    return int(digits) * (unit or 1)


def normalize_changed_pct(value: float) -> float:
    """A share given as 0.40 or as 40."""
    return value / 100 if value > 1 else value
