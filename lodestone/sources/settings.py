"""Settings from the environment, parsed strictly."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass


def strict_bool(name: str, value: str | None, default: bool) -> bool:
    if value is None or value == "":
        return default
    if value in ("true", "TRUE"):
        return True
    if value in ("false", "FALSE"):
        return False
    raise ValueError(f"{name} must be true or false, got {value!r}")


def positive_int(name: str, value: str | None, default: int) -> int:
    if value is None or value == "":
        return default
    if not value.isascii() or not value.isdigit() or int(value) <= 0:
        raise ValueError(f"{name} must be a positive integer, got {value!r}")
    return int(value)


@dataclass(frozen=True)
class Privacy:
    """What the query log may hold, and for how long."""

    content: bool = False
    raw_output: bool = False
    hmac_key: str = ""
    retention_days: int = 30

    @classmethod
    def of(cls, values: Mapping[str, str]) -> Privacy:
        return cls(
            strict_bool("LOG_CONTENT", values.get("LOG_CONTENT"), False),
            strict_bool("LOG_RAW_OUTPUT", values.get("LOG_RAW_OUTPUT"), False),
            values.get("LOG_HMAC_KEY", ""),
            positive_int("LOG_RETENTION_DAYS", values.get("LOG_RETENTION_DAYS"), 30),
        )
