"""Validated analysis options (as-of instant and trend window)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

MIN_WINDOW_DAYS = 7
MAX_WINDOW_DAYS = 3_650
DEFAULT_WINDOW_DAYS = 1_095


@dataclass(frozen=True)
class Options:
    """``as_of`` is epoch seconds; ``None`` means the latest result of each series, never the clock."""

    as_of: int | None = None
    window_days: int = DEFAULT_WINDOW_DAYS

    def __post_init__(self) -> None:
        if not MIN_WINDOW_DAYS <= self.window_days <= MAX_WINDOW_DAYS:
            raise ValueError(f"window_days must be between {MIN_WINDOW_DAYS} and {MAX_WINDOW_DAYS}")

    @classmethod
    def parse(cls, as_of: str | None = None, window_days: str | int | None = None) -> "Options":
        """From request-style text: a date means the end of that UTC day."""
        if window_days in (None, ""):
            days = DEFAULT_WINDOW_DAYS
        else:
            try:
                days = int(str(window_days).strip())
            except ValueError:
                days = -1
        return cls(as_of=_instant(as_of) if as_of else None, window_days=days)


def _instant(raw: str) -> int:
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", raw):
        try:
            day = datetime.strptime(raw, "%Y-%m-%d").replace(tzinfo=timezone.utc)
            return int((day + timedelta(days=1)).timestamp()) - 1
        except ValueError:
            pass
    elif re.fullmatch(r"\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})", raw):
        try:
            return int(datetime.fromisoformat(raw.upper().replace("Z", "+00:00")).timestamp() // 1)
        except ValueError:
            pass
    raise ValueError("as_of must be YYYY-MM-DD or an RFC 3339 timestamp")
