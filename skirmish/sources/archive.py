"""Moving a grown log aside."""

from __future__ import annotations

import os
from datetime import datetime

DEFAULT_MB = 200


def clamp_mb(mb: int) -> int:
    """Archive limit within 5..4000 MB."""
    return max(5, min(4000, mb))


def archive_log(path: str, max_bytes: int = DEFAULT_MB * 1024 * 1024, now: datetime | None = None) -> tuple[str | None, str | None]:
    """Rename a log of at least ``max_bytes`` to ``<stem>.yyyymmdd-hhmmss[-n].txt``.

    Gives ``(new path or None, error or None)``; it never raises.
    """
    try:
        if os.path.getsize(path) < max_bytes:
            return None, None
        stem, ext = os.path.splitext(path)
        base = f"{stem}.{(now or datetime.now()):%Y%m%d-%H%M%S}"
        target, n = base + ext, 1
        while os.path.exists(target):
            target, n = f"{base}-{n}{ext}", n + 1
        os.rename(path, target)
        return target, None
    except OSError as e:
        return None, str(e)
