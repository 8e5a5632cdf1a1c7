"""Zone transition tables: offsets by wall-clock threshold, built once a process, zone and release of the zone database.

`VERSION` names the release in use; it is part of each table's key, and whoever spreads work over processes can demand it.
A skipped local time takes the offset before the change, a repeated one is the first of the two. Times beyond the
tables' years are computed one by one from the zone's rule.
"""

from __future__ import annotations

import os
import zoneinfo
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np


def _version() -> str:
    """Release of the zone database: of the package if there is one, else as the system's own files state it."""
    for folder in zoneinfo.TZPATH:
        for name, mark in (("+VERSION", ""), ("tzdata.zi", "# version "), ("version", "")):
            path = os.path.join(folder, name)
            if os.path.isfile(path):
                with open(path, encoding="utf-8") as f:
                    line = f.readline().strip()
                if line.startswith(mark):
                    return line[len(mark) :]
    try:
        from tzdata import IANA_VERSION
    except ImportError:
        return "unknown"
    return IANA_VERSION


VERSION = _version()

#: Years that the tables cover.
FIRST_YEAR, LAST_YEAR = 1970, 2037
# Minutes east of UTC of zone abbreviations; IST is India's, GST the Gulf's.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "IST": 330, "GST": 240, "BST": 60, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "PKT": 300, "NPT": 345,
    "SGT": 480, "AWST": 480, "JST": 540, "ACST": 570, "AEST": 600, "ACDT": 630, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}


@lru_cache(maxsize=1024)
def table(zone: str, version: str = VERSION) -> tuple[np.ndarray, np.ndarray] | None:
    """(wall-clock thresholds, offsets in seconds; one offset more than thresholds), or None for an unknown zone."""
    try:
        z = ZoneInfo(zone)
    except (KeyError, ValueError, OSError):
        return None
    off = lambda t: int(z.utcoffset(datetime.fromtimestamp(t, timezone.utc).astimezone(z)).total_seconds())
    start, end = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in (FIRST_YEAR, LAST_YEAR + 1))
    at, offs = [], [off(start)]
    step = int(timedelta(days=7).total_seconds())
    for lo in range(start, end, step):
        hi = lo + step
        if off(hi) != offs[-1]:
            a, b = lo, hi
            while b - a > 1:
                m = (a + b) // 2
                a, b = (m, b) if off(m) == offs[-1] else (a, m)
            new = off(hi)
            at.append(b + max(new, offs[-1]))
            offs.append(new)
    return np.array(at, dtype=np.int64), np.array(offs, dtype=np.int64)


_BEGIN, _END = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in (FIRST_YEAR, LAST_YEAR + 1))

#: What the calendar of the standard library holds, but for a day at either end.
_CALENDAR = (-62135510400, 253402214400)


def to_utc(wall: np.ndarray, zone: str) -> np.ndarray | None:
    """UTC seconds of wall-clock seconds in `zone`; None if there is no such zone."""
    if (t := table(zone)) is None:
        return None
    out = wall - t[1][np.searchsorted(t[0], wall, side="right")]
    beyond = np.flatnonzero(((wall < _BEGIN) | (wall >= _END)) & (wall > _CALENDAR[0]) & (wall < _CALENDAR[1]))
    if len(beyond):
        z, first = ZoneInfo(zone), datetime(1970, 1, 1)
        for i in beyond:
            out[i] = wall[i] - int(z.utcoffset(first + timedelta(seconds=int(wall[i]))).total_seconds())
    return out
