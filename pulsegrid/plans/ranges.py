"""Date ranges and the windows of composite metrics; all days are UTC days."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone


def _moment(text: str) -> datetime:
    value = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value


def _is_day(text: str) -> bool:
    return len(text) == 10


@dataclass(frozen=True)
class DateRange:
    """From and to, as days or ISO moments; a day as ``to`` counts whole, a moment is included.

    Moments with an offset are taken to UTC.
    """

    start: str
    end: str

    def bounds(self) -> tuple[datetime, datetime, bool]:
        low = _moment(self.start)
        if _is_day(self.end):
            return low, _moment(self.end) + timedelta(days=1), False
        return low, _moment(self.end), True

    def days(self) -> tuple[date, date]:
        return _moment(self.start).date(), _moment(self.end).date()

    @property
    def n_days(self) -> int:
        first, last = self.days()
        return (last - first).days + 1


@dataclass(frozen=True)
class Windows:
    """Windows of a composite: the range, one of equal length before it, and three that end with it."""

    current: DateRange
    baseline: DateRange
    acute7d: DateRange
    chronic28d: DateRange
    long_trend12w: DateRange


def composite_windows(r: DateRange) -> Windows:
    first, last = r.days()
    if last < first:
        raise ValueError("the range ends before it starts")
    span = lambda a, b: DateRange(a.isoformat(), b.isoformat())
    back = lambda n: span(last - timedelta(days=n - 1), last)
    return Windows(span(first, last), span(first - timedelta(days=r.n_days), first - timedelta(days=1)), back(7), back(28), back(84))
