"""Cron expressions of subscriptions: evaluated on the driver, since they are a handful of settings."""

from __future__ import annotations

from datetime import datetime, time, timedelta


def _matches(part: str, value: int, low: int) -> bool:
    """One field of a cron expression: *, numbers, ranges, steps and lists of these."""
    for piece in part.split(","):
        span, _, step = piece.partition("/")
        first, _, last = span.partition("-")
        begin, end = (low, 99) if span == "*" else (int(first), int(last or (99 if step else first)))
        if begin <= value <= end and (value - begin) % int(step or 1) == 0:
            return True
    return False


def due(expression: str, last_run: datetime | None, now: datetime) -> bool:
    """Whether a fire time lies after the last run and not after now; "once:" is always due, a first run never is."""
    if expression.startswith("once:"):
        return True
    if last_run is None:
        return False
    minute, hour, day, month, weekday = expression.split()
    times = [time(h, m) for h in range(24) if _matches(hour, h, 0) for m in range(60) if _matches(minute, m, 0)]
    start = last_run.replace(second=0, microsecond=0) + timedelta(minutes=1)
    for i in range((now.date() - start.date()).days + 1):
        on = start.date() + timedelta(days=i)
        if _matches(day, on.day, 1) and _matches(month, on.month, 1) and _matches(weekday, on.isoweekday() % 7, 0):
            if any(start <= datetime.combine(on, t, start.tzinfo) <= now for t in times):
                return True
    return False
