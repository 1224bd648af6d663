"""Time windows, interval texts and UTC stamps."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from charscape.constants import UTC_FORMAT

_NTZ = "timestamp_ntz"


def ntz(text: str) -> Column:
    """Timestamp without zone from ISO text; a bare date is its midnight."""
    return F.lit(text).cast(_NTZ)


@dataclass(frozen=True)
class DateWindow:
    """Inclusive date window. Bare end dates mean midnight unless ``whole_end_day``."""

    start: str
    end: str
    whole_end_day: bool = False

    def __post_init__(self) -> None:
        if not self.start or not self.end:
            raise ValueError("a date window needs a start and an end")
        datetime.fromisoformat(self.start)
        datetime.fromisoformat(self.end)

    def contains(self, ts: Column) -> Column:
        if self.whole_end_day:
            next_day = F.date_trunc("day", ntz(self.end)).cast(_NTZ) + F.expr("INTERVAL 1 DAY")
            return (ts >= ntz(self.start)) & (ts < next_day)
        return (ts >= ntz(self.start)) & (ts <= ntz(self.end))


@dataclass(frozen=True)
class ColumnWindow:
    """Inclusive window whose bounds are columns, such as those of a job."""

    start: Column
    end: Column

    def contains(self, ts: Column) -> Column:
        return (ts >= self.start) & (ts <= self.end)


Window = DateWindow | ColumnWindow


def hull(pre: Window, post: Window) -> Window:
    """From the start of the first window to the end of the second: what one scan reads."""
    if isinstance(pre, DateWindow) and isinstance(post, DateWindow):
        return DateWindow(pre.start, post.end, post.whole_end_day)
    return ColumnWindow(pre.start, post.end)


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, UTC_FORMAT)


def parse_moment(text: Column) -> Column:
    """ISO text to UTC without zone; NULL when it is no timestamp."""
    zoned = F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), text.try_cast("timestamp").cast(_NTZ)
    )
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.contains(":"), zoned).otherwise(
        text.try_cast(_NTZ)
    )


def parse_interval(text: Column) -> tuple[Column, Column]:
    """``start/end`` with open ends empty or ``..``; anything but two parts gives no bounds."""
    parts = F.split(text, "/")

    def bound(i: int) -> Column:
        part = F.get(parts, F.lit(i))
        return F.when((F.size(parts) == 2) & ~part.isin("", ".."), parse_moment(part))

    return bound(0), bound(1)


def interval_text(start: Column, end: Column) -> Column:
    """The search form of two optional bounds; NULL when both are open."""
    return F.when(
        start.isNotNull() | end.isNotNull(),
        F.concat_ws("/", F.coalesce(start, F.lit("..")), F.coalesce(end, F.lit(".."))),
    )
