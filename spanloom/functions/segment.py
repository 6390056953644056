"""Expressions on segments (two double columns, seconds) and sliding windows.

A segment is empty when it is not longer than ``EPS``. Everything here is a column expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, inf, isinf

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


@dataclass(frozen=True)
class Seg:
    """The start and end columns of one segment."""

    start: Column
    end: Column

    @classmethod
    def of(cls, prefix: str = "") -> Seg:
        return cls(F.col(f"{prefix}start"), F.col(f"{prefix}end"))

    def filled(self) -> Column:
        return (self.end - self.start) > EPS

    def duration(self) -> Column:
        return F.when(self.filled(), self.end - self.start).otherwise(F.lit(0.0))

    def middle(self) -> Column:
        return (self.start + self.end) * 0.5

    def contains(self, other: Seg) -> Column:
        return (self.start <= other.start) & (self.end >= other.end)

    def intersection(self, other: Seg) -> Seg:
        return Seg(F.greatest(self.start, other.start), F.least(self.end, other.end))

    def intersects(self, other: Seg) -> Column:
        """Both non-empty, and more than the tolerance in common."""
        common = F.greatest(self.start, other.start) < F.least(self.end, other.end) - EPS
        return self.filled() & other.filled() & common

    def overlaps(self, t: Column) -> Column:
        return t.between(self.start, self.end)

    def hull(self, other: Seg) -> Seg:
        """The smallest segment around both; an empty one changes nothing."""

        def pick(own: Column, its: Column, both: Column) -> Column:
            return F.when(~self.filled(), its).when(~other.filled(), own).otherwise(both)

        return Seg(
            pick(self.start, other.start, F.least(self.start, other.start)),
            pick(self.end, other.end, F.greatest(self.end, other.end)),
        )

    def gap(self, other: Seg) -> Seg:
        """What lies between two non-empty segments; null if either is empty."""
        both = self.filled() & other.filled()
        return Seg(
            F.when(both, F.least(self.end, other.end)), F.when(both, F.greatest(self.start, other.start))
        )

    def extended(self, left: float, right: float) -> Seg:
        return Seg(self.start - F.lit(left), self.end + F.lit(right))

    def text(self) -> Column:
        filled = F.format_string("[%.3f --> %.3f]", self.start, self.end)
        return F.when(self.filled(), filled).otherwise(F.lit("∅"))

    def pretty(self) -> Column:
        both = F.concat(F.lit("["), clock(self.start), F.lit(" --> "), clock(self.end), F.lit("]"))
        return F.when(self.filled(), both).otherwise(F.lit("∅"))

    def struct(self) -> Column:
        return F.struct(self.start.alias("start"), self.end.alias("end"))

    def json(self) -> Column:
        return F.to_json(self.struct())


def clock(seconds: Column) -> Column:
    """HH:MM:SS.mmm, with days in front if there are any."""
    ms = F.floor(seconds * 1000 + 0.5).cast("long")
    day = F.floor(ms / 86_400_000)
    parts = [F.floor(ms / 3_600_000) % 24, F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000]
    time = F.format_string("%02d:%02d:%02d.%03d", *[p.cast("long") for p in parts])
    return F.when(day > 0, F.concat(F.format_string("%d:", day.cast("long")), time)).otherwise(time)


def parse_clock(text: Column) -> Column:
    """Seconds of ``[HH:]MM:SS[.,]mmm``."""
    part = F.reverse(F.split(F.regexp_replace(F.trim(text), ",", "."), ":"))
    at = lambda i: F.coalesce(F.try_element_at(part, F.lit(i)).cast("double"), F.lit(0.0))
    return at(1) + 60 * at(2) + 3600 * at(3)


@dataclass(frozen=True)
class SlidingWindow:
    """Windows of ``duration`` every ``step`` from ``start``; positions begin before ``end``."""

    duration: float = 0.030
    step: float = 0.010
    start: float = 0.0
    end: float = inf

    def __post_init__(self) -> None:
        if self.duration <= 0 or self.step <= 0 or self.end <= self.start:
            raise ValueError("duration and step must be positive, and end after start")

    @classmethod
    def of_frames(cls, block: int, step: int, rate: float) -> SlidingWindow:
        """Windows of ``block`` samples centred on multiples of ``step`` samples."""
        return cls(block / rate, step / rate, -0.5 * block / rate)

    def __len__(self) -> int:
        if isinf(self.end):
            raise ValueError("an infinite window has no length")
        n = ceil((self.end - self.start) / self.step)
        while n > 0 and self.start + (n - 1) * self.step >= self.end:
            n -= 1
        while self.start + n * self.step < self.end:
            n += 1
        return n

    def closest_frame(self, t: Column) -> Column:
        """Ties go to the even frame."""
        return F.rint((t - F.lit(self.start) - 0.5 * self.duration) / self.step).cast("long")

    def to_range(self, seg: Seg) -> tuple[Column, Column]:
        """First frame and number of frames of a segment."""
        first = F.greatest(F.lit(0).cast("long"), self.closest_frame(seg.start))
        return first, self.closest_frame(seg.end) - first

    def to_segment(self, first: Column, n: Column) -> Seg:
        start = F.lit(self.start) + (first - 0.5) * self.step + 0.5 * self.duration
        snapped = F.when(first == 0, F.lit(self.start)).otherwise(start)
        return Seg(snapped, start + n * self.step)

    def position(self, i: Column) -> Seg:
        """The i-th window; null beyond the end. Windows are not clipped."""
        start = F.lit(self.start) + i * self.step
        inside = F.when(start < F.lit(self.end), start)
        return Seg(inside, inside + self.duration)

    def positions(self) -> Column:
        """Frame numbers of all windows, as an array."""
        n = len(self)
        return F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")
