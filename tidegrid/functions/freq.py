"""Frequencies: aliases, steps along the calendar and the distance between two stamps."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {
    "s": ("seconds", 1), "S": ("seconds", 1), "min": ("minutes", 1), "T": ("minutes", 1), "h": ("hours", 1), "H": ("hours", 1),
    "D": ("days", 1), "W": ("days", 7), "MS": ("months", 1), "mo": ("months", 1), "M": ("months", 1), "QS": ("months", 3), "Q": ("months", 3),
    "YS": ("months", 12), "Y": ("months", 12), "y": ("months", 12), "d": ("days", 1), "w": ("days", 7), "m": ("minutes", 1), "q": ("months", 3),
}
_SECONDS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}
#: Rows of a season, by the unit a frequency steps in.
SEASONS = {"h": 24, "H": 24, "D": 7, "d": 7, "W": 1, "w": 1, "MS": 12, "M": 12, "mo": 12, "QS": 4, "Q": 4, "q": 4, "YS": 1, "Y": 1, "y": 1}


@dataclass(frozen=True)
class Freq:
    """A step of `step` units; unit `int` is for integer time columns."""

    alias: str
    unit: str
    step: int

    def add(self, stamp: Column, k: Column | int) -> Column:
        """stamp moved by k steps, from the anchor itself, so that month ends don't drift."""
        k = F.lit(k) if isinstance(k, int) else k
        n = (k * self.step).cast("int")
        if self.unit == "int":
            return stamp + k * self.step
        if self.unit == "months":
            return stamp + F.make_ym_interval(F.lit(0), n)
        days, hours, minutes, seconds = (n if self.unit == u else F.lit(0) for u in ("days", "hours", "minutes", "seconds"))
        return stamp + F.make_dt_interval(days, hours, minutes, seconds.cast("decimal(18,6)"))

    def steps(self, first: Column, last: Column) -> Column:
        """Whole steps from first to last, as a long."""
        if self.unit == "int":
            return F.floor((last - first) / self.step).cast("long")
        if self.unit == "months":
            months = (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first)
            return F.floor(months / self.step).cast("long")
        return F.floor((F.unix_timestamp(last.cast("timestamp")) - F.unix_timestamp(first.cast("timestamp"))) / (_SECONDS[self.unit] * self.step)).cast("long")

    def grid(self, first: Column, last: Column) -> Column:
        """An array of all stamps from first to last."""
        return F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(self.steps(first, last), F.lit(0).cast("long"))), lambda k: self.add(first, k))

    @property
    def season(self) -> int:
        return max(1, SEASONS.get(re.sub(r"^\d+", "", self.alias), 1) // (self.step if self.unit in _SECONDS and self.alias[:1].isdigit() else 1))


def freq(alias: str | int) -> Freq:
    """Parses `D`, `15min`, `2h`, `MS`, `1mo`, or an integer step."""
    if isinstance(alias, int):
        return Freq(str(alias), "int", alias)
    m = re.fullmatch(r"(\d*)([A-Za-z]+)(-[A-Z]+)?", alias)
    if not m or m[2] not in _UNITS:
        raise ValueError(f"unknown frequency {alias!r}")
    unit, size = _UNITS[m[2]]
    return Freq(alias, unit, size * int(m[1] or 1))
