"""What is settled before a plan is built: ranges of dates, how bars are made, and whether a component can run."""

from __future__ import annotations

import calendar
import datetime as dt
from dataclasses import dataclass, field, replace

from tickloom.functions.resolution import Resolution, supported

#: A bar that nothing closes waits for this share of its length.
STALE_SHARE = 0.1


def _day(value) -> dt.date | None:
    if value is None or value == "":
        return None
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def _back(day: dt.date, n: int, frame: str) -> dt.date:
    """The day that many weeks, months or years before; a day that the month lacks is its last one."""
    if frame in ("DAY", "WEEK"):
        return day - dt.timedelta(days=n * (7 if frame == "WEEK" else 1))
    month = day.year * 12 + day.month - 1 - n * (12 if frame == "YEAR" else 1)
    year, month = divmod(month, 12)
    return dt.date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


def data_range(given, today: dt.date) -> tuple[dt.date | None, dt.date | None]:
    """(start, end), both included, of what a user gives.

    None is no range. A pair, or a dict of ``start_date`` and perhaps ``end_date``, has days or
    their texts; a missing end is ``today``. ``ytd`` is from the first of January on, and a
    period (``3d``, ``2w``, ``1mo``, ``1y``, or a resolution of such) goes back from ``today``.
    """
    if given is None:
        return None, None
    if isinstance(given, tuple):
        if len(given) != 2:
            raise ValueError("a range has a start and an end")
        given = {"start_date": given[0], "end_date": given[1]}
    if isinstance(given, dict):
        if set(given) - {"start_date", "end_date"} or not given.get("start_date"):
            raise ValueError("a range has start_date and end_date")
        start, end = _day(given["start_date"]), _day(given.get("end_date")) or today
    elif given == "ytd":
        start, end = dt.date(today.year, 1, 1), today
    else:
        r = given if isinstance(given, Resolution) else Resolution(given)
        if r.frame not in ("DAY", "WEEK", "MONTH", "YEAR"):
            raise ValueError(f"a range goes back by days or more, not by {r!r}")
        start, end = _back(today, r.period, r.frame), today
    if start > end:
        raise ValueError("a range begins before it ends")
    return start, end


@dataclass(frozen=True)
class DataConfig:
    """How the bars of some resolutions are made; mappings are by the names of resolutions."""

    resolutions: tuple[str, ...]
    resample: dict[str, str] = field(default_factory=dict)
    skip_first: dict[str, bool] = field(default_factory=dict)
    stale_wait: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        for name in ("resample", "skip_first", "stale_wait"):
            object.__setattr__(self, name, {str(Resolution(k)): v for k, v in getattr(self, name).items()})
        object.__setattr__(self, "resolutions", tuple(str(Resolution(r)) for r in self.resolutions))
        object.__setattr__(self, "resample", {k: str(Resolution(v)) for k, v in self.resample.items()})
        for made, of in self.resample.items():
            coarse, fine = Resolution(made), Resolution(of)
            if coarse < fine or coarse.seconds() % fine.seconds():
                raise ValueError(f"{made} is not made of {of}")
        for r, wait in self.stale_wait.items():
            if not Resolution(r).is_bar or not 0 <= wait < Resolution(r).seconds():
                raise ValueError(f"the wait of {r} is shorter than the bar")

    def settled(self, offered: dict[str, list[int]]) -> DataConfig:
        """With what was left open: resolutions that a source does not offer are made of one that it does, bars that
        are resampled lack their first one, and idle bars wait for a tenth of their length. What was given stays."""
        made = dict(self.resample)
        for r in self.resolutions:
            if r not in made and (of := str(supported(Resolution(r), offered))) != r:
                made[r] = of
        # An hour made of 60 minutes is whole from the start; one made of other bars begins anywhere.
        partial = {r: r in made and Resolution(r).seconds() != Resolution(made[r]).seconds() for r in self.resolutions}
        waits = {r: STALE_SHARE * Resolution(r).seconds() for r in self.resolutions if Resolution(r).is_bar}
        return replace(self, resample=made, skip_first=partial | self.skip_first, stale_wait=waits | self.stale_wait)


@dataclass(frozen=True)
class Inputs:
    """What a component is given: its form, whether it has bars of its own and whether data are features, and its children."""

    name: str
    resolution: str
    form: str = "long"
    is_strategy: bool = False
    has_bars: bool = False
    has_features: bool = False
    children: tuple[Inputs, ...] = ()


def require_inputs(of: Inputs) -> None:
    """A component can be run if something gives its keys and something its features.

    A strategy has bars. Another component without bars takes its keys from a child of the same
    resolution, which is long if it is itself; coarser children cannot make up bars. Without
    children some data must be features.
    """
    if not of.has_bars:
        if of.is_strategy:
            raise ValueError(f"{of.name} is a strategy and has no bars")
        if not of.children:
            raise ValueError(f"{of.name} has neither bars nor children")
        same = [c for c in of.children if str(Resolution(c.resolution)) == str(Resolution(of.resolution))]
        if not any(of.form == "wide" or c.form == "long" for c in same):
            raise ValueError(f"{of.name} has no bars and no child of its resolution and form")
    if not of.children and not of.has_features:
        raise ValueError(f"{of.name} has no features")
    for c in of.children:
        require_inputs(c)
