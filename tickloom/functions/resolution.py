"""Bar resolutions: a value type for the driver and expressions for columns."""

from __future__ import annotations

import re
from functools import total_ordering

from pyspark.sql import Column
from pyspark.sql import functions as F

# Time frames in seconds (quotes and ticks have none), and their aliases.
SECONDS = {"QUOTE": -2, "TICK": -1, "SECOND": 1, "MINUTE": 60, "HOUR": 3600, "DAY": 86400, "WEEK": 604800, "MONTH": 2592000, "YEAR": 31536000}
ALIASES = {
    "q": "QUOTE", "quote": "QUOTE", "quotes": "QUOTE",
    "t": "TICK", "tick": "TICK", "ticks": "TICK",
    "s": "SECOND", "sec": "SECOND", "secs": "SECOND", "second": "SECOND", "seconds": "SECOND",
    "m": "MINUTE", "min": "MINUTE", "mins": "MINUTE", "minute": "MINUTE", "minutes": "MINUTE",
    "h": "HOUR", "hr": "HOUR", "hrs": "HOUR", "hour": "HOUR", "hours": "HOUR",
    "d": "DAY", "day": "DAY", "days": "DAY",
    "w": "WEEK", "wk": "WEEK", "wks": "WEEK", "week": "WEEK", "weeks": "WEEK",
    "mo": "MONTH", "mon": "MONTH", "mons": "MONTH", "month": "MONTH", "months": "MONTH",
    "y": "YEAR", "yr": "YEAR", "yrs": "YEAR", "year": "YEAR", "years": "YEAR",
}
SHORT = {"QUOTE": "q", "TICK": "t", "SECOND": "s", "MINUTE": "m", "HOUR": "h", "DAY": "d", "WEEK": "w", "MONTH": "mo", "YEAR": "y"}
BARS = ("SECOND", "MINUTE", "HOUR", "DAY")
#: Units of the next finer time frame in one of this.
FINER = {"DAY": ("HOUR", 24), "HOUR": ("MINUTE", 60), "MINUTE": ("SECOND", 60)}

PATTERN = r"^(\d*)[-_]?([A-Za-z]+?)(?:_[Ll]([1-3]))?$"


@total_ordering
class Resolution:
    """``1m``, ``15_MINUTE``, ``q_L2``. Finer resolutions are less; 60m and 1h differ."""

    def __init__(self, text: str):
        m = re.match(PATTERN, text.strip())
        frame = m and (ALIASES.get(m[2].lower()) or (m[2].upper() if m[2].upper() in SECONDS else None))
        if not frame or m[1] and int(m[1]) < 1:
            raise ValueError(f"not a resolution: {text!r}")
        self.period, self.frame = int(m[1] or 1), frame
        if m[3] and frame != "QUOTE":
            raise ValueError("only quotes have levels")
        self.level = int(m[3] or 1) if frame == "QUOTE" else None

    @property
    def key(self) -> tuple[int, int, int]:
        return SECONDS[self.frame], self.period, -(self.level or 0)

    @property
    def is_bar(self) -> bool:
        return self.frame in BARS

    def seconds(self) -> int:
        return self.period * SECONDS[self.frame]

    def __eq__(self, other) -> bool:
        return isinstance(other, Resolution) and self.key == other.key

    def __lt__(self, other) -> bool:
        return self.key < other.key

    def __hash__(self) -> int:
        return hash(self.key)

    def __str__(self) -> str:
        return f"{self.period}_{self.frame}" + (f"_L{self.level}" if self.level else "")

    def __repr__(self) -> str:
        return f"{self.period}{SHORT[self.frame]}" + (f"_L{self.level}" if self.level else "")

    def to_unit(self) -> Resolution:
        return Resolution(f"1_{self.frame}" + (f"_L{self.level}" if self.level else ""))

    def finer(self) -> Resolution:
        """One unit of the next finer frame; of quotes the next level. The finest stays as it is."""
        if self.level:
            return Resolution(f"1_QUOTE_L{self.level + 1}") if self.level < 3 else self
        frames = list(SECONDS)
        return Resolution(f"1_{frames[frames.index(self.frame) - 1]}")

    def coarser(self) -> Resolution:
        """One unit of the next coarser frame; of quotes the level before, then ticks. The coarsest frame stays."""
        if self.level and self.level > 1:
            return Resolution(f"1_QUOTE_L{self.level - 1}")
        frames = list(SECONDS)
        return Resolution(f"1_{frames[min(frames.index(self.frame) + 1, len(frames) - 1)]}")


def supported(wanted: Resolution, offered: dict[str, list[int]], shifts: dict[str, int] | None = None) -> Resolution:
    """The resolution to ask a source for: the wanted period, else the least that divides it, else finer units.

    ``offered`` has the periods of each time frame; a shift of the coarser unit takes the place of a whole unit.
    """
    frame, period = wanted.frame, wanted.period
    while True:
        periods = [p for p in offered.get(frame, []) if period % p == 0]
        if period in offered.get(frame, []):
            return Resolution(f"{period}_{frame}")
        if periods:
            return Resolution(f"{min(periods)}_{frame}")
        if frame not in FINER:
            raise ValueError(f"no offered resolution makes {wanted!r}")
        finer, units = FINER[frame]
        frame, period = finer, (shifts or {}).get(frame) or units


def parsed(text: Column) -> Column:
    """Struct (period, timeframe, level, seconds) of a column of resolutions; null where it is none."""
    word = F.lower(F.regexp_extract(text, PATTERN, 2))
    names = F.create_map(*[F.lit(x) for k, v in ALIASES.items() for x in (k, v)])
    frame = names[word]
    seconds = F.create_map(*[F.lit(x) for k, v in SECONDS.items() for x in (k, v)])
    digits = F.regexp_extract(text, PATTERN, 1)
    period = F.when(digits == "", 1).otherwise(F.expr("1").cast("int") * F.try_to_number(F.when(digits != "", digits), F.lit("999999999")).cast("int"))
    level = F.regexp_extract(text, PATTERN, 3)
    return F.when(
        frame.isNotNull() & (period >= 1),
        F.struct(
            period.cast("bigint").alias("period"), frame.alias("timeframe"),
            F.when(frame == "QUOTE", F.when(level == "", 1).otherwise(F.try_to_number(F.when(level != "", level), F.lit("9")).cast("int"))).cast("bigint").alias("level"),
            (period * seconds[frame]).cast("bigint").alias("seconds"),
        ),
    )
