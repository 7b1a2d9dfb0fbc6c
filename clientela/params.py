"""Parameters of the products: period, channel, bounds, house rules."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from clientela import constants as K


@dataclass(frozen=True)
class Period:
    """Inclusive range of calendar days; None leaves that end open."""

    start: date | None
    end: date | None

    @classmethod
    def preset(cls, name: str, as_of: date) -> Period:
        """Named period ending on ``as_of``, or every sale there is; an unknown name is an error."""
        if name == K.EVERYTHING:
            return cls(None, None)
        if name in K.PRESET_DAYS:
            return cls(as_of - timedelta(days=K.PRESET_DAYS[name]), as_of)
        if name == K.LAST_12_MONTHS:
            return cls(_one_year_before(as_of), as_of)
        if name == K.THIS_YEAR:
            return cls(date(as_of.year, 1, 1), as_of)
        raise ValueError(f"no period is called {name!r}; there are {', '.join(K.PERIOD_PRESETS)}")

    @classmethod
    def custom(cls, as_of: date, start: date | None = None, end: date | None = None) -> Period:
        """Free choice of days; the last 90 days where nothing is chosen."""
        return cls(start or as_of - timedelta(days=90), end or as_of)

    def contains(self, day: Column) -> Column:
        inside = day.isNotNull()
        if self.start is not None:
            inside = inside & (day >= F.lit(self.start))
        if self.end is not None:
            inside = inside & (day <= F.lit(self.end))
        return inside

    def begins_after(self, day: Column) -> Column:
        """Whether a day lies before the period; never where its start is open."""
        return F.lit(False) if self.start is None else day < F.lit(self.start)

    @property
    def months(self) -> int:
        """Calendar months touched by the period."""
        if self.start is None or self.end is None:
            raise ValueError("reports by month of a period need both of its ends")
        return (self.end.year - self.start.year) * 12 + self.end.month - self.start.month + 1


def _one_year_before(day: date) -> date:
    if (day.month, day.day) == (2, 29):
        return date(day.year - 1, 2, 28)
    return day.replace(year=day.year - 1)


@dataclass(frozen=True)
class Channel:
    """Restriction of sales to a source system and / or to stores whose name holds a fragment."""

    system: str | None = None
    store_fragment: str | None = None

    def predicate(self) -> Column:
        keep = F.lit(True)
        if self.system is not None:
            keep = keep & (F.col("source_system") == self.system)
        if self.store_fragment is not None:
            keep = keep & F.lower("store").contains(self.store_fragment)
        return keep


ONLINE = Channel(system=K.ONLINE_SYSTEM)
PHYSICAL = Channel(system=K.PHYSICAL_SYSTEM)
STORE_CHANNELS = tuple(Channel(store_fragment=f) for f in K.STORE_FRAGMENTS)


@dataclass(frozen=True)
class SegmentRule:
    """A segment: least and most tile of recency and frequency and least tile of value; None is open."""

    name: str
    least_r: int | None = None
    most_r: int | None = None
    least_f: int | None = None
    most_f: int | None = None
    least_m: int | None = None

    def fits(self, r: Column, f: Column, m: Column) -> Column:
        tests = [(r, self.least_r, self.most_r), (f, self.least_f, self.most_f), (m, self.least_m, None)]
        keep = F.lit(True)
        for tile, least, most in tests:
            keep = keep if least is None else keep & (tile >= least)
            keep = keep if most is None else keep & (tile <= most)
        return keep


# the first rule that fits names the customer; "Cannot Lose Them" lies within "At Risk" before it
SEGMENTS = (
    SegmentRule("Champions", least_r=4, least_f=4),
    SegmentRule("Loyal Customers", least_r=3, least_f=3),
    SegmentRule("Promising", least_r=4, most_f=2),
    SegmentRule("Potential Loyalist", least_r=3, most_f=2),
    SegmentRule("At Risk", most_r=2, least_f=3),
    SegmentRule("Cannot Lose Them", most_r=1, least_f=3),
    SegmentRule("About to Sleep", most_r=2, most_f=2, least_m=3),
    SegmentRule("Lost", most_r=1, most_f=1),
)
# the same with the narrower rule first, so that it holds somebody
SEGMENTS_NARROW_FIRST = (*SEGMENTS[:4], SEGMENTS[5], SEGMENTS[4], *SEGMENTS[6:])


@dataclass(frozen=True)
class Rules:
    """What counts as a sale, who counts as a customer, and what segments there are."""

    invoiced_status: str = K.INVOICED_STATUS
    own_shop_patterns: tuple[str, ...] = K.OWN_SHOP_PATTERNS
    online_system: str = K.ONLINE_SYSTEM
    category_prefixes: tuple[tuple[str, str], ...] = K.CATEGORY_PREFIXES
    segments: tuple[SegmentRule, ...] = SEGMENTS


@dataclass(frozen=True)
class Bounds:
    """Inclusive ranges on idle days, number of orders and spend; None is no limit."""

    min_days: int | None = None
    max_days: int | None = None
    min_orders: int | None = None
    max_orders: int | None = None
    min_spend: float | None = None
    max_spend: float | None = None

    def for_objective(self, objective: str) -> Bounds:
        """A known objective overrides days, least orders and least spend, never the other limits."""
        return replace(self, **K.OBJECTIVE_BOUNDS.get(objective, {}))

    def predicate(self) -> Column:
        """Condition on the columns idle_days, orders and spend."""
        keep = F.lit(True)
        for column, least, most in (
            ("idle_days", self.min_days, self.max_days),
            ("orders", self.min_orders, self.max_orders),
            ("spend", self.min_spend, self.max_spend),
        ):
            keep = keep if least is None else keep & (F.col(column) >= least)
            keep = keep if most is None else keep & (F.col(column) <= most)
        return keep
