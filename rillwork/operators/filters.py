"""Predicates: optional conjuncts, schedules, content filters and the ranking of candidates, as Columns.

Defined cases: a null text or time matches no filter that asks for something,
and an empty list of a filter asks for nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordered import free

DAYS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")


def conjunction(*conditions: Column | None) -> Column:
    """All conditions that are given; none given is true."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def one_of(column: str, values: list | None) -> Column | None:
    return F.col(column).isin(*values) if values else None


def between(column: str, low=None, high=None) -> Column | None:
    bounds = [F.col(column) >= low if low is not None else None, F.col(column) <= high if high is not None else None]
    return conjunction(*bounds) if any(b is not None for b in bounds) else None


def search(text: str | None, *columns: str) -> Column | None:
    """Whether some column contains the text, whatever its case."""
    if not text:
        return None
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(text.lower()), F.lit(False)) for c in columns])


def clamped(limit: int, low: int = 1, high: int = 1000) -> int:
    return min(max(limit, low), high)


def _second_of_day(clock: str) -> int:
    hour, minute = map(int, clock.split(":"))
    return hour * 3600 + minute * 60


def in_schedule(at: Column, days: tuple[str, ...], start: str, end: str) -> Column:
    """Whether a local time is on one of the days and in [start, end).

    If end comes before start, the window goes over midnight: on a listed day it
    holds from start on and before end; the day after a listed one it still holds before end.
    """
    second = F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    s, e = _second_of_day(start), _second_of_day(end)
    listed = F.dayofweek(at).isin(*[DAYS.index(d) + 1 for d in days])
    after = F.dayofweek(at).isin(*[(DAYS.index(d) + 1) % 7 + 1 for d in days])
    if s <= e:
        return listed & (second >= s) & (second < e)
    return F.when(listed, (second >= s) | (second < e)).otherwise(after & (second < e))


def next_match(at: Column, days: tuple[str, ...], start: str) -> Column:
    """The next time that a window of the schedule opens after a local time, up to seven days on."""
    s = _second_of_day(start)
    midnight = F.date_trunc("day", at)
    opens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda d: midnight + F.make_dt_interval(days=d, secs=F.lit(s)))
    wanted = [DAYS.index(d) + 1 for d in days]
    return F.array_min(F.filter(opens, lambda t: (t > at) & F.dayofweek(t).isin(*wanted)))


def cron_field(field: str, low: int, high: int) -> list[int]:
    """The values of a cron field: stars, lists, ranges and steps."""
    found = set()
    for part in field.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        first = low if span == "*" else int(a)
        last = high if span == "*" or (step and not b) else int(b or a)
        found.update(range(first, last + 1, int(step or 1)))
    return sorted(v for v in found if low <= v <= high)


def in_cron(at: Column, cron: str) -> Column:
    """Whether a local time's minute is named by ``minute hour day month weekday`` (0 and 7 are Sunday)."""
    minute, hour, day, month, weekday = cron.split()
    named = sorted({v % 7 for v in cron_field(weekday, 0, 7)})
    parts = [(F.minute(at), cron_field(minute, 0, 59)), (F.hour(at), cron_field(hour, 0, 23)), (F.dayofmonth(at), cron_field(day, 1, 31)), (F.month(at), cron_field(month, 1, 12)), (F.dayofweek(at) - 1, named)]
    return conjunction(*[c.isin(*v) for c, v in parts])


def keywords_match(title: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """No excluded keyword, and some included one unless none is named; whatever the case."""
    low = F.lower(F.coalesce(title, F.lit("")))
    some = lambda words: reduce(lambda a, b: a | b, [low.contains(w.lower()) for w in words], F.lit(False))
    return ~some(exclude) & (some(include) if include else F.lit(True))


def category_matches(category: Column, allowed: tuple[str, ...] = ()) -> Column:
    return F.coalesce(F.lower(category).isin(*[a.lower() for a in allowed]), F.lit(False)) if allowed else F.lit(True)


def regex_matches(text: Column, pattern: str, exclude: bool = False) -> Column:
    """Whether the text holds the pattern, or doesn't if ``exclude``; a pattern that is none matches nothing either way."""
    try:
        SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return F.lit(False)
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False)) != F.lit(exclude)


def first_reason(*checks: tuple[str, Column]) -> Column:
    """The name of the first check that fails; null if all pass."""
    return F.coalesce(*[F.when(~F.coalesce(passed, F.lit(False)), F.lit(name)) for name, passed in checks])


def preference(value: Column, wanted: tuple[str, ...]) -> Column:
    """The place of the first wanted text that the value contains; the last place if none, 0 if nothing is wanted."""
    cases = [F.when(F.coalesce(F.lower(value).contains(w.lower()), F.lit(False)), F.lit(i)) for i, w in enumerate(wanted)]
    return F.coalesce(*cases, F.lit(len(wanted))) if wanted else F.lit(0)


def ranked_candidates(rows: DataFrame, key: str, barred: Column, fits: Column, order: list[Column]) -> DataFrame:
    """The candidates of each key in order, with ``place`` from 1 on.

    Barred ones are out.  Those that don't fit are out too, unless none of the key fits.
    If the rows have a column ``place``, the new one is ``place_``.
    """
    fit, some = free("fits", rows), free("some", rows)
    left = rows.filter(~F.coalesce(barred, F.lit(False))).withColumn(fit, F.coalesce(fits, F.lit(False)))
    left = left.withColumn(some, F.max(fit).over(Window.partitionBy(key))).filter(F.col(fit) | ~F.col(some)).drop(fit, some)
    return left.withColumn(free("place", rows), F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def worst(*levels: Column) -> Column:
    """The greatest of ranked levels; null ones don't count."""
    return F.greatest(*levels)


def variant_choice(variants: DataFrame, playlist: str, number: str, bandwidth: str, target: int) -> DataFrame:
    """(playlist, highest, lowest, closest): the numbers of the variants to choose; of equal ones the lowest number, null bandwidths never."""
    rate = F.col(bandwidth)
    least = lambda by: F.min(F.when(rate.isNotNull(), F.struct(by, F.col(number))))[number]
    return variants.groupBy(playlist).agg(least((-rate).alias("by")).alias("highest"), least(rate.alias("by")).alias("lowest"), least(F.abs(rate - target).alias("by")).alias("closest"))
