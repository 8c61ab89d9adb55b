"""Edges of schedules in zones with changing offsets: when a window opens and closes, when a cron matches next.

Times are microseconds of UTC.  A local time that a zone skips has no instant,
one that it repeats has two.  Offsets are taken to change by multiples of a
quarter of an hour, three hours at most.  A null time has no edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters
from .ordered import free

MINUTE, DAY = 60_000_000, 86_400_000_000
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
_NAMES = {n: i for names, start in ((("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1),) for i, n in enumerate(names, start)}
_WEEK = {d.lower(): i for i, d in enumerate(filters.DAYS)}


def _clock(us: Column) -> Column:
    """The timestamp without zone that lies so many microseconds after the epoch."""
    return F.timestamp_add("MICROSECOND", us, F.expr(_EPOCH))


def _us(clock: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), clock)


def local_us(us: Column, zone: str) -> Column:
    """The local time of an instant, as microseconds of a clock without zone."""
    return _us(F.convert_timezone(F.lit("UTC"), F.lit(zone), _clock(us)))


def instants(local: Column, zone: str) -> Column:
    """The instants that have a local time, ascending: none in a gap, two if the clock goes back over it."""
    guess = _us(F.convert_timezone(F.lit(zone), F.lit("UTC"), _clock(local)))
    quarter = 15 * MINUTE
    near = F.transform(F.sequence(F.lit(-12), F.lit(12)), lambda k: guess + k.cast("long") * quarter)
    return F.filter(near, lambda u: local_us(u, zone) == local)


def _of_day(clock: str) -> int:
    parts = [int(p) for p in clock.split(":")]
    return sum(p * s for p, s in zip(parts, (3600, 60, 1), strict=False)) * 1_000_000


def _listed(day: Column, days: tuple[str, ...]) -> Column:
    """Whether a day, counted from the epoch on, is one of the days; the epoch was a Thursday."""
    return ((day + 4) % 7).isin(*[_WEEK[d.lower()[:3]] for d in days])


def _day(local: Column) -> Column:
    """The day of a local time, counted from the epoch on."""
    return F.call_function("div", local - F.pmod(local, F.lit(DAY)), F.lit(DAY))


def in_window(at: Column, days: tuple[str, ...], start: str, end: str, zone: str) -> Column:
    """Whether an instant is in the window, which goes over midnight if its end comes before its start."""
    return filters.in_schedule(_clock(local_us(at, zone)), days, start, end)


def _openings(day: Column, days: tuple[str, ...], start: str, zone: str) -> Column:
    """The instants, ascending, at which the window opens on a day and the seven after it; days on which that local time comes never or twice are left out."""
    opens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.struct((day + k).alias("day"), instants((day + k) * DAY + _of_day(start), zone).alias("at")))
    fit = F.filter(opens, lambda o: (F.size(o["at"]) == 1) & _listed(o["day"], days))
    return F.array_sort(F.transform(fit, lambda o: o["at"][0]))


def _closing(day: Column, days: tuple[str, ...], start: str, end: str, zone: str) -> Column:
    """When the window that is open at some time of a day closes.

    If the clock goes back over that time, the later instant counts; if it is skipped, the first minute after the gap.
    """
    over = _of_day(start) > _of_day(end)
    closes = (F.when(_listed(day, days), day + 1).otherwise(day) if over else day) * DAY + _of_day(end)
    found = instants(closes, zone)
    beyond = F.transform(F.sequence(F.lit(1), F.lit(180)), lambda m: F.array_max(instants(closes + m.cast("long") * MINUTE, zone)))
    first = F.get(F.filter(beyond, lambda u: u.isNotNull()), F.lit(0))
    return F.when(F.size(found) > 0, F.array_max(found)).otherwise(first).cast("long")


def _next(openings: Column, at: Column) -> Column:
    return F.get(F.filter(openings, lambda o: o > at), F.lit(0))


def next_opening(at: Column, days: tuple[str, ...], start: str, zone: str) -> Column:
    """The next instant, up to seven days on, at which the window opens; days on which that local time comes never or twice are left out.

    This tries many instants for each row; ``window_edges`` does for each day.
    """
    return _next(_openings(_day(local_us(at, zone)), days, start, zone), at)


def next_closing(at: Column, days: tuple[str, ...], start: str, end: str, zone: str) -> Column:
    """When the window that an instant is in closes; null outside.  This tries many instants for each row, too."""
    return F.when(in_window(at, days, start, end, zone), _closing(_day(local_us(at, zone)), days, start, end, zone))


def window_edges(rows: DataFrame, at: str, days: tuple[str, ...], start: str, end: str, zone: str) -> DataFrame:
    """Adds ``inside``, ``opens`` and ``closes``: whether a row's instant is in the window, and what ``next_opening`` and ``next_closing`` give.

    Edges are found once for each local day that the rows have; those go to all tasks, a row meets its day's.
    If the rows have columns of these names, the added ones have an underscore behind theirs.
    """
    local, day, opening, closing = (free(c, rows) for c in ("local", "day", "openings", "closing"))
    timed = rows.withColumn(local, local_us(F.col(at), zone)).withColumn(day, _day(F.col(local)))
    # the column alone, so that only the times are read for it
    found = timed.select(day).filter(F.col(day).isNotNull()).distinct()
    edges = found.select(day, _openings(F.col(day), days, start, zone).alias(opening), _closing(F.col(day), days, start, end, zone).alias(closing))
    met = timed.join(F.broadcast(edges), day, "left")
    inside = filters.in_schedule(_clock(F.col(local)), days, start, end)
    added = {"inside": inside, "opens": _next(F.col(opening), F.col(at)), "closes": F.when(inside, F.col(closing))}
    return met.select(*rows.columns, *[c.alias(free(n, rows)) for n, c in added.items()])


def cron_parts(cron: str) -> tuple[list[int], list[list[int]]]:
    """(seconds, [minutes, hours, days, months, weekdays from Sunday 0 on]) of a cron of five fields, or of six with seconds.

    Months and weekdays may be names.  Of six fields, weekdays count from Sunday 1 on; of five, 0 and 7 are Sunday.
    """
    fields = cron.lower().split()
    six = len(fields) == 6
    second, (minute, hour, day, month, week) = (fields[0], fields[1:]) if six else ("0", fields)
    for name, n in _NAMES.items():
        month = month.replace(name, str(n))
    for name, n in _WEEK.items():
        week = week.replace(name, str(n + six))
    star = lambda field: "*" if field == "?" else field
    weekdays = sorted({(v - six) % 7 for v in filters.cron_field(star(week), int(six), 7)})
    return filters.cron_field(second, 0, 59), [filters.cron_field(minute, 0, 59), filters.cron_field(hour, 0, 23), filters.cron_field(star(day), 1, 31), filters.cron_field(month, 1, 12), weekdays]


def _matches(local: Column, parts: list[list[int]]) -> Column:
    clock = _clock(local)
    values = (F.minute(clock), F.hour(clock), F.dayofmonth(clock), F.month(clock), F.dayofweek(clock) - 1)
    return filters.conjunction(*[v.isin(*p) for v, p in zip(values, parts, strict=True)])


def cron_edges(rows: DataFrame, at: str, cron: str, zone: str = "UTC", days: int = 8) -> DataFrame:
    """Adds ``matches``, ``next_match`` and ``next_unmatch`` of a cron that is read in a zone, minute by minute.

    ``next_match`` is the first second named in the first matching minute after the row's own, up to ``days`` on;
    ``next_unmatch`` the start of the first minute that doesn't match, null if the row's doesn't or if none follows in
    ``days``.  The matching minutes of each day in the rows' span, and ``days`` beyond, are found once, as runs; rows meet
    their day's.  If the rows have columns of these names, the added ones have an underscore behind theirs.
    """
    seconds, parts = cron_parts(cron)
    span = rows.agg(F.min(at).alias("low"), F.max(at).alias("high")).filter("low is not null")
    day = span.select(F.explode(F.sequence(F.floor(F.col("low") / DAY), F.floor(F.col("high") / DAY) + days + 1)).alias("day"))
    minutes = day.select("day", F.explode(F.sequence(F.lit(0), F.lit(1439))).alias("m"))
    hit = minutes.filter(_matches(local_us(F.col("day") * DAY + F.col("m").cast("long") * MINUTE, zone), parts))
    # runs of matching minutes inside each day, both ends as minutes from the epoch on, the end not included
    mask = hit.groupBy("day").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    starts = F.filter("ms", lambda m: ~F.array_contains("ms", m - 1))
    ends = F.filter("ms", lambda m: ~F.array_contains("ms", m + 1))
    runs = day.join(mask, "day", "left").select("day", F.transform(F.coalesce(F.arrays_zip(starts.alias("a"), ends.alias("b")), F.array()), lambda r: F.struct((F.col("day") * 1440 + r["a"]).alias("a"), (F.col("day") * 1440 + r["b"] + 1).alias("b"))).alias("runs"))
    return _met(rows, at, runs, seconds[0] if seconds else 0, days)


def _met(rows: DataFrame, at: str, runs: DataFrame, second: int, days: int) -> DataFrame:
    """Rows with the edges that their day's runs give, or those of the days after."""
    from pyspark.sql import Window

    # one row for each day of the span
    line = Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    after = Window.orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    first = F.get("runs", F.lit(0))
    midnight = F.col("day") * 1440
    whole = (F.size("runs") == 1) & (first["a"] == midnight) & (first["b"] == midnight + 1440)
    head_end = F.when(~whole | F.col("runs").isNull() | (F.size("runs") == 0), F.when(first["a"] == midnight, first["b"]).otherwise(midnight))
    table = runs.select("day", "runs", F.first(head_end, ignorenulls=True).over(line).alias("through"), F.first(first["a"], ignorenulls=True).over(after).alias("later"))
    table = table.withColumn("next_through", F.lead("through").over(Window.orderBy("day")))
    of, names = {c: free(c, rows) for c in ("day", "runs", "through", "later", "next_through", "minute")}, [free(c, rows) for c in ("matches", "next_match", "next_unmatch")]
    table = table.toDF(*[of[c] for c in ("day", "runs", "through", "later", "next_through")])
    timed = rows.withColumn(of["minute"], F.floor(F.col(at) / MINUTE)).withColumn(of["day"], F.floor(F.col(at) / DAY))
    met = timed.join(table, of["day"], "left")
    now = F.col(of["minute"])
    mine = F.get(F.filter(of["runs"], lambda r: (r["a"] <= now) & (now < r["b"])), F.lit(0))
    ahead = F.get(F.filter(of["runs"], lambda r: r["a"] > now), F.lit(0))["a"]
    follow = F.coalesce(F.when(now + 1 < mine["b"], now + 1), ahead, F.col(of["later"]))
    end = F.when(mine["b"] == (F.col(of["day"]) + 1) * 1440, F.col(of["next_through"])).otherwise(mine["b"])
    limit = days * 1440
    added = (mine.isNotNull(), F.when(follow - now <= limit, follow * MINUTE + second * 1_000_000), F.when(end - now <= limit, end * MINUTE))
    return met.select(*rows.columns, *[c.alias(n) for c, n in zip(added, names, strict=True)])
