"""Order-dependent repair of a stream's items, by key and sequence number.

Items before any header are in segment 0.  Each operator works on one key's
items in order, so a key's items meet in one task; keys are spread.  A null
flag counts as false, a null key is a key of its own, and a null time or size
is left out of differences and sums.  If the items have a column of the name
that an operator adds, the added one has an underscore behind its name; all
columns of the items stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import machines
from .ordered import free


def _line(key: str, order: str, *more: str):
    return Window.partitionBy(key, *more).orderBy(order)


def _is(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def segments(items: DataFrame, key: str, order: str, header: Column) -> DataFrame:
    """Adds ``segment``: how many headers there are up to and with the item."""
    return items.withColumn(free("segment", items), F.sum(F.when(header, 1).otherwise(0)).over(_line(key, order)).cast("long"))


def defragment(items: DataFrame, key: str, order: str, header: Column, least: int = 10) -> DataFrame:
    """Drops segments of fewer than ``least`` items, their header counted; what comes before any header stays."""
    segment, size = free("segment", items), free("size", items)
    found = segments(items, key, order, header).withColumn(size, F.count("*").over(Window.partitionBy(key, segment)))
    return found.filter((F.col(segment) == 0) | (F.col(size) >= least)).drop(size)


def missing_headers(items: DataFrame, key: str, order: str, header: Column) -> DataFrame:
    """(key, order): where the header to put before each key's first item goes, if that isn't one."""
    first = items.groupBy(key).agg(F.min_by(_is(header), order).alias("has"), F.min(order).alias("first"))
    return first.filter("not has").select(key, (F.col("first") - 1).alias(order))


def _first_of(items: DataFrame, key: str, order: str, header: Column, kind: Column, *same: str) -> DataFrame:
    segment, of_kind, n = (free(c, items) for c in ("segment", "of_kind", "n"))
    found = segments(items, key, order, header).withColumn(of_kind, _is(kind))
    return found.withColumn(n, F.row_number().over(_line(key, order, segment, of_kind, *same))).filter(~F.col(of_kind) | (F.col(n) == 1)).drop(of_kind, n)


def first_of_segment(items: DataFrame, key: str, order: str, header: Column, kind: Column) -> DataFrame:
    """Of the items of a kind only the first of each segment stays; other items stay."""
    return _first_of(items, key, order, header, kind)


def without_duplicates(items: DataFrame, key: str, order: str, header: Column, media: Column, identity: list[str]) -> DataFrame:
    """Of media items that agree in ``identity`` within a segment the first stays; other items stay.

    The whole segment is remembered; ``without_replays`` remembers a bounded number of items and knows shifted repeats.
    """
    return _first_of(items, key, order, header, media, *identity)


def without_replays(items: DataFrame, key: str, order: str, header: str, media: str, time: str, identity: str, capacity: int = 8192, jump: int = 2000) -> DataFrame:
    """(key, number, kept): false for media items that repeat what came before, also shifted by a constant time; see ``machines.Replay``."""
    return machines.walked(items, key, [order], machines.Replay(order, header, media, time, identity, capacity, jump))


def gop_order(items: DataFrame, key: str, order: str, at: str, keyframe: Column, script: Column, video: Column) -> DataFrame:
    """Adds ``place``: within each group from a keyframe to the next scripts first, then by time, video first on ties; null times come first."""
    gop, place = free("gop", items), free("place", items)
    found = items.withColumn(gop, F.sum(F.when(keyframe, 1).otherwise(0)).over(_line(key, order)))
    rank = [F.when(script, 0).otherwise(1), F.when(script, 0).otherwise(F.col(at)), F.when(video, 0).otherwise(1), F.col(order)]
    return found.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(gop, *rank)).cast("long")).drop(gop)


def time_from_segment_start(items: DataFrame, key: str, order: str, at: str, header: Column) -> DataFrame:
    """Adds ``local``: the time since the first item after the segment's header; headers have 0."""
    segment, local = free("segment", items), free("local", items)
    found = segments(items, key, order, header)
    first = F.first(F.when(~_is(header), F.col(at)), ignorenulls=True).over(_line(key, order, segment).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return found.withColumn(local, F.when(_is(header), 0).otherwise(F.col(at) - first).cast("long"))


def time_continued(items: DataFrame, key: str, order: str, at: str, header: Column) -> DataFrame:
    """Adds ``local``: times of a segment shifted so that they go on where the last segment's ended; headers have 0."""
    segment, local, shift = free("segment", items), free("local", items), free("shift", items)
    found = segments(items, key, order, header)
    timed = found.filter(~_is(header) & F.col(at).isNotNull())
    ends = timed.groupBy(key, segment).agg(F.min_by(at, order).alias("first"), F.max_by(at, order).alias("last"))
    line = Window.partitionBy(key).orderBy(segment)
    jumps = ends.withColumn("jump", F.coalesce(F.lag("last").over(line) - F.col("first"), -F.col("first")))
    of, at_ = free("of", found), free("at_", found)
    shifts = jumps.select(F.col(key).alias(of), F.col(segment).alias(at_), F.sum("jump").over(line).alias(shift))
    joined = found.join(shifts, found[key].eqNullSafe(shifts[of]) & (found[segment] == shifts[at_]), "left").drop(of, at_)
    return joined.withColumn(local, F.when(_is(header), 0).otherwise(F.col(at) + F.col(shift)).cast("long")).drop(shift)


def split_on_change(items: DataFrame, key: str, order: str, header: Column, signature: str) -> DataFrame:
    """Adds ``part``: it rises at the first media item after a header whose signature differs from that of the part under way."""
    now, media, rises, part = (free(c, items) for c in ("now", "media", "rises", "part"))
    line = _line(key, order)
    known = items.withColumn(now, F.last(F.when(header, F.col(signature)), ignorenulls=True).over(line)).withColumn(media, ~_is(header))
    # the signature that the media item before had
    was = F.last(F.when(F.col(media), F.col(now)), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    changed = F.coalesce((F.col(media) & (F.col(now) != was)).cast("long"), F.lit(0))
    return known.withColumn(rises, changed).withColumn(part, F.sum(rises).over(line)).drop(now, media, rises)


def carried(key: str, order: str, value: Column) -> Column:
    """The last value of the key that isn't null, up to and with the row."""
    return F.last(value, ignorenulls=True).over(_line(key, order))


def merged_ranges(ranges: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end): overlapping and adjacent ranges (both ends included) as one; ranges with a null end are left out."""
    rows = ranges.select(key, start, end).filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    new, island = free("new", rows), free("island", rows)
    line = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(line.rowsBetween(Window.unboundedPreceding, -1))
    found = rows.withColumn(new, F.coalesce((F.col(start) > reach + 1).cast("long"), F.lit(1))).withColumn(island, F.sum(new).over(line))
    return found.groupBy(key, island).agg(F.min(start).alias(start), F.max(end).alias(end)).drop(island)


def byte_offsets(rows: DataFrame, key: str, number: str, length: str) -> DataFrame:
    """Adds ``offset``: where a part begins if each follows the one of the number before; a gap begins at 0 again, a null length counts as 0."""
    island, offset = free("island", rows), free("offset", rows)
    long_ = F.coalesce(F.col(length), F.lit(0))
    found = rows.withColumn(island, F.col(number) - F.row_number().over(Window.partitionBy(key).orderBy(number)))
    return found.withColumn(offset, (F.sum(long_).over(Window.partitionBy(key, island).orderBy(number)) - long_).cast("long")).drop(island)


def _kind(items: DataFrame, column: str) -> str:
    return dict(items.dtypes)[column]


def limited_segments(items: DataFrame, key: str, order: str, size: str, most: int) -> DataFrame:
    """(key, order, result): the part of each item if a part ends before the item that would take it over ``most``.

    What a part holds depends on where the last ended, so a key's sizes are walked in order; a null size counts as 0.
    """
    return machines.walked(items, key, [order], machines.SizeLimit(order, size, most, _kind(items, order)))


def thinned(items: DataFrame, key: str, order: str, at: str, gap: int) -> DataFrame:
    """(key, order, result): whether an item is kept if at least ``gap`` passed since the last kept one; the first is kept, a null time isn't."""
    return machines.walked(items, key, [order], machines.Thin(order, at, gap, _kind(items, order)))


def timing_repaired(items: DataFrame, key: str, order: str, at: str, most: int, interval: int) -> DataFrame:
    """(key, order, result): times in which a step back or over ``most`` becomes ``interval``, for all that follows too.

    Items with a null time have no result, and steps go over them.
    """
    timed = items.select(key, order, at)
    step_ = free("step", timed)
    line = _line(key, order)
    before = F.last(at, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    step = F.col(at) - before
    mended = timed.withColumn(step_, F.when((step < 0) | (step > most), F.lit(interval)).otherwise(F.coalesce(step, F.col(at))))
    return mended.select(key, order, F.when(F.col(at).isNotNull(), F.sum(step_).over(line)).cast("long").alias("result"))


def keyframe_index(items: DataFrame, key: str, order: str, at: str, header: Column, script: Column, keyframe: Column, gap: int) -> DataFrame:
    """Adds ``times`` and ``places`` to each segment's first script: the times and byte places of its keyframes, thinned to ``gap``.

    ``place`` must be a column of the items.  Two passes: the index is aggregated for each segment, then put back into
    the row of its first script; other rows, later scripts among them, have nulls.  Keyframes with a null time don't
    count; a segment without a script gets no index, one without keyframes an empty one.
    """
    segment, number, times, places = (free(c, items) for c in ("segment", "number", "times", "places"))
    found = segments(items, key, order, header)
    # the key of a segment as one column, so that a segment is walked by itself
    of = F.to_json(F.struct(F.col(key).alias("k"), F.col(segment).alias("s")))
    frames = found.filter(_is(keyframe) & F.col(at).isNotNull()).select(of.alias("of"), F.col(order).alias("n"), F.col(at).alias("t"), F.col("place").alias("p"))
    kept = thinned(frames, "of", "n", "t", gap).filter("result").join(frames, ["of", "n"])
    index = kept.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("n", "t", "p"))).alias("index")).select(F.col("of").alias(number), F.col("index.t").alias(times), F.col("index.p").alias(places))
    first = F.row_number().over(_line(key, order, segment, number)) == 1
    scripts = found.withColumn(number, F.when(_is(script), of))
    asked = scripts.withColumn(number, F.when(F.col(number).isNotNull() & first, F.col(number)))
    empty = F.array().cast("array<long>")
    fill = lambda c: F.when(F.col(number).isNotNull(), F.coalesce(F.col(c), empty)).alias(c)
    return asked.join(index, number, "left").select(*items.columns, segment, fill(times), fill(places))


def limited_media(items: DataFrame, key: str, order: str, at: str, size: str, keyframe: str, head: str, begins: str, most_size: int | None = None, most_time: int | None = None) -> DataFrame:
    """(key, order, part, reason): parts of bounded size and time that begin at keyframes; see ``machines.MediaLimit``."""
    return machines.walked(items, key, [order], machines.MediaLimit(order, at, size, keyframe, head, begins, most_size, most_time, _kind(items, order)))


def segment_splits(items: DataFrame, key: str, order: str, init: str, kind: str, gap: Column | None = None) -> DataFrame:
    """(key, order, part, reason): where a playlist's media has to go on in a new file.

    A part ends where the kind of the media changes (``kind``), where an init differs from the one in force (``init``),
    or at a marked break (``break``); a repeated init splits nothing.  Nulls of ``init`` mean no init in the row.
    """
    line = _line(key, order)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    was_kind, was_init = F.last(kind, ignorenulls=True).over(before), F.last(init, ignorenulls=True).over(before)
    reasons = [(F.col(kind) != was_kind, "kind"), (F.col(init) != was_init, "init")] + ([(gap & (F.row_number().over(line) > 1), "break")] if gap is not None else [])
    reason = F.coalesce(*[F.when(c, F.lit(name)) for c, name in reasons])
    rows = items.select(key, order, reason.alias("reason"))
    return rows.select(key, order, F.sum(F.col("reason").isNotNull().cast("long")).over(line).alias("part"), "reason")



def hls_defragmented(items: DataFrame, key: str, order: str, kind: str, size: str, least: int = 5, held_bytes: int = 64 << 20) -> DataFrame:
    """Drops what a new init cuts short: groups from an init on of fewer than ``least`` items, and media before the first init.

    Kinds are ``ts``, ``init``, ``media`` and ``end``; others and nulls stay.  A group also ends at an end, where ``ts`` and
    the others take turns, and with the stream: then it stays, however small.  Media before the first init that hold
    more than ``held_bytes`` stay too.
    """
    names = ("turn", "starts", "group", "n", "bytes", "follow", "inits")
    turn, starts, group, n, held, follow, inits = (free(c, items) for c in names)
    line = _line(key, order)
    k = F.coalesce(F.col(kind), F.lit("other"))
    lane = F.when(k == "ts", "ts").when(k.isin("init", "media"), "mp4").otherwise(k)
    rows = items.withColumn(turn, F.coalesce(lane != F.lag(lane).over(line), F.lit(True)) | (k == "init"))
    rows = rows.withColumn(group, F.sum(F.col(turn).cast("long")).over(line)).withColumn(starts, F.when(F.col(turn), k)).withColumn(inits, F.count_if(k == "init").over(line))
    own = Window.partitionBy(key, group)
    rows = rows.withColumn(n, F.count("*").over(own)).withColumn(held, F.sum(F.coalesce(F.col(size), F.lit(0))).over(own)).withColumn(follow, F.first(starts, ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)))
    cut = F.coalesce(F.col(follow) == "init", F.lit(False))
    short = (F.first(starts, ignorenulls=True).over(own.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == "init") & (F.col(n) < least)
    early = (F.col(inits) == 0) & (F.col(held) <= held_bytes)
    gone = free("gone", items)
    return rows.withColumn(gone, k.isin("init", "media") & cut & (short | early)).filter(~F.col(gone)).select(*items.columns)
