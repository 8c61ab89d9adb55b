"""State machines over a key's rows in order, for batches and for streams.

A machine reads some columns of each row and may want to be woken at a time.
``walked`` runs it over a table: partitions are sorted by key and order, and a
task holds the state of one key at a time, never a key's rows.
``rillwork.streaming.machine_stream`` runs the same machine with the state in
Spark's store, and wakes it by timers.

State is a dict of what JSON can hold; a key whose state is as at the start
takes no room.  Times are microseconds.  A wake comes after the rows of its own
time.  Null flags count as false; a null key is a key of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Machine:
    #: Columns that it reads of each row, and columns that it gives with their types.
    reads: tuple[str, ...] = ()
    out: dict[str, str] = {}

    def start(self) -> dict:
        return {}

    def step(self, state: dict, row: dict) -> Iterable[tuple]:
        raise NotImplementedError

    def due(self, state: dict) -> int | None:
        """When to be woken if the key's state stays as it is."""
        return None

    def wake(self, state: dict, at: int) -> Iterable[tuple]:
        return ()

    def end(self, state: dict) -> Iterable[tuple]:
        """What a table's end gives; a stream has none."""
        return ()


def woken(machine: Machine, state: dict, before: int, last: bool = False) -> Iterator[tuple]:
    """Wakes the machine for all that is due before a time, or up to it if that is the last."""
    was = None
    while (at := machine.due(state)) is not None and (at < before or last and at == before):
        if at == was:
            raise RuntimeError(f"{type(machine).__name__} is due at {at} again after it was woken")
        was = at
        yield from machine.wake(state, at)


def walked(rows: DataFrame, key: str, order: list[str], machine: Machine, at: str | None = None, until: str | None = None) -> DataFrame:
    """(key, what the machine gives) for each key's rows in order.

    Wakes come only with ``at``, the rows' times.  With ``until``, a column that has the same time in all rows, rows
    after it are left out, and what is due up to it wakes the machine at the end.
    """
    names = list(dict.fromkeys([key, *order, *machine.reads, *([at] if at else []), *([until] if until else [])]))
    schema = StructType.fromDDL(", ".join([f"`{key}` {dict(rows.dtypes)[key]}", *(f"`{c}` {k}" for c, k in machine.out.items())]))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, of, state, last, found = False, None, {}, None, []

        def closed() -> None:
            if last is not None:
                found.extend((of, *x) for x in woken(machine, state, last, True))
            found.extend((of, *x) for x in machine.end(state))

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(names, values, strict=True))
                if not begun or row[key] != of:
                    if begun:
                        closed()
                    begun, of, state = True, row[key], machine.start()
                    last = row[until] if until else None
                if last is not None and row[at] > last:
                    continue
                if at and row[at] is not None:
                    found.extend((of, *x) for x in woken(machine, state, row[at]))
                found.extend((of, *x) for x in machine.step(state, row))
            yield _batch(found, arrow)
            found.clear()
        if begun:
            closed()
            yield _batch(found, arrow)

    return rows.select(*names).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _batch(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*found, strict=True) if found else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def hysteresis_window_us(checks: int = 3, interval_ms: int = 20_000) -> int:
    """How long an ambiguous end waits: a check more than the scheduler makes, 5 minutes at most; 80 s by default."""
    return min((max(checks, 1) + 1) * max(interval_ms, 1000), 300_000) * 1000


class Sessions(Machine):
    """One live session for each key, from its first live sighting on.

    A definite end ends it at once; another end waits: a live sighting in the window resumes the session, a further
    end changes nothing, and the window's end ends it by a timer.  Ends without a session give nothing.  Rows with a
    null time are left out.
    """

    out = {"started_us": "long", "what": "string", "at_us": "long", "via_hysteresis": "boolean"}

    def __init__(self, at: str, ends: str, definite: str, window_us: int = hysteresis_window_us()):
        self.at, self.ends, self.definite, self.window = at, ends, definite, window_us
        self.reads = (at, ends, definite)

    def step(self, state: dict, row: dict) -> Iterator[tuple]:
        at, waits = row[self.at], "until" in state
        if at is None:
            return
        if not (row[self.ends] or row[self.definite]):
            if not state:
                state["since"] = at
                yield at, "started", at, False
            elif waits:
                del state["until"]
                yield state["since"], "resumed", at, True
        elif state and row[self.definite]:
            yield state["since"], "ended", at, waits
            state.clear()
        elif state and not waits:
            state["until"] = at + self.window
            yield state["since"], "ending", at, False

    def due(self, state: dict) -> int | None:
        return state.get("until")

    def wake(self, state: dict, at: int) -> Iterator[tuple]:
        yield state["since"], "ended", at, True
        state.clear()


class Pairing(Machine):
    """Pairs a session's videos and chats by index, each pair once, and completes the session once.

    Rows are (at, kind, index, path) with kinds VIDEO and CHAT (an artifact; the same path again adds nothing),
    CHAT_STARTED, CHAT_STOPPED, ENDED and PERSISTED; others only count as activity.  A session is complete when it has
    ended and is persisted, has a video, and its chat, if there is any, has stopped.  After ``idle_us`` without a row
    it is forgotten; if it wasn't complete, ``unmet`` says what was missing.  Rows with a null time are left out.
    """

    VIDEO, CHAT, CHAT_STARTED, CHAT_STOPPED, ENDED, PERSISTED = "video", "chat", "chat_started", "chat_stopped", "ended", "persisted"
    out = {"what": "string", "index": "long", "videos": "array<string>", "chats": "array<string>", "unmet": "array<string>"}

    def __init__(self, at: str, kind: str, index: str, path: str, idle_us: int):
        self.at, self.kind, self.index, self.path, self.idle = at, kind, index, path, idle_us
        self.reads = (at, kind, index, path)

    def step(self, state: dict, row: dict) -> Iterator[tuple]:
        if row[self.at] is None:
            return
        kind, index = row[self.kind], row[self.index]
        state.setdefault("said", [])
        state["last"] = max(row[self.at], state.get("last", row[self.at]))
        if kind in (self.VIDEO, self.CHAT):
            if index is not None and row[self.path] is not None:
                held = state.setdefault(kind, {}).setdefault(str(index), [])
                if row[self.path] not in held:
                    held.append(row[self.path])
        elif kind not in state["said"]:
            state["said"].append(kind)
        videos, chats = (state.get(k, {}).get(str(index), []) for k in (self.VIDEO, self.CHAT))
        if videos and chats and index not in state.setdefault("paired", []):
            state["paired"].append(index)
            yield "pair", index, list(videos), list(chats), []
        if not state.get("complete") and not self.unmet(state):
            state["complete"] = True
            yield "complete", None, self._all(state, self.VIDEO), self._all(state, self.CHAT), []

    def unmet(self, state: dict) -> list[str]:
        said = state["said"]
        chat = self.CHAT in state or self.CHAT_STARTED in said
        return [name for name, met in ((self.ENDED, self.ENDED in said), (self.PERSISTED, self.PERSISTED in said), (self.CHAT_STOPPED, not chat or self.CHAT_STOPPED in said), (self.VIDEO, self.VIDEO in state)) if not met]

    @staticmethod
    def _all(state: dict, lane: str) -> list[str]:
        """The lane's paths by index, each once."""
        held = state.get(lane, {})
        return list(dict.fromkeys(p for i in sorted(held, key=int) for p in held[i]))

    def due(self, state: dict) -> int | None:
        return state["last"] + self.idle if state else None

    def wake(self, state: dict, at: int) -> Iterator[tuple]:
        if not state.get("complete"):
            yield "evicted", None, self._all(state, self.VIDEO), self._all(state, self.CHAT), self.unmet(state)
        state.clear()


class Assembler(Machine):
    """Gives a live stream's media in the order of their numbers, whatever order they arrive in.

    Rows are (at, kind, number, to, size, init): MEDIA with the name of the init it needs (null: none), INIT with its
    name in ``init``, FAILED (an init that won't come) and DEAD (the numbers up to ``to`` won't come; null: one).
    Media wait until all numbers before came, are dead or are given up, and until their init came.  A gap is given up
    after ``skip_count`` numbers arrived beyond it (not before the first media of a stream that needs inits) or
    ``skip_us`` have passed, and at once while ``most`` media or ``most_bytes`` are held; media of a failed init are
    dead.  Numbers before the next one are stale.  Of several inits that are due before a media, the last is given.
    The table's end gives what is held, in order; media without their init are skipped.
    """

    MEDIA, INIT, FAILED, DEAD = "media", "init", "failed", "dead"
    out = {"what": "string", "number": "long", "to": "long", "reason": "string"}

    def __init__(self, at: str, kind: str, number: str, to: str, size: str, init: str, first: int = 0, skip_count: int | None = 3, skip_us: int | None = None, most: int = 0, most_bytes: int = 0):
        self.at, self.kind, self.number, self.to, self.size, self.init = at, kind, number, to, size, init
        self.first, self.skip_count, self.skip_us, self.most, self.most_bytes = first, skip_count, skip_us, most, most_bytes
        self.reads = (at, kind, number, to, size, init)

    def start(self) -> dict:
        return {"next": self.first, "held": {}, "came": [], "failed": [], "inits": {}, "dead": [], "gap": None, "needs": False, "gave": False}

    def step(self, state: dict, row: dict) -> Iterator[tuple]:
        kind, number, at = row[self.kind], row[self.number], row[self.at]
        if kind == self.INIT and row[self.init] is not None:
            state["needs"] = True
            if row[self.init] not in state["came"]:
                state["came"].append(row[self.init])
            if number is not None:
                state["inits"][str(number)] = row[self.init]
        elif kind == self.FAILED and row[self.init] is not None:
            state["failed"].append(row[self.init])
        elif number is None:
            return
        elif kind == self.DEAD:
            state["dead"].append([number, number if row[self.to] is None else row[self.to]])
        elif kind == self.MEDIA:
            state["needs"] |= row[self.init] is not None
            if number < state["next"] or self._dead_to(state, number) is not None:
                yield "stale", number, None, None
                return
            new = str(number) not in state["held"]
            state["held"][str(number)] = [row[self.size] or 0, row[self.init]]
            if new and state["gap"] and number > state["gap"][0]:
                state["gap"][1] += 1
        yield from self._drained(state, at)

    @staticmethod
    def _dead_to(state: dict, number: int) -> int | None:
        """The last of the dead numbers from this one on without a break; none if it isn't dead."""
        to = None
        for a, b in sorted(state["dead"]):
            if a <= (number if to is None else to + 1) <= b:
                to = b
        return to

    def _full(self, state: dict) -> bool:
        held = state["held"]
        return bool(self.most and len(held) >= self.most or self.most_bytes and sum(x[0] for x in held.values()) >= self.most_bytes)

    def _patience(self, state: dict, at: int | None) -> str | None:
        """Why the gap under way is given up; none if it isn't."""
        _, beyond, since = state["gap"]
        if self._full(state):
            return "pressure"
        counted = self.skip_count is not None and beyond >= self.skip_count and not (state["needs"] and not state["gave"])
        waited = self.skip_us is not None and None not in (at, since) and at - since >= self.skip_us
        return "both" if counted and waited else "count" if counted else "time" if waited else None

    def _drained(self, state: dict, at: int | None) -> Iterator[tuple]:
        while True:
            now, held = state["next"], state["held"]
            to = self._dead_to(state, now)
            if to is not None:
                yield "skip", now, to, "upstream"
                self._advance(state, to + 1)
                continue
            if not held:
                return
            least = min(map(int, held))
            if least > now:
                if not state["gap"] or state["gap"][0] != now:
                    state["gap"] = [now, sum(int(k) > now for k in held), at]
                reason = self._patience(state, at)
                if reason is None:
                    return
                yield "skip", now, least - 1, reason
                self._advance(state, least)
                continue
            state["gap"] = None
            init = held[str(now)][1]
            if init is not None and init not in state["came"]:
                if init in state["failed"]:
                    state["dead"].append([now, now])
                elif self._full(state):
                    yield "skip", now, now, "pressure"
                    self._advance(state, now + 1)
                else:
                    return
                continue
            yield from self._given(state, now)
            self._advance(state, now + 1)

    @staticmethod
    def _given(state: dict, number: int) -> Iterator[tuple]:
        due = sorted(int(k) for k in state["inits"] if int(k) <= number)
        if due:
            yield "init", due[-1], None, state["inits"][str(due[-1])]
        for k in due:
            del state["inits"][str(k)]
        state["held"].pop(str(number), None)
        state["gave"] = True
        yield "media", number, None, None

    @staticmethod
    def _advance(state: dict, number: int) -> None:
        state["next"], state["gap"] = number, None
        state["held"] = {k: x for k, x in state["held"].items() if int(k) >= number}
        state["dead"] = [x for x in state["dead"] if x[1] >= number]

    def due(self, state: dict) -> int | None:
        gap = state["gap"]
        return gap[2] + self.skip_us if gap and gap[2] is not None and self.skip_us is not None else None

    def wake(self, state: dict, at: int) -> Iterator[tuple]:
        yield from self._drained(state, at)

    def end(self, state: dict) -> Iterator[tuple]:
        for number in sorted(map(int, state["held"])):
            init = state["held"][str(number)][1]
            if init is not None and init not in state["came"]:
                yield "skip", number, number, "upstream"
            else:
                yield from self._given(state, number)


class Planner(Machine):
    """Decides each number of a sliding playlist once.

    Rows are snapshots (order, first number, ``usable``: for each entry whether it can be fetched, null: not).  Gives
    ``plan`` for new usable numbers, ``skipped`` for new ones that can't be fetched (contiguous ones joined), ``missing``
    where the window slid past undecided numbers, ``stale`` for a window that lies before all undecided numbers, and
    ``reset`` if it lies more than four windows before them; after a reset nothing of the key is decided any more.
    """

    out = {"snapshot": "long", "what": "string", "number": "long", "to": "long"}

    def __init__(self, snapshot: str, first: str, usable: str):
        self.snapshot, self.first, self.usable = snapshot, first, usable
        self.reads = (snapshot, first, usable)

    def step(self, state: dict, row: dict) -> Iterator[tuple]:
        at, first, usable = row[self.snapshot], row[self.first], row[self.usable] or []
        if first is None or state.get("over"):
            return
        after, mark = first + len(usable), state.get("mark")
        if mark is not None and first > mark:
            yield at, "missing", mark, first - 1
        elif mark is not None and after < mark:
            state["over"] = mark - after > 4 * max(len(usable), 1)
            yield at, "reset" if state["over"] else "stale", first, after - 1
            return
        run = None
        for number, good in enumerate(usable, first):
            if mark is not None and number < mark:
                continue
            if run is not None and (run[0] == "skipped") == (not good):
                run[2] = number
            else:
                if run is not None:
                    yield at, *run
                run = ["plan" if good else "skipped", number, number]
        if run is not None:
            yield at, *run
        state["mark"] = max(after, mark or after)


class Replay(Machine):
    """Which media items repeat what came before: exactly, or shifted by a constant time after a jump back.

    Rows are (order, header, media, time, identity).  An item is a repeat if its identity came with the same time
    among the last ``capacity`` kept items.  Once a time lies more than ``jump`` before the latest, the stream counts
    as replaying: the first item whose identity last came later, at a time still remembered, fixes the offset, and
    items that match at their time plus the offset are repeats too.  A header forgets all.  Gives (order, kept); what
    isn't media, or has a null time or identity, is kept and not remembered.
    """

    out = {"number": "long", "kept": "boolean"}

    def __init__(self, order: str, header: str, media: str, time: str, identity: str, capacity: int = 8192, jump: int = 2000):
        self.order, self.header, self.media, self.time, self.identity = order, header, media, time, identity
        self.capacity, self.jump = capacity, jump
        self.reads = (order, header, media, time, identity)

    def step(self, state: dict, row: dict) -> Iterator[tuple]:
        time, name = row[self.time], row[self.identity]
        if row[self.header]:
            state.clear()
        if row[self.header] or not row[self.media] or time is None or name is None:
            yield row[self.order], True
            return
        name = str(name)
        seen, latest, line = state.setdefault("seen", {}), state.setdefault("latest", {}), state.setdefault("line", [])
        top = state.get("top", time)
        state["replays"] = state.get("replays", False) or top - time > self.jump
        state["top"] = max(top, time)
        known = lambda t: f"{name}@{t}" in seen
        repeats = known(time)
        if not repeats and state["replays"]:
            if "offset" not in state and latest.get(name, [time])[0] > time and known(latest[name][0]):
                state["offset"] = latest[name][0] - time
            repeats = "offset" in state and known(time + state["offset"])
        if not repeats:
            n = state["n"] = state.get("n", 0) + 1
            seen[f"{name}@{time}"] = n
            latest[name] = [time, n]
            line.append([name, time, n])
            if len(line) > self.capacity:
                old, then, k = line.pop(0)
                del seen[f"{old}@{then}"]
                if latest[old][1] == k:
                    del latest[old]
        yield row[self.order], not repeats


class SizeLimit(Machine):
    """(order, part) where a part ends before the item that would take it over ``most``; a null size is 0."""

    def __init__(self, order: str, size: str, most: int, kind: str = "long"):
        self.order, self.size, self.most = order, size, most
        self.reads, self.out = (order, size), {order: kind, "result": "long"}

    def step(self, state: dict, row: dict) -> Iterator[tuple]:
        size = row[self.size] or 0
        if state.get("held") and state["held"] + size > self.most:
            state["part"], state["held"] = state.get("part", 0) + 1, 0
        state["held"] = state.get("held", 0) + size
        yield row[self.order], state.get("part", 0)


class MediaLimit(Machine):
    """(order, part, reason) where a part ends before the keyframe at which its size or time has reached a bound.

    The size is that of all items since the part began, the one at hand included; the time is that since the part's
    first item that isn't a ``head``.  A stream that ``begins`` starts anew.  At twice a bound any item begins a part, as
    keyframes may never come.  ``reason`` is ``time`` or ``size`` at a part's first item.  Nulls count as 0 or no time.
    """

    def __init__(self, order: str, at: str, size: str, keyframe: str, head: str, begins: str, most_size: int | None, most_time: int | None, kind: str = "long"):
        self.order, self.at, self.size, self.keyframe, self.head, self.begins = order, at, size, keyframe, head, begins
        self.most_size, self.most_time = most_size, most_time
        self.reads, self.out = (order, at, size, keyframe, head, begins), {order: kind, "part": "long", "reason": "string"}

    def step(self, state: dict, row: dict) -> Iterator[tuple]:
        part, reason = state.get("part", 0), None
        if row[self.begins]:
            state.clear()
            state["part"] = part
        else:
            state["size"] = state.get("size", 0) + (row[self.size] or 0)
            if not row[self.head] and row[self.at] is not None:
                state["top"] = max(state.get("top", 0), row[self.at])
                state.setdefault("from", row[self.at])
            long_ = max(state["top"] - state["from"], 0) if "from" in state else -1
            over = lambda n: self.most_time is not None and long_ >= n * self.most_time, lambda n: self.most_size is not None and state["size"] >= n * self.most_size
            n = 1 if row[self.keyframe] else 2
            if over[0](n) or over[1](n):
                reason = "time" if over[0](1) else "size"
                state["size"], state["part"] = 0, part + 1
                if "top" in state:
                    state["from"] = state["top"]
        yield row[self.order], state.get("part", 0), reason


class Thin(Machine):
    """(order, kept) where an item is kept if ``gap`` passed since the last kept one; the first is kept, a null time never."""

    def __init__(self, order: str, at: str, gap: int, kind: str = "long"):
        self.order, self.at, self.gap = order, at, gap
        self.reads, self.out = (order, at), {order: kind, "result": "boolean"}

    def step(self, state: dict, row: dict) -> Iterator[tuple]:
        at = row[self.at]
        kept = at is not None and ("last" not in state or at - state["last"] >= self.gap)
        if kept:
            state["last"] = at
        yield row[self.order], kept


class Failures(Machine):
    """(order) of the failures at which ``threshold`` ones lie within the window; a signal or a success clears the count.

    Rows with a null time are left out.
    """

    def __init__(self, order: str, at: str, failed: str, window: int, threshold: int, kind: str = "long"):
        self.order, self.at, self.failed, self.window, self.threshold = order, at, failed, window, threshold
        self.reads, self.out = (order, at, failed), {order: kind}

    def step(self, state: dict, row: dict) -> Iterator[tuple]:
        at = row[self.at]
        if at is None:
            return
        if not row[self.failed]:
            state.clear()
            return
        state["log"] = [*(t for t in state.get("log", ()) if at - t < self.window), at]
        if len(state["log"]) >= self.threshold:
            state.clear()
            yield (row[self.order],)


class Estimate(Machine):
    """(order, estimate): a moving estimate of sizes, a quarter from each new one; sizes that are null or 0 leave it."""

    def __init__(self, order: str, size: str, first: int = 2 << 20, kind: str = "long"):
        self.order, self.size, self.first = order, size, first
        self.reads, self.out = (order, size), {order: kind, "estimate": "long"}

    def step(self, state: dict, row: dict) -> Iterator[tuple]:
        now = state.get("now", self.first)
        if row[self.size]:
            state["now"] = now = max((3 * now + row[self.size]) // 4, 1)
        yield row[self.order], now
