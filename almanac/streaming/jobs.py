"""Streams: per-user saved sets, a live board, compaction of a key/value log."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from almanac.functions import dates as D

ACTIONS = "user long, item string, action string, ts timestamp, seq long"


class SavedSets(StatefulProcessor):
    """A user's saved items as single entries of a map, each with the number of wipes that it came after.

    An action reads and writes its own item only. A wipe (clear, replace) counts
    up one mark, and entries with an older mark are no longer there, so it costs
    the same for a set of any size; such an entry is overwritten when its item
    comes again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.wipes = handle.getValueState("wipes", "n long")
        self.items = handle.getMapState("items", "item string", "mark long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        wipes = self.wipes.get()[0] if self.wipes.exists() else 0
        before = wipes
        for r in sorted(rows, key=lambda r: (r.ts, r.seq)):
            if r.action in ("clear", "replace"):
                wipes += 1
                yield Row(user=key[0], item=None, saved=False, ts=r.ts, seq=r.seq)
            if r.action == "clear" or r["item"] is None:
                continue
            entry = (r["item"],)
            there = self.items.containsKey(entry) and self.items.getValue(entry)[0] == wipes
            on = {"add": True, "replace": True, "remove": False, "toggle": not there}.get(r.action, there)
            if on != there:
                if on:
                    self.items.updateValue(entry, (wipes,))
                else:
                    self.items.removeKey(entry)
                yield Row(user=key[0], item=r["item"], saved=on, ts=r.ts, seq=r.seq)
        if wipes != before:
            self.wipes.update((wipes,))

    def close(self) -> None:
        pass


def saved_set_state(actions: DataFrame) -> DataFrame:
    """user, item, saved, ts, seq: changes of the users' sets by a stream of actions (add, remove, toggle, replace, clear).

    A row without an item says that the user's set was emptied. Within a batch
    a user's actions are taken in the order of (ts, seq); how many there are is
    bounded by the source's trigger limits. Needs the RocksDB state store.
    """
    return actions.where("user is not null").groupBy("user").transformWithState(SavedSets(), "user long, item string, saved boolean, ts timestamp, seq long", "append", "none")


def saved_set_batch(actions: DataFrame) -> DataFrame:
    """user, item: the same sets from all actions at once: the last reset of an item, then the parity of later toggles."""
    at = F.struct("ts", "seq")
    wipes = actions.where("action in ('clear', 'replace')").groupBy("user").agg(F.max(at).alias("wiped"))
    rows = actions.where("action <> 'clear'").withColumn("at", at).join(wipes, "user", "left").where("wiped is null or at >= wiped")
    per = rows.groupBy("user", "item").agg(F.max(F.when(F.col("action") != "toggle", F.struct("at", "action"))).alias("set"))
    toggles = rows.where("action = 'toggle'").join(per, ["user", "item"]).where("set is null or at > set.at").groupBy("user", "item").agg(F.count("*").alias("n"))
    on = F.coalesce(F.col("set.action").isin("add", "replace"), F.lit(False)).cast("int")
    return per.join(toggles, ["user", "item"], "left").where((on + F.coalesce("n", F.lit(0))) % 2 == 1).select("user", "item")


def log_compaction_batch(log: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    return log.groupBy(key).agg(F.max(F.struct(*order, value)).alias("m")).select(key, F.col(f"m.{value}").alias(value))


def log_compaction_stream(log: DataFrame) -> DataFrame:
    """key, value: the latest value of each key, by seq (the greater value of equal ones); files may be out of order. For update mode."""
    return log_compaction_batch(log, "key", "value", ["seq"])


def state_changes(instances: DataFrame) -> DataFrame:
    """The instances with ``changes``: an array of (at, state) in order, the state that holds from each moment on.

    A state can change half an hour before the start, at the start, at the end,
    and at midnight of the first and last day and the days after them; the state
    at each such moment is ``live_state``'s, and moments that change nothing are
    left out. The first entry holds from the beginning of time. Cancelled
    instances and those without times have none. Timed instances without a flag
    but ``end_unknown`` have their changes written down at once; the others go
    through all moments, whose functions are not compiled.
    """
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("run", "time_unknown", "all_day", "end_unknown", "cancelled")]
    midnight = lambda t, days: D.ny_midnight(F.date_add(F.to_date(D.ny_time(t)), days))
    s, e = F.col("s"), F.col("e")
    moments = F.array_sort(F.array_distinct(F.filter(F.array(F.lit("1900-01-01").cast("timestamp"), s - F.expr("interval 30 minutes"), s, e, midnight(s, 0), midnight(s, 1), midnight(e, 0), midnight(e, 1)), lambda t: t.isNotNull())))
    run, unknown, all_day, no_end, cancelled = flags
    states = F.transform(moments, lambda t: F.struct(t.alias("at"), D.live_state(s, e, t, run, unknown, all_day, no_end, cancelled)["state"].alias("state")))
    states = F.filter(states, lambda x: x["state"].isNotNull())
    changed = F.filter(F.transform(states, lambda x, i: F.struct(x["at"].alias("at"), x["state"].alias("state"), F.when(i > 0, F.get(states, i - 1)["state"]).alias("was"))), lambda x: x["was"].isNull() | (x["was"] != x["state"]))
    first = F.lit("1900-01-01").cast("timestamp")
    over = F.when(no_end, F.greatest(e, midnight(s, 1))).otherwise(e)
    step = lambda at, state: F.struct(at.alias("at"), (F.lit(state) if isinstance(state, str) else state).alias("state"))
    begins = [step(first, "upcoming"), step(s - F.expr("interval 30 minutes"), "soon")]
    short = F.array(*begins, step(s, F.when(no_end, "started").otherwise("live")), step(over, "past"))
    plain = ~run & ~unknown & ~all_day & ~cancelled & (s > F.lit("1900-01-02").cast("timestamp")) & e.isNotNull() & (over > s)
    every = F.transform(changed, lambda x: F.struct(x["at"].alias("at"), x["state"].alias("state")))
    return instances.withColumn("changes", F.when(plain, short).otherwise(every))


class Board(StatefulProcessor):
    """An instance's coming changes (times in milliseconds), with a timer at the next one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.plan = handle.getValueState("plan", "seen long, times array<long>, states array<string>, said string")

    def _move(self, key: tuple, seen: int, times: list[int], states: list[str], said: str | None, now: int) -> Iterator[Row]:
        """Say the state that holds now, and wake at the next change."""
        due = sum(t <= now for t in times)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due < len(times):
            self.handle.registerTimer(times[due])
        state = states[due - 1] if due else None
        self.plan.update((seen, times, states, state))
        if state != said:
            yield Row(id=key[0], state=state, was=said, at=times[due - 1] if due else seen)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        last = max(rows, key=lambda r: (r.at, len(r.times), r.times, r.states))  # an instance may be told of anew; the latest holds
        old = self.plan.get() if self.plan.exists() else (last.at, [], [], None)
        if old[0] <= last.at:
            yield from self._move(key, last.at, list(last.times), list(last.states), old[3], max(timerValues.getCurrentWatermarkInMs(), 0))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        seen, times, states, said = self.plan.get()
        yield from self._move(key, seen, list(times), list(states), said, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def live_board_stream(instances: DataFrame) -> DataFrame:
    """id, state, was, at: changes of the instances' live state as the stream's clock moves.

    instances (id, s, e, run, time_unknown, all_day, end_unknown, cancelled,
    seen) are told by a stream; ``seen`` is its clock (event time), so rows
    without an id may come as ticks. Each instance has a timer at its next
    change and costs nothing in between; an instance told anew, moved or
    cancelled, gets a new plan (a null state if it has none; of rows told at one
    moment the one with most changes holds). What was said before is kept, so
    every change is said once; of changes that pass in one batch the last is
    said. ``board_counts`` adds up the changes. Needs the RocksDB state store.
    """
    planned = state_changes(instances.withWatermark("seen", "0 seconds"))
    times, states = F.transform("changes", lambda c: F.unix_millis(c["at"])), F.transform("changes", lambda c: c["state"])
    rows = planned.select(F.coalesce("id", F.lit(TICK)).alias("id"), "seen", F.unix_millis("seen").alias("at"), times.alias("times"), states.alias("states"))
    said = rows.groupBy("id").transformWithState(Board(), "id long, state string, was string, at long", "append", "eventTime")
    return said.withColumn("at", F.timestamp_millis("at"))


#: The id of rows that only tell the time.
TICK = -(2**63)


def board_batch(instances: DataFrame, now: Column) -> DataFrame:
    """id, state of each instance at a moment, by the same plan."""
    due = F.filter("changes", lambda c: c["at"] <= now)
    return state_changes(instances).select("id", F.try_element_at(due, F.lit(-1))["state"].alias("state")).where("state is not null")


def board_counts(changes: DataFrame) -> DataFrame:
    """state, n: how many instances are in each state after the changes (an append-only table of them)."""
    step = F.explode(F.array(F.struct(F.col("state"), F.lit(1).alias("n")), F.struct(F.col("was").alias("state"), F.lit(-1).alias("n")))).alias("c")
    return changes.select(step).where("c.state is not null").groupBy("c.state").agg(F.sum("c.n").alias("n")).where("n <> 0")


def live_board(batch: DataFrame, instances: DataFrame) -> DataFrame:
    """now, live, to_come: counts at the latest clock tick of a batch (value timestamp column ``now``)."""
    now = batch.agg(F.max("now").alias("now")).where("now is not null")
    on = instances.join(F.broadcast(now), F.lit(True))  # one row
    return on.groupBy("now").agg(F.count_if((F.col("s") <= F.col("now")) & (F.col("now") < F.col("e"))).alias("live"), F.count_if(F.col("s") > F.col("now")).alias("to_come"))


def saved_order(items: DataFrame) -> DataFrame:
    """The users' items numbered by when they were saved."""
    return items.withColumn("n", F.row_number().over(Window.partitionBy("user").orderBy("ts", "item")))
