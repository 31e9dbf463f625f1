"""Time-to-live, rate limits and quotas, as keyed stream state and as batch twins.

Windows open at the first event after the last one closed, so where one opens hangs on all before it. The batch twins cut time into segments of
SEGMENT window lengths. A segment is a function from "no window may open before x" to the same for what follows, a step function with few steps, found for
all segments at once; the steps are followed once per key, and each segment then marks its windows knowing its x. A key that never pauses, with all events
of a table, is as many segments as it is long.

start_dedup and start_rate_limit run each micro-batch of a stream through the batch twins and hand one row per open key on to the
next, so no task holds a key's rows. dedup_stream and rate_limit_stream are for triggers that bound what one key has in a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from patchlight import constants as C
from patchlight.operators.budget import running_total
from patchlight.session import cut_lineage

#: Window lengths that a segment of a key's time is long.
SEGMENT = 64


def _new(table: pa.Table) -> np.ndarray:
    """Whether each row starts another (key, segment)."""
    if not table.num_rows:
        return np.zeros(0, bool)
    key, seg = table["_key"].combine_chunks(), table["_seg"].to_numpy()
    other = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
    return np.append(True, other | (seg[1:] != seg[:-1]))


def _group(table: pa.Table, row: int) -> tuple[str, int]:
    return table["_key"][row].as_py(), table["_seg"][row].as_py()


def _followers(new: np.ndarray, us: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The first row of the same group at or after time + span (len: none), and each row's group number."""
    of = np.cumsum(new) - 1
    base = us[new][of]
    # One axis for all groups: none reaches into the next.
    line = of * np.int64((us - base).max() + span + 1) + (us - base)
    after = np.searchsorted(line, line + span)
    return np.where(np.append(of, -1)[after] == of, after, len(us)), of


def _steps(span: int):
    """A segment's step function: for breaks b[i] (its events in the first span), where windows that open at the first event at or after x > b[i - 1] end.

    A segment may be as long as its key is busy, so its function is carried from batch to batch: exits that a batch holds events after go on in it,
    and steps that end alike become one. Its rows are not held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, breaks, exits, passed = None, np.zeros(0, np.int64), np.zeros(0, np.int64), False

        def made(done: list) -> pa.RecordBatch:
            columns = [pa.array([g[k] for g, _, _ in done], t) for k, t in ((0, pa.string()), (1, pa.int64()))]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array([d[k] for d in done], pa.list_(pa.int64())) for k in (1, 2)]], ["_key", "_seg", "_breaks", "_exits"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table, done = pa.Table.from_batches([batch]), []
            new, us, seg = _new(table), table["_us"].to_numpy(), table["_seg"].to_numpy()
            after, _ = _followers(new, us, span)
            # The last window of the chain that starts at each row, by pointer doubling.
            last = np.append(np.where(after < len(us), after, np.arange(len(us))), len(us))
            while (last[last] != last).any():
                last = last[last]
            ends = us[last[:-1]] + span
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(us))
            first = table.take(pa.array(head))
            early = us < seg * (span * SEGMENT) + span
            for of, i, j in zip(zip(first["_key"].to_pylist(), first["_seg"].to_pylist(), strict=True), head.tolist(), tail.tolist(), strict=True):
                if of != group:
                    if group is not None:
                        done.append((group, breaks, exits))
                    group, breaks, exits, passed = of, us[:0], us[:0], False
                at = i + np.searchsorted(us[i:j], exits)
                exits = np.where(at < j, ends[np.minimum(at, j - 1)], exits)
                if not passed:
                    # Events in the first span, and the first one after it.
                    m = i + int(np.searchsorted(~early[i:j], True)) + 1
                    passed, m = m <= j, min(m, j)
                    breaks, exits = np.append(breaks, us[i:m]), np.append(exits, ends[i:m])
                keep = np.append(exits[1:] != exits[:-1], True)
                breaks, exits = breaks[keep], exits[keep]
            if done:
                yield made(done)
        if group is not None:
            yield made([(group, breaks, exits)])

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a key in order: the time before which no window may open in each. One number is carried."""
    key, x = None, None
    for batch in batches:
        out = []
        for i, k in enumerate(batch["_key"].to_pylist()):
            if k != key:
                key, x = k, FIRST
            out.append(x)
            breaks, exits = (batch[c][i].values.to_numpy() for c in ("_breaks", "_exits"))
            at = int(np.searchsorted(breaks, x))
            x = int(exits[at]) if at < len(breaks) else x
        yield pa.RecordBatch.from_arrays([batch["_key"], batch["_seg"], pa.array(out, pa.int64())], ["_key", "_seg", "_x"])


#: Before any event.
FIRST = -(2**62)


def _marked(span: int):
    """opened for every distinct time of a segment whose x is known. A segment that goes on in the next batch does so with the x that it has then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, then = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            new, us, x = _new(table), table["_us"].to_numpy(), table["_x"].to_numpy()
            if _group(table, 0) == group:
                x = np.where(np.cumsum(new) == 1, then, x)
            after, of = _followers(new, us, span)
            late = us >= x
            opens = np.zeros(len(us) + 1, bool)
            # The first row at or after x opens; all segments step on together, at most SEGMENT times.
            at = np.flatnonzero(late & (new | np.append(True, ~late[:-1])))
            while len(at):
                opens[at] = True
                at = after[at]
                at = at[at < len(us)]
            # Within a group times grow, so the latest opening so far is the greatest row number seen.
            row = np.maximum.accumulate(np.where(opens[:-1], np.arange(len(us)), -1))
            own = (row >= 0) & (of[np.maximum(row, 0)] == of)
            opened = np.where(own, us[np.maximum(row, 0)], x - span)
            group, then = _group(table, -1), int(opened[-1]) + span
            yield pa.RecordBatch.from_arrays([table["_key"].combine_chunks(), table["_us"].combine_chunks(), pa.array(opened)], ["_key", "_us", "opened"])

    return run


def anchored_windows(events: DataFrame, keys: list[str], us: str, seconds: int) -> DataFrame:
    """Adds opened: the start of the window an event falls in, windows opening at the first event
    after the last one closed. us is the event time in microseconds; events without one are left out.

    A null key is a key of its own. The work is on distinct times of a key, in segments; a segment's times are one task's, which holds a batch of them; so is the list of a
    key's segments, of which one number is carried.
    """
    span = seconds * 1_000_000
    # One text per key, null parts told from empty ones.
    key = F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k in keys])
    rows = events.where(F.col(us).isNotNull()).withColumn("_key", key)
    step = span * SEGMENT
    times = rows.select("_key", F.col(us).cast("bigint").alias("_us")).distinct().withColumn("_seg", F.expr(f"(_us - pmod(_us, {step}L)) div {step}L"))
    order = ["_key", "_seg", "_us"]
    placed = cut_lineage(times.repartition("_key", "_seg").sortWithinPartitions(*order))
    functions = placed.select(*order).mapInArrow(_steps(span), "_key string, _seg bigint, _breaks array<bigint>, _exits array<bigint>")
    entries = functions.repartition("_key").sortWithinPartitions("_key", "_seg").mapInArrow(_entries, "_key string, _seg bigint, _x bigint")
    known = placed.join(entries, ["_key", "_seg"]).select(*order, "_x").repartition("_key", "_seg").sortWithinPartitions(*order)
    opened = known.mapInArrow(_marked(span), "_key string, _us bigint, opened bigint").select(F.col("_key").alias("_own"), F.col("_us").alias("_at"), "opened")
    return rows.join(opened, (F.col("_key") == F.col("_own")) & (F.col(us) == F.col("_at"))).select(*events.columns, "opened")


def first_per_ttl(events: DataFrame, keys: list[str], us: str, seq: str, seconds: int) -> DataFrame:
    """Events kept when repeats within the time to live are dropped; the time is not refreshed."""
    w = anchored_windows(events, keys, us, seconds)
    rest = [c for c in events.columns if c not in keys]
    return w.groupBy(*keys, "opened").agg(F.min_by(F.struct(*rest), F.struct(us, seq)).alias("_f")).select(
        *keys, *[F.col(f"_f.{c}").alias(c) for c in rest])


def rate_limited(events: DataFrame, keys: list[str], us: str, seq: str, seconds: int = C.HOOK_WINDOW_SECONDS,
                 limit: int = C.HOOK_MAX_EVENTS) -> DataFrame:
    """Adds n (place in its window) and limited. A window is at most seconds of one key."""
    w = W.partitionBy(*keys, "opened").orderBy(us, seq)
    return anchored_windows(events, keys, us, seconds).withColumn("n", F.row_number().over(w)).withColumn(
        "limited", F.col("n") > limit)


def tumbling_counts(events: DataFrame, key: str, ts: str = "ts", width: str = "60 seconds") -> DataFrame:
    """Clock-aligned variant: one aggregation, in batch or stream."""
    return events.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(
        key, F.col("w.start").alias("window_start"), "n")


def api_quota(calls: DataFrame, key: str, us: str, seq: str, limit: int = C.API_MAX_REQUESTS, seconds: int = C.API_WINDOW_SECONDS) -> DataFrame:
    """Calls within the sliding window up to each call, remaining quota and reset time.

    One running count per key over its distinct times, with a mark at each time's window start: the calls in a window are those up to the call less
    those before its mark, and the first of them is the call that the next number names. The running count cuts a busy key into slices, and what
    is looked up in it has the time or the number in its key, so no task sees a key's calls. Calls at one time count alike, equal rows stay rows; a
    null key is a key of its own; a call without a time has no window and null figures.
    """
    span = seconds * 1_000_000
    rows = calls.withColumn("_k", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))
    times = cut_lineage(rows.where(F.col(us).isNotNull()).groupBy("_k", F.col(us).alias("_at")).agg(F.count("*").alias("_c")))
    marks = times.select("_k", (F.col("_at") - span).alias("_at"), F.lit(0).cast("bigint").alias("_c"))
    both = times.unionByName(marks).groupBy("_k", "_at").agg(F.sum("_c").alias("_c"))
    line = cut_lineage(running_total(both, ["_k"], ["_at"], "_c", "_cum"))
    ends = line.where("_c > 0").select("_k", F.col("_at").alias("_us"), "_cum", (F.col("_at") - span).alias("_from"))
    starts = line.select("_k", F.col("_at").alias("_from"), (F.col("_cum") - F.col("_c")).alias("_before"))
    numbered = line.where("_c > 0").select("_k", (F.col("_cum") - F.col("_c")).alias("_before"), F.col("_at").alias("_first"))
    found = ends.join(starts, ["_k", "_from"]).join(numbered, ["_k", "_before"]).select("_k", F.col("_us").alias("_t"), (F.col("_cum") - F.col("_before")).alias("n"), "_first")
    one = rows.join(found, (rows["_k"] == found["_k"]) & (F.col(us) == F.col("_t")), "left")
    return one.select(
        *[rows[c] for c in calls.columns], "n", (F.col("n") <= limit).alias("allowed"), F.greatest(F.lit(limit) - F.col("n"), F.lit(0)).alias("remaining"),
        (F.col("_first") + span).alias("reset_at"))


def dedup_stream(stream: DataFrame, key: str, order: str, seconds: int = 3600) -> DataFrame:
    """The first event of each key and, once its time to live is over, the first one after that; seeing a key again does not prolong it.

    State is one time per key. A null key is a key of its own. Events of one key and micro-batch are taken in the order of (ts, order),
    in memory; start_dedup has no such bound.
    """
    span = seconds * 1_000_000
    keyed = stream.withWatermark("ts", f"{seconds} seconds").withColumn("_k", F.coalesce(F.col(key).cast("string"), F.lit(""))).withColumn("_us", F.unix_micros("ts"))
    names = stream.columns
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened = state.get[0] if state.exists else -(2**62)
        rows = pd.concat(list(batches)).sort_values(["_us", order])
        times = rows["_us"].to_numpy()
        keep = []
        # One search per window that opens, not one step per event.
        at = times.searchsorted(opened + span)
        while at < len(times):
            keep.append(at)
            opened = int(times[at])
            at = times.searchsorted(opened + span)
        state.update((opened,))
        state.setTimeoutTimestamp(max((opened + span) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield rows.iloc[keep][names]

    return keyed.groupBy("_k").applyInPandasWithState(step, out, "opened long", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limit_stream(stream: DataFrame, key: str = "installation_id", seconds: int = C.HOOK_WINDOW_SECONDS,
                      limit: int = C.HOOK_MAX_EVENTS) -> DataFrame:
    """Events with limited, by per-key state (window start, count). A null key is a bucket of its own. start_rate_limit does it for micro-batches of any size."""
    span = seconds * 1_000_000
    keyed = stream.withWatermark("ts", f"{seconds} seconds").withColumn("_k", F.coalesce(F.col(key).cast("string"), F.lit(""))).withColumn("_us", F.unix_micros("ts"))
    out = "delivery_id string, ts timestamp, pr_url string, job_event string, installation_id bigint, limited boolean"

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (-(2**62), 0)
        # A micro-batch of one key is read in full to order it; its size is bounded by the trigger.
        rows = pd.concat(list(batches)).sort_values(["_us", "delivery_id"])
        flags = []
        for us in rows["_us"]:
            if us >= start + span:
                start, n = us, 0
            n += 1
            flags.append(n > limit)
        state.update((int(start), int(n)))
        # Drop the state once its window has closed in event time.
        state.setTimeoutTimestamp(max((start + span) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield rows.assign(limited=flags)[["delivery_id", "ts", "pr_url", "job_event", "installation_id", "limited"]]

    def with_timeout(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        yield from step(k, batches, state)

    return keyed.groupBy("_k").applyInPandasWithState(
        with_timeout, out, "start long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def _keyed(events: DataFrame, key: str) -> DataFrame:
    """Adds _k, never null, and _us. Events without a time have no place in any window and go."""
    return events.withColumn("_k", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))).withColumn("_us", F.unix_micros("ts")).where("_us IS NOT NULL")


def _start(stream: DataFrame, key: str, seconds: int, out: str, base: str, once: bool, step):
    """Run step(live events with _k, _us and the window _opened, _n that their key has open, write) on each micro-batch.

    step writes the batch's result by write and returns _k, _opened, _n of the windows it opened or went on with. The windows that may still be
    open are kept in two folders in turn: a batch that runs again reads what the batch before left and overwrites what is its own, so results
    appear once. An event older than the latest of the earlier batches by more than seconds is late and goes, so closed windows are forgotten then.
    """
    span = seconds * 1_000_000
    schema = "_k string, _opened long, _n long"

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        held = spark.read.schema(schema).parquet(f"{base}/held/{(epoch - 1) % 2}") if epoch else spark.createDataFrame([], schema)
        # The row without a key has the watermark.
        mark = held.where("_k IS NULL").agg(F.max("_opened")).first()[0]
        held = held.where("_k IS NOT NULL")
        events = _keyed(batch, key)
        live = events if mark is None else events.where(F.col("_us") > mark)
        opened = step(live.join(held, "_k", "left"), lambda df: df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}"), f"{out}/epoch={epoch}")
        latest = events.agg(F.max("_us")).first()[0]
        marks = [x for x in (mark, latest - span if latest is not None else None) if x is not None]
        last = held.union(opened).groupBy("_k").agg(F.max(F.struct("_opened", "_n")).alias("_w")).select("_k", "_w.*")
        if marks:
            last = last.where(F.col("_opened") + span > max(marks)).union(spark.createDataFrame([(None, max(marks), 0)], schema))
        last.write.mode("overwrite").parquet(f"{base}/held/{epoch % 2}")

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{base}/state")
    return (w.trigger(availableNow=True) if once else w).start()


def start_dedup(stream: DataFrame, key: str, order: str, out: str, base: str, seconds: int = 3600, once: bool = False):
    """What dedup_stream keeps, as part files in out, one folder per micro-batch. A key's rows are never in one task's memory."""
    span, names = seconds * 1_000_000, stream.columns

    def step(live: DataFrame, write, at: str) -> DataFrame:
        fresh = live.where(F.col("_opened").isNull() | (F.col("_us") >= F.col("_opened") + span)).drop("_opened", "_n")
        opening = anchored_windows(fresh.select("_k", "_us").distinct(), ["_k"], "_us", seconds).where("opened = _us").select("_k", "_us")
        first = F.min_by(F.struct(*names), F.struct(F.col(order).isNull(), F.col(order)))
        write(fresh.join(opening, ["_k", "_us"]).groupBy("_k", "_us").agg(first.alias("_f")).select("_f.*"))
        kept = _keyed(live.sparkSession.read.schema(stream.schema).parquet(at).select(*names), key)
        return kept.select("_k", F.col("_us").alias("_opened"), F.lit(1).cast("long").alias("_n"))

    return _start(stream, key, seconds, out, base, once, step)


def start_rate_limit(stream: DataFrame, out: str, base: str, key: str = "installation_id", order: str = "delivery_id", seconds: int = C.HOOK_WINDOW_SECONDS,
                     limit: int = C.HOOK_MAX_EVENTS, once: bool = False):
    """The events with limited, as rate_limit_stream gives them, as part files in out, one folder per micro-batch."""
    span, names = seconds * 1_000_000, stream.columns

    def step(live: DataFrame, write, at: str) -> DataFrame:
        goes_on = F.coalesce(F.col("_us") < F.col("_opened") + span, F.lit(False))
        fresh = live.where(~goes_on).drop("_opened", "_n")
        windows = anchored_windows(fresh.select("_k", "_us").distinct(), ["_k"], "_us", seconds).withColumnRenamed("opened", "_opened")
        cols = [*names, "_k", "_us", "_opened", "_n"]
        placed = live.where(goes_on).select(*cols).union(fresh.join(windows, ["_k", "_us"]).withColumn("_n", F.lit(0).cast("long")).select(*cols))
        n = F.row_number().over(W.partitionBy("_k", "_opened").orderBy("_us", order)) + F.col("_n")
        write(placed.withColumn("limited", n > limit).select(*names, "limited"))
        return placed.groupBy("_k", "_opened").agg((F.count(F.lit(1)) + F.max("_n")).alias("_n"))

    return _start(stream, key, seconds, out, base, once, step)
