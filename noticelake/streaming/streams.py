"""Streaming forms of the subscription, versioning and rate operators.

Each takes a DataFrame and returns one; on a stream they carry watermarks and run
with bounded state, on a table they are plain windowed aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticelake.sources.scratch import stored


def daily_rate(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Number of events per key and day."""
    day = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy(key, day.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def sliding_activity(events: DataFrame, key: str, length: str = "7 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """Number of events per key in sliding windows."""
    w = F.window("ts", length, step)
    return events.withWatermark("ts", late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of events of a key without a pause of ``gap``."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drop_repeats(events: DataFrame, keys: list[str], minutes: int = 30, inclusive: bool = False, late: str = "1 day"):
    """Streams: an event goes if the last kept one of its keys is at most ``minutes`` old, less than that if ``inclusive``.

    The state of a key is the time of its last kept event; it ends once the watermark has passed its span. Events of a
    batch are taken in order of time; one that is older than the last kept one, but not late, goes.
    """
    gap = minutes * 60 * 1_000_000
    slack = 0 if inclusive else 1

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        last, kept = (state.get[0] if state.exists else None), []
        for i, at in enumerate(rows["ts"].astype("datetime64[us]").astype("int64")):
            if last is None or at >= last + gap + slack:
                kept.append(i)
                last = at
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + gap // 1000, state.getCurrentWatermarkMs()) + 1)
        yield rows.iloc[kept]

    marked = events.withWatermark("ts", late)
    return marked.groupBy(*keys).applyInPandasWithState(keep, events.schema, "last long", "append", "EventTimeTimeout")


def drop_repeats_batch(events: DataFrame, keys: list[str], order: str, minutes: int = 30, inclusive: bool = False) -> DataFrame:
    """The same rule over a table: the kept events of each key, of equal times the one of the least ``order``.

    Each time of a key is joined with the first one beyond its span. Where that lies in the same slice of time or the
    next, a window over both finds it, else it is the first time of a later slice, so that no task gets all of a key.
    The kept times are what is reached from a key's first one; jumps double in each round.
    """
    gap = minutes * 60 * 1_000_000 + (0 if inclusive else 1)
    slice_ = max(gap, 6 * 3600 * 1_000_000)
    times = events.select(*keys, F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col(order).alias("first_of"))
    times = stored(times.groupBy(*keys, "at").agg(F.min("first_of").alias("first_of")))
    sliced = times.withColumn("slice", F.floor(F.col("at") / slice_))
    both = sliced.select(*keys, "at", F.explode(F.array(F.struct(F.col("slice").alias("slice"), F.lit(True).alias("own")), F.struct((F.col("slice") + 1).alias("slice"), F.lit(False).alias("own")))).alias("p"))
    # From the latest time to the first: what precedes a row by the span is what follows it in time.
    ahead = Window.partitionBy(*keys, "p.slice").orderBy(-F.col("at")).rangeBetween(Window.unboundedPreceding, -gap)
    near = both.withColumn("near", F.min(F.when(F.col("p.own"), F.col("at"))).over(ahead))
    near = near.groupBy(*keys, "at").agg(F.min("near").alias("near"))
    firsts = sliced.groupBy(*keys, "slice").agg(F.min("at").alias("begin"))
    later = Window.partitionBy(*keys).orderBy(-F.col("slice")).rangeBetween(Window.unboundedPreceding, -2)
    after = firsts.withColumn("far", F.min("begin").over(later)).select(*keys, "slice", "far")
    jump = sliced.join(near, [*keys, "at"]).join(after, [*keys, "slice"]).select(*keys, "at", F.coalesce("near", "far").alias("to"))
    jump = stored(jump.filter("to is not null"))
    kept = stored(times.groupBy(*keys).agg(F.min("at").alias("at")))
    while True:
        reached = stored(kept.join(jump, [*keys, "at"]).select(*keys, F.col("to").alias("at")))
        if reached.isEmpty():
            break
        kept = stored(kept.unionByName(reached))
        twice = jump.select(*keys, F.col("at").alias("to"), F.col("to").alias("end"))
        jump = stored(jump.join(twice, [*keys, "to"]).select(*keys, "at", F.col("end").alias("to")))
    chosen = kept.join(times, [*keys, "at"]).select(F.col("first_of").alias(order))
    return events.join(chosen, order, "left_semi")


def append_batches(stream: DataFrame, path: str, checkpoint: str, log: str | None = None):
    """Write a stream to ``path`` in available batches, then a log of the batch's ids.

    A batch has a partition of its own number in both, which a repeated run of the batch replaces.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if log:
            batch.select("event_id").write.mode("overwrite").parquet(f"{log}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
