"""Overlapping action chunks and event-time windows over streams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "steps array<long>, sums array<array<double>>, counts array<long>"
OUT = "episode long, step long, n long, dx double, dy double, dz double, dyaw double"


def average_stream(chunks: DataFrame) -> DataFrame:
    """Steps of a stream of chunks (episode, start_step, actions), each once, as soon as no later
    chunk can cover it.

    Chunks of an episode come by rising start_step, so when one that starts at t arrives, all steps
    before t are complete: they are sent out and leave the state.  A chunk with no actions at t says
    that the episode ends, and sends out what is left.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        if state.exists:
            steps, sums, counts = state.get
            held = {int(s): [list(map(float, v)), int(n)] for s, v, n in zip(steps, sums, counts, strict=True)}
        rows = pd.concat(list(batches)).sort_values("start_step", kind="stable")
        done = []
        for start, actions in zip(rows["start_step"], rows["actions"], strict=True):
            over = len(actions) == 0
            for s in sorted(k for k in held if over or k < start):
                done.append((s, held[s][1], *[v / held[s][1] for v in held[s][0]]))
                del held[s]
            for i, a in enumerate(actions):
                cell = held.setdefault(int(start) + i, [[0.0] * 4, 0])
                cell[0] = [x + float(y) for x, y in zip(cell[0], a, strict=True)]
                cell[1] += 1
        state.update((list(held), [v[0] for v in held.values()], [v[1] for v in held.values()]))
        out = pd.DataFrame(done, columns=["step", "n", "dx", "dy", "dz", "dyaw"])
        out.insert(0, "episode", int(key[0]))
        out["dyaw"] = (out["dyaw"] + math.pi) % (2 * math.pi) - math.pi
        yield out

    return chunks.groupBy("episode").applyInPandasWithState(update, OUT, STATE, "append", "NoTimeout")


def event_time(frames: DataFrame, base: str = "1970-01-01", fps: float = 5.0) -> DataFrame:
    """Adds ts, the time of each frame."""
    return frames.withColumn("ts", F.timestamp_micros((F.unix_micros(F.lit(base).cast("timestamp")) + F.col("frame_index") * (1e6 / fps)).cast("long")))


def windowed_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in tumbling windows, for a batch or a stream with late rows."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    return df.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
