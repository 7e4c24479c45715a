"""Structured Streaming: count windows with state, simplex events with state, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from filtra.functions import reduce as R

_PAIRS = "cloud_id string, window long, dim int, birth double, death double"
_EMPTY = pd.DataFrame({"cloud_id": [], "window": [], "dim": [], "birth": [], "death": []})


def _rows(cloud: str, window: int, pairs: list) -> pd.DataFrame:
    return pd.DataFrame([(cloud, window, *p) for p in pairs], columns=list(_EMPTY.columns))


def count_windows(points: DataFrame, size: int, stride: int | None = None, max_dim: int = 1, radius: float | None = None) -> DataFrame:
    """(cloud_id, window, dim, birth, death): a diagram of every full window of `size` points of a stream.

    points has cloud_id, seq and coords. The state holds a cloud's last size points at
    most; windows start every `stride` points (none: size). Points of one micro-batch
    are taken in the order of seq.
    """
    stride = stride or size
    if not 0 < stride <= size:
        raise ValueError("the stride must lie between 1 and the size")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window, flat = state.get if state.exists else (0, "")
        held = [[float(v) for v in p.split(",")] for p in flat.split(";")] if flat else []
        new = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for coords in new["coords"]:
            held.append([float(v) for v in coords])
            if len(held) == size:
                yield _rows(str(key[0]), window, R.vr_pairs(R.distances(np.array(held)), max_dim, radius))
                held, window = held[stride:], window + 1
        state.update((window, ";".join(",".join(map(repr, p)) for p in held)))

    return points.select("cloud_id", "seq", "coords").groupBy("cloud_id").applyInPandasWithState(
        step, _PAIRS, "window long, held string", "append", GroupStateTimeout.NoTimeout
    )


def simplex_events(events: DataFrame, max_dim: int = 2) -> DataFrame:
    """A diagram a cloud and micro-batch after its add and remove events (cloud_id, seq, op, vertices).

    The state is the complex. A facet must be there before what it bounds; removing an
    absent simplex or one with cofaces changes nothing. window counts the batches.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, flat = state.get if state.exists else (0, "")
        there = [tuple(int(v) for v in s.split(",")) for s in flat.split(";")] if flat else []
        new = pd.concat(list(batches)).sort_values("seq", kind="stable")
        before = [("add", s) for s in sorted(there, key=lambda s: (len(s), s))]
        now = R.replay([*before, *zip(new["op"], ([int(v) for v in x] for x in new["vertices"]))])
        state.update((turn + 1, ";".join(",".join(map(str, s)) for s in sorted(now))))
        yield _rows(str(key[0]), turn, R.reduce_complex([(float(len(s) - 1), s) for s in now], max_dim))

    return events.select("cloud_id", "seq", "op", "vertices").groupBy("cloud_id").applyInPandasWithState(
        step, _PAIRS, "turn long, simplices string", "append", GroupStateTimeout.NoTimeout
    )


def event_time_statistics(stream: DataFrame, time: str, key: str, value: str, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Count, sum, mean, deviation of a value by event-time window and key, with a watermark for late rows."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "n", "total", "mean", "std")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key that end after a gap without rows."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "n"
    )


def degree_updates(edge_changes: DataFrame) -> DataFrame:
    """Running Laplacian diagonal of a stream of (src, dst, change +1 or -1): the degree of each vertex."""
    ends = edge_changes.select(F.explode(F.array("src", "dst")).alias("v"), "change")
    return ends.groupBy("v").agg(F.sum("change").alias("degree"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain what is available into Parquet, exactly once by the checkpoint."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
