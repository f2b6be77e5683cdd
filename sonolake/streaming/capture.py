"""Count-based batches of a sample stream, with a bounded backlog for each device.

The samples of a device come in ticks (what is at hand when the consumer looks). At each tick they go behind the backlog; of more than
`capacity` samples the oldest are dropped and counted; then at most one whole batch of `size` samples is taken off the front. A
consumer that looks often enough loses nothing: every sample comes out in a batch or waits in the backlog.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sonolake.functions import dsp
from sonolake.sources import objects, tables

BATCHES = "device string, batch long, first long, last long, n long, samples array<double>, dropped long"
_STATE = "places array<long>, samples array<double>, taken long, dropped long"


class Backlog:
    """The samples of one device that wait, and what has become of the others."""

    def __init__(self, places: np.ndarray, samples: np.ndarray, taken: int = 0, dropped: int = 0):
        self.places, self.samples, self.taken, self.dropped = places, samples, taken, dropped

    def look(self, places: np.ndarray, samples: np.ndarray, size: int, capacity: int) -> tuple | None:
        """A tick: adds samples, drops the oldest beyond the capacity, takes a batch if there is a whole one."""
        self.places, self.samples = np.concatenate([self.places, places]), np.concatenate([self.samples, samples])
        if (over := len(self.places) - capacity) > 0:
            self.places, self.samples, self.dropped = self.places[over:], self.samples[over:], self.dropped + over
        if len(self.places) < size:
            return None
        batch = self.taken, int(self.places[0]), int(self.places[size - 1]), size, self.samples[:size].tolist(), self.dropped
        self.places, self.samples, self.taken = self.places[size:], self.samples[size:], self.taken + 1
        return batch


def capture_batches(stream: DataFrame, size: int, capacity: int) -> DataFrame:
    """device, batch (number), first and last place, n, samples, dropped (so far) of each batch of a stream of (device, tick, place, sample).

    The state of a device is its backlog, `capacity` samples at most; it lasts from run to run with the stream's checkpoint. A
    tick is one look: its samples have to come in one micro-batch, in any order, and no earlier than those of smaller ticks.
    """
    if not 0 < size <= capacity:
        raise ValueError("a batch has at least one sample and fits into the backlog")

    def run(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        ticks, places, samples = (np.concatenate([part[c].to_numpy(k) for part in parts]) for c, k in (("tick", np.int64), ("place", np.int64), ("sample", float)))
        order = np.lexsort((places, ticks))
        ticks, places, samples = ticks[order], places[order], samples[order]
        ends = [*(np.flatnonzero(ticks[1:] != ticks[:-1]) + 1), len(ticks)]
        kept = state.get if state.exists else ([], [], 0, 0)
        backlog = Backlog(np.array(kept[0], np.int64), np.array(kept[1], float), *kept[2:])
        found = []
        for begin, end in zip([0, *ends[:-1]], ends, strict=True):  # one tick after the other
            if (batch := backlog.look(places[begin:end], samples[begin:end], size, capacity)) is not None:
                found.append((key[0], *batch))
        state.update((backlog.places.tolist(), backlog.samples.tolist(), backlog.taken, backlog.dropped))
        yield pd.DataFrame(found, columns=[c.split()[0] for c in BATCHES.split(", ")])

    known = stream.where("device is not null and tick is not null and place is not null")
    kinds = {"device": "string", "tick": "long", "place": "long", "sample": "double"}
    rows = known.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()))
    return rows.groupBy("device").applyInPandasWithState(run, BATCHES, _STATE, "append", GroupStateTimeout.NoTimeout)


def run_captured(batches: DataFrame, path: str, checkpoint: str) -> None:
    """Works off what is available and appends the batches to a table; a later run goes on with the backlogs."""
    batches.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def produce(batches: DataFrame, root: str, rate: int, bucket: str = "landing") -> DataFrame:
    """Puts the waveform of each batch into a bucket below `root`; the events that tell of it (with the uuid that names both).

    A batch has an id of its device and number alone, so one that comes again puts the same object and event.
    """
    uuid = F.substring(F.sha2(F.concat_ws("\u0001", "device", "batch"), 256), 1, 32)

    def wave(row: dict) -> bytes:
        """The samples scaled to their largest magnitude as a 16-bit waveform."""
        return tables.encode_wav(dsp.normalise(np.asarray(row["samples"], float)), int(rate))

    named = batches.select(uuid.alias("uuid"), "device", "first", "n", F.concat(F.lit("audio/hot-path/raw/"), uuid, F.lit(".wav")).alias("audio_path"), "samples")
    objects.write_objects(named.select(F.col("audio_path").alias("name"), "samples"), f"{root}/{bucket}", wave, deal=False)  # samples are more than their waveform
    return named.select("uuid", "audio_path", F.lit(bucket).alias("bucket"), F.lpad(F.col("first").cast("string"), 12, "0").alias("timestamp"), F.lit(rate).alias("sample_rate"), F.floor(F.col("n") / rate).cast("int").alias("duration"), "device")
