"""Activity segments of frames that arrive as a stream.

State is kept by clip: whether activity is on, where its run began, and frames that came before
their turn. Frames are taken in order, whatever order they come in; a run is reported once it ends.
A clip's length n may come with its frames or, where a source doesn't know it before, in a closing
row of its own (f null); once all its frames are taken, the last run is reported and the state goes.
Without a length a clip stays open: state never expires by itself in streamed_segments(); idle_segments()
closes clips by timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from cadenza.operators.activity import Thresholds

STATE = "on BOOLEAN, begun INT, next INT, n INT, waiting ARRAY<STRUCT<f: INT, ste: DOUBLE, zcr: DOUBLE>>"


def streamed_segments(frames: DataFrame, length: int, hop: int, limits: Thresholds) -> DataFrame:
    """(clip_id, seg_start, seg_end) of a stream of (clip_id, n, f, ste, zcr)."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        on, begun, at, n, held = state.get if state.exists else (False, 0, 0, None, [])
        waiting = {r[0]: (r[1], r[2]) for r in held}
        for part in parts:
            for f, size, ste, zcr in zip(*(part[c].tolist() for c in ("f", "n", "ste", "zcr")), strict=True):
                n = n if pd.isna(size) else int(size)
                if not pd.isna(f) and f >= at:
                    waiting[int(f)] = (float(ste), float(zcr))
        found = []
        while at in waiting:
            ste, zcr = waiting.pop(at)
            if not on and (ste > limits.energy_hi or zcr > limits.zcr_hi):
                on, begun = True, at
            elif on and ste < limits.energy_lo and zcr < limits.zcr_lo:
                on = False
                found.append((begun, at))
            at += 1
        if n is not None and at >= (1 if n < length else (n - length) // hop + 1):
            found += [(begun, at)] if on else []
            state.remove()
        else:
            state.update((on, begun, at, n, [(f, *v) for f, v in sorted(waiting.items())]))
        ends = [(a * hop, b * hop + length) for a, b in found]
        if ends:
            yield pd.DataFrame({"clip_id": key[0], "seg_start": [a for a, _ in ends], "seg_end": [b if n is None else min(b, n) for _, b in ends]})

    kind = frames.schema["clip_id"].dataType.simpleString()
    return frames.groupBy("clip_id").applyInPandasWithState(
        run, f"clip_id {kind}, seg_start INT, seg_end INT", STATE, "append", GroupStateTimeout.NoTimeout
    )


def read_frames(frames: DataFrame, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of frame statistics from Parquet files below path, with the columns of frames."""
    return frames.sparkSession.readStream.schema(frames.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


#: Places of frames that wait in one entry.
BLOCK = 256


class IdleClips(StatefulProcessor):
    """Takes a clip's frames in their order and closes it once it has been idle for some time.

    State: `run` (whether activity is on, where its run began, the next frame, the clip's length if it is known,
    whether frames wait), and `waiting`, a map of the frames that came before their turn, an entry for each BLOCK
    of places, of which only those whose turn it is are read. Each call of the state is a message to the JVM, so
    frames of a batch whose turn it is never go there. An event-time timer is set `idle` after the latest frame's time.
    """

    def __init__(self, length: int, hop: int, limits: Thresholds, idle_ms: int) -> None:
        self.length, self.hop, self.limits, self.idle = length, hop, limits, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "on BOOLEAN, begun INT, next INT, n INT, due BIGINT, waits BOOLEAN")
        self.waiting = handle.getMapState("waiting", "block INT", "f ARRAY<INT>, ste ARRAY<DOUBLE>, zcr ARRAY<DOUBLE>")

    def frame(self, f: int, ste: float, zcr: float, on: bool, begun: int, found: list) -> tuple[bool, int]:
        if not on and (ste > self.limits.energy_hi or zcr > self.limits.zcr_hi):
            return True, f
        if on and ste < self.limits.energy_lo and zcr < self.limits.zcr_lo:
            found.append((begun, f))
            return False, begun
        return on, begun

    def rows(self, key: tuple, found: list, n: int | None) -> Iterator[pd.DataFrame]:
        if found:
            ends = [b * self.hop + self.length for _, b in found]
            yield pd.DataFrame({"clip_id": [key[0]] * len(found), "seg_start": [a * self.hop for a, _ in found], "seg_end": [e if n is None else min(e, n) for e in ends]})

    def state(self) -> tuple:
        return self.run.get() or (False, 0, 0, None, None, False)

    def block(self, k: int) -> dict[int, tuple[float, float]]:
        """Frames that wait in a block."""
        held = self.waiting.getValue((k,)) if self.waiting.containsKey((k,)) else None
        return {} if held is None else {f: (ste, zcr) for f, ste, zcr in zip(*held, strict=True)}

    def keep(self, came: dict[int, tuple[float, float]], touched: set[int]) -> None:
        """Put frames with those of their blocks; came has all of the touched blocks."""
        blocks: dict[int, dict] = {k: {} for k in touched}
        for f, v in came.items():
            blocks.setdefault(f // BLOCK, {})[f] = v
        for k, frames in blocks.items():
            frames = frames if k in touched else self.block(k) | frames
            if frames:
                self.waiting.updateValue((k,), (list(frames), [v[0] for v in frames.values()], [v[1] for v in frames.values()]))
            else:
                self.waiting.removeKey((k,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        on, begun, at, n, due, waits = self.state()
        latest, found = None, []
        came: dict[int, tuple[float, float]] = {}
        for part in rows:
            for f, size, ste, zcr, when in zip(*(part[c].tolist() for c in ("f", "n", "ste", "zcr", "at")), strict=True):
                n = n if pd.isna(size) else int(size)
                ms = int(when.timestamp() * 1000)
                latest = ms if latest is None else max(latest, ms)
                if not pd.isna(f) and f >= at:
                    came[int(f)] = (float(ste), float(zcr))
        read: set[int] = set()
        while True:
            if waits and at // BLOCK not in read:
                read.add(at // BLOCK)
                came = self.block(at // BLOCK) | came
            if at not in came:
                break
            on, begun = self.frame(at, *came.pop(at), on, begun, found)
            at += 1
        if n is not None and at >= (1 if n < self.length else (n - self.length) // self.hop + 1):
            found += [(begun, at)] if on else []
            self.forget(due)
        else:
            if latest is not None and (due is None or latest + self.idle > due):
                if due is not None:
                    self.handle.deleteTimer(due)
                due = latest + self.idle
                self.handle.registerTimer(due)
            self.keep(came, read)
            self.run.update((on, begun, at, n, due, waits or bool(came)))
        yield from self.rows(key, found, n)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        on, begun, at, n, _, waits = self.state()
        found: list[tuple[int, int]] = []
        # frames that never came keep the state as it is
        left = sorted(row for _, held in self.waiting.iterator() for row in zip(*held, strict=True)) if waits else []
        for f, ste, zcr in left:
            on, begun = self.frame(f, ste, zcr, on, begun, found)
            at = f + 1
        found += [(begun, at)] if on else []
        self.forget(None)
        yield from self.rows(key, found, n)

    def forget(self, due: int | None) -> None:
        if due is not None:
            self.handle.deleteTimer(due)
        self.run.clear()
        self.waiting.clear()

    def close(self) -> None:
        pass


def idle_segments(frames: DataFrame, length: int, hop: int, limits: Thresholds, idle: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """(clip_id, seg_start, seg_end) of a stream of (clip_id, n, f, ste, zcr, at), at being a frame's time.

    As streamed_segments, but a clip that nothing came of for `idle` (by event time) is closed: frames that are
    missing are passed over, the last run is reported and all its state goes, so what is kept is what the clips of
    the last so many minutes need. Frames later than `late` behind the latest of the stream may be dropped; one
    that comes for a closed clip begins it anew. Needs the RocksDB state store (session.ROCKSDB).
    """
    kind = frames.schema["clip_id"].dataType.simpleString()
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return frames.withWatermark("at", late).groupBy("clip_id").transformWithStateInPandas(
        IdleClips(length, hop, limits, ms), f"clip_id {kind}, seg_start INT, seg_end INT", "append", "EventTime"
    )
