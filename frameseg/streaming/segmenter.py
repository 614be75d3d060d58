"""Segments of frames that arrive as a stream. An extension: the batch operators define the results.

Per recording the state holds the open run, and the runs that may still merge. A run is settled when it ends, because an island of
values >= off counts iff it reaches on; a song is emitted once the stream has moved on by more than the merge gap. Smoothing is up to
the source: it needs frames from both sides. Frames of a recording must come in order; late ones are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schemas import PostProcessConfig

OUT = "vod_id string, a long, b long"
STATE = "next long, run_a long, top double, song_a long, song_b long"


def _advance(state: tuple, frames, cfg: PostProcessConfig) -> tuple[tuple, list[tuple[int, int]]]:
    """Takes (frame, value) pairs in order; returns the state and songs that are complete. -1 stands for none."""
    nxt, run_a, top, song_a, song_b = state
    gap, done = max(cfg.max_gap_s, cfg.merge_gap_s), []

    def close(b: int):
        nonlocal run_a, top, song_a, song_b
        if run_a >= 0 and top >= cfg.on_threshold and (b - run_a) / cfg.frame_rate >= cfg.min_blip_s:
            if song_a >= 0 and (run_a - song_b) / cfg.frame_rate > gap:
                emit()
            song_a, song_b = (run_a if song_a < 0 else song_a), b
        run_a, top = -1, 0.0

    def emit():
        nonlocal song_a, song_b
        if song_a >= 0 and (song_b - song_a) / cfg.frame_rate >= cfg.min_song_s:
            done.append((song_a, song_b))
        song_a = song_b = -1

    for i, v in frames:
        if i < nxt:
            continue
        if i > nxt:  # missing frames are below every threshold
            close(nxt)
        if v == v and v is not None and v >= cfg.off_threshold:
            run_a, top = (i, v) if run_a < 0 else (run_a, max(top, v))
        else:
            close(i)
        nxt = i + 1
        if song_a >= 0 and run_a < 0 and (nxt - song_b) / cfg.frame_rate > gap:
            emit()
    return (nxt, run_a, top, song_a, song_b), done


def _end(state: tuple, cfg: PostProcessConfig) -> list[tuple[int, int]]:
    """What is complete if no frame follows."""
    far = state[0] + int(10 * max(cfg.max_gap_s, cfg.merge_gap_s) * cfg.frame_rate) + 10
    return _advance(state, [(state[0], 0.0), (far, 0.0)], cfg)[1]


def stream_songs(frames: DataFrame, cfg: PostProcessConfig, idle_ms: int = 60_000) -> DataFrame:
    """Runs [a, b) of songs from a stream of (vod_id, frame_idx, prob); a recording that is silent for idle_ms ends."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (0, -1, 0.0, -1, -1)
        if state.hasTimedOut:
            done = _end(now, cfg)
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("frame_idx")
            now, done = _advance(now, zip(rows.frame_idx.astype(int), rows.prob, strict=True), cfg)
            state.update(now)
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], a, b) for a, b in done], columns=["vod_id", "a", "b"])

    return frames.groupBy("vod_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
