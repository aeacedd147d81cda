"""Speech segments of a stream of frames: keyed state and a timer that ends open utterances."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyline.operators.frames import FRAME_MS, IDLE, RATE, STATE, VAD, OnValues, detect, trimmed

SEGMENTS = "clip_id long, utt_no int, start_sample long, end_sample long, truncated boolean"


def segment_stream(frames: DataFrame, idle: str = "10 seconds", delay: str = "0 seconds", rate: int = RATE,
                   cfg: dict | None = None) -> DataFrame:
    """``vad_segments`` over a stream of frames ``(clip_id, frame_no, rms, zcr, at)``.

    A clip's state is the detector's scalars, the number of its segments and its last frame; no
    frame is kept. Frames of one clip come in order from one micro-batch to the next and in any
    order within one; frames at or before the last one count as repeats. An utterance that is
    open when no frame came for ``idle`` of event time ends there, and the clip's state goes: a
    pause within a recording must be shorter. ``at`` older than ``delay`` behind the latest is late
    and not read.
    """
    cfg = {**VAD, **(cfg or {})}
    size = rate * FRAME_MS // 1000
    keep = rate * cfg["hangover_ms"] // 1000
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    names = list(STATE)

    def table(clip, first: int, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(
            [(clip, first + k, *segment) for k, segment in enumerate(found)],
            columns=["clip_id", "utt_no", "start_sample", "end_sample", "truncated"])

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (*IDLE.values(), 0, -1, 0)
        now = dict(zip(names, held))
        now["floor"] = None if pd.isna(now["floor"]) else now["floor"]
        count, last, latest = held[len(names):]
        if state.hasTimedOut:
            state.remove()
            if now["speaking"] and now["utter"] > 0:
                begin = now["at"] - now["utter"]
                length = trimmed(OnValues, now["utter"], now["silence"], size, keep)
                yield table(key[0], count, [(begin, begin + length, False)])
            return
        found: list[tuple] = []

        def done(changed: dict, closes: bool, segment: tuple) -> dict:
            if closes:
                found.append(segment)
            return changed

        rows = pd.concat(parts).sort_values("frame_no", kind="stable")
        for no, rms, zcr in zip(rows["frame_no"].tolist(), rows["rms"].tolist(), rows["zcr"].tolist()):
            if no > last:
                now, last = detect(OnValues, now, {"rms": rms, "zcr": zcr}, rate, cfg, done), no
        latest = max(latest, int(rows["at"].max().timestamp() * 1000))
        state.update((*[now[n] for n in names], count + len(found), last, latest))
        state.setTimeoutTimestamp(latest + wait)
        if found:
            yield table(key[0], count, found)

    kept = ", ".join(f"{n} {t}" for n, t in STATE.items()) + ", count int, last long, latest long"
    return (frames.select("clip_id", "frame_no", "rms", "zcr", "at").withWatermark("at", delay)
            .groupBy("clip_id").applyInPandasWithState(run, SEGMENTS, kept, "append", GroupStateTimeout.EventTimeTimeout))


def run_segments(frames: DataFrame, root: str, checkpoint: str, **settings) -> None:
    """Drain a stream of frames into ``root/segments``; a replayed micro-batch replaces its folder."""
    def batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/segments/batch={batch_id}")

    (segment_stream(frames, **settings).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())


def read_segments(spark, root: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(f"{root}/segments").select(*[F.col(c.split()[0]) for c in SEGMENTS.split(", ")])
