"""Streaming segmentation against the batch fold, whatever the split."""

import datetime as dt
import random

import pytest

from tallyline.operators import frames as fr
from tallyline.streaming import segments

START = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "clip_id long, frame_no long, rms double, zcr double, at timestamp"
HEARTBEAT = (-1, 0, 0.0, 0.1, START + dt.timedelta(hours=2))


def recording(clip, n, seed):
    """Frames of loud and quiet stretches, with some hiss and hum."""
    rng = random.Random(seed)
    out, loud = [], False
    while len(out) < n:
        for _ in range(rng.randrange(1, 60)):
            out.append((clip, len(out), rng.uniform(0.03, 0.3) if loud else rng.uniform(0.0, 0.008),
                        rng.choice([0.1, 0.1, 0.1, 0.5, 0.01]), START + dt.timedelta(milliseconds=30 * len(out))))
        loud = not loud
    return out[:n]


def run(spark, root, pushes, **settings):
    for n, rows in enumerate(pushes):
        spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{root}/frames/{n}")
        segments.run_segments(spark.readStream.schema(SCHEMA).parquet(f"{root}/frames/*"), root, f"{root}/checkpoint",
                              **settings)
    return sorted(map(tuple, segments.read_segments(spark, root).collect()))


def batch(spark, rows, **settings):
    return sorted(map(tuple, fr.vad_segments(spark.createDataFrame(rows, SCHEMA), **settings).collect()))


@pytest.mark.parametrize("cut", [1, 137])
def test_stream_equals_batch(spark, tmp_path, cut):
    rows = recording(1, 300, 1) + recording(2, 280, 2) + recording(3, 150, 9)
    early = [r for r in rows if r[1] < cut]
    random.Random(4).shuffle(early)
    late = [r for r in rows if r[1] >= cut]
    # repeats of frames that were read before change nothing
    got = run(spark, str(tmp_path), [early, late + [r for r in early if r[1] == cut - 1] + [HEARTBEAT]], delay="1 minute")
    want = batch(spark, rows)
    assert got == want and len(want) >= 5


def test_an_open_utterance_ends_when_its_recording_pauses(spark, tmp_path):
    loud = [(1, k, 0.2, 0.1, START + dt.timedelta(milliseconds=30 * k)) for k in range(20)]
    assert run(spark, str(tmp_path / "a"), [loud]) == []
    assert run(spark, str(tmp_path / "b"), [loud, [HEARTBEAT]]) == batch(spark, loud)


def test_long_utterances_are_capped(spark, tmp_path):
    cfg = {"max_utterance_ms": 900}
    loud = [(1, k, 0.2, 0.1, START + dt.timedelta(milliseconds=30 * k)) for k in range(100)]
    got = run(spark, str(tmp_path), [loud[:33], loud[33:] + [HEARTBEAT]], cfg=cfg)
    assert got == batch(spark, loud, cfg=cfg)
    assert [r[-1] for r in got][:2] == [True, True]


def test_rule_is_the_same_on_values():
    """One frame on plain values, by hand: a first loud frame seeds the floor and starts a run."""
    state = fr.detect(fr.OnValues, fr.IDLE, {"rms": 0.2, "zcr": 0.1}, fr.RATE, fr.VAD, lambda s, *_: s)
    assert state == {"floor": 0.01, "speaking": False, "run": 1, "silence": 0, "pre": 480, "utter": 0, "at": 480}
