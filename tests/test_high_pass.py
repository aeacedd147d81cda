"""The high-pass over blocks of samples against one sequential filter."""

import math

import numpy as np
import pytest

from tallyline.operators import frames as fr


def _sequential(pcm, rate, hz):
    rc = 1 / (2 * math.pi * hz)
    factor, y, before, out = np.float32(rc / (rc + 1 / rate)), np.float32(0), np.float32(pcm[0]), []
    for x in np.array(pcm, np.float32):
        y = np.float32(factor * (y + x - before))
        before = x
        out.append(float(y))
    return out


def _features(y, size):
    for i in range(len(y) // size):
        part = y[i * size:(i + 1) * size]
        crossed = sum((a >= 0) != (b >= 0) for a, b in zip(part, part[1:]))
        yield math.sqrt(sum(v * v for v in part) / size), crossed / (size - 1)


@pytest.mark.parametrize("rate, hz", [(1000, 100.0), (1000, 0.5), (16000, 100.0)])
def test_blocks_equal_the_sequential_filter(spark, rate, hz):
    rng = np.random.default_rng(3)
    n, heard = fr._block_size(rate, hz)
    assert n % (rate * fr.FRAME_MS // 1000) == 0 and heard <= 8
    clips = {length: (0.4 + 0.3 * np.sin(np.arange(length) / 7) + 0.1 * rng.standard_normal(length)).astype(np.float32).tolist()
             for length in (1, n - 1, n, n + 1, 2 * n + n // 2 + 5)}
    rows = [*clips.items(), (-1, []), (-2, None)]
    df = spark.createDataFrame(rows, "clip_id long, pcm array<float>").repartition(2)
    got = {(r.clip_id, r.frame_no): (r.rms, r.zcr) for r in fr.frame_features(df, rate, hz).collect()}
    want = {(k, i): f for k, pcm in clips.items()
            for i, f in enumerate(_features(_sequential(pcm, rate, hz), rate * fr.FRAME_MS // 1000))}
    assert set(got) == set(want)
    assert all(abs(got[k][0] - want[k][0]) < 1e-5 for k in want)
    # a sample next to zero may fall on either side in floats
    assert sum(abs(got[k][1] - want[k][1]) > 1e-9 for k in want) <= len(want) // 100


def test_a_step_decays_to_silence(spark):
    df = spark.createDataFrame([(1, [0.0] + [1.0] * 2999)], "clip_id long, pcm array<float>")
    got = [r.rms for r in fr.frame_features(df, 1000, 100.0).orderBy("frame_no").collect()]
    assert len(got) == 100 and got[0] > 0.1 and got[-1] < 1e-9 and got == sorted(got, reverse=True)


def test_a_clip_is_dealt_by_blocks(spark):
    df = spark.range(1).selectExpr("id AS clip_id", "transform(sequence(1, 9000), i -> cast(i % 17 as float)) AS pcm")
    assert fr.high_pass_blocks(df, 1000, 100.0).count() == 9
    plan = fr.frame_features(df, 1000, 100.0)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(clip_id" in plan and "block" in plan
