"""Audio sample arrays and frame series: levels, conditioning, segmentation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 16000
FRAME_MS = 30
# Detector settings.
VAD = {
    "pre_roll_ms": 300, "start_frames": 3, "end_silence_ms": 700, "hangover_ms": 120,
    "max_utterance_ms": 30000, "min_rms": 0.010, "ratio": 2.5, "max_zcr": 0.35, "min_zcr": 0.02,
    "rise_idle": 0.004, "rise_speech": 0.0005,
}


def rms(samples: Column) -> Column:
    """Root mean square of a sample array; 0 for an empty one."""
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) == 0, F.lit(0.0)).otherwise(F.sqrt(total / F.size(samples)))


def zero_crossing_rate(samples: Column) -> Column:
    """Sign changes over neighbours; 0 below two samples."""
    signs = F.array_join(F.transform(samples, lambda x: F.when(x >= 0, "1").otherwise("0")), "")
    # every change is a border between a run of ones and a run of zeros
    runs = F.length(F.regexp_replace(F.regexp_replace(signs, "1+", "1"), "0+", "0"))
    return F.when(F.size(samples) < 2, F.lit(0.0)).otherwise((runs - 1) / (F.size(samples) - 1))


def mono(samples: Column, channels: Column) -> Column:
    """Mean over interleaved channels."""
    frames = F.floor(F.size(samples) / channels).cast("int")
    mixed = F.transform(F.sequence(F.lit(0), F.greatest(frames - 1, F.lit(0))), lambda i: (
        F.aggregate(F.slice(samples, i * channels + 1, channels), F.lit(0.0).cast("float"),
                    lambda a, x: (a + x).cast("float")) / channels).cast("float"))
    return F.when(channels <= 1, samples).when(
        frames == 0, F.array().cast("array<float>")).otherwise(mixed)


def resample(samples: Column, from_rate: Column, to_rate: Column) -> Column:
    """Linear interpolation at multiples of the rate ratio; the last sample holds."""
    ratio = from_rate / to_rate
    n = F.floor(F.size(samples) / ratio).cast("int")

    def at(i: Column) -> Column:
        pos = i * ratio
        j = F.floor(pos).cast("int")
        frac = (pos - j).cast("float")
        a, b = F.get(samples, j), F.get(samples, j + 1)
        return F.when(b.isNull(), a).otherwise((a * (1 - frac) + b * frac).cast("float"))

    same = (from_rate <= 0) | (to_rate <= 0) | (from_rate == to_rate) | (F.size(samples) == 0)
    return F.when(same, samples).when(n == 0, F.array().cast("array<float>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at))


def _factor(rate: int, hz: float) -> Column:
    """What the first-order high-pass keeps from one sample to the next."""
    rc = 1 / (2 * math.pi * hz)
    return F.lit(rc / (rc + 1 / rate)).cast("float").cast("double")


def _block_size(rate: int, hz: float) -> tuple[int, int]:
    """Samples of a block, whole frames of at least a second, and how many blocks a sample is heard in.

    After ``forgotten`` samples the filter's memory is below the precision of a double; a block is
    long enough that this takes eight of them at most.
    """
    frame = rate * FRAME_MS // 1000
    forgotten = math.log(1e18) / math.log1p(2 * math.pi * hz / rate)
    frames = math.ceil(max(rate, forgotten / 8) / frame)
    return frames * frame, math.ceil(forgotten / (frames * frame))


def high_pass_blocks(clips: DataFrame, rate: int, hz: float) -> DataFrame:
    """Blocks ``(clip_id, block, x, y, samples)`` of clips, each with the filter's state before it.

    The high-pass over a block is an affine step of the state, ``y -> f^n y + b``: blocks are
    filtered from rest, all at once, for their ``b``, and the steps compose by handing every
    ``b`` on to the blocks in which it is still heard, by a power of ``f^n``. So a long clip is
    filtered in as many tasks as it has blocks. ``x`` is the sample before the block (the first
    of the clip for the first). Clip ids are unique and not null.
    """
    n, heard = _block_size(rate, hz)
    factor = _factor(rate, hz)
    count = F.ceil(F.size("pcm") / n).cast("int")
    cut = F.when(F.size("pcm") > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.struct(
        F.get("pcm", F.greatest(i * n - 1, F.lit(0))).cast("double").alias("x"),
        F.slice("pcm", i * n + 1, n).alias("samples"))))
    blocks = clips.select("clip_id", F.posexplode(cut).alias("block", "b")).select(
        "clip_id", "block", "b.x", "b.samples").repartition("clip_id", "block")
    rest = F.struct(F.col("x").alias("x"), F.lit(0.0).alias("y"))
    end = F.aggregate("samples", rest, lambda s, x: F.struct(
        x.cast("double").alias("x"), (factor * (s["y"] + x - s["x"])).alias("y")), lambda s: s["y"])
    passed = blocks.select("clip_id", "block", end.alias("b")).select(
        "clip_id", "b", "block", F.explode(F.sequence(F.lit(1), F.lit(heard))).alias("hop"))
    states = passed.groupBy("clip_id", (F.col("block") + F.col("hop")).alias("block")).agg(
        F.sum(F.col("b") * F.pow(factor, F.lit(n) * (F.col("hop") - 1))).alias("y"))
    return blocks.join(states, ["clip_id", "block"], "left").select(
        "clip_id", "block", "x", F.coalesce("y", F.lit(0.0)).alias("y"), "samples")


def _high_pass_features(clips: DataFrame, rate: int, hz: float) -> DataFrame:
    size, (n, _), factor = rate * FRAME_MS // 1000, _block_size(rate, hz), _factor(rate, hz)
    frame = "struct<rms:double,zcr:double>"
    start = F.struct(
        "x", "y", F.lit(0).alias("n"), F.lit(0.0).alias("energy"), F.lit(0).alias("crossings"),
        F.array().cast(f"array<{frame}>").alias("frames"))

    def step(s: Column, x: Column) -> Column:
        def state(v: Column) -> Column:
            energy = s["energy"] + v["y"] * v["y"]
            # a decay below the smallest float is silence
            crossed = s["crossings"] + F.when((s["n"] > 0) & (
                (s["y"].cast("float") >= 0) != (v["y"].cast("float") >= 0)), 1).otherwise(0)
            full = s["n"] + 1 == size
            done = F.array(F.struct(F.sqrt(energy / size).alias("rms"),
                                    (crossed / (size - 1)).alias("zcr")))
            return F.struct(
                x.cast("double").alias("x"), v["y"].alias("y"),
                F.when(full, 0).otherwise(s["n"] + 1).alias("n"),
                F.when(full, 0.0).otherwise(energy).alias("energy"),
                F.when(full, 0).otherwise(crossed).alias("crossings"),
                F.when(full, F.concat(s["frames"], done)).otherwise(s["frames"]).alias("frames"))

        y = factor * (s["y"] + x - s["x"])
        return F.get(F.transform(F.array(F.struct(y.alias("y"))), state), F.lit(0))

    frames = F.aggregate("samples", start, step, lambda s: s["frames"])
    return high_pass_blocks(clips, rate, hz).select("clip_id", "block", F.posexplode(frames).alias("pos", "f")).select(
        "clip_id", (F.col("block") * (n // size) + F.col("pos")).alias("frame_no"), "f.rms", "f.zcr")


def frame_features(clips: DataFrame, rate: int = RATE, high_pass_hz: float = 0.0) -> DataFrame:
    """Frame series ``(clip_id, frame_no, rms, zcr)`` of mono clips.

    With a cut-off the first-order high-pass runs over blocks of samples in parallel
    (``high_pass_blocks``), in doubles, and emits one level and one rate per frame, never samples.
    """
    size = rate * FRAME_MS // 1000
    if high_pass_hz > 0:
        return _high_pass_features(clips, rate, high_pass_hz)
    count = F.floor(F.size("pcm") / size).cast("int")
    cut = F.when(count > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))),
        lambda i: F.slice(F.col("pcm"), i * size + 1, size))).otherwise(
        F.array().cast("array<array<float>>"))
    return clips.select("clip_id", F.posexplode(cut).alias("frame_no", "s")).select(
        "clip_id", "frame_no", rms(F.col("s")).alias("rms"),
        zero_crossing_rate(F.col("s")).alias("zcr"))


class OnColumns:
    """What the detector's rule needs, on columns: a fold over the frames of a clip."""

    missing = staticmethod(lambda a: a.isNull())
    no = staticmethod(lambda a: ~a)
    first = staticmethod(lambda a, b: F.coalesce(a, b))
    when = staticmethod(lambda c, a, b: F.when(c, a).otherwise(b))
    least = staticmethod(lambda a, b: F.least(a, F.lit(b)))
    greatest = staticmethod(lambda a, b: F.greatest(a, F.lit(b)))
    # a value used more than once is computed once
    let = staticmethod(lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0)))


class OnValues:
    """The same on plain values: one frame after the other of a stream."""

    missing = staticmethod(lambda a: a is None)
    no = staticmethod(lambda a: not a)
    first = staticmethod(lambda a, b: b if a is None else a)
    when = staticmethod(lambda c, a, b: a if c else b)
    least, greatest = min, max
    let = staticmethod(lambda value, use: use(value))


def trimmed(op, utter, silence, size: int, keep: int):
    """Length of an utterance without its trailing silence beyond the hangover."""
    quiet = silence * size
    cut = quiet - keep
    return op.when((quiet <= keep) | (cut >= utter), utter, utter - cut)


def detect(op, s, x, rate: int, cfg: dict, done):
    """The activity detector's rule for one frame ``{rms, zcr}``, on columns or on values.

    State: adaptive floor, speech and silence runs, buffered pre-roll length,
    utterance length and end of the frames so far. Lengths are in samples.
    ``done`` takes the changed state and, with ``closes``, the finished segment.
    """
    size = rate * FRAME_MS // 1000
    pre_max = rate * cfg["pre_roll_ms"] // 1000
    longest = rate * cfg["max_utterance_ms"] // 1000
    keep = rate * cfg["hangover_ms"] // 1000
    level, zcr, speaking = x["rms"], x["zcr"], s["speaking"]
    rise = op.when(speaking, cfg["rise_speech"], cfg["rise_idle"])
    known = op.first(s["floor"], level)
    floor = op.when(op.missing(s["floor"]), op.least(level, cfg["min_rms"]), op.when(
        level < known, level, known + (level - known) * rise))

    def rest(floor):
        loud = level >= op.greatest(floor * cfg["ratio"], cfg["min_rms"])
        return op.let(loud & (zcr <= cfg["max_zcr"]) & (zcr >= cfg["min_zcr"]), lambda speech: move(floor, speech))

    def move(floor, speech):
        end = s["at"] + size
        # idle: buffer the pre-roll, count speech frames
        pre = op.least(s["pre"] + size, pre_max)
        run = op.when(speech, s["run"] + 1, 0)
        starts = op.no(speaking) & (run >= cfg["start_frames"])
        # speaking: grow, count silence, close on silence or length
        utter = s["utter"] + size
        silence = op.when(speech, 0, s["silence"] + 1)
        quiet = speaking & (silence * FRAME_MS >= cfg["end_silence_ms"])
        capped = speaking & op.no(quiet) & (utter >= longest)
        closes = quiet | capped
        start = end - utter
        return done({
            "floor": floor, "speaking": (speaking & op.no(closes)) | starts,
            "run": op.when(speaking, op.when(closes, 0, s["run"]), run),
            "silence": op.when(closes | starts, 0, op.when(speaking, silence, s["silence"])),
            "pre": op.when(speaking | starts, 0, pre),
            "utter": op.when(starts, pre, op.when(speaking & op.no(closes), utter, 0)),
            "at": end,
        }, closes, (start, start + trimmed(op, utter, silence, size, keep), capped))

    return op.let(floor, rest)


#: state of the detector ahead of the first frame, and the types it keeps
IDLE = {"floor": None, "speaking": False, "run": 0, "silence": 0, "pre": 0, "utter": 0, "at": 0}
STATE = {"floor": "double", "speaking": "boolean", "run": "int", "silence": "int", "pre": "long", "utter": "long",
         "at": "long"}


def segment_step(rate: int, cfg: dict):
    """State change of ``detect`` as a fold that also collects the finished segments."""
    def step(s: Column, x: Column) -> Column:
        def done(state: dict, closes: Column, segment: tuple) -> Column:
            start, end, capped = segment
            found = F.array(F.struct(start.cast("long").alias("start_sample"), end.cast("long").alias("end_sample"),
                                     capped.alias("truncated")))
            return F.struct(
                *[state[n].cast(t).alias(n) for n, t in STATE.items()],
                F.when(closes, F.concat(s["segments"], found)).otherwise(s["segments"]).alias("segments"))

        return detect(OnColumns, s, x, rate, cfg, done)

    return step


SEGMENT = "struct<start_sample:bigint,end_sample:bigint,truncated:boolean>"


def frame_tails(clips: DataFrame, rate: int = RATE) -> DataFrame:
    """Samples behind the last whole frame of each clip, ``(clip_id, tail_samples)``."""
    return clips.select("clip_id", (F.size("pcm") % (rate * FRAME_MS // 1000)).alias("tail_samples"))


def vad_segments(frames: DataFrame, rate: int = RATE, cfg: dict | None = None,
                 flush: bool = True, tails: DataFrame | None = None) -> DataFrame:
    """Speech segments ``(clip_id, utt_no, start_sample, end_sample, truncated)``.

    One fold per clip over its ordered frames; a clip is a bounded recording.
    The samples of ``tails`` end an utterance that is open at the end.
    """
    cfg = {**VAD, **(cfg or {})}
    size = rate * FRAME_MS // 1000
    keep = rate * cfg["hangover_ms"] // 1000
    start = F.struct(*[F.lit(IDLE[n]).cast(t).alias(n) for n, t in STATE.items()],
                     F.array().cast(f"array<{SEGMENT}>").alias("segments"))

    def finish(s: Column) -> Column:
        open_end = F.array(F.struct(
            (s["at"] - s["utter"]).alias("start_sample"),
            (s["at"] - s["utter"] + trimmed(OnColumns, s["utter"] + F.col("tail_samples"), s["silence"], size, keep)).cast(
                "long").alias("end_sample"),
            F.lit(False).alias("truncated")))
        return F.when(F.lit(flush) & s["speaking"] & (s["utter"] > 0),
                      F.concat(s["segments"], open_end)).otherwise(s["segments"])

    ordered = frames.groupBy("clip_id").agg(F.array_sort(F.collect_list(
        F.struct("frame_no", "rms", "zcr"))).alias("f"))
    if tails is None:
        ordered = ordered.withColumn("tail_samples", F.lit(0))
    else:
        ordered = ordered.join(tails, "clip_id", "left").fillna(0, ["tail_samples"])
    found = F.aggregate("f", start, segment_step(rate, cfg), finish)
    return ordered.select("clip_id", F.posexplode(found).alias("utt_no", "s")).select(
        "clip_id", "utt_no", "s.*")


def trimmed_length(segments: DataFrame) -> DataFrame:
    """Samples of speech per clip; clips without speech are absent."""
    return segments.groupBy("clip_id").agg(
        F.sum(F.col("end_sample") - F.col("start_sample")).alias("speech_samples"))


def push_to_talk_cap(samples: Column, rate: int = RATE) -> Column:
    """Length kept of a held capture and whether it hit the 30 s cap."""
    limit = rate * 30
    return F.struct(F.least(samples, F.lit(limit)).alias("kept"),
                    (samples > limit).alias("truncated"))
