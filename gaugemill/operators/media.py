"""Audio columns: PCM16 WAV decoding, features, mixing, trimming and joining, in Arrow batches of numpy."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..sources.readers import exists
from ..sources.writers import not_yet_made
from .order import spread

NUMBERS = ("duration_sec", "rms", "onset_strength", "periodicity_score", "zero_crossing_rate")
FEATURES = T.StructType([*(T.StructField(n, T.DoubleType()) for n in NUMBERS), T.StructField("error", T.StringType())])


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1) and their rate; other sample widths than 16 bits are an error."""
    with wave.open(io.BytesIO(data)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit PCM is supported")
        raw = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
        return raw.mean(1) / 32768.0, w.getframerate()


def encode(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.round(samples * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def features(x: np.ndarray, rate: int) -> tuple[float, float, float, float, float]:
    """Duration, loudness, the sharpest rise of frame energy, the autocorrelation peak of it, and crossings a second."""
    if not len(x):
        return (0.0,) * 5
    # Frames of 32 ms every 10 ms, lags from 80 to 750 ms.
    seconds, size, hop = len(x) / rate, max(64, int(rate * 0.032)), max(32, int(rate * 0.010))
    starts = np.arange(0, max(1, len(x) - size + 1), hop)
    power = np.concatenate([[0.0], np.cumsum(x**2)])
    ends = np.minimum(starts + size, len(x))
    energy = np.sqrt(np.maximum(0, power[ends] - power[starts]) / (ends - starts))
    onset = float(max(0.0, np.diff(energy).max())) if len(energy) > 1 else 0.0
    least = max(1, int(0.08 / (hop / rate)))
    most = max(least + 1, int(0.75 / (hop / rate)))
    even, peak = energy - energy.mean(), 0.0
    total = float((even**2).sum())
    if total > 1e-9:
        peak = max([0.0, *(float(even[:-lag] @ even[lag:]) / total for lag in range(least, min(most, len(even) - 1) + 1))])
    signs = x >= 0
    return seconds, float(np.sqrt((x**2).mean())), onset, peak, float(np.sum(signs[1:] != signs[:-1])) / max(1.0, seconds)


@F.pandas_udf(FEATURES)
def audio_features(content: pd.Series) -> pd.DataFrame:
    rows = []
    for data in content:
        try:
            rows.append((*features(*decode(bytes(data))), None))
        except Exception as e:  # a bad file is a row with an error, not a failed job
            rows.append((0.0, 0.0, 0.0, 0.0, 0.0, type(e).__name__))
    return pd.DataFrame(rows, columns=FEATURES.names)


@F.pandas_udf(T.DoubleType())
def wav_seconds(content: pd.Series) -> pd.Series:
    """From the header alone."""
    def one(data) -> float:
        with wave.open(io.BytesIO(bytes(data))) as w:
            return w.getnframes() / w.getframerate()

    return content.map(one)


def mix(u: np.ndarray, v: np.ndarray, volume_u: float, volume_v: float) -> np.ndarray:
    out = np.zeros(max(len(u), len(v)))
    out[: len(u)] += volume_u * u
    out[: len(v)] += volume_v * v
    return out


def mixed(a: Column, b: Column, volume_a: float, volume_b: float, seconds: float | None = None) -> Column:
    """Both at once, as long as the longer, or cut off."""
    @F.pandas_udf("binary")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p, q):
            (u, rate), (v, _) = decode(bytes(p)), decode(bytes(q))
            out = mix(u, v, volume_a, volume_b)
            return encode(out if seconds is None else out[: int(seconds * rate)], rate)

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)])

    return run(a, b)


def joined(a: Column, b: Column, seconds: float | None = 1.2, gap: float = 0.25) -> Column:
    """One after the other with a pause, each cut to ``seconds``."""
    @F.pandas_udf("binary")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p, q):
            (u, rate), (v, _) = decode(bytes(p)), decode(bytes(q))
            n = None if seconds is None else int(seconds * rate)
            return encode(np.concatenate([u[:n], np.zeros(int(gap * rate)), v[:n]]), rate)

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)])

    return run(a, b)


def trimmed(a: Column, seconds: float) -> Column:
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        def one(p):
            u, rate = decode(bytes(p))
            return encode(u[: int(seconds * rate)], rate)

        return x.map(one)

    return run(a)


@F.pandas_udf(T.BinaryType())
def wav(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """Arrays of 16-bit samples as sounds."""
    return pd.Series([None if x is None else encode(np.asarray(x, "float64") / 32768, int(r)) for x, r in zip(samples, rate, strict=True)])


#: What a job may ask for: ``how`` is mix, join or trim; ``seconds`` cuts a mix or trim, or either part of a join.
JOB = ("path", "how", "first", "second", "volume_first", "volume_second", "seconds", "gap")


@F.pandas_udf(T.StructType([T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())]))
def _render(how: pd.Series, a: pd.Series, b: pd.Series, volume_a: pd.Series, volume_b: pd.Series, seconds: pd.Series, gap: pd.Series) -> pd.DataFrame:
    def one(kind, p, q, volume_p, volume_q, most, pause):
        if kind not in ("mix", "join", "trim"):
            raise ValueError("unknown kind")
        if p is None or (q is None and kind != "trim"):
            raise FileNotFoundError
        u, rate = decode(bytes(p))
        n = None if pd.isna(most) else int(most * rate)
        if kind == "trim":
            return encode(u[:n], rate)
        v, other = decode(bytes(q))
        if rate != other:
            raise ValueError("rates differ")
        return encode(mix(u, v, volume_p, volume_q)[:n] if kind == "mix" else np.concatenate([u[:n], np.zeros(int(pause * rate)), v[:n]]), rate)

    rows = []
    for job in zip(how, a, b, volume_a.fillna(1.0), volume_b.fillna(1.0), seconds, gap.fillna(0.0), strict=True):
        try:
            rows.append((one(*job), None))
        except Exception as e:  # a job that can't be done is a row with an error, not a failed run
            rows.append((None, type(e).__name__))
    return pd.DataFrame(rows, columns=["content", "error"])


def rendered(jobs: DataFrame, sounds: DataFrame) -> DataFrame:
    """(path, content, error) of every job (columns JOB), of ``sounds`` with path and content; jobs meet sounds by path.

    A missing sound, other samples than 16 bits, unlike rates and unknown kinds give an error and no content; volumes are 1
    and pauses nothing where null. Of repeated sounds the one that is smallest counts, of jobs for one path the first in order
    of its columns. A sound that many jobs ask for is one hot key of a join, whose other side adaptive execution splits.
    """
    cells = sounds.groupBy("path").agg(F.min("content").alias("content"))
    asked = jobs.groupBy("path").agg(F.min(F.struct(*JOB[1:])).alias("job")).select("path", "job.*")
    side = lambda name: cells.select(F.col("path").alias(name), F.col("content").alias(f"_{name}"))
    both = spread(asked, "path").join(side("first"), "first", "left").join(side("second"), "second", "left")
    made = both.select("path", _render("how", "_first", "_second", *(F.col(c).cast("double") for c in JOB[4:])).alias("made"))
    return made.select("path", "made.*")


def render(jobs: DataFrame, sounds: DataFrame, out: str) -> None:
    """Adds to the table ``out`` (path, content) what is asked for and not there yet; jobs with errors are tried again by the
    next run. A run that was broken off left nothing of its own."""
    wanted = jobs if not exists(jobs.sparkSession, out) else not_yet_made(jobs, jobs.sparkSession.read.parquet(out), "path")
    rendered(wanted, sounds).where("error is null").select("path", "content").write.mode("append").parquet(out)
