"""Audio: WAV decoding, resampling, header-only durations, companding, augmentation."""

from __future__ import annotations

import io
import subprocess
import wave
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SR = 16_000


def resample(x: np.ndarray, sr: int, to: int = SR) -> np.ndarray:
    """Linear interpolation over both end points."""
    if sr == to or len(x) == 0:
        return x.astype(np.float32)
    n = max(1, round(len(x) * to / sr))
    return np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x).astype(np.float32)


def decode_wav(raw: bytes) -> tuple[np.ndarray, int]:
    """(mono samples in -1..1, rate) of PCM WAV; channels are averaged."""
    with wave.open(io.BytesIO(raw)) as w:
        width, ch, sr, data = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000).astype(np.float32) / 0x800000 - 1
    else:
        x = np.frombuffer(data, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    return x.reshape(-1, ch).mean(axis=1), sr


def decode(raw: bytes, fallback: list[str] | None = None) -> np.ndarray:
    """Mono samples at 16 kHz. Bytes that are no WAV go to the fallback command (raw float32 on its standard output), if one is given."""
    try:
        return resample(*decode_wav(raw))
    except (wave.Error, EOFError, ValueError):
        if not fallback:
            raise
    out = subprocess.run(fallback, input=raw, capture_output=True, check=True, timeout=600).stdout
    return np.frombuffer(out, np.float32)


def encode_wav(x: np.ndarray, sr: int = SR) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(sr)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def flac_seconds(head: bytes) -> float | None:
    """Duration in the STREAMINFO block of a FLAC header; None if it isn't one or the length is unknown."""
    if len(head) < 26 or head[:4] != b"fLaC" or head[4] & 0x7F != 0:
        return None
    bits = int.from_bytes(head[18:26], "big")
    rate, total = bits >> 44, bits & (1 << 36) - 1
    return total / rate if rate and total else None


def wav_seconds(head: bytes) -> float | None:
    try:
        with wave.open(io.BytesIO(head)) as w:
            return w.getnframes() / w.getframerate()
    except (wave.Error, EOFError):
        return None


def _header_seconds(head: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else flac_seconds(bytes(h)) or wav_seconds(bytes(h)) for h in head], dtype=float)


def header_seconds(head: Column) -> Column:
    """Duration from the first bytes of a file."""
    return F.pandas_udf(_header_seconds, "double")(head)


def audio_files(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """(path, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", "content")


def durations(files: DataFrame) -> DataFrame:
    return files.select("path", header_seconds(F.substring("content", 1, 4096)).alias("seconds"))


def _analysed(content: pd.Series, fallback: list[str] | None = None) -> pd.DataFrame:
    from ..operators.chunking import silence_mask, silence_runs

    rows = []
    for c in content:
        try:
            x = decode(bytes(c), fallback)
            rows.append((len(x) / SR, [{"start": a, "end": b} for a, b in silence_runs(*silence_mask(x))], None))
        except Exception as e:  # noqa: BLE001
            rows.append((None, None, type(e).__name__))
    return pd.DataFrame(rows, columns=["seconds", "silences", "error"])


def analysed(content: Column, fallback: list[str] | None = None) -> Column:
    """Duration and silences of audio bytes, WAV or what the fallback command reads; a file that can't be read gives its error, not a
    failed job."""

    def run(c: pd.Series) -> pd.DataFrame:
        return _analysed(c, fallback)

    return F.pandas_udf(run, "struct<seconds: double, silences: array<struct<start: double, end: double>>, error: string>")(content)


def mu_law(x: np.ndarray) -> np.ndarray:
    """8-bit companding there and back, 127 steps a side: silence stays silence."""
    y = np.sign(x) * np.log1p(255 * np.abs(np.clip(x, -1, 1))) / np.log(256)
    q = np.round(y * 127) / 127
    return (np.sign(q) * (np.power(256, np.abs(q)) - 1) / 255).astype(np.float32)


def with_noise(x: np.ndarray, rng: np.random.Generator, snr: tuple[float, float]) -> np.ndarray:
    power = float((x**2).mean()) + 1e-12
    return x + rng.normal(0, np.sqrt(power / 10 ** (rng.uniform(*snr) / 10)), len(x)).astype(np.float32)


def phone_augment(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Telephone line: band of 300 to 3400 Hz, 8 kHz, noise (7 in 10) and companding (1 in 2) inside it, back to 16 kHz, gain."""
    f = np.fft.rfft(x)
    hz = np.fft.rfftfreq(len(x), 1 / SR)
    y = resample(np.fft.irfft(f * ((hz >= 300) & (hz <= 3400)), len(x)), SR, SR // 2)
    if rng.random() < 0.7:
        y = with_noise(y, rng, (12, 30))
    if rng.random() < 0.5:
        y = mu_law(y)
    y = resample(y, SR // 2, SR) * rng.uniform(0.6, 1.2)
    return np.clip(y, -1, 1).astype(np.float32)


def light_augment(x: np.ndarray, rng: np.random.Generator, most: float = 30.0) -> np.ndarray:
    """In one of two draws a speed up to 5 % off, where the result stays within `most` seconds; in one of two weak noise; gain."""
    y = x
    if rng.random() < 0.5:
        speed = rng.choice([0.95, 0.975, 1.025, 1.05])
        if len(x) / speed <= most * SR:
            y = resample(x, int(SR * speed), SR)
    if rng.random() < 0.5:
        y = with_noise(y, rng, (18, 35))
    return np.clip(y * rng.uniform(0.7, 1.15), -1, 1).astype(np.float32)


def _over(f: Callable[[np.ndarray, np.random.Generator], np.ndarray]) -> Callable[[pd.Series, pd.Series], pd.Series]:
    """A function of samples and a generator as one over columns; the seed of a row makes its draw the same after a retry."""

    def run(x: pd.Series, seed: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(np.asarray(v, np.float32), np.random.default_rng(abs(int(k)))) for v, k in zip(x, seed, strict=True)])

    return run


def resampled(samples: Column, sr: Column) -> Column:
    """array<float> at any rate to 16 kHz."""

    def run(x: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else resample(np.asarray(v, np.float32), int(r)) for v, r in zip(x, rate, strict=True)])

    return F.pandas_udf(run, "array<float>")(samples, sr)


def companded(samples: Column) -> Column:
    return F.pandas_udf(_over(lambda x, _: mu_law(x)), "array<float>")(samples, F.lit(0))


def phone_augmented(samples: Column, seed: Column) -> Column:
    return F.pandas_udf(_over(phone_augment), "array<float>")(samples, seed)


def light_augmented(samples: Column, seed: Column) -> Column:
    return F.pandas_udf(_over(light_augment), "array<float>")(samples, seed)
