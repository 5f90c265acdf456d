"""PCM WAV: headers, samples and back. Rows of bytes through Arrow batches."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROBE = T.StructType([T.StructField("container", T.StringType()), T.StructField("duration_ms", T.LongType()), T.StructField("has_audio", T.BooleanType()), T.StructField("audio_codec", T.StringType()), T.StructField("sample_rate", T.IntegerType()), T.StructField("channels", T.IntegerType())])


def probe_bytes(content: bytes | None) -> tuple:
    """Container facts of a WAV file, or nulls where it cannot be read."""
    try:
        with wave.open(io.BytesIO(content or b"")) as w:
            return "wav", int(1000 * w.getnframes() / w.getframerate()), w.getnframes() > 0, f"pcm_s{8 * w.getsampwidth()}le", w.getframerate(), w.getnchannels()
    except (wave.Error, EOFError, ZeroDivisionError):
        return None, None, False, None, None, None


def decode_mono(content: bytes) -> np.ndarray:
    """Samples of 16-bit PCM in [-1, 1), channels averaged."""
    with wave.open(io.BytesIO(content)) as w:
        a = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").astype(np.float32) / 32768.0
        return a.reshape(-1, w.getnchannels()).mean(axis=1) if w.getnchannels() > 1 else a


def encode_mono(samples: np.ndarray, rate: int) -> bytes:
    """16-bit PCM of samples clamped to [-1, 1]."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.floor(np.clip(np.asarray(samples, dtype=np.float64), -1.0, 1.0) * 32767.0 + 0.5).astype("<i2").tobytes())
    return out.getvalue()


def probe(content: Column) -> Column:
    @F.pandas_udf(PROBE)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([probe_bytes(x) for x in s], columns=[f.name for f in PROBE])

    return run(content)


def decode(content: Column) -> Column:
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([decode_mono(x) if probe_bytes(x)[0] else None for x in s])

    return run(content)


def encode(samples: Column, rate: int) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else encode_mono(x, rate) for x in s])

    return run(samples)


def log_mel(samples: np.ndarray, rate: int = 16_000, n_fft: int = 400, hop: int = 160, n_mels: int = 80) -> np.ndarray:
    """Log-mel spectrogram, floored eight decades under its peak and scaled around 0 to 1."""
    pad = n_fft // 2
    x = np.pad(np.asarray(samples, dtype=np.float64), pad, mode="reflect") if len(samples) > pad else np.pad(np.asarray(samples, dtype=np.float64), pad)
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
    power = np.abs(np.fft.rfft(frames * np.hanning(n_fft + 1)[:-1], axis=1)) ** 2
    mel = mel_filterbank(rate, n_fft, n_mels) @ power.T
    logs = np.log10(np.maximum(mel, 1e-10))
    return (np.maximum(logs, logs.max(initial=-10.0) - 8.0) + 4.0) / 4.0


def hz_to_mel(hz: np.ndarray) -> np.ndarray:
    """Linear to 1000 Hz, then 27 steps of log(6.4)."""
    hz = np.asarray(hz, dtype=np.float64)
    return np.where(hz < 1000.0, hz * 3.0 / 200.0, 15.0 + np.log(np.maximum(hz, 1000.0) / 1000.0) * 27.0 / np.log(6.4))


def mel_to_hz(mel: np.ndarray) -> np.ndarray:
    mel = np.asarray(mel, dtype=np.float64)
    return np.where(mel < 15.0, mel * 200.0 / 3.0, 1000.0 * np.exp((np.maximum(mel, 15.0) - 15.0) * np.log(6.4) / 27.0))


def mel_filterbank(rate: int, n_fft: int, n_mels: int) -> np.ndarray:
    """Triangles of unit area over equal steps of the mel scale."""
    freqs = np.fft.rfftfreq(n_fft, 1.0 / rate)
    edges = mel_to_hz(np.linspace(0.0, hz_to_mel(rate / 2.0), n_mels + 2))
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    up, down = (freqs - low) / (mid - low), (high - freqs) / (high - mid)
    return np.maximum(0.0, np.minimum(up, down)) * (2.0 / (high - low))
