"""Operator 6: sound columns. WAV files, short-time Fourier transforms and spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._spark import batches_of

RATE, UNIT = 8_000, 64
FRAME, HOP = 256, 128
#: Frames transformed at a time.
BLOCK = 4_096
#: The spectrum's bands, of bins, each of which has at most one peak a frame.
BANDS = ((1, 8), (8, 24), (24, 56), (56, 129))
#: A peak is paired with so many that follow, at most so many frames later.
FAN_OUT, REACH = 3, 63
_WINDOW = np.hanning(FRAME).astype(np.float32)


def wav_of(data: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit WAV file whose samples are the bytes of ``data``."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(data)
    return out.getvalue()


def samples_of(wav: bytes) -> bytes:
    """The samples of an 8-bit WAV file."""
    with wave.open(io.BytesIO(wav), "rb") as f:
        if f.getsampwidth() != 1:
            raise ValueError("8-bit samples are expected")
        return f.readframes(f.getnframes())


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of ``unit``."""
    return data + bytes(-len(data) % unit if data else unit)


def frames_of(samples: bytes) -> np.ndarray:
    """Overlapping frames that hold all samples; silence fills the last one."""
    x = np.frombuffer(samples, dtype=np.uint8)
    short = FRAME - len(x) if len(x) < FRAME else -(len(x) - FRAME) % HOP
    if short:
        x = np.concatenate([x, np.full(short, 128, dtype=np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of the spectral peaks, in order: a band's loudest bin, no softer than the band in the frames beside it."""
    frames = frames_of(samples)
    level, place = [], []
    for at in range(0, len(frames), BLOCK):
        part = (frames[at : at + BLOCK].astype(np.float32) - 128) * _WINDOW
        power = np.abs(np.fft.rfft(part, axis=1)) ** 2
        top = [lo + power[:, lo:hi].argmax(axis=1) for lo, hi in BANDS]
        place.append(np.stack(top, axis=1))
        level.append(np.stack([power[np.arange(len(power)), t] for t in top], axis=1))
    level, place = np.concatenate(level), np.concatenate(place)
    edge = np.full((1, len(BANDS)), -1.0, dtype=level.dtype)
    peak = (level > 1.0) & (level >= np.concatenate([edge, level[:-1]])) & (level > np.concatenate([level[1:], edge]))
    at, band = np.nonzero(peak)
    return at, place[at, band]


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes): frame of a peak, and its bin, the bin of a later peak and the frames between, for each pair."""
    at, bins = peaks(samples)
    times, codes = [], []
    for k in range(1, FAN_OUT + 1):
        gap = at[k:] - at[:-k]
        near = gap <= REACH
        times.append(at[:-k][near])
        codes.append((bins[:-k][near] << 14) | (bins[k:][near] << 6) | gap[near])
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.argsort(times, kind="stable")
    return times[order].astype(np.int32), codes[order].astype(np.int32)


def stored_as_wav(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The id, n_bytes and media: a WAV file with the padded UTF-8 bytes of each whole text as samples. Null is taken as empty."""
    kind = df.schema[doc_id].dataType.simpleString()
    batches_of(1_000, df.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(v.as_py() or "").encode("utf-8", "surrogatepass") for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([wav_of(padded(x)) for x in raw], pa.binary())], ["id", "n_bytes", "media"])

    out = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(store, f"id {kind}, n_bytes long, media binary")
    return out.withColumnRenamed("id", doc_id)


def analysed(stored: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``stored``, with id, n_bytes and media, and what is read back from each file: payload_bytes, payload_sha256, tail_crc32, and
    the fingerprint as two arrays of equal length, fp_times (frames) and fp_codes.

    Equal files give equal rows; a file of silence has an empty fingerprint.
    """
    kind = stored.schema[doc_id].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for v in batch.column(2):
                payload = samples_of(v.as_py())
                times, codes = fingerprint(payload)
                for column, x in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), times, codes), strict=True):
                    column.append(x)
            types = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, t) for x, t in zip(out, types, strict=True))], ["id", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "fp_times", "fp_codes"])

    schema = f"id {kind}, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, fp_times array<int>, fp_codes array<int>"
    return stored.select(F.col(doc_id).alias("id"), "n_bytes", "media").mapInArrow(read, schema).withColumnRenamed("id", doc_id)


def media_columns(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Sound files of all texts with their fingerprints: analysed() after stored_as_wav().

    Repeated rows give repeated rows; a table without rows gives none; other columns are left out.
    """
    return analysed(stored_as_wav(df, text, doc_id), doc_id)
