"""Media columns: texts kept as 8-bit WAV payloads, read back and fingerprinted by spectral-peak pairs.

Every row is handled alone inside ``mapInArrow``: no shuffle, memory bound by one text. The stored form is a
mono 8-bit PCM WAV made and read by the standard ``wave`` module. Fingerprints pair each spectral peak with the
loudest peak of the next frames; an entry codes (frame << 20 | low bin << 11 | high bin << 2 | distance), so the
array is sorted by time and two recordings align where (entry & 0xFFFFF) agree at a constant frame offset.

Cases: null and empty texts hold one block of bytes 255; silence has no peaks, hence an empty array; repeated rows
give equal values; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import texts_of

FRAME, HOP, RATE, FAN = 576, 288, 8000, 3
#: Borders of the frequency bands that give one peak each.
BANDS = (1, 8, 20, 45, 90, 160, 289)
SCHEMA = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
    "media_sha256 string, n_frames bigint, fingerprint array<bigint>, wav binary"
)
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload(text: bytes) -> bytes:
    """The text padded with bytes 255 to a positive multiple of 576."""
    return text + b"\xff" * (-len(text) % FRAME if text else FRAME)


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def fingerprint(samples: bytes) -> tuple[int, np.ndarray]:
    """Frames of the short-time Fourier transform, and the coded peak pairs. Half a frame of rest
    stands at both ends, so that one block has three frames; long texts go in pieces of 2048 frames."""
    rest = np.full(HOP, 128, np.uint8)
    x = np.concatenate([rest, np.frombuffer(samples, np.uint8), rest])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bins, loud = [], []
    for at in range(0, len(frames), 2048):
        block = frames[at : at + 2048].astype(np.float32) - np.float32(127.5)
        block -= block.mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(block * _WINDOW, axis=1)) ** 2
        bins.append(np.stack([power[:, a:b].argmax(axis=1) + a for a, b in zip(BANDS, BANDS[1:])], axis=1))
        loud.append(np.stack([power[:, a:b].max(axis=1) for a, b in zip(BANDS, BANDS[1:])], axis=1))
    bins, loud = np.concatenate(bins), np.concatenate(loud)
    strong = (loud > loud.mean(axis=1, keepdims=True)) & (loud > 1)
    top = loud.argmax(axis=1)
    best, is_best = bins[np.arange(len(bins)), top], strong[np.arange(len(bins)), top]
    codes = []
    for step in range(1, FAN + 1):
        t, band = np.nonzero(strong[:-step] & is_best[step:, None])
        codes.append((t.astype(np.int64) << 20) | (bins[t, band].astype(np.int64) << 11) | (best[t + step].astype(np.int64) << 2) | step)
    return len(frames), np.sort(np.concatenate(codes))


def _rows(keep_wav: bool):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            data, at = texts_of(batch.column(1))
            for a in range(0, batch.num_rows, 256):
                out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
                for i in range(a, min(a + 256, batch.num_rows)):
                    text = data[at[i] : at[i + 1]].tobytes()
                    stored = to_wav(payload(text))
                    back = from_wav(stored)
                    n_frames, codes = fingerprint(back)
                    for c, v in zip(out, (ids[i].as_py(), len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), n_frames, codes, stored if keep_wav else None)):
                        out[c].append(v)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return run


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_wav: bool = True) -> DataFrame:
    """One row per input row with the digests, the time-coded fingerprint and, if kept, the stored WAV."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_rows(keep_wav), SCHEMA)


def op5_media_fingerprints(docs: DataFrame) -> DataFrame:
    """Contract columns; ``feature`` is frames:pairs:md5 of the fingerprint array."""
    made = media_table(docs, keep_wav=False)
    code = F.md5(F.concat_ws(",", F.col("fingerprint").cast("array<string>")))
    return made.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat_ws(":", "n_frames", F.size("fingerprint"), code).alias("feature"), F.size("fingerprint").cast("bigint").alias("n_pairs"),
    )
