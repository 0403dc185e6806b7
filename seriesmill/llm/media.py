"""Media columns: payloads as 8-bit WAV, short-time Fourier transforms and spectral-peak pair fingerprints.

A WAV is written and read by the standard wave module.  Each frame's mean is taken off before the window, so that the
constant doesn't leak into the low bins.  Peaks are bins stronger than both neighbours and than the frame's mean power;
the strongest ones of a frame are paired with those of each of the next frames, and each pair (bin, bin, distance)
is stored with the frame it begins at: two parallel arrays, times and codes, that can be matched by time offset.
"""

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

from .common import map_rows

#: Payloads are padded with spaces to a positive multiple of this.
BLOCK = 192
#: Samples of a frame, and from one frame to the next; the payload is always a whole number of steps.
FRAME, STEP = 192, 96
RATE = 8000
#: Peaks of a frame, at most.
PEAKS = 2
#: Frames after a peak's own whose peaks it is paired with.
REACH = 3
#: Frames transformed at a time.
FRAMES_AT_ONCE = 8192
#: Bytes of results sent back at a time.
SENT_AT_ONCE = 16 << 20

_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b" " * (-len(data) % BLOCK or (0 if data else BLOCK))


def write_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectrum_peaks(samples: bytes) -> np.ndarray:
    """The bins of each frame's strongest peaks, strongest first (the lower bin of equal ones); -1 where there are fewer."""
    wave_in = np.frombuffer(samples, np.uint8)
    frames = max(0, (len(wave_in) - FRAME) // STEP + 1)
    peaks = np.full((frames, PEAKS), -1, np.int32)
    view = np.lib.stride_tricks.sliding_window_view(wave_in, FRAME)[::STEP] if frames else None
    for at in range(0, frames, FRAMES_AT_ONCE):
        part = view[at : at + FRAMES_AT_ONCE].astype(np.float32)
        part -= part.mean(axis=1, keepdims=True)
        spectrum = np.fft.rfft(part * _WINDOW, axis=1)
        power = np.round(spectrum.real**2 + spectrum.imag**2)
        inner = power[:, 1:-1]
        inner = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner > power.mean(axis=1, keepdims=True)), inner, 0)
        rows = np.arange(len(inner))
        for k in range(PEAKS):
            best = inner.argmax(axis=1)
            peaks[at : at + FRAMES_AT_ONCE, k] = np.where(inner[rows, best] > 0, best + 1, -1)
            inner[rows, best] = 0
    return peaks


def pair_fingerprints(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (frame numbers) and codes of the peak pairs, in order of time and code: all peaks of a frame with all of each next one."""
    peaks = spectrum_peaks(samples)
    codes = np.full((len(peaks), REACH, PEAKS, PEAKS), -1, np.int32)
    for gap in range(1, REACH + 1):
        a, b = peaks[:-gap, :, None], peaks[gap:, None, :]
        codes[:-gap, gap - 1] = np.where((a >= 0) & (b >= 0), a << 16 | b << 8 | gap, -1)
    codes = codes.reshape(len(peaks), REACH * PEAKS * PEAKS)
    codes.sort(axis=1)
    there = codes >= 0
    return np.repeat(np.arange(len(peaks), dtype=np.int32), there.sum(axis=1)), codes[there]


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (WAV bytes), payload_bytes, payload_sha256, tail_crc32, times and codes.

    What follows media is computed from the samples read back out of it.  Null text counts as empty, whose
    payload is one block of spaces; equal texts give equal values, repeated rows repeated results, an empty
    table none.  No shuffle; a worker holds one batch and up to SENT_AT_ONCE bytes of results.
    """

    names = ("doc_id", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "times", "codes")

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {n: [] for n in names}
        held = 0
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py()
            media = write_wav(to_payload(text))
            samples = read_wav(media)
            times, codes = pair_fingerprints(samples)
            values = (key.as_py(), len((text or "").encode()), media, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), times, codes)
            for name, value in zip(names, values, strict=True):
                out[name].append(value)
            held += len(media) + times.nbytes * 2
            if held > SENT_AT_ONCE:
                yield out
                out, held = {n: [] for n in names}, 0
        yield out

    chosen = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_rows(chosen, rows, "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, times array<int>, codes array<int>")


def media_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """media_columns with the media reduced to size and digest, and a short text, feature, beside the fingerprint's arrays."""
    feature = F.concat_ws(":", F.size("codes").cast("string"), F.hex(F.xxhash64("times", "codes")))
    return media_columns(df, id_col, text_col).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), "times", "codes",
    )
