"""Media columns: WAV bytes in a binary column, and fingerprints of what they sound like.

``write_media`` stores payloads as 8-bit mono WAV files in a Parquet table, one row a
file. ``fingerprints`` reads such a column with the wave module (other widths and several
channels too), takes short-time Fourier transforms of the samples, and pairs spectral
peaks: each code of its time-coded array says when a pair begins, its two frequencies and
how far apart they are. Everything happens where a row is read: no shuffle, and beside the
row itself a task holds one block of frames.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, ship, table, utf8

RATE = 8000
UNIT = 64
FRAME, HOP = 256, 128
#: Frames that are transformed at a time.
BLOCK = 4096
#: First bins of the bands that each give a frame's strongest bin; the last is the end.
BANDS = (1, 3, 5, 9, 17, 33, 65, 129)
#: A peak is not exceeded by its band this many frames before and after.
AROUND = 3
#: Pairs that a peak opens, and the frames that they span at most.
FAN, SPAN = 5, 63
MEDIA = "id long, n_bytes long, media binary"
SOUND = (
    "rate int, channels int, sample_bytes int, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "frames long, peaks long, codes array<long>, error string"
)
_HELD = 8 << 20


def padded(payload: bytes, unit: int = UNIT) -> bytes:
    """``payload`` with zero bytes up to a positive multiple of ``unit``."""
    return payload + bytes(max(unit, -(-len(payload) // unit) * unit) - len(payload))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[bytes, int, int, int]:
    """(sample bytes as stored, rate, channels, bytes of a sample)."""
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes()), w.getframerate(), w.getnchannels(), w.getsampwidth()


def _mono(raw: bytes, channels: int, width: int) -> np.ndarray:
    """Samples around 0, in steps of the format; the sum of the channels."""
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.int32) - 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.int64)
    return x if channels == 1 else x.reshape(-1, channels).sum(axis=1)


def spectra(samples: np.ndarray) -> Iterator[np.ndarray]:
    """Blocks of short-time spectra in hundredths of a decibel, a row per frame. The last
    frame is filled with silence; a sound shorter than a frame has one, none has none."""
    window = np.hanning(FRAME + 1)[:-1]
    n = 0 if not len(samples) else 1 + max(0, -(-(len(samples) - FRAME) // HOP))
    for at in range(0, n, BLOCK):
        count = min(BLOCK, n - at)
        x = samples[at * HOP : (at + count - 1) * HOP + FRAME].astype(np.float64)
        x = np.pad(x, (0, (count - 1) * HOP + FRAME - len(x)))
        z = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * window, axis=1)
        # whole hundredths: the last bits of a transform decide nothing
        yield np.rint(1000 * np.log10(z.real**2 + z.imag**2 + 1)).astype(np.int32)


def peaks(samples: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(frames, frame of each peak, bin of each peak), in order of both. Of equal bins in a
    band the lowest counts, of equal frames in a row the first; silence has no peak."""
    level, at = [], []
    for s in spectra(samples):
        bands = [s[:, a:b] for a, b in zip(BANDS, BANDS[1:], strict=False)]
        level.append(np.stack([b.max(axis=1) for b in bands], axis=1))
        at.append(np.stack([b.argmax(axis=1) + a for a, b in zip(BANDS, bands, strict=False)], axis=1).astype(np.uint8))
    if not level:
        return 0, np.empty(0, np.int64), np.empty(0, np.int64)
    v, bins = np.concatenate(level), np.concatenate(at)
    top = v > 0
    for k in range(1, min(AROUND, len(v) - 1) + 1):
        top[k:] &= v[k:] > v[:-k]
        top[:-k] &= v[:-k] >= v[k:]
    frame, band = np.nonzero(top)
    return len(v), frame, bins[frame, band].astype(np.int64)


def pair_codes(frame: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """A code for each pair of a peak with one of the ``FAN`` next ones within ``SPAN``
    frames, by time: frame * 2^22 + bin * 2^14 + other bin * 2^6 + frames between."""
    out = []
    for k in range(1, min(FAN, len(frame) - 1) + 1):
        apart = frame[k:] - frame[:-k]
        near = apart <= SPAN
        out.append((frame[:-k] << 22 | bins[:-k] << 14 | bins[k:] << 6 | apart)[near])
    return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _batches(rows: Iterator[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows that come with their size, of some 8 MB or one row."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if size >= _HELD:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def media_column(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, media: the UTF-8 bytes of each row's text, padded, as a WAV file. A null
    text is an empty one. Rows with equal or null ids stay rows of their own; other columns,
    whatever their names, are left out; no rows give no rows."""
    ship(docs.sparkSession)
    schema = _schema(MEDIA)

    def rows(batches):
        def each():
            for b in batches:
                for i, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    payload = payload.as_py()
                    wav = to_wav(padded(payload))
                    yield (i, len(payload), wav), len(wav) + 64

        yield from _batches(each(), schema)

    return docs.select(F.col(f"`{id}`").cast("long").alias("id"), utf8(F.col(f"`{text}`")).alias("payload")).mapInArrow(rows, MEDIA)


def write_media(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> None:
    """The rows of :func:`media_column` as a Parquet table under ``path``."""
    media_column(docs, id, text).write.option("compression", "zstd").parquet(path)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEDIA).parquet(path)


def _sound(media: bytes | None) -> tuple:
    if media is None:
        return (None,) * 10
    try:
        raw, rate, channels, width = from_wav(media)
        x = _mono(raw[: len(raw) // (channels * width) * channels * width], channels, width)
    except (wave.Error, EOFError, ValueError) as e:
        return (*(None,) * 9, f"{type(e).__name__}: {e}")
    frames, frame, bins = peaks(x)
    return rate, channels, width, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-UNIT:]), frames, len(frame), pair_codes(frame, bins), None


def fingerprints(media: DataFrame) -> DataFrame:
    """``id``, ``n_bytes``, media_bytes, media_sha256 and :data:`SOUND` of rows of
    :func:`read_media`. payload_sha256 and tail_crc32 are of the sample bytes read back,
    codes is the time-coded array of :func:`pair_codes`. Null media give nulls; media
    that the wave module cannot read give nulls and say why in ``error``."""
    ship(media.sparkSession)
    ddl = f"id long, n_bytes long, media_bytes long, media_sha256 string, {SOUND}"
    schema = _schema(ddl)

    def rows(batches):
        def each():
            for b in batches:
                for i, n, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    m = m.as_py()
                    known = (None, None) if m is None else (len(m), hashlib.sha256(m).hexdigest())
                    row = (i, n, *known, *_sound(m))
                    yield row, 256 + 8 * (0 if row[-2] is None else len(row[-2]))

        yield from _batches(each(), schema)

    return media.select("id", "n_bytes", "media").mapInArrow(rows, ddl)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a WAV file that is stored, read back and fingerprinted.
    ``feature`` is frames, peaks, pairs and a hash of the time-coded array."""
    path = f"{scratch(spark)}/media-{uuid.uuid4().hex[:8]}"
    write_media(table(spark, sf_dir, "documents", "doc_id", "text"), path)
    d = fingerprints(read_media(spark, path))
    feature = F.concat_ws(":", F.col("frames"), F.col("peaks"), F.size("codes"), F.lower(F.hex(F.xxhash64("codes"))))
    return d.select(
        F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature")
    )
