"""Media columns: text bytes kept as 8-bit PCM, with audio features in fixed-shape Arrow tensors.

Every row is one audio stream: WAV, mono, 8 bits a sample. The stored bytes are read back and the
features come from those: a 2/3 polyphase resampler, overlapped log-mel frames, and time spans
found by hysteresis on the frame energy. Log-mel frames are stored in clips of CLIP_FRAMES x BANDS,
an Arrow fixed-shape tensor column with the clip's time span, as an Arrow stream. Long streams are
worked off a group of clips at a time.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

UNIT = 192
RATE = 8000
UP, DOWN, REACH = 2, 3, 9
FRAME, HOP, BANDS, CLIP_FRAMES = 256, 128, 24, 64
#: Source samples under one hop, and clips worked on at once.
HOP_SOURCE, GROUP = HOP * DOWN // UP, 64
SCALE = 64
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
MEDIA = "doc_id long, n_bytes long, media binary, tensors binary, spans array<struct<start_ms: long, end_ms: long>>"
SPANS = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))


def resampler() -> np.ndarray:
    """(taps, UP): column r gives output r of each block of DOWN source samples."""
    at = np.arange(-REACH, REACH + DOWN)[:, None] - np.arange(UP) * (DOWN / UP)
    taper = np.where(np.abs(at) < REACH, 0.5 + 0.5 * np.cos(np.pi * at / REACH), 0)
    return (UP / DOWN * np.sinc(at * UP / DOWN) * taper).astype(np.float32)


def mel_bank(rate: float) -> np.ndarray:
    """(FRAME / 2 + 1, BANDS) triangles, evenly spaced on the mel scale."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, to_mel(rate / 2), BANDS + 2) / 2595) - 1)
    bins = np.linspace(0, rate / 2, FRAME // 2 + 1)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.clip(np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid)), 0, None).astype(np.float32)


TAPS, BANK, TAPER = resampler(), mel_bank(RATE * UP / DOWN), np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def log_mel(samples: np.ndarray, first: int, last: int) -> np.ndarray:
    """Frames first..last-1 as whole numbers, SCALE to a neper; samples outside the stream are silence."""
    blocks = (last - first) * HOP // UP + HOP // UP
    lo, hi = first * HOP_SOURCE - REACH, (first * HOP // UP + blocks) * DOWN + REACH
    x = np.zeros(hi - lo, np.float32)
    part = samples[max(lo, 0) : hi]
    x[max(lo, 0) - lo : max(lo, 0) - lo + len(part)] = (part.astype(np.float32) - 128) / 128
    y = (np.ascontiguousarray(sliding_window_view(x, len(TAPS))[::DOWN]) @ TAPS).reshape(-1)
    spectrum = np.fft.rfft(sliding_window_view(y, FRAME)[::HOP] * TAPER)
    power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
    return np.rint(np.log(power @ BANK + 1e-6) * SCALE).astype(np.int16)


def segments(energy: np.ndarray) -> np.ndarray:
    """Frame ranges: on above the mean plus half a deviation, off below the mean minus half of one."""
    mean, dev = energy.mean(), energy.std()
    mark = np.where(energy > mean + dev / 2, 1, np.where(energy < mean - dev / 2, -1, 0))
    seen = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.concatenate([[False], (seen >= 0) & (mark[np.maximum(seen, 0)] > 0), [False]])
    return np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)


def to_tensors(samples: np.ndarray) -> bytes:
    """Arrow stream of (frames: tensor CLIP_FRAMES x BANDS, n_frames, start_ms, end_ms), one row a clip."""
    n_frames = len(samples) // HOP_SOURCE
    kind = pa.fixed_shape_tensor(pa.int16(), (CLIP_FRAMES, BANDS))
    schema = pa.schema([("frames", kind), ("n_frames", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64())])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, schema) as out:
        for first in range(0, n_frames, GROUP * CLIP_FRAMES):
            found = log_mel(samples, first, last := min(n_frames, first + GROUP * CLIP_FRAMES))
            starts = np.arange(first, last, CLIP_FRAMES)
            ends = np.minimum(starts + CLIP_FRAMES, last)
            full = np.zeros((len(starts) * CLIP_FRAMES, BANDS), np.int16)
            full[: len(found)] = found
            clips = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), CLIP_FRAMES * BANDS))
            ms = lambda frames: pa.array(frames * HOP_SOURCE * 1000 // RATE)
            out.write_batch(pa.record_batch([clips, pa.array((ends - starts).astype(np.int32)), ms(starts), ms(ends)], schema=schema))
    return sink.getvalue()


def from_tensors(tensors: bytes) -> Iterator[np.ndarray]:
    for batch in pa.ipc.open_stream(tensors):
        frames = batch.column("frames").to_numpy_ndarray().reshape(-1, BANDS)
        lengths = batch.column("n_frames").to_numpy()
        yield frames[(np.arange(CLIP_FRAMES) < lengths[:, None]).reshape(-1)]


def spans_of(tensors: bytes) -> list[dict]:
    """Time spans of the frames' energy."""
    energy = np.concatenate([frames.sum(1, dtype=np.int64) for frames in from_tensors(tensors)])
    return [{"start_ms": a, "end_ms": b} for a, b in (segments(energy) * HOP_SOURCE * 1000 // RATE).tolist()]


def feature_of(tensors: bytes, spans: list[dict]) -> str:
    """Mean of each band, number and length of the spans, check sum of the frames."""
    sums, n, check = np.zeros(BANDS, np.int64), 0, 0
    for frames in from_tensors(tensors):
        sums += frames.sum(0, dtype=np.int64)
        n += len(frames)
        check = zlib.crc32(frames.tobytes(), check)
    means = ",".join(str(x) for x in (sums // n).tolist())
    return f"{means};{len(spans)};{sum(x['end_ms'] - x['start_ms'] for x in spans)};{check:08x}"


def encode_row(text: str | None) -> tuple:
    """n_bytes, media, tensors, spans: what is stored of a text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    media = to_wav(data + b" " * (-len(data) % UNIT or (0 if data else UNIT)))
    tensors = to_tensors(np.frombuffer(from_wav(media), np.uint8))
    return len(data), media, tensors, spans_of(tensors)


def digest_row(media: bytes, tensors: bytes, spans: list[dict]) -> tuple:
    """The digests of what was stored, from the stored bytes alone."""
    payload = from_wav(media)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(tensors, spans)


def _mapped(rows: DataFrame, columns: list[str], schema: str, kinds: list[pa.DataType], row: Callable[..., tuple], rows_at_once: int) -> DataFrame:
    """rows (doc_id, *columns, the rest of schema's first ones kept) -> schema, `row` of the columns behind what is kept."""
    names = [x.split()[0] for x in schema.split(", ")][: len(kinds)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                kept = part.num_columns - len(columns)
                found = zip(*(row(*(x.as_py() for x in given)) for given in zip(*part.columns[kept:])))
                made = [pa.array(x, kind) for x, kind in zip(found, kinds[kept:])]
                yield pa.record_batch([*part.columns[:kept], *made], names=names)

    return rows.mapInArrow(work, schema)


def media_columns(docs: DataFrame, *, rows_at_once: int = 64) -> DataFrame:
    """doc_id, n_bytes, media, tensors and spans for each row of docs (doc_id, text).

    A null text counts as empty, and an empty text is one unit of spaces. Equal texts have equal
    values; repeated rows have a row each, in no set order. A very long text is one media file; its
    frames are worked out a group of clips at a time. Other columns of docs are not read; no row is
    dropped; an empty table gives an empty result.
    """
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), SPANS]
    return _mapped(docs.select("doc_id", "text"), ["text"], MEDIA, kinds, encode_row, rows_at_once)


def describe_media(stored: DataFrame, *, rows_at_once: int = 64) -> DataFrame:
    """The digests of rows that media_columns() made, once they are stored: read back, nothing else is known of them."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return _mapped(stored.select("doc_id", "n_bytes", "media", "tensors", "spans"), ["media", "tensors", "spans"], DIGEST, kinds, digest_row, rows_at_once)
