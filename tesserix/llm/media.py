"""Audio columns: bytes stored as 8-bit sound, and their features.

Sound is kept in WAV form (one channel, unsigned 8-bit samples). Features: polyphase resampling, log-mel energies of overlapping
frames, and spans of activity found with two thresholds (a span begins above the upper one and lasts until below the
lower one). Each span is cut into pieces of a fixed number of frames, kept as an Arrow column of fixed-shape tensors beside
their begin and end in seconds.

A null is an empty payload; payloads are padded to a whole number of blocks, one at least, so there always is sound.
Equal bytes give equal sound and features. Repeated rows and other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserix.llm.common import chunks, utf8

BLOCK, PAD = 576, b"\xff"
RATE = 8000
UP, DOWN, TAPS = 3, 4, 16  # 8,000 to 6,000 samples a second
FRAME, HOP, MELS = 256, 128, 24
TENSOR_FRAMES = 32


def padded(raw: bytes, block: int = BLOCK) -> bytes:
    return raw + PAD * (-len(raw) % block if raw else block)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


@cache
def _phases(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """One low-pass filter per phase, (up, taps), each of gain one."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    h = (np.sinc(t / max(up, down)) * np.hamming(n)).reshape(taps, up).T
    return h / h.sum(axis=1, keepdims=True)


def resampled(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """``up`` / ``down`` times the rate: output m is filtered by the phase of m * down, no zeros are stuffed in."""
    count = -(-len(x) * up // down)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(taps - 1), x, np.zeros(1)]), taps)
    out = np.empty(count)
    for r in range(up):
        m = np.arange(r, count, up) * down
        out[r::up] = windows[m // up] @ _phases(up, down, taps)[r * down % up][::-1]
    return out


@cache
def _mel_bank(rate: float = RATE * UP / DOWN, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangles of equal width on the mel scale, (frequencies, mels)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    rise = (f - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, mels) log energies and the log energy of each frame; a short end is filled up with silence."""
    need = FRAME + HOP * max(0, -(-(len(x) - FRAME) // HOP))
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(x, (0, need - len(x))), FRAME)[::HOP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    return np.log(power @ _mel_bank() + 1e-6), np.log(power.sum(axis=1) + 1e-6)


def active_spans(energy: np.ndarray) -> np.ndarray:
    """(spans, 2) first and behind-last frame: on above mean + half a deviation, off below mean - half a deviation."""
    half = 0.5 * energy.std()
    state = np.where(energy > energy.mean() + half, 1, np.where(energy < energy.mean() - half, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.where(known >= 0, state[known], 0)
    edge = np.diff(np.concatenate([[0], on, [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)


def span_tensors(mel: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``TENSOR_FRAMES`` frames, (pieces, frames, mels) float32 filled up with zeros, and begin and end of each in frames."""
    bounds = [(a, min(a + TENSOR_FRAMES, e)) for s, e in spans.tolist() for a in range(s, e, TENSOR_FRAMES)]
    out = np.zeros((len(bounds), TENSOR_FRAMES, mel.shape[1]), np.float32)
    for k, (a, e) in enumerate(bounds):
        out[k, :e - a] = mel[a:e]
    return out, np.array(bounds, np.int64).reshape(-1, 2)


def features(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mel, spans, tensors, seconds of each tensor)."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float64) - 128) / 128
    mel, energy = log_mel(resampled(x))
    spans = active_spans(energy)
    tensors, bounds = span_tensors(mel, spans)
    seconds = np.stack([bounds[:, 0] * HOP, np.where(bounds[:, 1] > bounds[:, 0], (bounds[:, 1] - 1) * HOP + FRAME, 0)], axis=1) / (RATE * UP / DOWN)
    return mel, spans, tensors, seconds


def tensor_column(tensors: np.ndarray, seconds: np.ndarray) -> bytes:
    """An Arrow stream of one batch: begin, end, and the fixed-shape tensor of each piece."""
    shape = pa.fixed_shape_tensor(pa.float32(), tensors.shape[1:])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensors.ravel()), tensors.shape[1] * tensors.shape[2])
    batch = pa.RecordBatch.from_arrays([pa.array(seconds[:, 0]), pa.array(seconds[:, 1]), pa.ExtensionArray.from_storage(shape, flat)],
                                       names=["begin", "end", "mel"])
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue()


def from_tensor_column(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    table = pa.ipc.open_stream(raw).read_all().combine_chunks()
    if not table.num_rows:
        return np.zeros((0, TENSOR_FRAMES, MELS), np.float32), np.zeros((0, 2))
    return table["mel"].chunk(0).to_numpy_ndarray(), np.stack([table["begin"].to_numpy(), table["end"].to_numpy()], axis=1)


def store_audio(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, n_bytes, media): the bytes of a column as sound."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_raw"):
            data, starts = utf8(batch.column("_raw"))
            raw, cut = data.tobytes(), starts.tolist()
            media = [to_wav(padded(raw[a:b])) for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(starts)), pa.array(media, pa.binary())],
                                             names=[key, "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(column).alias("_raw")).mapInArrow(store, f"`{key}` {kind}, n_bytes long, media binary")


def audio_features(stored: DataFrame, key: str = "doc_id", tensors: bool = True) -> DataFrame:
    """(key, n_bytes, payload, mean_mel, spans, pieces): read back from ``media``. ``pieces`` is the Arrow tensor column of each
    sound; with ``tensors`` off it is null and only its digest (``pieces_sha256``) and the rest are given."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "media"):
            rows = []
            for media in batch.column("media"):
                m = media.as_buffer().to_pybytes()
                payload = from_wav(m)
                mel, spans, pieces, seconds = features(payload)
                arrow = tensor_column(pieces, seconds)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(),
                             mel.mean(axis=0).tolist(), spans.tolist(), arrow if tensors else None, hashlib.sha256(arrow).hexdigest()))
            columns = list(zip(*rows)) if rows else [()] * 9
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("n_bytes"), *(pa.array(list(c), k) for c, k in zip(columns, kinds))],
                                             names=[key, "n_bytes", *names])

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "mean_mel", "spans", "pieces", "pieces_sha256"]
    kind = stored.schema[key].dataType.simpleString()
    return stored.select(key, "n_bytes", "media").mapInArrow(
        compute, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
                 "mean_mel array<double>, spans array<array<long>>, pieces binary, pieces_sha256 string")


def audio_digest(docs: DataFrame) -> DataFrame:
    found = audio_features(store_audio(docs), tensors=False)
    text = F.concat_ws(";", F.concat(F.lit("spans="), F.size("spans").cast("string")),
                       F.concat(F.lit("mel="), F.array_join(F.transform("mean_mel", lambda v: F.round(v * 100).cast("long").cast("string")), ",")),
                       F.concat(F.lit("tensors="), F.col("pieces_sha256")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", text.alias("feature"))
