"""Media columns, audio: 8-bit PCM in a WAV column, polyphase resampling, overlapped log-mel
filterbanks and hysteresis energy segmentation.

Samples are resampled by a rational factor with one small matrix product: every ``down`` input
samples give ``up`` outputs, each by its own phase of a windowed-sinc filter. Overlapping frames
of the result go through a Hann window, a real FFT and triangular mel filters; the logarithms are
cut into fixed-shape patches. Segments are runs of frames above a lower energy threshold that
touch a higher one. Patches with their time spans are an Arrow record batch with a fixed-shape
tensor column (half floats), kept as IPC bytes in a binary column; segments are an array of spans.
Media are written to the shared folder first; features and checksums come from what is read back,
and are a stored table of their own.

All work is done for one row at a time, in blocks of fixed size, so that equal media give equal
features whatever else a batch holds.

Edge cases: a null text is an empty one and an empty payload is filled up to one unit; null
media give null checksums, features and digests; media shorter than a frame give one zero-padded frame; repeated rows
give repeated rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import delete, materialize

MEDIA = "doc_id long, n_bytes long, media binary"
CHECKS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
FEATURES = f"doc_id long, n_bytes long, {CHECKS}, n_frames long, segments array<struct<start_s:double,end_s:double>>, patches binary"
DIGESTS = f"doc_id long, n_bytes long, {CHECKS}, feature string"


@dataclass(frozen=True)
class Params:
    rate: int = 16_000  # of the stored samples
    up: int = 5
    down: int = 8
    taps: int = 12  # of each phase
    frame: int = 256
    hop: int = 160
    mels: int = 32
    patch: int = 64  # frames
    high: float = 0.7  # quantiles of the frame energies
    low: float = 0.4

    @property
    def out_rate(self) -> float:
        return self.rate * self.up / self.down


def to_wav(payload: bytes, rate: int) -> bytes:
    """Unsigned 8-bit mono PCM in a RIFF file."""
    pad = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples, by walking the chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        tag, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if tag == b"fmt ":
            rate = int.from_bytes(media[at + 12 : at + 16], "little")
        elif tag == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def _encode(unit: int, fill: int, rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out, held = [], [], 0
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                whole = max(unit, -(-len(raw) // unit) * unit)
                ids.append((doc_id.as_py(), len(raw)))
                out.append(to_wav(raw.ljust(whole, bytes([fill])), rate))
                held += whole
                if held > 2 << 20:
                    yield _media(ids, out)
                    ids, out, held = [], [], 0
            yield _media(ids, out)

    return run


def _media(ids: list[tuple], out: list[bytes]) -> pa.RecordBatch:
    d, n = zip(*ids, strict=True) if ids else ((), ())
    return pa.record_batch([pa.array(d, pa.int64()), pa.array(n, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "n_bytes", "media"])


def encode_texts(docs: DataFrame, unit: int = 576, fill: int = 255, rate: int = Params.rate) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, filled up to whole units, as audio."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode(unit, fill, rate), MEDIA)


@lru_cache
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """(taps + down - 1 inputs, up outputs): the filter of every output of a block."""
    cut = 1.0 / max(up, down)
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t * cut) * cut * up * np.hamming(n)
    w = np.zeros((taps + down - 1, up))
    for j in range(up):
        at, phase = divmod(j * down, up)
        for k in range(taps):
            w[taps - 1 + at - k, j] += h[phase + k * up]
    return w.astype(np.float32)


def resample(x: np.ndarray, p: Params, block: int = 1 << 15) -> np.ndarray:
    """Polyphase resampling of float32 samples by up / down."""
    w = _phases(p.up, p.down, p.taps)
    blocks = -(-len(x) // p.down)
    padded = np.zeros(blocks * p.down + p.taps - 1, np.float32)
    padded[p.taps - 1 : p.taps - 1 + len(x)] = x
    windows = np.lib.stride_tricks.sliding_window_view(padded, len(w))[:: p.down]
    return np.concatenate([(windows[i : i + block] @ w).reshape(-1) for i in range(0, blocks, block)])


@lru_cache
def _mel_filters(p: Params) -> np.ndarray:
    mel = lambda f: 2595.0 * np.log10(1 + f / 700.0)
    edges = 700.0 * (10 ** (np.linspace(mel(50.0), mel(p.out_rate / 2), p.mels + 2) / 2595.0) - 1)
    f = np.fft.rfftfreq(p.frame, 1 / p.out_rate)
    up = (f[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[None, 2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(y: np.ndarray, p: Params, block: int = 2048) -> np.ndarray:
    """(frames, mels) of overlapping frames; the last one is filled up with zeros."""
    frames = 1 + max(0, -(-(len(y) - p.frame) // p.hop))
    padded = np.zeros((frames - 1) * p.hop + p.frame, np.float32)
    padded[: min(len(y), len(padded))] = y[: len(padded)]
    view = np.lib.stride_tricks.sliding_window_view(padded, p.frame)[:: p.hop]
    window, bank, out = np.hanning(p.frame).astype(np.float32), _mel_filters(p), np.empty((frames, p.mels), np.float32)
    for i in range(0, frames, block):
        spectrum = np.fft.rfft(view[i : i + block] * window)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        np.log(power @ bank + np.float32(1e-6), out=out[i : i + block])
    return out


def segments(mel: np.ndarray, p: Params) -> list[tuple[float, float]]:
    """Hysteresis: runs of frames above the low threshold that reach the high one, as seconds."""
    energy = mel.mean(axis=1)
    low, high = np.quantile(energy, [p.low, p.high])
    above = np.concatenate([[False], energy >= low, [False]])
    edge = np.flatnonzero(above[1:] != above[:-1])
    start, stop = edge[::2], edge[1::2]
    reach = np.concatenate([[0], (energy >= high).cumsum()])
    good = reach[stop] > reach[start]
    second = p.hop / p.out_rate
    return [(round(float(a * second), 6), round(float(b * second), 6)) for a, b in zip(start[good], stop[good], strict=True)]


def pack_patches(mel: np.ndarray, p: Params) -> bytes:
    """Fixed-shape tensors with their time spans as an Arrow IPC stream."""
    n = max(1, -(-len(mel) // p.patch))
    full = np.zeros((n * p.patch, p.mels), np.float16)
    full[: len(mel)] = mel
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, p.patch, p.mels))
    at = np.arange(n) * p.patch
    stop = np.minimum(at + p.patch, len(mel))
    second = p.hop / p.out_rate
    batch = pa.record_batch([tensors, pa.array(at * second), pa.array(stop * second), pa.array(stop - at)], names=["log_mel", "start_s", "end_s", "frames"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_patches(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(patches, frames, mels) and the (start, end) seconds of every patch."""
    batch = pa.ipc.open_stream(packed).read_all().combine_chunks().to_batches()[0]
    spans = np.stack([np.asarray(batch.column("start_s")), np.asarray(batch.column("end_s"))], axis=1)
    return batch.column("log_mel").to_numpy_ndarray(), spans


def analyse(media: bytes, p: Params) -> tuple:
    """Checksums, number of frames, segments and patches of one medium."""
    rate, payload = from_wav(media)
    if rate != p.rate:
        raise ValueError(f"rate {rate}, expected {p.rate}")
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128.0) / 128.0
    mel = log_mel(resample(x, p), p)
    checks = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
    return *checks, len(mel), segments(mel, p), pack_patches(mel, p)


def _features(p: Params):
    span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), span, pa.binary()]
    names = ["doc_id", "n_bytes", *(f.split()[0] for f in CHECKS.split(", ")), "n_frames", "segments", "patches"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = b.column("media")
            size = np.asarray(pc.fill_null(pc.binary_length(media), 0)).cumsum()
            lo = 0
            while lo < b.num_rows:  # some megabytes of media at a time, one row at least
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + (2 << 20), "right")))
                rows = [(None,) * len(kinds) if m.as_py() is None else analyse(m.as_py(), p) for m in media.slice(lo, hi - lo)]
                cols = list(zip(*rows, strict=True))
                cols[6] = [None if s is None else [{"start_s": a, "end_s": e} for a, e in s] for s in cols[6]]
                yield pa.record_batch([b.column(c).slice(lo, hi - lo) for c in ("doc_id", "n_bytes")] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
                lo = hi

    return run


def features(media: DataFrame, p: Params | None = None) -> DataFrame:
    """Checksums, n_frames, segments and patches of rows of doc_id, n_bytes, media."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features(p or Params()), FEATURES)


def _feature(frames: int | None, segs: list[dict] | None, packed: bytes | None) -> str | None:
    if packed is None:
        return None
    coarse = np.rint(unpack_patches(packed)[0].astype(np.float32) * 4).astype("<i2").tobytes()
    voiced = sum(s["end_s"] - s["start_s"] for s in segs)
    return f"frames={frames};segments={len(segs)};voiced_s={voiced:.3f};mel={hashlib.sha1(coarse).hexdigest()[:20]}"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in DIGESTS.split(", ")]
    for b in batches:
        found = [_feature(n.as_py(), s.as_py(), x.as_py()) for n, s, x in zip(*(b.column(c) for c in ("n_frames", "segments", "patches")), strict=True)]
        yield pa.record_batch([*(b.column(c) for c in names[:-1]), pa.array(found, pa.string())], names=names)


def digests(rows: DataFrame) -> DataFrame:
    """Read stored features back and reduce the tensors and segments to a string."""
    return rows.mapInArrow(_digests, DIGESTS)


def store(docs: DataFrame, unit: int = 576, fill: int = 255, p: Params | None = None) -> tuple[DataFrame, DataFrame]:
    """The stored media table, and the stored features of what is read back from it."""
    p = p or Params()
    media = materialize(encode_texts(docs, unit, fill, p.rate), "audio-media", "zstd")
    return media, materialize(features(media, p), "audio-features", "zstd")


def digest_texts(docs: DataFrame, unit: int = 576, fill: int = 255, p: Params | None = None) -> DataFrame:
    """Checksums and a feature string of each text's stored medium."""
    media, found = store(docs, unit, fill, p)
    delete(docs.sparkSession, media._stored_at)  # all that is asked for here has been read from it
    return digests(found)
