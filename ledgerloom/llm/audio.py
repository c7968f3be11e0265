"""Media columns: audio features of byte payloads.

A payload is stored as mono WAV with unsigned 8-bit samples, a byte a sample, so that it comes back without
loss. Features are computed from the stored bytes: polyphase resampling, overlapped log-mel filterbanks and
segmentation by energy with hysteresis. Clips are of any length, features are tensors of one shape: a clip
has a table with one row for every `FRAMES` frames, each a [FRAMES, MELS] float16 tensor (an Arrow fixed-shape
tensor column; the last one is filled up with the floor value) with the seconds it covers, its frames and the
spans of the segments that begin in it. A clip's table is stored beside its id as an Arrow IPC stream.

The steps go along the clip in blocks that overlap by the filters' reach, so memory doesn't grow with a clip.
Every clip is computed by itself from its own bytes alone. No sum goes through BLAS, whose order of additions
depends on its threads: filters and bands are summed in a fixed order, in doubles, and log energies are
rounded to steps of 1 / STEPS, which float16 holds exactly. Equal texts have equal values.

Defined results: null texts are empty; an empty text is a payload of padding; repeated rows get the same
result; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

UNIT, PAD = 192, b" "
RATE, UP, DOWN = 16_000, 3, 4  # from 16 to 12 kHz
TAPS, SIZE, HOP, MELS, FRAMES = 8, 256, 128, 24, 64
FLOOR_LOG, STEPS = -10.0, 64
ON_DB, OFF_DB, HOLD = 3.0, -3.0, 3  # against the clip's mean energy; frames that a segment lasts at least


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + PAD * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF WAVE file of unsigned 8-bit mono samples; chunks are filled up to an even length."""
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def samples_of(media: bytes) -> tuple[np.ndarray, int]:
    """The data chunk's samples and the rate of a WAVE file; ValueError if it's not of this kind."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit samples")
        if kind == b"data":
            return np.frombuffer(media, np.uint8, n, at + 8), rate
        at += 8 + n + n % 2
    raise ValueError("no samples")


def _filters(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Windowed-sinc low-pass at the lower of both rates, one row for each of `up` phases."""
    n = np.arange(up * taps) - (up * taps - 1) / 2
    cut = 1.0 / max(up, down)
    h = np.sinc(n * cut) * cut * np.hamming(len(n)) * up
    return np.ascontiguousarray(h.reshape(taps, up).T[:, ::-1] / (h.sum() / up))


def _mel_bank(rate: float, size: int = SIZE, mels: int = MELS) -> np.ndarray:
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(to_mel(40.0), to_mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.arange(size // 2 + 1) * rate / size
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.clip(np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid)), 0, None)
    return (bank / np.maximum(bank.sum(1, keepdims=True), 1e-9)).T


FILTERS, BANK = _filters(), _mel_bank(RATE * UP / DOWN)
TAPER = np.hanning(SIZE)
#: The bands' bins end to end (a band without a bin keeps its first one, of weight 0), and where each band starts.
_BINS = [np.flatnonzero(band) if band.any() else np.zeros(1, np.int64) for band in BANK.T]
BINS, WEIGHTS = np.concatenate(_BINS), np.concatenate([BANK[b, m] for m, b in enumerate(_BINS)])
BANDS = np.cumsum([0, *map(len, _BINS[:-1])])


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase: output k reads inputs around k * DOWN / UP with the filter of its phase."""
    n = len(x) * UP // DOWN
    wide = np.concatenate([np.zeros(TAPS // 2), x, np.zeros(TAPS + DOWN)])
    out = np.zeros(n)
    for first in range(UP):  # outputs first, first + UP, ... share a phase and lie DOWN inputs apart
        start, phase = divmod(first * DOWN, UP)
        last = start + DOWN * (len(range(first, n, UP)) - 1) + 1
        for k in range(TAPS if last > start else 0):
            out[first::UP] += wide[start + k : last + k : DOWN] * FILTERS[phase, k]
    return out


def log_mel(samples: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """[frames, MELS] log energies of 8-bit samples. A frame starts every HOP resampled samples while one fits
    (one frame at least); blocks are cut at multiples of DOWN * HOP samples and read past their end."""
    reach = DOWN * HOP
    block = max(block // reach, 1) * reach
    total = max(1, (len(samples) * UP // DOWN - SIZE) // HOP + 1)
    parts, done = [], 0
    margin = reach  # inputs before and after that the filters and the last frames read
    for at in range(0, max(len(samples), 1), block):
        begin = max(0, at - margin)
        x = (samples[begin : at + block + 2 * margin].astype(np.float64) - 128) / 128
        y = resample(x)[(at - begin) * UP // DOWN :]
        if len(y) < SIZE:
            y = np.concatenate([y, np.zeros(SIZE - len(y))])
        n = min(total - done, block * UP // DOWN // HOP, (len(y) - SIZE) // HOP + 1)
        if n <= 0:
            break
        frames = np.lib.stride_tricks.as_strided(y, (n, SIZE), (y.strides[0] * HOP, y.strides[0])) * TAPER
        spectrum = np.fft.rfft(frames, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        bands = np.add.reduceat(power[:, BINS] * WEIGHTS, BANDS, axis=1)
        parts.append(np.round(np.log(np.maximum(bands, np.exp(FLOOR_LOG))) * STEPS) / STEPS)
        done += n
    return np.concatenate(parts)


def segments(mel: np.ndarray, on_db: float = ON_DB, off_db: float = OFF_DB, hold: int = HOLD) -> list[tuple[int, int]]:
    """[first, last) frames of the stretches that rise above `on_db` and last until below `off_db` (both against
    the mean energy) and `hold` frames at least."""
    energy = np.exp(mel).mean(1)
    level = 10 * np.log10(np.maximum(energy, 1e-12) / max(float(energy.mean()), 1e-12))
    mark = np.where(level >= on_db, 1, np.where(level < off_db, -1, 0))
    known = np.flatnonzero(mark)
    last = np.zeros(len(mark), np.int64)  # each frame's state is that of the last frame with a mark
    last[known] = known
    last = np.maximum.accumulate(last)
    active = mark[last] == 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], active.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= hold]


def seconds(frame: int) -> float:
    return frame * HOP * DOWN / (UP * RATE)


_SPAN = pa.struct([("begin_s", pa.float64()), ("end_s", pa.float64())])
TABLE = pa.schema([("log_mel", pa.fixed_shape_tensor(pa.float16(), (FRAMES, MELS))), ("begin_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("spans", pa.list_(_SPAN))])


def feature_table(mel: np.ndarray, found: list[tuple[int, int]], rows: int = 256) -> bytes:
    """A clip's features: an Arrow IPC stream of TABLE, a row for every FRAMES frames, `rows` of them a batch."""
    sink, n = pa.BufferOutputStream(), -(-len(mel) // FRAMES)
    by_row: dict[int, list[dict]] = {}
    for a, b in found:
        by_row.setdefault(a // FRAMES, []).append({"begin_s": seconds(a), "end_s": seconds(b)})
    with pa.ipc.new_stream(sink, TABLE) as w:
        for lo in range(0, n, rows):
            hi = min(n, lo + rows)
            values = np.full(((hi - lo) * FRAMES, MELS), FLOOR_LOG, np.float16)
            part = mel[lo * FRAMES : hi * FRAMES]
            values[: len(part)] = part
            storage = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), FRAMES * MELS)
            ends = [min(len(mel), (i + 1) * FRAMES) for i in range(lo, hi)]
            w.write_batch(
                pa.record_batch(
                    [pa.ExtensionArray.from_storage(TABLE.field(0).type, storage), pa.array([seconds(i * FRAMES) for i in range(lo, hi)]), pa.array([seconds(e) for e in ends]), pa.array([e - i * FRAMES for i, e in zip(range(lo, hi), ends)], pa.int32()), pa.array([by_row.get(i, []) for i in range(lo, hi)], pa.list_(_SPAN))],
                    schema=TABLE,
                )
            )
    return sink.getvalue().to_pybytes()


def opened(features: bytes) -> tuple[np.ndarray, pa.Table]:
    """The tensors [rows, FRAMES, MELS] of a clip's features, and their table."""
    table = pa.ipc.open_stream(features).read_all()
    return np.concatenate([c.to_numpy_ndarray() for c in table["log_mel"].chunks]), table


STORED = "doc_id bigint, n_bytes bigint, media binary"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the texts' payloads as WAVE files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                both = [padded(t) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([n for _, n in both], pa.int64()), pa.array([wav(p) for p, _ in both], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, STORED)


FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, features binary"
_FEATURES = pa.schema([(c.split()[0], {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in FEATURES.split(", ")])


def features(media: DataFrame) -> DataFrame:
    """Digests and the feature table of each stored clip (rows of `store`), all from the bytes that are read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for doc, n, raw in zip(batch["doc_id"].to_pylist(), batch["n_bytes"].to_pylist(), batch["media"]):
                file = raw.as_py()
                samples, _ = samples_of(file)
                payload = samples.tobytes()
                mel = log_mel(samples)
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature_table(mel, segments(mel))))
                held += len(out[-1][-1])
                if held > 8 << 20 or len(out) == 1000:
                    yield _rows(out, _FEATURES)
                    out, held = [], 0
            if out:
                yield _rows(out, _FEATURES)

    return media.mapInArrow(run, FEATURES)


def _rows(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def described(features: bytes) -> str:
    """Frames, segments with the first one's span, the mean log-mel of each band to a tenth, and a CRC of the tensors
    in steps: what op6 tells of a clip's feature table."""
    tensors, table = opened(features)
    n = int(np.sum(table["frames"].to_numpy()))
    flat = tensors.reshape(-1, MELS).astype(np.float64)
    spans = [s for row in table["spans"].to_pylist() for s in row]
    first = f"{spans[0]['begin_s']:.3f}-{spans[0]['end_s']:.3f}" if spans else "none"
    crc = zlib.crc32((flat * STEPS).astype("<i2").tobytes())
    return f"frames={n};segments={len(spans)};first={first};mel=" + ",".join(f"{v:.1f}" for v in flat[:n].mean(0)) + f";tensors={crc:08x}"


def tensor_rows(features: DataFrame) -> DataFrame:
    """doc_id, nth, begin_s, end_s, frames, log_mel (FRAMES x MELS values end to end), spans: a row for each tensor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, raw in zip(batch["doc_id"], batch["features"]):
                nth = 0
                for part in pa.ipc.open_stream(raw.as_py()):
                    n, cells = part.num_rows, pa.array(part["log_mel"].to_numpy_ndarray().reshape(part.num_rows, -1).astype(np.float32).tolist(), pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * n, pa.int64()), pa.array(range(nth, nth + n), pa.int32()), part["begin_s"], part["end_s"], part["frames"], cells, part["spans"]], names=["doc_id", "nth", "begin_s", "end_s", "frames", "log_mel", "spans"])
                    nth += n

    return features.select("doc_id", "features").mapInArrow(run, "doc_id bigint, nth int, begin_s double, end_s double, frames int, log_mel array<float>, spans array<struct<begin_s: double, end_s: double>>")


DIGEST = FEATURES.replace("features binary", "feature string")
_DIGEST = pa.schema([*list(_FEATURES)[:-1], ("feature", pa.string())])


def digests(stored_features: DataFrame) -> DataFrame:
    """The rows of `features` with their table, read back, described as a string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([described(f.as_py()) for f in batch["features"]], pa.string())], schema=_DIGEST)

    return stored_features.mapInArrow(run, DIGEST)


def op6_audio(spark, sf_dir: str) -> DataFrame:
    media = stored(store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "audio-media")
    return digests(stored(features(media), "audio-features"))
