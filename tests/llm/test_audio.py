import hashlib
import os
import subprocess
import sys
import zlib

import numpy as np
import pytest

from ledgerloom.llm import audio as A

DOCS = [(1, None), (2, ""), (3, "é" * 100), (4, "a" * 192), (5, "word " * 30_000), (6, "é" * 100), (6, "é" * 100)]


def test_digests_against_the_texts(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 as media", "'x' as n_bytes")
    rows = A.digests(A.features(A.store(df))).collect()
    assert len(rows) == len(DOCS)
    texts = dict(DOCS)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert (r.media_bytes, r.media_sha256) == (len(A.wav(payload)), hashlib.sha256(A.wav(payload)).hexdigest())
    assert len({tuple(r)[1:] for r in rows if r.doc_id in (3, 6)}) == 1
    assert A.digests(A.features(A.store(df.limit(0)))).count() == 0


def test_tensors_of_one_shape_with_spans(spark):
    rows = A.features(A.store(spark.createDataFrame(DOCS, "doc_id long, text string")))
    for r in rows.collect():
        tensors, table = A.opened(bytes(r.features))
        mel = A.log_mel(np.frombuffer(A.padded(dict(DOCS)[r.doc_id])[0], np.uint8))
        assert tensors.shape[1:] == (A.FRAMES, A.MELS) and table.schema.field("log_mel").type.shape == [A.FRAMES, A.MELS]
        assert np.array_equal(tensors.reshape(-1, A.MELS)[: len(mel)], mel)
        assert sum(table["frames"].to_pylist()) == len(mel)
        found = [(s["begin_s"], s["end_s"]) for row in table["spans"].to_pylist() for s in row]
        assert found == [(A.seconds(a), A.seconds(b)) for a, b in A.segments(mel)]
    each = sorted((x for x in A.tensor_rows(rows).collect() if x.doc_id == 5), key=lambda x: x.nth)
    assert all(abs(a.end_s - b.begin_s) < 1e-9 for a, b in zip(each, each[1:])) and {len(x.log_mel) for x in each} == {A.FRAMES * A.MELS}


def plain(text):
    """Frames and mean log-mels of a text by zero-stuffing, convolution, a DFT by its definition and whole sums."""
    raw = (text or "").encode()
    x = np.array(list(raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))), float)
    y = direct((x - 128) / 128)[(A.TAPS // 2 - 1) * A.UP :: A.DOWN][: len(x) * A.UP // A.DOWN]
    y = np.concatenate([y, np.zeros(max(0, A.SIZE - len(y)))])
    k = np.arange(A.SIZE)
    turn = np.exp(-2j * np.pi * np.outer(k[: A.SIZE // 2 + 1], k) / A.SIZE)
    out = [np.log(np.maximum((np.abs(turn @ (y[i : i + A.SIZE] * np.hanning(A.SIZE))) ** 2) @ A.BANK, np.exp(A.FLOOR_LOG))) for i in range(0, len(y) - A.SIZE + 1, A.HOP)]
    return len(out), np.mean(out, 0)


def test_the_query_against_plain_sums(spark, sf, tmp_path):
    rows = A.op6_audio(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in sorted(rows, key=lambda r: r.n_bytes)[::5]:
        if r.n_bytes > 30_000:
            continue
        held = dict(p.split("=") for p in r.feature.split(";"))
        n, mean = plain(texts[r.doc_id])
        assert int(held["frames"]) == n
        assert np.allclose([float(v) for v in held["mel"].split(",")], mean, atol=0.07)


def test_threads_do_not_matter():
    code = "import zlib; import numpy as np; from ledgerloom.llm import audio as A; x = np.random.default_rng(3).integers(0, 256, 300_000).astype(np.uint8); print(zlib.crc32(A.feature_table(A.log_mel(x), [])))"
    runs = {subprocess.run([sys.executable, "-c", code], env={**os.environ, "OPENBLAS_NUM_THREADS": n}, capture_output=True, text=True, check=True).stdout for n in ("1", "4")}
    assert len(runs) == 1


def direct(x, up=A.UP, down=A.DOWN):
    """Resampling by stuffing zeros, one filter, and dropping."""
    n = up * A.TAPS
    k = np.arange(n) - (n - 1) / 2
    h = np.sinc(k / max(up, down)) / max(up, down) * np.hamming(n) * up
    h /= h.sum() / up
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    return np.convolve(wide, h)


def test_resampling_keeps_a_tone():
    t = np.arange(A.RATE) / A.RATE
    for hz in (440, 1000, 3000):
        y = A.resample(np.sin(2 * np.pi * hz * t).astype(np.float32))
        assert abs(np.abs(np.fft.rfft(y)).argmax() * (A.RATE * A.UP / A.DOWN) / len(y) - hz) < 1
        assert 0.65 < np.abs(y[100:-100]).max() < 1.1
    x = np.random.default_rng(0).normal(size=400).astype(np.float32)
    full = direct(x)[(A.TAPS // 2 - 1) * A.UP :: A.DOWN]
    y = A.resample(x)
    assert np.allclose(y, full[: len(y)], atol=1e-4)


def test_blocks_do_not_matter():
    x = np.random.default_rng(1).integers(0, 256, 100_000).astype(np.uint8)
    assert np.array_equal(A.log_mel(x), A.log_mel(x, block=4096))


def test_segments():
    t = np.arange(40_000) / A.RATE
    tone, quiet = (128 + 100 * np.sin(2 * np.pi * 800 * t)).astype(np.uint8), np.full(40_000, 128, np.uint8)
    (a, b), = A.segments(A.log_mel(np.concatenate([quiet, tone, quiet])))
    assert abs(A.seconds(a) - 2.5) < 0.05 and abs(A.seconds(b) - 5.0) < 0.05
    assert A.segments(A.log_mel(quiet)) == []


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        A.samples_of(b"RIFFxxxxWAVX")
    with pytest.raises(ValueError):
        A.samples_of(A.wav(b"abcd").replace(b"\x08\x00data", b"\x10\x00data"))
