"""Telephony audio as media columns.

Companded samples expand by 256-entry tables, IMA ADPCM decodes with numpy across blocks (one step of all blocks at a
time), PCM is resampled by a windowed-sinc polyphase filter. ``store_payload`` keeps any bytes losslessly as 8-bit
samples in a WAVE container; ``pcm_column`` stores what a decoded payload sounds like as resampled 16-bit PCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.shared import documents, stored
from threadloom.llm.wordgrid import slices, text_bytes

MU_LAW, A_LAW, IMA_ADPCM, PCM = 7, 6, 0x11, 1
BLOCK = 64
RATE, OUT_RATE = 8000, 16000


@lru_cache(maxsize=2)
def expansion(law: int) -> np.ndarray:
    """The 16-bit sample of each code, from the segment rule of G.711."""
    code = np.arange(256)
    if law == MU_LAW:
        code = ~code & 0xFF
        size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
        return np.where(code & 0x80, -size, size).astype(np.int16)
    code = code ^ 0x55
    step = (code >> 4) & 7
    size = np.where(step == 0, ((code & 0x0F) << 4) + 8, (((code & 0x0F) << 4) + 0x108) << np.maximum(step - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


@lru_cache(maxsize=1)
def ima_steps() -> np.ndarray:
    # The 89 step sizes of the IMA ADPCM format.
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ])


@lru_cache(maxsize=1)
def ima_moves() -> tuple[np.ndarray, np.ndarray]:
    """What each nibble adds to the sample, and the step index after it, at index * 16 + nibble."""
    step, nibble = ima_steps()[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    move = np.array([-1, -1, -1, -1, 2, 4, 6, 8])[nibble & 7]
    after = np.clip(np.arange(len(step))[:, None] + move, 0, len(step) - 1)
    return np.where(nibble & 8, -size, size).astype(np.int32).ravel(), after.astype(np.int32).ravel()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (n, 2 * size - 7) of n mono IMA ADPCM blocks, uint8 (n, size): 16-bit first sample, step index, zero."""
    n, size = blocks.shape
    value = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((n, 1 + 2 * (size - 4)), dtype=np.int16)
    out[:, 0] = value
    delta, after = ima_moves()
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    rows = np.empty((2 * (size - 4), n), dtype=np.int16)
    for j in range(len(rows)):
        at = index * 16 + ((codes[j // 2] >> (4 * (j % 2))) & 15)
        value += delta[at]
        np.clip(value, -32768, 32767, out=value)
        index = after[at]
        rows[j] = value
    out[:, 1:] = rows.T
    return out


@lru_cache(maxsize=8)
def _filter(up: int, down: int, half: int = 8) -> np.ndarray:
    """Low-pass taps in 2**-15, (up, 2 * half), one row a phase."""
    cut = min(1.0, up / down)
    t = np.arange(-half + 1, half + 1)[None, :] - np.arange(up)[:, None] / up
    taps = cut * np.sinc(cut * t) * np.cos(np.pi * t / (2 * half + 1)) ** 2
    return np.rint(taps / taps.sum(axis=1, keepdims=True) * (1 << 15)).astype(np.int64)


def resample(pcm: np.ndarray, rate: int, out_rate: int) -> np.ndarray:
    """16-bit PCM at another rate, in whole numbers, so equal samples always give equal results."""
    if rate == out_rate or not len(pcm):
        return pcm.astype(np.int16)
    g = np.gcd(rate, out_rate)
    up, down = out_rate // g, rate // g
    taps = _filter(up, down)
    half = taps.shape[1] // 2
    padded = np.pad(pcm.astype(np.int64), (half - 1, half))
    out = np.full(-(-len(pcm) * up // down), 1 << 14, dtype=np.int64)
    for r in range(up):  # outputs r, r + up, ... share a phase and lie ``down`` inputs apart
        base, phase = divmod(r * down, up)
        n = len(range(r, len(out), up))
        for k in np.flatnonzero(taps[phase]).tolist():
            out[r::up] += padded[base + k :: down][:n] * taps[phase, k]
    return np.clip(out >> 15, -32768, 32767).astype(np.int16)


def wave(payload: bytes, law: int = MU_LAW, rate: int = RATE, bits: int = 8, block: int = 1) -> bytes:
    """A mono WAVE file whose data chunk is the payload (padded to an even size as RIFF asks)."""
    fmt = struct.pack("<HHIIHHH", law, 1, rate, rate * block, block, bits, 0)
    data = payload + b"\0" * (len(payload) % 2)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[int, int, bytes]:
    """Format code, rate and data of a WAVE file; chunks in any order."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, law, rate, data = 12, 0, 0, b""
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            law, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return law, rate, data


def decode(media: bytes) -> tuple[int, np.ndarray]:
    """Rate and 16-bit samples of a stored file."""
    law, rate, data = read_wave(media)
    raw = np.frombuffer(data, dtype=np.uint8)
    if law in (MU_LAW, A_LAW):
        return rate, expansion(law)[raw]
    if law == IMA_ADPCM:
        return rate, decode_adpcm(raw[: len(raw) // BLOCK * BLOCK].reshape(-1, BLOCK)).ravel()
    return rate, raw[: len(raw) // 2 * 2].view("<i2").astype(np.int16)


def pcm_features(pcm: np.ndarray) -> str:
    """Integers only, so equal samples give equal strings everywhere."""
    x = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"n={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};peak={int(np.abs(x).max(initial=0))};crossings={crossings}"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        data, begin = text_bytes(b.column("text"))
        media = []
        for a, z in zip(begin[:-1].tolist(), begin[1:].tolist()):
            size = max(-(-(z - a) // BLOCK) * BLOCK, BLOCK)
            media.append(wave(data[a:z].tobytes().ljust(size, b"\0")))
        yield pa.record_batch([b.column("doc_id"), pa.array(np.diff(begin)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store_payload(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes (null: none), zeros appended up to a positive multiple of 64,
    as mu-law samples of a WAVE file. Ids may be null or repeat; other columns are ignored. An empty table gives no rows."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is read back from stored files: payload digests, and features of the samples under three codings."""
    for b in slices(batches, "media"):
        files = [m.as_py() for m in b.column("media")]
        payloads = [read_wave(m)[2] for m in files]
        rows = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, BLOCK)
        decoded = np.empty((len(rows), 2 * BLOCK - 7), dtype=np.int16)
        for a in range(0, len(rows), 1 << 15):  # bounds the samples in memory
            decoded[a : a + (1 << 15)] = decode_adpcm(rows[a : a + (1 << 15)])
        at, feature = 0, []
        for media, payload in zip(files, payloads):
            rate, pcm = decode(media)
            mu = pcm_features(resample(pcm, rate, OUT_RATE))
            alaw = pcm_features(expansion(A_LAW)[np.frombuffer(payload, dtype=np.uint8)])
            n = len(payload) // BLOCK
            feature.append(f"mu[{mu}] a[{alaw}] ima[{pcm_features(decoded[at : at + n].ravel())}]")
            at += n
        columns = [
            b.column("doc_id"), b.column("n_bytes"), pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
            pa.array([zlib.crc32(p[-BLOCK:]) for p in payloads], pa.int64()), pa.array([len(m) for m in files], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in files]), pa.array(feature),
        ]
        yield pa.record_batch(columns, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_digest(stored_media: DataFrame) -> DataFrame:
    """The payload that comes back from each stored file, its checksums and the feature, a row for every row. Ids may be null
    or repeat; equal files have equal values; an empty table gives no rows."""
    return stored_media.mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def pcm_column(media: DataFrame, out_rate: int = OUT_RATE) -> DataFrame:
    """doc_id, rate, pcm (16-bit little-endian samples at out_rate) of the files that store_payload makes, which are never
    null; ids may be null or repeat, an empty table gives no rows."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sound = [resample(pcm, rate, out_rate).astype("<i2").tobytes() for rate, pcm in map(lambda m: decode(m.as_py()), b.column("media"))]
            yield pa.record_batch([b.column("doc_id"), pa.array([out_rate] * b.num_rows, pa.int32()), pa.array(sound, pa.binary())], ["doc_id", "rate", "pcm"])

    return media.select("doc_id", "media").mapInArrow(convert, "doc_id long, rate int, pcm binary")


def op5_telephony_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as telephony audio and read back; a null text is an empty one, see store_payload and media_digest."""
    return media_digest(stored(store_payload(documents(spark, sf_dir)), "media"))
