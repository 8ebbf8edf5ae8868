"""Media columns: telephony audio in WAV containers.

Mu-law and A-law expand by lookup tables, IMA ADPCM blocks decode with numpy across all
blocks of a row at once (one step per sample position), and decoded audio is resampled
and stored as 16-bit PCM.

Defined cases: null texts store as empty ones; a null or malformed media value decodes
to null columns; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: WAV format tags (fixed values).
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 0x11
RATE, UNIT, BLOCK = 8000, 576, 576


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, size = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(exponent > 0, (size + 256) << np.maximum(exponent - 1, 0), size)
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = _mulaw_table(), _alaw_table()

# The IMA ADPCM step sizes and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """For index * 16 + nibble: the change of the sample and the next index."""
    step, nibble = STEPS[:, None], np.arange(16)[None]
    size = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
    following = np.clip(np.arange(89)[:, None] + CHANGES[nibble & 7], 0, 88)
    return np.where(nibble & 8, -size, size).astype(np.int32).ravel(), (following * 16).astype(np.int32).ravel()


ADPCM_DELTA, ADPCM_NEXT = _adpcm_tables()


def adpcm_blocks(data: bytes, block: int = BLOCK) -> np.ndarray:
    """Mono IMA ADPCM, a row of samples per block; all blocks advance together, sample by sample."""
    whole = len(data) // block
    raw = np.frombuffer(data, np.uint8, whole * block).reshape(whole, block)
    out = np.empty((1 + 2 * (block - 4), whole), np.int16)
    sample = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(raw[:, 2], 88).astype(np.int32) * 16
    out[0] = sample
    body = raw[:, 4:].T
    nibbles = np.empty((2 * (block - 4), whole), np.int32)
    nibbles[::2], nibbles[1::2] = body & 15, body >> 4
    for k in range(len(nibbles)):
        at = index + nibbles[k]
        sample = np.minimum(np.maximum(sample + ADPCM_DELTA[at], -32768), 32767)
        index = ADPCM_NEXT[at]
        out[k + 1] = sample
    return np.ascontiguousarray(out.T)


def adpcm_decode(data: bytes, block: int = BLOCK) -> np.ndarray:
    return adpcm_blocks(data, block).ravel()


def resample(pcm: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation in integers, so that equal samples give equal results everywhere."""
    if rate == target or not len(pcm):
        return pcm.astype(np.int16)
    n = -(-len(pcm) * target // rate)
    at = np.arange(n, dtype=np.int64) * rate
    left, part = at // target, at % target
    right = np.minimum(left + 1, len(pcm) - 1)
    wide = pcm.astype(np.int64)
    return ((wide[left] * (target - part) + wide[right] * part + target // 2) // target).astype(np.int16)


def wav(data: bytes, tag: int, rate: int = RATE, bits: int = 8, align: int = 1) -> bytes:
    """A mono WAV file; compressed tags carry a fact chunk with the sample count."""
    samples = len(data) if tag != IMA_ADPCM else len(data) // align * (2 * (align - 4) + 1)
    per_second = rate * align if tag != IMA_ADPCM else rate * align // (2 * (align - 4) + 1)
    extra = struct.pack("<HH", 2, 2 * (align - 4) + 1) if tag == IMA_ADPCM else b"" if tag == PCM else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", tag, 1, rate, per_second, align, bits) + extra
    fact = b"" if tag == PCM else b"fact" + struct.pack("<II", 4, samples)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """Tag, rate, block align and data of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data = 12, None, None
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif kind == b"data":
            data = media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    if form is None or data is None or form[1] != 1:
        raise ValueError("no format, no data or several channels")
    return form[0], form[2], form[4], data


def decode_pcm(tag: int, data: bytes, align: int) -> np.ndarray:
    if tag == MULAW:
        return MULAW_PCM[np.frombuffer(data, np.uint8)]
    if tag == ALAW:
        return ALAW_PCM[np.frombuffer(data, np.uint8)]
    if tag == IMA_ADPCM:
        return adpcm_decode(data, align)
    if tag == PCM:
        return np.frombuffer(data, "<i2")
    raise ValueError(f"format tag {tag} is not telephony audio")


def decode_media(table: DataFrame, media: str = "media", key: str = "doc_id", target: int = 16000) -> DataFrame:
    """(key, tag, rate, n_samples, pcm_wav): decoded, resampled and stored as 16-bit PCM WAV."""

    def one(value: bytes | None) -> tuple:
        try:
            tag, rate, align, data = read_wav(value or b"")
            pcm = resample(decode_pcm(tag, data, align), rate, target)
        except (ValueError, struct.error):
            return None, None, None, None
        return tag, rate, len(pcm), wav(pcm.astype("<i2").tobytes(), PCM, target, 16, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(x.as_py()) for x in batch.column(1)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [key, "tag", "rate", "n_samples", "pcm_wav"])

    kind = dict(table.dtypes)[key]
    return table.select(key, media).mapInArrow(run, f"{key} {kind}, tag int, rate int, n_samples long, pcm_wav binary")


def text_payload(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and those with 255 appended up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def features(tag: int, rate: int, data: bytes, blocks: np.ndarray, target: int = 16000) -> str:
    """Levels of the stored bytes as mu-law and A-law, and checksums of the resampled mu-law audio and of its ADPCM reading (blocks)."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    level = [math.sqrt(int((counts * table.astype(np.int64) ** 2).sum()) / max(1, len(data))) for table in (MULAW_PCM, ALAW_PCM)]
    pcm = resample(decode_pcm(tag, data, 1), rate, target)
    return f"mulaw_rms={level[0]:.3f};alaw_rms={level[1]:.3f};pcm{target}={zlib.crc32(pcm.astype('<i2').tobytes()):08x};adpcm={zlib.crc32(blocks.astype('<i2').tobytes()):08x}"


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a mu-law WAV of the text's bytes), payload (read back from media), feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in slices(texts, 1 << 21):
                sizes, raws = zip(*map(text_payload, texts[i:j]), strict=True)
                media = [wav(x, MULAW) for x in raws]
                read = [read_wav(x) for x in media]
                payload = [x[3] for x in read]
                decoded = adpcm_blocks(b"".join(payload))  # payloads are whole blocks: all rows advance together
                ends = np.cumsum([len(x) // BLOCK for x in payload])
                feature = [
                    features(tag, rate, data, decoded[end - len(data) // BLOCK : end])
                    for (tag, rate, _, data), end in zip(read, ends.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(payload, pa.binary()), pa.array(feature, pa.string())],
                    ["doc_id", "n_bytes", "media", "payload", "feature"],
                )

    schema = "doc_id long, n_bytes long, media binary, payload binary, feature string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def media_digests(docs: DataFrame) -> DataFrame:
    """The digests of the stored media and of what is read back."""
    stored = store_texts(docs)
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
