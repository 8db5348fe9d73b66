"""Telephony audio columns: mu-law, A-law and IMA ADPCM payloads, expanded, resampled and stored as WAV."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable
from functools import cache
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, map_rows, table, utf8

UNIT = 64
RATE = 8000
PCM_RATE = 16000
FORMATS = {"pcm": 1, "alaw": 6, "ulaw": 7, "adpcm": 17}

# The index and step tables of IMA ADPCM.
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    dtype=np.int32,
)


@cache
def ulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


@cache
def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    low, segment = (code & 15) << 4, code >> 4 & 7
    size = np.where(segment == 0, low + 8, low + 264 << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def decode_adpcm(payload: bytes, block: int = UNIT) -> np.ndarray:
    """Samples by block of mono IMA ADPCM (4 bytes of header, then nibbles, low one first).

    All blocks advance together, one nibble a step.  A step index above 88 counts as 88;
    bytes beyond the last full block are ignored here; ``expand`` decodes them.
    """
    data = np.frombuffer(payload, dtype=np.uint8)
    data = data[: data.size // block * block].reshape(-1, block)
    value = data[:, 0].astype(np.int32) | data[:, 1].astype(np.int8).astype(np.int32) << 8
    index = np.minimum(data[:, 2], 88).astype(np.int32)
    out = np.empty((2 * (block - 4) + 1, data.shape[0]), dtype=np.int16)
    out[0] = value
    body = np.ascontiguousarray(data[:, 4:].T)
    for k in range(2 * (block - 4)):
        nibble = body[k >> 1] >> 4 if k & 1 else body[k >> 1] & 15
        step, size = STEPS[index], (nibble & 7).astype(np.int32)
        delta = ((2 * size + 1) * step) >> 3
        value = np.clip(np.where(nibble & 8, value - delta, value + delta), -32768, 32767)
        index = np.clip(index + INDEX_STEPS[size], 0, 88)
        out[k + 1] = value
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation in whole numbers; the last sample is held."""
    if source == target or not pcm.size:
        return pcm
    wide = pcm.astype(np.int32)
    after = np.append(wide[1:], wide[-1])
    if target == 2 * source:
        out = np.empty(2 * wide.size, dtype=np.int16)
        out[::2], out[1::2] = wide, (wide + after) >> 1
        return out
    at = np.arange(pcm.size * target // source, dtype=np.int64) * source
    k, part = at // target, at % target
    return ((wide[k] * (target - part) + after[k] * part) // target).astype(np.int16)


def wav(data: bytes, codec: str, rate: int, block: int = UNIT) -> bytes:
    """A mono RIFF/WAVE file; sample data of an odd size get the pad byte that RIFF asks for."""
    unit, bits = {"pcm": (2, 16), "adpcm": (block, 4)}.get(codec, (1, 8))
    extra = struct.pack("<HH", 2, 2 * (block - 4) + 1) if codec == "adpcm" else struct.pack("<H", 0)
    speed = rate * block // (2 * (block - 4) + 1) if codec == "adpcm" else rate * unit
    fmt = struct.pack("<HHIIHH", FORMATS[codec], 1, rate, speed, unit, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[str, int, int, bytes]:
    """(codec, rate, block, sample data) of a stored file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data" and fmt:
            return {v: k for k, v in FORMATS.items()}[fmt[0]], fmt[2], fmt[4], media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no sample data")


def expand(payload: bytes, codec: str, block: int = UNIT) -> np.ndarray:
    """Linear 16-bit samples of a payload."""
    if codec == "ulaw":
        return ulaw_table()[np.frombuffer(payload, dtype=np.uint8)]
    if codec == "alaw":
        return alaw_table()[np.frombuffer(payload, dtype=np.uint8)]
    if codec == "adpcm":
        whole, rest = decode_adpcm(payload, block).ravel(), payload[len(payload) // block * block :]
        return np.append(whole, decode_adpcm(rest, len(rest))) if len(rest) >= 4 else whole  # a short last block to its end
    if codec == "pcm":
        return np.frombuffer(payload[: len(payload) & ~1], dtype="<i2")
    raise ValueError(f"unknown codec: {codec}")


def decode_media(df: DataFrame, payload: str = "payload", codec: str = "codec", source: int = RATE, target: int = PCM_RATE, block: int = UNIT) -> DataFrame:
    """Adds ``media``: each payload expanded by its codec (ulaw, alaw, adpcm, pcm), resampled, as a PCM WAV file.

    ADPCM payloads have blocks of ``block`` bytes; the last one may be shorter.  A null payload, or a null or unknown codec, gives null.  All columns of ``df`` stay; one of the
    name ``media`` is replaced.
    """
    from pyspark.sql.functions import pandas_udf

    bounded_batches(df.sparkSession)

    def converted(data, kind) -> bytes | None:
        if data is None or kind not in FORMATS:
            return None
        return wav(resample(expand(bytes(data), kind, block), source, target).astype("<i2").tobytes(), "pcm", target)

    @pandas_udf("binary")
    def stored(data, kind):
        return data.combine(kind, converted)

    return df.withColumn("media", stored(F.col(f"`{payload}`"), F.col(f"`{codec}`")))


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT) if data else bytes(UNIT)


def features(pcm: np.ndarray) -> str:
    """CRC, RMS, peak and zero crossings of samples."""
    wide = pcm.astype(np.int64)
    crossings = np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0))
    return f"{zlib.crc32(pcm.astype('<i2', copy=False).tobytes()):08x}:{isqrt(int(wide @ wide) // max(1, wide.size))}:{int(np.abs(wide).max(initial=0))}:{crossings}"


CODECS = ("ulaw", "alaw", "adpcm")


def _store(ids: list, texts: list[bytes], group: int = 1 << 20) -> Iterable[tuple]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < group):
            size += len(texts[end])
            end += 1
        files = [wav(padded(t), "ulaw", RATE) for t in texts[at:end]]
        payloads = [read_wav(f)[3] for f in files]
        blocks = decode_adpcm(b"".join(payloads))  # numpy works across the blocks of many texts
        first = 0
        for i, t, f, p in zip(ids[at:end], texts[at:end], files, payloads, strict=True):
            last = first + len(p) // UNIT
            linear = (expand(p, "ulaw"), expand(p, "alaw"), blocks[first:last].ravel())
            pcm = [wav(resample(x, RATE, PCM_RATE).astype("<i2", copy=False).tobytes(), "pcm", PCM_RATE) for x in linear]
            told = ";".join(f"{k}={features(expand(read_wav(x)[3], 'pcm'))}" for k, x in zip(CODECS, pcm, strict=True))
            yield i, len(t), f, p, *pcm, told
            first = last
        at = end


def store_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores the bytes of each text as the 8-bit mu-law samples of a WAV file and reads them back.

    Returns ``key``, n_bytes, media (the file), payload (read back from it), pcm_ulaw, pcm_alaw and pcm_adpcm (WAV files of
    16-bit PCM: the payload expanded by each codec and resampled to PCM_RATE) and feature: CRC, RMS, peak and zero
    crossings of the samples read back from each.  Null and empty texts are one block of zero bytes; equal texts give equal
    values; rows of a null key and repeated rows stay as they are; an empty table gives no rows; other columns are not
    read, whatever their names.
    """
    kind = df.schema[key].dataType.simpleString()
    files = ", ".join(f"pcm_{c} binary" for c in CODECS)
    return map_rows(df.select(F.col(f"`{key}`"), utf8(f"`{text}`").alias("t")), _store, f"`{key}` {kind}, n_bytes bigint, media binary, payload binary, {files}, feature string")


def op1_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_texts(table(spark, sf_dir, "documents"))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{UNIT})")).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        *[F.sha2(f"pcm_{c}", 256).alias(f"pcm_{c}_sha256") for c in CODECS],
    )
