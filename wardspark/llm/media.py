"""Telephony audio in binary columns: mu-law, A-law and IMA ADPCM in WAV containers, expanded to resampled PCM.

mu-law and A-law expand by lookup tables that follow from their formulas. ADPCM blocks are independent, so numpy
decodes the k-th sample of all blocks of a batch in one step. ``to_pcm`` stores 16-bit PCM at the wanted rate.

Any bytes can be kept as 8-bit mu-law samples without loss; ``store_payload`` does so for texts, expands them to PCM at
STORED_RATE beside, writes both to the shared folder and reads them back, and ``features`` describes what was read.

Defined cases: a null text or medium counts as empty bytes (a payload has one block of padding at least; an empty
medium gives empty PCM); repeated rows are handled each on their own; a container that is no WAV, or of another
format or sample size, gives null; PCM of 8, 16, 24 and 32 bits is read; channels stay channels; a last ADPCM block
shorter than the others is decoded by its own length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm.common import arrow_map, slices, stored, table

BLOCK, PAD = 576, 255
RATE, TARGET_RATE, STORED_RATE = 8000, 16000, 4000
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17
#: ADPCM blocks and samples that are decoded at once.
SLAB_BLOCKS = 4096

#: Index changes of the IMA ADPCM format.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int64)
#: Step sizes of the IMA ADPCM format.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767,
], np.int64)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, size = (code & 0x70) >> 4, ((code & 0x0F) << 4) + 8
    size = np.where(exponent > 0, size + 0x100 << np.maximum(exponent - 1, 0), size)
    return np.where(code & 0x80, size, -size).astype(np.int16)


def decode_blocks(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM (mono): one row of bytes per block, one row of samples per block.

    A block starts with its first sample (16 bits) and step index; each later byte holds two samples, low bits first."""
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(blocks[:, 2].astype(np.int64), len(STEPS) - 1)
    out = np.empty((1 + 2 * (blocks.shape[1] - 4), len(blocks)), np.int16)
    out[0] = value = head
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(2 * len(data)):
        nibble = (data[k >> 1] >> 4 if k & 1 else data[k >> 1] & 15).astype(np.int64)
        step = STEPS[index]
        change = ((2 * (nibble & 7) + 1) * step) >> 3
        value = np.clip(value + np.where(nibble & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[nibble], 0, len(STEPS) - 1)
        out[k + 1] = value
    return out.T


def resample(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation to another rate."""
    if rate == target or not len(samples):
        return samples.astype(np.int16)
    n = len(samples) * target // rate
    return np.round(np.interp(np.arange(n) * (rate / target), np.arange(len(samples)), samples)).astype(np.int16)


def wav(kind: int, rate: int, data: bytes, block: int = 1, bits: int = 8, channels: int = 1) -> bytes:
    head = struct.pack("<HHIIHHH", kind, channels, rate, rate * block, block, bits, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body) + len(data) % 2) + body + b"\0" * (len(data) % 2)


def parse_wav(medium: bytes) -> tuple[int, int, int, int, bytes] | None:
    """Format, rate, block size, bits and data; None if it is no mono WAV."""
    parsed = parse_channels(medium)
    return parsed[1:] if parsed and parsed[0] == 1 else None


def parse_channels(medium: bytes) -> tuple[int, int, int, int, int, bytes] | None:
    """Number of channels, format, rate, block size, bits and data; None if it is no WAV."""
    if medium[:4] != b"RIFF" or medium[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(medium):
        name, size = medium[at : at + 4], struct.unpack_from("<I", medium, at + 4)[0]
        if name == b"fmt " and size >= 16:
            form = struct.unpack_from("<HHIIHH", medium, at + 8)
        elif name == b"data" and form and form[1] >= 1:
            return form[1], form[0], form[2], form[4], form[5], medium[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return None


def samples(kind: int, block: int, bits: int, data: bytes) -> np.ndarray | None:
    if kind == PCM and bits == 8:
        return np.frombuffer(data, np.uint8).astype(np.int16) - 128 << 8
    if kind == PCM and bits in (16, 24, 32):  # the two highest bytes of each sample
        size = bits // 8
        whole = np.frombuffer(data[: len(data) // size * size], np.uint8).reshape(-1, size)
        return np.ascontiguousarray(whole[:, -2:]).view("<i2")[:, 0]
    if kind in (MULAW, ALAW):
        return (mulaw_table() if kind == MULAW else alaw_table())[np.frombuffer(data, np.uint8)]
    if kind == IMA_ADPCM and block > 4:
        end = len(data) // block * block
        whole = np.frombuffer(data[:end], np.uint8).reshape(-1, block)
        parts = [decode_blocks(whole[i : i + SLAB_BLOCKS]).ravel() for i in range(0, len(whole), SLAB_BLOCKS)]
        if len(data) - end >= 4:  # a last block of its own length; less than a head holds no sample
            parts.append(decode_blocks(np.frombuffer(data[end:], np.uint8).reshape(1, -1)).ravel())
        return np.concatenate(parts) if parts else np.empty(0, np.int16)
    return None


def split_channels(channels: int, kind: int, block: int, bits: int, data: bytes) -> list[bytes]:
    """The data of each channel; ADPCM takes turns by four bytes (a head each, then eight samples each), others by sample."""
    if channels == 1:
        return [data]
    width = 4 if kind == IMA_ADPCM else max(bits // 8, 1) if kind == PCM else 1
    whole = np.frombuffer(data[: len(data) // (width * channels) * width * channels], np.uint8).reshape(-1, channels, width)
    return [whole[:, k].tobytes() for k in range(channels)]


def expand(medium: bytes | None, rate: int) -> bytes | None:
    """A WAV of 16-bit PCM at ``rate`` with the channels of the medium; None if that is not understood."""
    parsed = parse_channels(medium) if medium else (1, PCM, rate, 2, 16, b"")
    if parsed is None or parsed[1] == IMA_ADPCM and parsed[0] > 1 and parsed[3] % (4 * parsed[0]):
        return None
    n, kind, own_rate, block, bits, data = parsed
    sounds = [samples(kind, block // n if kind == IMA_ADPCM else block, bits, x) for x in split_channels(n, kind, block, bits, data)]
    if sounds[0] is None:
        return None
    made = np.column_stack([resample(x, own_rate, rate) for x in sounds])
    return wav(PCM, rate, made.astype("<i2").tobytes(), 2 * n, 16, n)


def to_pcm(df: DataFrame, media: str = "media", rate: int = TARGET_RATE, out: str = "pcm") -> DataFrame:
    """All columns of ``df`` and a WAV of 16-bit PCM at ``rate`` in ``out`` with its channels (null if the medium is not understood)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, StructField, StructType

    kept = [f for f in df.schema if f.name != out]
    schema = StructType([*kept, StructField(out, BinaryType())])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                names = part.schema.names
                made = pa.array([expand(m, rate) for m in part.column(names.index(media)).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(f.name)) for f in kept), made], schema=target)

    return df.mapInArrow(run, schema)


def store_payload(docs: DataFrame) -> DataFrame:
    """Keep each whole text as a mu-law WAV and its sound as resampled PCM: doc_id, n_bytes, media, pcm; written to the
    shared folder and read back."""

    def rows(x: dict) -> dict:
        out: dict[str, list] = {"n_bytes": [], "media": [], "pcm": []}
        for text in x["text"]:
            raw = (text or "").encode()
            payload = raw + bytes([PAD]) * (-len(raw) % BLOCK if raw else BLOCK)
            out["n_bytes"].append(len(raw))
            out["media"].append(wav(MULAW, RATE, payload))
            out["pcm"].append(expand(out["media"][-1], STORED_RATE))
        return {"doc_id": x["doc_id"], **out}

    return stored(arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, n_bytes long, media binary, pcm binary", rows))


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)


def features(media: DataFrame) -> DataFrame:
    """Digests of stored media and of their payload, and a description of the sound: root mean squares of the
    mu-law, A-law and ADPCM readings of the samples, zero crossings, and rate, length and checksum of the stored PCM."""

    def rows(x: dict) -> dict:
        out: dict[str, list] = {n: [] for n in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")}
        payloads, sounds = [], [parse_wav(p) for p in x["pcm"]]
        for medium in x["media"]:
            payload = parse_wav(medium)[4]
            payloads.append(payload)
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-32:]))
            out["media_bytes"].append(len(medium))
            out["media_sha256"].append(hashlib.sha256(medium).hexdigest())
        return {"doc_id": x["doc_id"], "n_bytes": x["n_bytes"], **out, "feature": describe(payloads, sounds)}

    return arrow_map(media, FEATURES, rows)


def describe(payloads: list[bytes], sounds: list[tuple]) -> list[str]:
    """Descriptions of payloads of whole blocks and of their parsed PCM; ADPCM blocks of all payloads are decoded together."""
    mulaw, alaw = mulaw_table(), alaw_table()
    joined = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    power = [
        (decode_blocks(joined[i : i + SLAB_BLOCKS]).astype(np.int64) ** 2).sum(axis=1)
        for i in range(0, len(joined), SLAB_BLOCKS)
    ]
    power, at, out = np.concatenate(power) if power else np.empty(0, np.int64), 0, []
    for payload, (_, rate, _, bits, pcm) in zip(payloads, sounds, strict=True):
        codes, n = np.frombuffer(payload, np.uint8), len(payload) // BLOCK
        sound = mulaw[codes]
        loud = [int(np.sqrt((s.astype(np.int64) ** 2).mean())) for s in (sound, alaw[codes])]
        adpcm = int(np.sqrt(power[at : at + n].sum() / (n * (1 + 2 * (BLOCK - 4)))))
        crossings = int(np.count_nonzero((sound[1:] < 0) != (sound[:-1] < 0)))
        out.append(f"rms={loud[0]}/{loud[1]}/{adpcm};zc={crossings};pcm={rate}:{len(pcm) * 8 // bits}:{zlib.crc32(pcm):08x}")
        at += n
    return out


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store_payload(table(spark, sf_dir, "documents", "doc_id", "text")))
