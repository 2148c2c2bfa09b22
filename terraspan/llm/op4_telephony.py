"""Operator 4: telephony audio as a media column: mu-law, A-law, IMA ADPCM, resampled PCM.

A payload is stored losslessly as the 8-bit samples of a mono WAV file (mu-law, A-law or
ADPCM code bytes) and read back from the file's chunks. Decoding: mu-law and A-law by
lookup tables of 256 entries, made from the companding rules; ADPCM is sequential within a
block, but blocks are independent, so one numpy step advances all blocks of a batch by one
sample. ``resample`` brings PCM from one rate to another by linear interpolation with whole
numbers only, and ``to_pcm`` stores the result as 16-bit PCM WAV.

``store`` adds the WAV file (and, if asked, the resampled PCM file) to any table, to be
written as media columns; ``described`` computes the features from such columns as they are read back, those of
the resampled PCM from its stored file where there is one. The query stores both.
Everything is row-local, so there is no shuffle and a lost task is simply redone. Decoded and resampled
samples exist for SLICE bytes at a time, however long a text is; its files, of 1 and 4 times its bytes, are held whole.

Defined cases: a null text is the empty text, whose payload is one padded unit of 576 bytes;
equal texts give equal values; long texts are stored whole; an empty table gives no rows;
extra columns are ignored by the query and carried along by ``store`` and ``described``; one named like an added column gives way to it.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, table, text_or_empty

UNIT = 576
RATE, TARGET_RATE = 8_000, 16_000
#: Bytes of payload that are decoded at once, and rows of media that are held at once.
SLICE, ROWS = 1024 * UNIT, 256
#: How media columns are written: pages of 8 MB at level 12, as the samples of a text are four times as long as it is and repeat only as far apart.
WRITING = {"compression": "zstd", "parquet.compression.codec.zstd.level": "12", "parquet.page.size": str(8 << 20)}
#: WAV format tags: fixed values.
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17
#: IMA ADPCM index changes by code: fixed values.
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    value = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -value, value).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    segment, low = code >> 4 & 7, (code & 15) << 4
    value = np.where(segment == 0, low + 8, low + 264 << np.maximum(segment - 1, 0))
    return np.where(code & 128, value, -value).astype(np.int16)


def _step_table() -> np.ndarray:
    """The 89 IMA step sizes: each about 1.1 times the one before, from 7 to 32767."""
    # fixed values
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
        337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
        6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ], dtype=np.int32)


MULAW_TABLE, ALAW_TABLE, STEPS = _mulaw_table(), _alaw_table(), _step_table()


def encode_mulaw(pcm: np.ndarray) -> np.ndarray:
    """16-bit samples to mu-law codes."""
    x = pcm.astype(np.int32)
    size = np.minimum(np.abs(x), 32_635) + 132
    segment = np.floor(np.log2(size)).astype(np.int32) - 7
    code = np.where(x < 0, 128, 0) | segment << 4 | size >> segment + 3 & 15
    return (~code & 0xFF).astype(np.uint8)


def decode_adpcm(payload: np.ndarray, block: int = UNIT) -> np.ndarray:
    """Samples ``(blocks, 2 * block - 7)`` of mono IMA ADPCM; a row per block.

    A block begins with its first sample (16 bits), its step index and a reserved byte; then
    each byte has two codes, the low half first.
    """
    rows = payload.reshape(-1, block)
    sample = rows[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(rows[:, 2].astype(np.int32), 0, len(STEPS) - 1)
    codes = np.empty((2 * (block - 4), len(rows)), dtype=np.uint8)
    codes[0::2], codes[1::2] = rows[:, 4:].T & 15, rows[:, 4:].T >> 4
    # the change for a code at a step index: one lookup a sample
    step, code = STEPS[:, None], np.arange(16)[None, :]
    change = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
    change = np.where(code & 8, -change, change).astype(np.int32).ravel()
    after = np.clip(np.arange(len(STEPS))[:, None] + INDEX_STEPS[None, :], 0, len(STEPS) - 1).astype(np.int32).ravel()
    out = np.empty((len(codes) + 1, len(rows)), dtype=np.int16)
    out[0] = sample
    for i, c in enumerate(codes):
        at = index * 16 + c
        sample = np.minimum(np.maximum(sample + change[at], -32_768), 32_767)
        index = after[at]
        out[i + 1] = sample
    return out.T


def resampled(values: np.ndarray, rate: int = RATE, target: int = TARGET_RATE, decode: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Linear interpolation in whole numbers, SLICE samples at a time: output k lies at k * rate / target; floor division.

    ``values`` are samples, or codes that the table ``decode`` turns into samples; only those that a slice needs are decoded for it.
    """
    n = len(values) * target // rate
    for first in range(0, n, SLICE):
        at = np.arange(first, min(n, first + SLICE), dtype=np.int64) * rate
        left, part = at // target, at % target
        low = int(left[0])
        near = values[low : int(left[-1]) + 2]
        pcm = (near if decode is None else decode[near]).astype(np.int64)
        right = np.minimum(left + 1, len(values) - 1)
        yield ((pcm[left - low] * (target - part) + pcm[right - low] * part) // target).astype("<i2")


def resample(pcm: np.ndarray, rate: int = RATE, target: int = TARGET_RATE) -> np.ndarray:
    """All of ``resampled`` samples at once."""
    return np.concatenate([np.empty(0, dtype=np.int16), *resampled(pcm, rate, target)]).astype(np.int16)


def wav_head(n: int, tag: int = MULAW, rate: int = RATE, bits: int = 8, block: int | None = None) -> bytes:
    """What comes before ``n`` bytes of data in a mono WAV file; formats other than PCM carry a fact chunk."""
    align = block or bits // 8
    per_block = 2 * align - 7 if tag == IMA_ADPCM else 1
    extra = b"" if tag == PCM else struct.pack("<H", 0) if tag != IMA_ADPCM else struct.pack("<HH", 2, per_block)
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * align // per_block, align, bits) + extra
    fact = b"" if tag == PCM else b"fact" + struct.pack("<II", 4, n // align * per_block)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", n)
    return b"RIFF" + struct.pack("<I", len(body) + n + n % 2) + body


def wav(data: bytes, tag: int = MULAW, rate: int = RATE, bits: int = 8, block: int | None = None) -> bytes:
    """A mono WAV file."""
    return wav_head(len(data), tag, rate, bits, block) + data + b"\0" * (len(data) % 2)


def read_wav(stored: bytes) -> tuple[int, int, bytes]:
    """``(format tag, rate, data)``, found chunk by chunk."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate = 12, None, None
    while at + 8 <= len(stored):
        name, n = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", stored, at + 8)
        elif name == b"data":
            return tag, rate, stored[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def payload_of(text: str | None) -> tuple[int, bytes]:
    """``(unpadded bytes, payload)``: UTF-8, then bytes 255 up to a positive multiple of UNIT."""
    data = (text or "").encode("utf-8", "surrogatepass")
    units = max(1, -(-len(data) // UNIT))
    return len(data), data.ljust(units * UNIT, b"\xff")


def _squares(samples: np.ndarray) -> np.ndarray:
    """Sums of squares of each row, or of a single one."""
    x = samples.astype(np.int64)
    return (x * x).sum(axis=-1)


def _root(squares: int, n: int) -> int:
    """The root of the mean, to the whole number below."""
    return math.isqrt(int(squares) // max(1, n))


def to_pcm(stored: bytes, target: int = TARGET_RATE) -> bytes:
    """A stored mu-law, A-law or ADPCM WAV as a 16-bit PCM WAV at the target rate."""
    tag, rate, data = read_wav(stored)
    codes, table = np.frombuffer(data, np.uint8), {MULAW: MULAW_TABLE, ALAW: ALAW_TABLE, IMA_ADPCM: None}[tag]
    values = decode_adpcm(codes).ravel() if table is None else codes
    out = bytearray(wav_head(2 * (len(values) * target // rate), PCM, target, 16))
    for part in resampled(values, rate, target, table):
        out += part.tobytes()
    return bytes(out)


def _adpcm_levels(payloads: list[bytes]) -> list[int]:
    """Each payload's mean block level as ADPCM. Blocks of many payloads are decoded together, SLICE bytes at a time."""
    out, i = [], 0
    while i < len(payloads):
        j, size = i + 1, len(payloads[i])
        while j < len(payloads) and size + len(payloads[j]) <= SLICE:
            size += len(payloads[j])
            j += 1
        codes = np.frombuffer(b"".join(payloads[i:j]), np.uint8)
        loud = []
        for first in range(0, len(codes), SLICE):
            blocks = decode_adpcm(codes[first : first + SLICE])
            loud.append(np.sqrt(_squares(blocks) // blocks.shape[1]).astype(np.int64))
        ends = np.cumsum([len(p) // UNIT for p in payloads[i:j]])
        total = np.r_[0, np.cumsum(np.concatenate(loud))][np.r_[0, ends]]
        out += (np.diff(total) // np.diff(np.r_[0, ends])).tolist()
        i = j
    return out


def features_of(files: list[bytes], pcms: list[bytes] | None = None) -> list[dict]:
    """The features of stored mu-law files, from the bytes in their data chunks; those of the resampled samples from the PCM files, if given."""
    payloads = [read_wav(f)[2] for f in files]
    return [_features(*x) for x in zip(files, payloads, _adpcm_levels(payloads), pcms or [None] * len(files))]


def _wide(codes: np.ndarray, pcm: bytes | None) -> tuple[int, int]:
    """Number and CRC of the resampled samples."""
    if pcm is not None:
        tag, rate, data = read_wav(pcm)
        if (tag, rate) != (PCM, TARGET_RATE):
            raise ValueError("not resampled PCM")
        return len(data) // 2, zlib.crc32(data)
    wide, crc = 0, 0
    for part in resampled(codes, decode=MULAW_TABLE):
        wide, crc = wide + len(part), zlib.crc32(part, crc)
    return wide, crc


def _features(stored: bytes, back: bytes, adpcm: int, pcm: bytes | None) -> dict:
    codes = np.frombuffer(back, np.uint8)
    mulaw = alaw = crossings = 0
    before = None
    for first in range(0, len(codes), SLICE):
        part = codes[first : first + SLICE]
        samples = MULAW_TABLE[part]
        mulaw += int(_squares(samples))
        alaw += int(_squares(ALAW_TABLE[part]))
        down = np.signbit(samples)
        crossings += int(np.count_nonzero(down[1:] != down[:-1])) + (before is not None and bool(before != down[0]))
        before = down[-1]
    n, (wide, crc) = len(codes), _wide(codes, pcm)
    return {
        "payload_bytes": n, "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-32:]),
        "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(),
        "feature": f"mulaw_rms={_root(mulaw, n)};alaw_rms={_root(alaw, n)};adpcm_rms={adpcm};crossings={crossings};pcm16k_samples={wide};pcm16k_crc={crc}",
    }


FEATURES = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
STORED = {"n_bytes": pa.int64(), "media": pa.binary()}
NAMES = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def _rows(df: DataFrame, sources: list[str], keep: list[str], added: dict, make, ordered: bool = False) -> DataFrame:
    """``keep`` and what ``make`` returns for values of the columns ``sources``, at most ROWS of them at a time; if ``ordered``, a batch goes by its first source."""
    schema = df.select(*keep).schema
    for n, t in added.items():
        schema = schema.add(n, NAMES[t])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = pc.sort_indices(b.column(sources[0])) if ordered else None
            for first in range(0, b.num_rows, ROWS):
                part = b.take(order.slice(first, ROWS)) if ordered else b.slice(first, ROWS)
                made = make(*(part.column(c).to_pylist() for c in sources))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array([m[n] for m in made], t) for n, t in added.items())], names=[*keep, *added])

    return df.mapInArrow(run, schema)


def store(docs: DataFrame, keep: list[str], pcm: bool = False) -> DataFrame:
    """The columns ``keep`` with the text's ``n_bytes``, its mu-law WAV file ``media`` and, if asked, the resampled 16-bit file ``pcm``.

    The rows of an Arrow batch come in the order of their texts, so that copies and texts that begin alike are written side by side and pack better.
    """
    added = STORED | ({"pcm": pa.binary()} if pcm else {})
    source, keep = fresh(docs, "_media_text"), [c for c in keep if c.lower() not in added]

    def make(text: str) -> dict:
        n, payload = payload_of(text)
        media = wav(payload)
        return {"n_bytes": n, "media": media} | ({"pcm": to_pcm(media)} if pcm else {})

    return _rows(docs.select(*keep, text_or_empty().alias(source)), [source], keep, added, lambda texts: [make(t) for t in texts], ordered=True)


def described(stored: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``stored`` (all, without ``media``, if not given) and the features of the files in its columns ``media`` and, if it has one, ``pcm``."""
    keep = [c for c in keep or stored.columns if c.lower() not in FEATURES and c != "media"]
    sources = ["media"] + ["pcm"] * ("pcm" in stored.columns and stored.schema["pcm"].dataType.simpleString() == "binary")
    return _rows(stored.select(*dict.fromkeys([*keep, *sources])), sources, keep, FEATURES, features_of)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every document's audio: its mu-law and resampled PCM files, written to the shared folder as media columns and read back."""
    stored = materialize(store(table(spark, sf_dir, "documents"), ["doc_id"], pcm=True), **WRITING)
    return described(stored, ["doc_id", "n_bytes"]).select("doc_id", "n_bytes", *FEATURES)
