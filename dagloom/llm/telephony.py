"""Telephony audio columns: mu-law and A-law by lookup tables, IMA ADPCM by numpy across blocks,
and linear PCM resampled to twice the rate.

`encode` stores bytes as a WAV file of one of three codecs without changing them; `decode` parses
stored WAV files, expands them to 16-bit PCM and resamples. Everything is integer arithmetic, so
results are the same on any machine.

Defined results: a null or empty payload becomes one unit of silence bytes (32); a stored file
that is null or no WAV of these codecs gives null features and no PCM. A very long payload is one
long file, with as many blocks as it needs; repeated rows and equal payloads give equal files and
features, and nothing is ranked, so there are no ties. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagloom.llm.tokens import Texts

UNIT = 192
RATE = 8000
MULAW, ALAW, ADPCM = 7, 6, 17
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "adpcm"}


def _mulaw_table() -> np.ndarray:
    """G.711: inverted sign, 3-bit exponent, 4-bit mantissa; bias 132."""
    code = ~np.arange(256) & 255
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    """G.711: even bits inverted, 3-bit exponent, 4-bit mantissa."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, code & 15
    size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW_TO_PCM, ALAW_TO_PCM = _mulaw_table(), _alaw_table()

# Fixed values of the IMA ADPCM standard.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
        7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """blocks (n, size) bytes of mono IMA ADPCM to (n, 1 + 2 * (size - 4)) samples. The loop is
    over the nibbles of a block; each step works on all blocks at once. A header's step index
    beyond the table counts as the table's last."""
    n, size = blocks.shape
    head = blocks[:, :4].astype(np.int32)
    value = ((head[:, 0] | head[:, 1] << 8) ^ 0x8000) - 0x8000
    index = np.minimum(head[:, 2], len(STEPS) - 1)
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    out[0] = value
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(2 * (size - 4)):
        nibble = (data[k >> 1] >> 4 if k & 1 else data[k >> 1] & 15).astype(np.int32)
        # delta and next step index of every (index, nibble) are in one table each
        at = (index << 4) | nibble
        value = value + _DELTA[at]
        np.clip(value, -32768, 32767, out=value)
        index = _NEXT[at]
        out[k + 1] = value
    return out.T


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    step, nibble = STEPS[:, None], np.arange(16)[None, :]
    delta = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    index = np.arange(len(STEPS), dtype=np.int32)[:, None] + INDEX_STEP[nibble & 7]
    return np.where(nibble & 8, -delta, delta).astype(np.int32).reshape(-1), np.clip(index, 0, len(STEPS) - 1).astype(np.int32).reshape(-1)


_DELTA, _NEXT = _adpcm_tables()


def resample_2x(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: the samples, and between them a 6-tap half-band interpolation
    (3, -25, 150, 150, -25, 3) / 256; beyond its ends a signal keeps its end values."""
    if not len(pcm):
        return pcm.astype(np.int16)
    x = np.concatenate([np.repeat(pcm[:1], 2), pcm, np.repeat(pcm[-1:], 3)]).astype(np.int32)
    n = len(pcm)
    between = 150 * (x[2 : n + 2] + x[3 : n + 3]) - 25 * (x[1 : n + 1] + x[4 : n + 4]) + 3 * (x[:n] + x[5 : n + 5])
    out = np.empty(2 * n, np.int16)
    out[::2] = pcm
    out[1::2] = np.clip((between + 128) >> 8, -32768, 32767)
    return out


def wav(codec: int, payload: bytes) -> bytes:
    """A WAV file of one channel at RATE whose data chunk is the payload."""
    if codec == ADPCM:
        samples = 1 + 2 * (UNIT - 4)
        fmt = struct.pack("<HHIIHHHH", codec, 1, RATE, RATE * UNIT // samples, UNIT, 4, 2, samples)
    else:
        fmt = struct.pack("<HHIIHHH", codec, 1, RATE, RATE, 1, 8, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(stored: bytes) -> tuple[int, int, bytes] | None:
    """(codec, block size, data) or None."""
    if stored is None or len(stored) < 12 or stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        return None
    at, codec, block = 12, None, 0
    while at + 8 <= len(stored):
        kind, size = stored[at : at + 4], int.from_bytes(stored[at + 4 : at + 8], "little")
        if kind == b"fmt " and size >= 16:
            codec, block = int.from_bytes(stored[at + 8 : at + 10], "little"), int.from_bytes(stored[at + 20 : at + 22], "little")
        if kind == b"data":
            return (codec, block, stored[at + 8 : at + 8 + size]) if codec in NAMES else None
        at += 8 + size + (size & 1)
    return None


def padded(text: bytes) -> bytes:
    return text + b" " * ((-len(text)) % UNIT or (0 if text else UNIT))


def codec_of(payload: bytes) -> int:
    """A payload alone decides its codec, so equal payloads are stored equally."""
    return (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]


ENCODED = "doc_id long, n_bytes long, media binary"


def encode(docs: DataFrame) -> DataFrame:
    """Store each whole text's bytes, padded to whole units, as a WAV file."""

    def run(it):
        for batch in it:
            texts = Texts.of_arrow(batch.column(1))
            for i, j in texts.pieces(1 << 24):
                part = texts.part(i, j)
                payloads = [padded(part.bytes_of(k)) for k in range(len(part))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(np.diff(part.off), pa.int64()),
                        pa.array([wav(codec_of(p), p) for p in payloads], pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "media"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)


def expand(parsed: list[tuple[int, int, bytes] | None]) -> list[np.ndarray | None]:
    """16-bit PCM of each parsed file; ADPCM blocks of one size are decoded together. A shorter
    last block with a whole header is a block of its own size."""
    out: list[np.ndarray | None] = [None] * len(parsed)
    by_size: dict[int, list[tuple[int, bytes]]] = {}
    for i, p in enumerate(parsed):
        if p is None:
            continue
        codec, block, data = p
        if codec == ADPCM:
            if block > 4:
                whole = len(data) // block * block
                by_size.setdefault(block, []).append((i, data[:whole]))
                if len(data) - whole >= 4:
                    by_size.setdefault(len(data) - whole, []).append((i, data[whole:]))
        else:
            out[i] = (MULAW_TO_PCM if codec == MULAW else ALAW_TO_PCM)[np.frombuffer(data, np.uint8)]
    found: dict[int, list[tuple[int, np.ndarray]]] = {}
    for size, of in by_size.items():
        pcm = decode_adpcm(np.frombuffer(b"".join(data for _, data in of), np.uint8).reshape(-1, size))
        at = np.concatenate([[0], np.cumsum([len(data) // size for _, data in of])]).tolist()
        for (i, _), a, b in zip(of, at[:-1], at[1:], strict=True):
            found.setdefault(i, []).append((size, pcm[a:b].reshape(-1)))
    for i, parts in found.items():
        # a file's last block is smaller than its others
        out[i] = np.concatenate([x for _, x in sorted(parts, key=lambda x: -x[0])])
    return out


DECODED = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, codec string, n_samples long, rms double, peak int, crossings long, pcm_sha256 string"
)


def decode(stored: DataFrame, with_pcm: bool = True) -> DataFrame:
    """Features of stored files (doc_id, n_bytes, media), read from the stored bytes; with_pcm
    adds the resampled 16-bit PCM itself as column pcm, to be written wherever it should go."""

    def run(it):
        for batch in it:
            for start in range(0, max(batch.num_rows, 1), 256):
                part = batch.slice(start, 256)
                files = part.column(2).to_pylist()
                parsed = [parse_wav(x) for x in files]
                pcms = expand(parsed)
                rows = []
                for file, p, pcm in zip(files, parsed, pcms, strict=True):
                    data = p[2] if p else None
                    row = (
                        [len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(file), hashlib.sha256(file).hexdigest(), NAMES[p[0]]]
                        if p
                        else [None, None, None, None if file is None else len(file), None if file is None else hashlib.sha256(file).hexdigest(), None]
                    )
                    if pcm is None or not len(pcm):
                        rows.append([*row, None, None, None, None, None] + [None] * with_pcm)
                        continue
                    wide = pcm.astype(np.float64)  # sums of squares of 16-bit samples are exact up to 2**53
                    again = resample_2x(pcm).tobytes()
                    signs = pcm < 0
                    rows.append(
                        [*row, len(pcm), float(np.sqrt(np.dot(wide, wide) / len(pcm))), int(max(int(pcm.max()), -int(pcm.min()))), int(np.count_nonzero(signs[1:] != signs[:-1])), hashlib.sha256(again).hexdigest()]
                        + [again] * with_pcm
                    )
                columns = list(zip(*rows, strict=True)) if rows else [[]] * (11 + with_pcm)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.string()] + [pa.binary()] * with_pcm
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]],
                    names=[x.split(" ")[0] for x in DECODED.split(", ")] + ["pcm"] * with_pcm,
                )

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, DECODED + ", pcm binary" * with_pcm)


def op1_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resampled PCM is computed in full; the query keeps its digest."""
    media = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    feature = F.concat_ws(
        ";",
        F.col("codec"),
        F.concat(F.lit("samples="), F.col("n_samples")),
        F.concat(F.lit("rms="), F.format_string("%.6f", "rms")),
        F.concat(F.lit("peak="), F.col("peak")),
        F.concat(F.lit("crossings="), F.col("crossings")),
        F.concat(F.lit("pcm16k="), F.col("pcm_sha256")),
    )
    return decode(media, with_pcm=False).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature")
    )
