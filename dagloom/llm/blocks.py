"""Exchange of per-document keys in compact blocks.

Documents are dealt to blocks by ranges of doc_id (bounds from approximate percentiles over all
ids), and travel once, compressed. Each block sends the distinct 64-bit keys it holds, sorted and
delta-coded, split by their top bits into buckets; a bucket answers every block in the order of
its keys; the block then meets its answers. A key that a third of all rows hold costs one entry
a block, so nothing is ever gathered by key, and any lost task is recomputed from its inputs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagloom.llm.tokens import Texts

#: stands for a null doc_id, which counts as the largest
NULL_ID = np.iinfo(np.int64).max
PACKED = "block int, ids binary, lens binary, z binary"


class Layout:
    """Bounds of the blocks and the number of bits that select a bucket."""

    def __init__(self, bounds: list[int], bits: int):
        self.bounds, self.bits = bounds, bits


def plan_layout(docs: DataFrame, block_bytes: int = 8 << 20, keys_per_bucket: int = 1 << 20) -> Layout:
    """Size blocks and buckets from the whole input's bytes; the driver holds the bounds only."""
    n, size = docs.agg(F.count("doc_id"), F.sum(F.octet_length("text"))).first()
    size = size or 0
    blocks = max(1, -(-size // block_bytes))
    bounds: list[int] = []
    if blocks > 1 and n:
        ranks = [k / blocks for k in range(1, blocks)]
        bounds = docs.agg(F.percentile_approx("doc_id", ranks, max(10_000, 20 * blocks))).first()[0]
        bounds = sorted(set(bounds))
    bits = max(1, int(np.ceil(np.log2(max(1, size / 6 / keys_per_bucket)))))
    return Layout(bounds, bits)


def pack(docs: DataFrame, layout: Layout) -> DataFrame:
    """Rows of PACKED: the ids and texts that one Arrow batch holds of one block."""
    bounds = np.array(layout.bounds, np.int64)

    def run(it):
        z = zstandard.ZstdCompressor(level=1)
        for batch in it:
            ids = batch.column(0).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = Texts.of_arrow(batch.column(1))
            data, off = texts.buf.tobytes(), texts.off
            block = np.searchsorted(bounds, ids, "right")
            order = np.argsort(block, kind="stable")
            lens = np.diff(off)
            cuts = np.flatnonzero(np.diff(block[order], prepend=-1, append=-1))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                of = order[a:b]
                joined = b"".join([data[off[i] : off[i + 1]] for i in of.tolist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(block[of[0]])], pa.int32()),
                        pa.array([ids[of].tobytes()], pa.binary()),
                        pa.array([lens[of].tobytes()], pa.binary()),
                        pa.array([z.compress(joined)], pa.binary()),
                    ],
                    names=["block", "ids", "lens", "z"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PACKED)


def unpack(table: pa.Table) -> tuple[np.ndarray, Texts]:
    """All documents of a block by ascending id; ties keep the order of their texts."""
    un = zstandard.ZstdDecompressor()
    ids, texts = [], []
    for k, l, z in zip(table["ids"].to_pylist(), table["lens"].to_pylist(), table["z"].to_pylist(), strict=True):
        ids.append(np.frombuffer(k, np.int64))
        lens = np.frombuffer(l, np.int64)
        data = un.decompress(z) if lens.sum() else b""
        at = np.concatenate([[0], np.cumsum(lens)]).tolist()
        texts += [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    all_ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
    order = sorted(range(len(texts)), key=lambda i: (all_ids[i], texts[i]))
    return all_ids[order], Texts.of_list([texts[i] for i in order])


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending distinct keys as the first key and the low byte planes of the differences."""
    d = np.diff(keys)
    planes = (int(d.max()).bit_length() + 7) // 8 if len(d) else 0
    low = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :planes].T)
    return bytes([planes]) + keys[:1].tobytes() + low.tobytes()


def unpack_keys(blob: bytes, n: int) -> np.ndarray:
    planes = blob[0]
    d = np.zeros((n, 8), np.uint8)
    if n > 1 and planes:
        d[1:, :planes] = np.frombuffer(blob, np.uint8, offset=9).reshape(planes, n - 1).T
    d = d.reshape(-1).view(np.uint64)
    d[0] = np.frombuffer(blob, np.uint64, 1, 1)[0]
    return np.cumsum(d, dtype=np.uint64)


def split(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of ascending keys with the same top bits."""
    top = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(top, prepend=-1, append=-1))
    return [(int(top[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def key_rows(block: int, keys: np.ndarray, bits: int, values: np.ndarray | None = None) -> pa.Table:
    """What a block sends: its distinct ascending keys, with a value each if there are any."""
    runs = split(keys, bits)
    return pa.table(
        {
            "block": pa.array([block] * len(runs), pa.int32()),
            "bucket": pa.array([r[0] for r in runs], pa.int32()),
            "n": pa.array([b - a for _, a, b in runs], pa.int32()),
            "keys": pa.array([pack_keys(keys[a:b]) for _, a, b in runs], pa.binary()),
            "vals": pa.array([b"" if values is None else values[a:b].tobytes() for _, a, b in runs], pa.binary()),
        }
    )


KEYS = "block int, bucket int, n int, keys binary, vals binary"
ANSWERS = "block int, bucket int, answer binary"


def answer_rows(table: pa.Table, answer: Callable[[np.ndarray, np.ndarray, list[bytes]], np.ndarray]) -> pa.Table:
    """answer(keys, place, vals): keys of all blocks by ascending block, place[i] the block's
    position; it returns one value for each, and each block gets back those of its own keys."""
    table = table.sort_by("block")
    ns = table["n"].to_numpy()
    keys = np.concatenate([unpack_keys(b, n) for b, n in zip(table["keys"].to_pylist(), ns.tolist(), strict=True)])
    out = answer(keys, np.repeat(np.arange(len(ns)), ns), table["vals"].to_pylist())
    at = np.concatenate([[0], np.cumsum(ns)])
    own = [out[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.table(
        {
            "block": table["block"],
            "bucket": table["bucket"],
            "answer": pa.array([np.packbits(x).tobytes() if x.dtype == bool else x.tobytes() for x in own], pa.binary()),
        }
    )


def answers_of(keys: np.ndarray, bits: int, answers: pa.Table, kind: type) -> np.ndarray:
    """The answers to a block's distinct ascending keys, in their order."""
    got = dict(zip(answers["bucket"].to_pylist(), answers["answer"].to_pylist(), strict=True))
    out = np.zeros(len(keys), kind)
    for bucket, a, b in split(keys, bits):
        raw = np.frombuffer(got[bucket], np.uint8 if kind is bool else kind)
        out[a:b] = np.unpackbits(raw, count=b - a).astype(bool) if kind is bool else raw
    return out
