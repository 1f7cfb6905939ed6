"""Secret scans by dictionary-primed zstandard novelty.

Patterns find the base spans. The method then looks at every long token-like string in a sensitive
context and measures the bytes it adds to the compressed form of the text around it, under a
dictionary of the corpus' most frequent identifiers, counted over all documents, and of words of code.
Words, names and other text of the surroundings add little; random keys add nearly their own entropy,
and such strings are reported as kind `novel`.

Defined results: a null or empty text has no spans; a very long text is searched whole, a
long candidate measured whole; a document's result depends on its text and the dictionary alone,
so repeated rows and ties agree, and base spans depend on the text alone; identifiers of equal count
go by their code points; offsets are code points, ends exclusive; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagloom.llm.tokens import batches_of

KINDS = ("assign", "access", "hex", "novel")

# Fixed patterns.
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

#: the method's own candidates: token characters, at least so many, near a word of this list
TOKEN = np.zeros(256, bool)
TOKEN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="]] = True
LEAST_NOVEL = 20
CONTEXT_BYTES = 48
#: the surrounding code that a candidate is measured against, on either side
CODE_BYTES = 192
#: identifiers of the corpus in the dictionary, at most; letters alone, so that no key gets in
MOST_IDENTIFIERS = 2000
IDENTIFIER = re.compile(rb"(?<![A-Za-z0-9_])[A-Za-z](?:_?[A-Za-z]){2,31}(?![A-Za-z0-9_])")
#: different names that a task counts before it hands them on
HELD_NAMES = 1 << 17
SENSITIVE = re.compile(rb"(?i:key|secret|token|auth|bearer|credential|private|passw|pwd|access)")
#: what stands between parts of one secret: lines of a key, parts of a signed token
JOINT = re.compile(rb"\.|\r?\n[\x20\t]*")
#: added compressed bytes for each byte of a candidate; random base64 has 0.75, hex 0.5
NOVELTY = 0.55

#: what code and configuration around a secret is made of; its order is of no importance
IDENTIFIERS = (
    "import from return class def function const let var public private static void string int bool true false null none "
    "self this config settings environment variable default value name user username email host port database url path file "
    "password passwd secret token api_key apikey access_key secret_key private_key auth authorization bearer credential client_id client_secret "
    "session cookie header request response server service account region bucket endpoint version license copyright "
    "http https www com org net json yaml xml html utf-8 base64 sha256 md5 uuid example test localhost root admin "
    "begin end public certificate signature expires created updated description content length type object array list map "
    "the of and to in is that for it with as was on be at by this are or from an have not which you all can has more "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 ========== ---------- __________ "
).encode()


class Novelty:
    """Marginal compressed bytes under a primed dictionary."""

    def __init__(self, identifiers: bytes = b"") -> None:
        kind = zstandard.ZstdCompressionDict(identifiers + b" " + IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        kind.precompute_compress(level=3)
        self._z = zstandard.ZstdCompressor(dict_data=kind, write_content_size=False, write_checksum=False, write_dict_id=False)

    def added(self, before: bytes, candidate: bytes, after: bytes) -> float:
        """Added bytes for each byte of the candidate. Its own copies nearby don't count as surroundings."""
        around = (before + b"\n" + after).replace(candidate, b"")
        return (len(self._z.compress(around + b"\n" + candidate)) - len(self._z.compress(around))) / max(1, len(candidate))


def _long_runs(buf: np.ndarray, off: np.ndarray, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of table's bytes inside one text each, of `least` bytes or more."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = table[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    now, before = inside[1:], inside[:-1]
    starts, ends = np.flatnonzero(now & (~before | cut)), np.flatnonzero(before & (~now | cut))
    on = ends - starts >= least
    return starts[on], ends[on]


_HEX_TABLE = np.zeros(256, bool)
_HEX_TABLE[[*b"0123456789abcdef"]] = True
_HIGH = np.zeros(256, bool)
_HIGH[0x80:0xC0] = True

SCHEMA = "doc_id long, kinds array<string>, starts array<int>, ends array<int>, novelty array<double>"


def spans_of(text: bytes, hexes: list[tuple[int, int]], tokens: list[tuple[int, int]], novelty: Novelty) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, added bytes per byte) of a text, in bytes, by start and kind. hexes and
    tokens: its long runs of those characters."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(a, 2, b) for a, b in hexes]
    scored = [(a, k, b, novelty.added(text[max(0, a - CODE_BYTES) : a], text[a:b], text[b : b + CODE_BYTES])) for a, k, b in out]
    joined = 0  # end of the last candidate in a sensitive context
    for a, b in tokens:
        before = text[max(0, a - CONTEXT_BYTES) : a]
        # the name of an assignment may touch its value, so the candidate's own head counts too
        if SENSITIVE.search(before) or SENSITIVE.search(text[a : a + 16]) or (joined and JOINT.fullmatch(text, joined, a)):
            joined = b
            added = novelty.added(text[max(0, a - CODE_BYTES) : a], text[a:b], text[b : b + CODE_BYTES])
            if added >= NOVELTY:
                scored.append((a, 3, b, added))
    return sorted(scored)


def identifiers(docs: DataFrame, most: int = MOST_IDENTIFIERS) -> bytes:
    """The `most` most frequent identifiers of all documents, the most frequent last, where a match
    is cheapest. At most 64 bytes each reach the driver."""

    def handed_on(found):
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    def run(it):
        found: Counter = Counter()
        for _, texts in batches_of(it, 1 << 20):
            found.update(IDENTIFIER.findall(texts.joined(b"\n")))
            if len(found) > HELD_NAMES:
                yield handed_on(found)
                found = Counter()
        yield handed_on(found)

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # gathered by an executor, so that the driver does not get the first ones of every task
    top = counted.orderBy(F.desc("n"), "word").limit(most).agg(F.collect_list(F.struct("n", "word")).alias("top")).first()["top"]
    return " ".join(w for _, w in sorted(top, key=lambda x: (-x["n"], x["word"]), reverse=True)).encode()


def scan(docs: DataFrame, known: bytes | None = None) -> DataFrame:
    """Spans of every whole text: kinds, starts, ends (code points) and the novelty of each, under
    `known` identifiers or those of docs."""
    known = identifiers(docs) if known is None else known

    def run(it):
        novelty = Novelty(known)
        for batch, texts in batches_of(it):
            buf, off = texts.buf, texts.off
            data = buf.tobytes()
            hex_runs = list(zip(*(x.tolist() for x in _long_runs(buf, off, _HEX_TABLE, LEAST_HEX)), strict=True))
            token_runs = list(zip(*(x.tolist() for x in _long_runs(buf, off, TOKEN, LEAST_NOVEL)), strict=True))
            h = t = 0
            rows: list[tuple] = []
            at = off.tolist()
            for a, b in zip(at[:-1], at[1:], strict=True):
                hexes, tokens = [], []
                while h < len(hex_runs) and hex_runs[h][0] < b:
                    hexes.append((hex_runs[h][0] - a, hex_runs[h][1] - a))
                    h += 1
                while t < len(token_runs) and token_runs[t][0] < b:
                    tokens.append((token_runs[t][0] - a, token_runs[t][1] - a))
                    t += 1
                found = spans_of(data[a:b], hexes, tokens, novelty)
                if found:
                    # code points before a byte offset: bytes less continuation bytes
                    extra = np.concatenate([[0], np.cumsum(_HIGH[buf[a:b]])])
                    rows.append(([KINDS[k] for _, k, _, _ in found], [s - int(extra[s]) for s, *_ in found], [e - int(extra[e]) for _, _, e, _ in found], [x for *_, x in found]))
                else:
                    rows.append(([], [], [], []))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(list(c), pa.list_(k)) for c, k in zip(columns, kinds, strict=True)]],
                names=["doc_id", "kinds", "starts", "ends", "novelty"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    each = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda x: F.struct(x["kinds"].alias("kind"), F.concat_ws(":", x["kinds"], x["starts"], x["ends"]).alias("s")))
    base = F.filter("each", lambda x: x["kind"] != "novel")

    def count(kind: str):
        return F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")

    return found.withColumn("each", each).select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(F.array_join(F.transform(base, lambda x: x["s"]), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("each", lambda x: x["s"]), ",").alias("spans"),
        F.coalesce(F.array_max("novelty"), F.lit(0.0)).alias("novelty"),
    )


def plain_base(text: str | None) -> tuple[int, int, int, str]:
    """Brute force for tests, on code points."""
    text = text or ""
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    n = len(found)
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= LEAST_ACCESS]
    k = len(found) - n
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= LEAST_HEX]
    joined = ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(found))
    return n, k, len(found) - n - k, hashlib.sha256(joined.encode()).hexdigest()
